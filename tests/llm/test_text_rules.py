import random

import numpy as np
import pandas as pd
import pytest

from catalore.llm import chat, mixing, quality, toxicity
from catalore.llm.common import documents

from .conftest import ODD


def test_quality_of_odd_rows(odd):
    rows = {r.doc_id: r for r in quality.verdicts(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[8].n_words == 40_000 and rows[8].n_repeat_words == 40_000 and rows[8].base_failed
    assert rows[10].n_dup_lines == 1 and rows[10].n_symbols == 3 and rows[10].n_removed_lines == 1
    assert rows[7].word_chars == 6


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_repeated_words_by_brute_force():
    random.seed(1)
    for _ in range(300):
        words = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randrange(25))]
        assert quality.repeated_words(words) == repeated(words)


@pytest.mark.parametrize(
    "line, wrong",
    [
        ("This is a sentence.", False), ("What a day!", False), ("HOME | ABOUT | NEWS | LOGIN.", True),
        ("WIN!! NOW!! FREE!! CASH!!", True), ("no mark in this line", True), ("a# b## c### d#.", True),
        ("All rights reserved.", True), ("Prices rose by 5% in May.", False),
    ],
)
def test_line_rules(line, wrong):
    data = line.encode()
    assert quality.fails(data, len(data.split())) is wrong


def test_rejected_where_too_much_is_lost(table):
    good = "This{0} is{0} a{0} plain{0} sentence{0} with{0} some{0} words{0} in{0} it{0}.\n"
    menu = "home | news | item{} | more\n"
    rows = [
        (1, "".join(good.format(i) for i in range(20))),
        (2, "".join(good.format(i) for i in range(5)) + "".join(menu.format(i) for i in range(30))),
    ]
    docs = table(rows)
    assert {r.doc_id: r.kept for r in quality.verdicts(docs).collect()} == {1: True, 2: False}
    left = quality.cleaned(docs).collect()
    assert [(r.doc_id, "|" in r.clean_text) for r in left] == [(1, False)]


# --- mixing --------------------------------------------------------------------------


def rake(cells, temper, keep):
    """Probabilities of cells by plain loops."""
    weight = cells["tokens"] / cells["tokens"].sum()
    wanted = {}
    for name in mixing.DIMENSIONS:
        sums = cells.groupby(name)["tokens"].sum() ** temper
        wanted[name] = sums / sums.sum()
    for _ in range(300):
        for name in mixing.DIMENSIONS:
            sums = weight.groupby(cells[name]).transform("sum")
            weight = weight * cells[name].map(wanted[name]) / sums
    ratio, capped = weight / cells["tokens"], np.zeros(len(cells), bool)
    while True:
        scale = (keep * cells["tokens"].sum() - cells["tokens"][capped].sum()) / weight[~capped].sum()
        if ((ratio * scale >= 1) == capped).all():
            return np.minimum(1, ratio * scale), weight, wanted
        capped = ratio * scale >= 1


def test_mixing_against_plain_raking(spark, sf):
    got = mixing.mixture(documents(spark, sf)).toPandas()
    cells = got.groupby(list(mixing.DIMENSIONS), as_index=False)["tokens"].sum()
    chance, weight, wanted = rake(cells, mixing.TEMPER, mixing.KEEP)
    for name in mixing.DIMENSIONS:
        assert np.allclose(weight.groupby(cells[name]).sum(), wanted[name].sort_index(), atol=1e-9)
    known = {tuple(c): p for c, p in zip(cells[list(mixing.DIMENSIONS)].values, chance)}
    want = [known[tuple(c)] for c in got[list(mixing.DIMENSIONS)].values]
    assert np.allclose(got["probability"], want, atol=2e-6)


def test_given_targets_are_met(spark, sf):
    docs = documents(spark, sf)
    target = spark.createDataFrame([("en", 1.0), ("de", 1.0), ("fr", 2.0), ("xx", 5.0)], "value string, share double")
    narrow = mixing.weighed(docs)
    cells = mixing.cut_lineage(narrow.groupBy(*mixing.DIMENSIONS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens"))
    raked = mixing.raked(mixing.with_targets(cells, {"lang": target}, 0.7)).toPandas()
    sums = raked.groupby("lang")["weight"].sum()
    assert sums.get("es", 0.0) == 0
    # The least-fitted dimension is off by little even where targets cannot all be met.
    assert sums["fr"] == pytest.approx(0.5, abs=0.02) and sums["en"] == pytest.approx(0.25, abs=0.02)


def test_contradicting_targets_are_told(spark, table):
    rows = [(i, "one two", "en" if i % 4 else "de", "a" if i % 4 else "b", 1) for i in range(400)]
    targets = {
        "source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"),
        "lang": spark.createDataFrame([("en", 0.2), ("de", 0.8)], "value string, share double"),
    }
    with pytest.raises(mixing.TargetsConflict, match="source by 0.7"):
        mixing.mixture(table(rows), targets=targets)
    targets["lang"] = spark.createDataFrame([("en", 4.0), ("en", 5.0), ("de", 1.0), ("xx", 7.0)], "value string, share double")
    found = {(r.dimension, r.value): r for r in mixing.shares(table(rows), targets=targets).collect()}
    assert found["lang", "en"].raked == pytest.approx(0.9) and found["source", "b"].raked == pytest.approx(0.1)


def test_contradicting_defaults_are_a_warning(table):
    # One source has a language of its own: a quarter as a source, more as a language.
    rows = [(i, "one two", "de" if i % 4 else "en", f"s{i % 4}", 1) for i in range(200)]
    with pytest.warns(UserWarning, match="contradict"):
        found = mixing.mixture(table(rows))
    assert found.count() == 200


def test_shares_of_the_sample(spark, sf):
    docs = documents(spark, sf)
    found = mixing.shares(docs).toPandas()
    got = mixing.mixture(docs).toPandas()
    got["weight"] = got["tokens"] * got["probability"]
    for name in mixing.DIMENSIONS:
        mine = found[found["dimension"] == name].set_index("value").sort_index()
        assert np.allclose(mine["target"], mine["raked"], atol=1e-8)
        want = got.groupby(name)["weight"].sum() / got["weight"].sum()
        assert np.allclose(mine["expected"], want.sort_index(), atol=1e-5)


def test_mixed_keeps_whole_rows(clashing):
    kept = mixing.mixed(clashing)
    assert kept.schema.names == clashing.schema.names
    chosen = {r.doc_id for r in mixing.mixture(clashing).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == chosen


def test_share_of_tokens_kept(table):
    rows = [(i, "one two three " * (i % 5 + 1), "en", f"s{i % 3}", 1) for i in range(3000)]
    found = mixing.mixture(table(rows)).toPandas()
    kept = found.loc[found["kept"], "tokens"].sum() / found["tokens"].sum()
    assert kept == pytest.approx(mixing.KEEP, abs=0.03)


def test_null_source_is_a_value(table):
    rows = [(1, "a b", None, None, 1), (2, None, "en", "s", 1)]
    found = {r.doc_id: (r.source, r.lang, r.tokens) for r in mixing.mixture(table(rows)).collect()}
    assert found == {1: ("", "", 2), 2: ("s", "en", 1)}


# --- chat ----------------------------------------------------------------------------


def collapsed(rows):
    """Maximal conversations by comparing all of them; rows are (conv_id, turn, role, text)."""
    import hashlib

    talks = {}
    for conv, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        key = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())
        talks.setdefault(conv, []).append((key, role, text))
    talks = {c: [(r, t) for _, r, t in sorted(v)] for c, v in talks.items()}
    kept = {}
    for conv, talk in talks.items():
        if any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks.values()):
            continue
        same = [c for c, o in talks.items() if o == talk and c is not None]
        if conv == (min(same) if same else None):
            kept[conv] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talk)
    return kept


def rendered(spark, rows):
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = sorted(chat.rendered(log.repartition(6)).collect(), key=lambda r: r.part)
    found = {}
    for r in parts:
        found[r.conv_id] = found.get(r.conv_id, "") + r.text
    return found


def snapshots():
    random.seed(9)
    rows, conv = [], 0
    for _ in range(30):
        talk = [(random.choice(["user", "assistant"]), f"text {random.randrange(6)}") for _ in range(random.randrange(1, 9))]
        for length in random.sample(range(1, len(talk) + 1), min(3, len(talk))):
            rows += [(conv, i, r, t) for i, (r, t) in enumerate(talk[:length])]
            conv += 1
    return rows


def test_snapshots_collapse(spark):
    rows = snapshots()
    assert rendered(spark, rows) == collapsed(rows)


def test_one_conversation_over_many_pieces(spark):
    rows = [(5, i, "user", f"turn {i}") for i in range(1500)] + [(6, i, "user", f"turn {i}") for i in range(700)]
    rows += [(7, i, "user", f"turn {i}" if i < 900 else "other") for i in range(1000)]
    assert rendered(spark, rows) == collapsed(rows)


def test_odd_turns(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"),
        (2, None, "", ""), (2, 0, "user", "a"), (None, 1, "user", "z"), (None, 2, "user", "y"),
        (3, 9, "user", "a" * 100_000), (4, 3, "user", "a" * 100_000), (9, 1, "user", "z"),
    ]
    assert rendered(spark, rows) == collapsed(rows)
    assert rendered(spark, []) == {}


# --- toxicity ------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(documents(spark, sf), labels).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    assert held["score"].between(0, 1).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.02


def test_scores_use_no_labels_of_held_out_rows(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    changed = labels.selectExpr(
        "doc_id", "quality",
        "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic",
    )
    rows = [{r.doc_id: r.score for r in toxicity.toxicity(docs, l).collect()} for l in (labels, changed)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("toxic, score", [(None, 0.0), (0, 0.0), (1, 1.0)])
def test_without_both_classes(spark, odd, toxic, score):
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(13)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, labels).collect()} == {score}


def test_toxicity_of_odd_rows(spark, clashing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(13)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(clashing, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.without_toxic(clashing, labels)
    assert kept.schema.names == clashing.schema.names
    want = sorted(str(r.doc_id) for r in rows if not r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_model_is_kneser_ney():
    """Probabilities of the tables against the recursion, spelled out."""
    words = {"idiot": (0, 6), "idea": (5, 1), "the": (40, 30), "tree": (9, 2)}
    grams = {}
    for word, counts in words.items():
        padded = toxicity.LEAD + word + toxicity.END
        for at in range(len(word) + 1):
            gram = grams.setdefault(padded[at : at + toxicity.ORDER], [0, 0])
            gram[0] += counts[0]
            gram[1] += counts[1]
    names = sorted(grams)
    model = toxicity.build(names, np.array([grams[n] for n in names], float).T)
    levels = {toxicity.ORDER: [{g: c[k] for g, c in grams.items() if c[k]} for k in (0, 1)]}
    for order in range(toxicity.ORDER - 1, 0, -1):
        levels[order] = []
        for k in (0, 1):
            kinds = set(levels[order + 1][0]) | set(levels[order + 1][1]) if order <= toxicity.SHARED else levels[order + 1][k]
            counts = {}
            for gram in kinds:
                counts[gram[1:]] = counts.get(gram[1:], 0) + 1
            levels[order].append(counts)

    def chance(k, gram):
        found = 1 / model.characters
        for order in range(1, toxicity.ORDER + 1):
            counts, end = levels[order][k], gram[-order:]
            after = {g: c for g, c in counts.items() if g[:-1] == end[:-1]}
            if after:
                whole = sum(after.values())
                found = max(after.get(end, 0) - toxicity.DISCOUNT, 0) / whole + toxicity.DISCOUNT * len(after) / whole * found
        return found

    for word in ("idiot", "idiotic", "three", "zzz"):
        padded = toxicity.LEAD + word + toxicity.END
        parts = [padded[i : i + toxicity.ORDER] for i in range(len(word) + 1)]
        want = sum(np.log(chance(1, p)) - np.log(chance(0, p)) for p in parts)
        assert model.values([word])[0] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_rare_grams_go_first(spark):
    rows = [(f"g{i}", i, 0, 0, 0) for i in range(1, 200)]
    grams = spark.createDataFrame(rows, "gram string, ordinary_0 long, toxic_0 long, ordinary_1 long, toxic_1 long")
    left = toxicity.frequent(grams, 100).toPandas()
    assert 0 < len(left) <= 100 and left["ordinary_0"].min() == 128
    assert isinstance(left, pd.DataFrame)


def test_the_model_keeps_every_gram(spark, table):
    random.seed(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(random.choices(letters, k=9)) for _ in range(300)) for _ in range(450)]
    docs = table(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    learned = [r.text for r in docs.filter(toxicity.remainder() != toxicity.HELD_OUT).collect()]
    words = {w for text in learned for w in text.split()}
    padded = [toxicity.LEAD + w + toxicity.END for w in words]
    grams = {p[i : i + toxicity.ORDER] for p in padded for i in range(len(p) - toxicity.ORDER + 1)}
    assert len(grams) > 500_000
    assert len(toxicity.train(docs, labels).keys[-1]) == len(grams)
