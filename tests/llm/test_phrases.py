"""Near copies by MinHash, periodic runs and collocations against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalore.llm import collocations, minhash, runs

from .conftest import ODD


def shingle_set(text, width=4):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return frozenset(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def near(rows):
    """(doc_id, n_shingles, component_id) by comparing all sets."""
    sets = [shingle_set(text) for _, text in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    above = {s: s for s in distinct}

    def top(s):
        while above[s] != s:
            s = above[s]
        return s

    for i, one in enumerate(distinct):
        for two in distinct[:i]:
            shared = len(one & two)
            if 100 * shared >= 80 * (len(one) + len(two) - shared):
                above[top(one)] = top(two)
    ids = {}
    for (doc_id, _), own in zip(rows, sets):
        if own and doc_id is not None:
            ids[top(own)] = min(doc_id, ids.get(top(own), doc_id))
    return sorted(((d, len(s), ids.get(top(s)) if s else d) for (d, _), s in zip(rows, sets)), key=repr)


def check_near(docs, rows, **kwargs):
    got = minhash.near_copies(docs, **kwargs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_of_odd_rows(clashing):
    check_near(clashing, ODD)


@pytest.mark.parametrize("block", [minhash.BLOCK, 5])
def test_minhash_of_a_family(table, block):
    """Copies that link in chains, two families that share half of their words, and lone texts."""
    random.seed(7)
    rows, halves = [], [[f"{side}{i}" for i in range(100)] for side in "abc"]
    for number in range(160):
        words = halves[0] + halves[1 + number % 2]
        for at in random.sample(range(200), random.randrange(0, 12)):
            words[at] = f"x{random.randrange(10**6)}"
        rows.append((number, " ".join(words)))
    rows += [(500 + i, f"short text {i % 3}") for i in range(9)] + [(None, rows[0][1]), (3, "another text of row three")]
    check_near(table(rows), rows, block=block)


def test_estimate_is_corrected_for_accidents():
    random.seed(5)
    one = np.unique(np.array([random.getrandbits(64) for _ in range(900)], np.uint64))
    for share in (0.0, 0.5, 0.8):
        same = int(len(one) * 2 * share / (1 + share))
        other = np.array([random.getrandbits(64) for _ in range(len(one) - same)], np.uint64)
        two = np.unique(np.concatenate([one[:same], other]))
        planes = [minhash.planes(minhash.minima(s)).reshape(minhash.BITS, -1) for s in (one, two)]
        differ = np.bitwise_count(np.bitwise_or.reduce(planes[0] ^ planes[1], axis=0).view(np.uint64)).sum()
        accident = 2.0**-minhash.BITS
        estimate = (1 - differ / minhash.PERMUTATIONS - accident) / (1 - accident)
        assert abs(estimate - share) < 0.15


def test_members_of_a_group_meet_by_blocks():
    random.seed(1)
    sets = [np.unique([random.randrange(40) for _ in range(30)]) for _ in range(40)]
    rows = np.array([[0, 1, i % 2, i, i % 7, len(s)] for i, s in enumerate(sets)], np.int64)
    left, right = minhash.sides(rows)
    shared = minhash.shared_counts(sets, left, right)
    assert shared.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    linked = {
        (i, j) for i in range(0, 40, 2) for j in range(1, 40, 2) if i % 7 != j % 7
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))
    }
    forest = minhash.links_of_group(rows[:, :5], sets, 50)
    assert set(forest) <= linked and len(forest) < len(rows)
    above = {i: i for i in range(40)}
    for i, j in forest:
        old, new = above[i], above[j]
        above = {k: new if v == old else v for k, v in above.items()}
    assert all(above[i] == above[j] for i, j in linked)


def all_runs(words):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        at = 0
        while at + period < len(words):
            to = at
            while to + period < len(words) and words[to] == words[to + period]:
                to += 1
            if to - at + period >= max(24, 3 * period):
                found.setdefault((at, to - at + period), period)
            at = max(to, at) + 1
    return sorted([(s, n, p) for (s, n), p in found.items()], key=lambda r: (r[0], r[2]))


def run_columns(words):
    found = all_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs_against_brute_force():
    random.seed(3)
    for _ in range(150):
        texts = []
        for _ in range(random.randrange(1, 5)):
            words = [b"%d" % random.randrange(random.choice([1, 2, 3, 60])) for _ in range(random.randrange(0, 200))]
            for _ in range(random.randrange(0, 4) if words else 0):
                at, period = random.randrange(len(words)), random.randrange(1, 40)
                block = words[at : at + period]
                words[at : at + period] = (block * 30)[: random.randrange(0, 150)]
            texts.append(words)
        assert runs.summaries(texts) == [run_columns(w) for w in texts]


def test_extensions_against_brute_force():
    random.seed(4)
    for size, kinds in ((1, 1), (40, 1), (300, 2), (300, 3)):
        words = np.array([random.randrange(kinds) for _ in range(size)], np.int64)
        pairs = [(i, j) for i in range(size + 1) for j in range(size + 1) if i != j][::7]
        if not pairs:
            continue
        left, right = map(np.array, zip(*pairs))
        for (i, j), got in zip(pairs, runs.Extensions(words).of(left, right).tolist()):
            want = 0
            while max(i, j) + want < size and words[i + want] == words[j + want]:
                want += 1
            assert got == want


def test_runs_of_fibonacci_words():
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 1000:
        one, two = two, two + one
    assert runs.summaries([two]) == [run_columns(two)]


def test_cover_meets_every_pair_of_places():
    assert (runs.STEPS >= 0).all() and (runs.STEPS < runs.SPAN).all()


def by_hand(words, doc_id):
    number = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if number % 10 or not words:
        return words
    rest, count = number // 10, len(words)
    a = rest % count
    p = 1 + (count - a) // (3 + rest % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_odd_rows(clashing, table):
    many = [(i, " ".join(f"w{j % 90}" for j in range(i % 130))) for i in range(150)]
    for docs, rows in ((clashing, [r for r in ODD if len(r[1] or "") < 10_000]), (table(many), many)):
        want = [(d, *run_columns(by_hand((t or "").encode().split(), d))) for d, t in rows]
        got = [tuple(r) for r in runs.collapsed_runs(docs, runs.planted).collect()]
        got = [r for r in got if r[0] not in (8, 9)] if docs is clashing else got
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_very_long_runs_take_useful_time():
    assert runs.summaries([[b"word"] * 300_000])[0][:5] == (1, 0, 300_000, 1, 300_000_000)


def phrases_of(rows, least, top):
    """Collocations of (lang, text) rows by plain counting."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().lower()
        for end in b",;:!?\n\x0b\x0c\r":
            data = data.replace(bytes([end]), b".")
        for piece in data.split(b"."):
            words = piece.replace(b"\t", b" ").decode().split(" ")
            words = [w for w in words if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    often = {p: a for p, a in counts.items() if a >= least}
    found = []
    for (lang, *words), a in often.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[(lang, *words[:k])], often[(lang, *words[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        inside = any(
            p[0] == lang and len(p) > len(words) + 1 and b >= a
            and any(list(p[i : i + len(words)]) == words for i in range(1, len(p) - len(words) + 1))
            for p, b in often.items()
        )
        if not inside:
            score, _, left, right = min(cuts)
            found.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:top]
        ranked += [(lang, i + 1, *f[1:]) for i, f in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("hot", [collocations.HOT_POINTERS, 2])
def test_collocations_against_plain_counts(table, hot):
    random.seed(9)
    rows = []
    for number in range(300):
        words = [random.choice(["a", "b", "c", "d", "É", "Ab", "z\x00", "日本"]) for _ in range(random.randrange(0, 60))]
        marks = [random.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!,"]) for _ in words]
        rows.append((number, "".join(map("".join, zip(words, marks))), random.choice(["en", "fr", None, ""]), "s", 1))
    rows += [(400 + i, "the very same passage is here, twice: the very same passage", "de", "s", 1) for i in range(30)]
    rows += [(None, None, "en", None, None), (1, "", None, None, None)]
    got = collocations.collocations(table(rows), least=20, top=25, hot_pointers=hot).collect()
    want = phrases_of([(r[2], r[1]) for r in rows], 20, 25)
    assert sorted(tuple(r) for r in got) == want and len(want) > 60


def test_collocations_of_odd_rows(clashing):
    got = collocations.collocations(clashing).collect()
    assert sorted(tuple(r) for r in got) == phrases_of([("en", t) for _, t in ODD], 100, 2000)


def test_slots_shared_by_many_words_lose_nothing(table):
    rows = [(i, f"one two w{i} three four five one two", "en", "s", 1) for i in range(120)]
    got = collocations.collocations(table(rows), slots=64).collect()
    assert sorted(tuple(r) for r in got) == phrases_of([(r[2], r[1]) for r in rows], 100, 2000)


def test_equal_pointers_of_many_partitions_move_as_few_rows(table):
    """A row of each pointer of a lang for a task or two, not one for every partition and lang."""
    rows = [(i, "one two three four", ("en", "fr", None)[i % 3], "s", 1) for i in range(240)]
    all_frequent = np.full(8, 255, np.uint8)
    got = collocations.weighted_pointers(table(rows).repartition(24), all_frequent, 5).collect()
    times = Counter()
    for r in got:
        times[r.lang, r.phrase, r.words] += r.times
    words = "one two three four".split()
    own = {("", 0): 320} | {(w, 1): 80 for w in words} | {(" ".join(words[i:]), 4 - i): 80 for i in range(3)}
    assert times == {(lang, *key): n for lang in ("en", "fr", "und") for key, n in own.items()}
    assert len(got) <= 2 * len(times)


def test_copies_of_one_lang_are_dealt_to_many_tasks(spark, table):
    docs = table([(i, "the very same text", "en", "s", 1) for i in range(1600)]).repartition(32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = collocations.dealt_by_lang(docs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 1600 and max(r["count"] for r in sizes) <= 800


def test_small_inputs_are_not_dealt_to_all_shuffle_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        parts = collocations.dealt_by_lang(docs).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == collocations.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert collocations.dealt_by_lang(docs).rdd.getNumPartitions() == min(parts, int(before))


def test_rows_are_added_up_and_sent_on():
    random.seed(6)
    for kinds in (5, 300):
        rows = [("en", f"p{random.randrange(kinds)}", 2, random.randrange(1, 9)) for _ in range(900)]
        names = ["lang", "phrase", "words", "times"]
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 30])], names=names) for at in range(0, 900, 30)]
        got = [tuple(r.values()) for part in collocations.summed(iter(parts), 100) for r in part.to_pylist()]
        want, sums = Counter(), Counter()
        for listed, counts in ((rows, want), (got, sums)):
            for lang, phrase, words, times in listed:
                counts[lang, phrase, words] += times
        assert sums == want and len(got) < (6 if kinds == 5 else 900)
    assert list(collocations.summed(iter([]), 100)) == []


def test_quicksort_counts_equal_parts():
    random.seed(2)
    keys = np.array([[random.randrange(3) for _ in range(3)] for _ in range(500)])
    keys[::5, 2] = -1
    times = np.array([random.randrange(1, 4) for _ in range(500)])
    counts = Counter()
    for row, weight in zip(keys.tolist(), times.tolist()):
        for depth in range(3):
            if row[depth] >= 0:
                counts[tuple(row[: depth + 1])] += weight
    got = {tuple(keys[at, : depth + 1].tolist()): w for at, depth, w in collocations.frequent_prefixes(keys, times, 60)}
    assert got == {p: w for p, w in counts.items() if w >= 60}
