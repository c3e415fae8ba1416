"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models give the characters of a word (an expression) by the characters before them,
up to ORDER at a time, so that unseen forms of a known expression still count. Counts of
the highest orders belong to a class; the lowest SHARED orders are continuation counts
of both classes together, so that what is rare in either class falls back to the same
numbers and says little. An expression's value is the difference of its log-likelihoods
in the two models. A document is described by its largest values, as they are and over
the lengths of their expressions, and by its length-normalised total; a logistic curve
turns the description into a score.

Counts come from all labelled rows but those with remainder HELD_OUT of crc32(doc_id)
mod 3. Words and then their n-grams are counted in parallel, in two folds: the curve is
fitted on documents described by the counts of the other fold, then the model takes both.
All n-grams are kept, however rare, so that the model grows with their distinct number
(the driver and every worker hold it); a caller who must bound it can give ``most_grams``.
The curve is fitted on CURVE_ROWS rows at most. Only texts are inputs of a score.

A document with repeated labels is toxic if one says so; null labels are ignored. A null
text counts as the empty text, whose values are zero; a null doc_id is not held out. Where a class has no labelled row
the share of toxic rows is every document's score (zero without labels). Repeated rows
get equal scores; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.llm.common import fresh, hashed_sample, map_texts, whole_text
from catalore.session import cut_lineage

ORDER, SHARED = 5, 4
DISCOUNT = 0.75
HELD_OUT = 1
#: Rows that the curve is fitted on at most, half of them for each class.
CURVE_ROWS = 4_000
THRESHOLD = 0.7
#: Words that one worker remembers, and longest ones it does.
REMEMBERED, LONGEST = 400_000, 64
#: Words counted in a task before it passes them on.
COUNTED = 300_000
#: Counts of a word or n-gram: ordinary and toxic in the first fold, then in the second.
COUNTS = ("ordinary_0", "toxic_0", "ordinary_1", "toxic_1")
#: The description of a document.
DESCRIPTION = ("top_1", "top_3", "mean", "sum_1", "sum_3", "sum_6", "total", "log_words")
PAD, END = "\x02", "\x03"
LEAD = PAD * (ORDER - 1)


def normalised(word: str) -> str:
    """Letters and digits of a word in lower case."""
    return word.lower() if word.isalnum() else "".join(filter(str.isalnum, word)).lower()


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and fold of the rows to learn from.

    Labels come with every document or so and are never broadcast: the join has one plan
    at every size.
    """
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    rows = docs.select("doc_id", whole_text().alias("text")).filter(remainder() != HELD_OUT)
    return rows.join(marks.filter(remainder() != HELD_OUT).hint("merge"), "doc_id").select(
        "doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    )


def count_batches(
    df: DataFrame, name: str, pairs: Callable[[pa.RecordBatch], Iterator[tuple[str, tuple]]]
) -> DataFrame:
    """``name`` and its four counts: what ``pairs`` gives, summed in the task and then overall."""

    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = zip(*counts.values()) if counts else [()] * len(COUNTS)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
            names=[name, *COUNTS],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for key, more in pairs(batch):
                known = counts.get(key)
                if known is None:
                    counts[key] = list(more)
                    if len(counts) >= COUNTED:
                        yield rows(counts)
                        counts = {}
                else:
                    for at, number in enumerate(more):
                        known[at] += number
        yield rows(counts)

    counted = df.mapInArrow(run, ", ".join([f"{name} string", *(f"{c} long" for c in COUNTS)]))
    return counted.groupBy(name).agg(*(F.sum(c).alias(c) for c in COUNTS))


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple]]:
    """The words of a batch of (text, toxic, fold)."""
    for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
        once = tuple(int(at == 2 * fold + toxic) for at in range(len(COUNTS)))
        for word, times in Counter(text.split()).items():
            found = normalised(word)
            if found:
                yield found, tuple(times * n for n in once)


def grams_of(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple]]:
    """The n-grams of the highest order of a batch of counted words."""
    words, *counts = (c.to_pylist() for c in batch.columns)
    for word, more in zip(words, zip(*counts)):
        padded = LEAD + word + END
        for at in range(len(word) + 1):
            yield padded[at : at + ORDER], more


def frequent(grams: DataFrame, most: int) -> DataFrame:
    """The n-grams above a power of two of the class-balanced count; ``most`` at most.

    Lower orders are then those of the n-grams that are left.
    """
    ordinary, toxic = (F.col(f"{c}_0") + F.col(f"{c}_1") for c in ("ordinary", "toxic"))
    sums = grams.agg(F.sum(ordinary), F.sum(toxic), F.count("*")).first()
    if not sums[2] or sums[2] <= most:
        return grams
    weight = ordinary + toxic * F.lit(max(1.0, sums[0] / max(1, sums[1])))
    level = F.floor(F.log2(F.greatest(weight, F.lit(1.0))))
    left, least = 0, 0
    for row in grams.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left += row["count"]
        if left > most:
            least = row["level"] + 1
            break
    return grams.filter(level >= least)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of every line of code points."""
    key = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        key = extended(key, column)
    return key


def extended(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    mixed = (key ^ (code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


@dataclass
class Model:
    """For each order the keys of its n-grams with, by class, share and weight of the rest.

    ``share`` is the discounted probability of the n-gram after its context, ``rest``
    what the n-gram as a context leaves to the lower order.
    """

    keys: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    first_rest: float = 1.0
    characters: int = 1
    curve: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(DESCRIPTION)))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(DESCRIPTION)))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(DESCRIPTION)))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def values(self, words: list[str]) -> np.ndarray:
        """Difference of the log-likelihoods of each word in the two models."""
        if not words:
            return np.zeros(0)
        text = "".join([LEAD + word + END for word in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chances = np.full((2, len(codes)), 1.0 / self.characters)
        key = [np.zeros(len(codes), np.uint64)]
        rest = np.full((2, len(codes)), self.first_rest)
        for order in range(1, ORDER + 1):
            shorter = np.concatenate([np.zeros(1, np.uint64), key[-1][:-1]]) if order > 1 else key[0]
            key.append(extended(shorter, codes))
            known = self.keys[order - 1]
            place = np.minimum(np.searchsorted(known, key[order]), len(known) - 1)
            hit = known[place] == key[order]
            share = np.where(hit, self.share[order - 1][:, place], 0.0)
            chances = share + rest * chances
            after = np.where(hit, self.rest[order - 1][:, place], 1.0)
            # What the n-gram before leaves, for the next order.
            rest = np.concatenate([np.ones((2, 1)), after[:, :-1]], axis=1)
        said = np.where(codes == ord(PAD), 0.0, np.log(chances[1]) - np.log(chances[0]))
        lengths = np.array([len(word) for word in words])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + ORDER)])
        return np.add.reduceat(said, starts)


def build(grams: list[str], counts: np.ndarray) -> Model:
    """Kneser-Ney tables from the n-grams of the highest order and their class counts."""
    text = "".join(grams)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append((codes, counts))
        if order > 1:
            key = keys_of(codes[:, 1:])
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            seen = counts > 0
            # From the first shared order on, the classes are counted as one.
            if order - 1 <= SHARED:
                seen = np.broadcast_to(seen.any(axis=0), seen.shape)
            counts = np.stack([np.bincount(inverse, s, len(first)) for s in seen])
            codes = codes[first, 1:]
    model = Model(characters=len(levels[-1][0]) + 1)
    above: tuple[np.ndarray, np.ndarray] | None = None
    for order in range(ORDER, 0, -1):
        codes, counts = levels[ORDER - order]
        context = keys_of(codes[:, :-1])
        held, inverse = np.unique(context, return_inverse=True)
        total = np.stack([np.bincount(inverse, c, len(held)) for c in counts])
        types = np.stack([np.bincount(inverse, c > 0, len(held)) for c in counts])
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        share = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[:, inverse], 1)
        own = keys_of(codes)
        keys = np.unique(own if above is None else np.concatenate([own, above[0]]))
        shares, rests = np.zeros((2, len(keys))), np.ones((2, len(keys)))
        shares[:, np.searchsorted(keys, own)] = share
        if above is not None:
            rests[:, np.searchsorted(keys, above[0])] = above[1]
        model.keys.insert(0, keys)
        model.share.insert(0, shares.astype(np.float32))
        model.rest.insert(0, rests.astype(np.float32))
        above = (held, left)
    model.first_rest = float(above[1][0, 0])
    return model


class Values:
    """Values of words, those seen before from memory."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def describe(self, texts: list[str]) -> np.ndarray:
        """The DESCRIPTION of each text; lengths are those of the words as they stand."""
        split = [text.split() for text in texts]
        known = self.known
        missing = list({word for words in split for word in words if word not in known})
        plain = [normalised(word) for word in missing]
        kept = [i for i, word in enumerate(plain) if word]
        new = dict.fromkeys(missing, 0.0)
        for i, value in zip(kept, self.model.values([plain[i] for i in kept]).tolist()):
            new[missing[i]] = value
        either = new if not known else {**new}
        if len(known) + len(new) > REMEMBERED:
            if 2 * len(new) > sum(map(len, split)):
                self.known = {}
            get = lambda word: known[word] if word in known else either[word]
        else:
            known.update(new)
            get = known.__getitem__
        rows = np.zeros((len(texts), len(DESCRIPTION)))
        for at, words in enumerate(split):
            if words:
                values = np.fromiter(map(get, words), np.float64, len(words))
                lengths = np.fromiter(map(len, words), np.float64, len(words)) + 1
                each = values / lengths
                top, sums = -np.sort(-each)[:3], -np.sort(-values)[:6]
                rows[at] = (
                    top[0], top.mean(), each.mean(), sums[0], sums[:3].sum(), sums.sum(),
                    values.sum() / lengths.sum(), np.log(len(words)),
                )
        return rows


_LOADED: dict[str, Values] = {}


def loaded(model: Model) -> Values:
    """The values of a model, kept while a worker scores with it."""
    if model.name not in _LOADED:
        _LOADED.clear()
        _LOADED[model.name] = Values(model)
    return _LOADED[model.name]


def curve_of(rows: np.ndarray, toxic: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (constant first) by Newton steps, lightly damped.

    ``counted`` is how many rows each of the sample stands for.
    """
    x = np.column_stack([np.ones(len(rows)), rows])
    weights, damping = np.zeros(x.shape[1]), np.array([0.0, *[1e-2] * rows.shape[1]])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counted * (toxic - chance)) - damping * weights
        bend = (x * (counted * chance * (1 - chance))[:, None]).T @ x + np.diag(damping + 1e-9)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def scores(model: Model, rows: np.ndarray) -> np.ndarray:
    x = (rows - model.centre) / model.spread
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ model.curve[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most_grams: int | None = None) -> Model | float:
    """The model of all n-grams, or the share of toxic rows where one class has no row."""
    rows = cut_lineage(labelled(docs, labels))
    seen = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    of_class = [seen.get((c, 0), 0) + seen.get((c, 1), 0) for c in (0, 1)]
    if not all(of_class):
        return of_class[1] / max(1, sum(of_class))
    words = count_batches(rows.select("text", "toxic", "fold"), "word", words_of)
    grams = cut_lineage(count_batches(words, "gram", grams_of))
    grams = grams if most_grams is None else frequent(grams, most_grams)
    kept = grams.toPandas().sort_values("gram")
    if not len(kept):
        return of_class[1] / sum(of_class)
    names, counts = kept["gram"].tolist(), kept[list(COUNTS)].to_numpy(float).T
    folds = [counts[:2], counts[2:]]
    # A fold without rows of a class cannot describe the other one; then both do.
    apart = all(seen.get((c, f)) for c in (0, 1) for f in (0, 1)) and all(f.any() for f in folds)
    model = build(names, folds[0] + folds[1])
    described = []
    for fold in (0, 1):
        other = folds[1 - fold]
        there = other.any(axis=0)
        judge = build([n for n, t in zip(names, there) if t], other[:, there]) if apart else model
        for c in (0, 1):
            # Of each class by itself, so that the rare one is there; weights put that right.
            part = rows.filter((F.col("toxic") == c) & (F.col("fold") == fold))
            most = CURVE_ROWS // 4
            part = hashed_sample(part, ["doc_id"], most / max(1, seen.get((c, fold), 0)), most)
            described.append(descriptions(part.select("toxic", "text"), judge, ["toxic"]).toPandas())
    sample = pd.concat(described, ignore_index=True).sort_values(["toxic", *DESCRIPTION])
    x, toxic = sample[list(DESCRIPTION)].to_numpy(float), sample["toxic"].to_numpy(int)
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    stands_for = (np.array(of_class) / np.maximum(np.bincount(toxic, minlength=2), 1))[toxic]
    model.curve = curve_of((x - model.centre) / model.spread, toxic.astype(float), stands_for)
    return model


def descriptions(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(
        docs,
        lambda texts: [tuple(r) for r in loaded(sent.value).describe(texts).tolist()],
        dict.fromkeys(DESCRIPTION, "double"),
        keys,
    )


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every document."""
    if isinstance(model, float | int):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[tuple]:
        rows = loaded(sent.value).describe(texts)
        return [(s,) for s in scores(sent.value, rows).tolist()]

    return map_texts(docs, run, {"score": "double"})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    model = train(docs, labels)
    if isinstance(model, float | int):
        return docs.filter(F.lit(model < threshold))
    sent, score = docs.sparkSession.sparkContext.broadcast(model), fresh(docs, "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [text or "" for text in part.column(at).to_pylist()]
                found = scores(sent.value, loaded(sent.value).describe(texts))
                yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
