"""Periodic runs of words, by difference-cover common extensions on a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least LEAST_LENGTH and
LEAST_EXPONENT * q words long, that no neighbouring word extends. Words that are q apart
match along a run, over a stretch of at least ``max(2 q, 24 - q)`` places. A grid of half
that spacing therefore meets every run of period q in a place from which over half of the
stretch still matches. Summed over all periods the grids are harmonic: about n log n
places for n words.

Places whose first words differ go at once. How far the others match, to the right and
(on the reversed words) to the left, is a longest common extension. Of the suffixes only
those at places of a difference cover modulo 31 are sorted, six of 31. From any two places
the cover is reached by both after 30 words at most; these are compared, and the rest is a
range minimum over the common prefixes of neighbouring sorted samples, from a sparse table.
Samples are sorted word by word over the first 31 words, then by doubling, each time only
where neighbours are still equal; common prefixes follow from the pass that parts them.

Words are numbered within their document, so that documents of a batch share one table
and never match each other. Only documents with a surviving place get tables.

A null or empty text has no words, no runs and the digests of the empty text. Rows are
taken one by one: repeated rows and ids give repeated results, an empty table gives an
empty one, other columns are not read. Long texts take time in proportion to n log n. A
null doc_id has no number to plant a period by, so that its text stays as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalore.llm.common import whole_text

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: A difference cover: every difference modulo SPAN is one of two members.
SPAN = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
#: Words of one batch, and grid places looked at together.
BATCH_WORDS = 200_000
GRID_PLACES = 2_000_000
UNKNOWN = np.iinfo(np.int32).max


def steps_to_cover() -> np.ndarray:
    """For two places modulo SPAN the words until both are members of the cover."""
    member = np.isin(np.arange(SPAN), COVER)
    at = np.arange(SPAN)
    steps = np.full((SPAN, SPAN), -1, np.int64)
    for k in range(SPAN):
        both = member[(at + k) % SPAN][:, None] & member[(at + k) % SPAN][None, :]
        steps[(steps < 0) & both] = k
    return steps


STEPS = steps_to_cover()


class LeastOf:
    """Minima of ranges of an array, from a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value at low..high, both included."""
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.rows[k]
            out[of] = np.minimum(row[low[of]], row[high[of] - (1 << int(k)) + 1])
        return out


class Extensions:
    """How many words agree from two places on."""

    def __init__(self, words: np.ndarray) -> None:
        count = len(words)
        self.words = np.append(words, np.full(SPAN + 1, -1))
        places = np.arange(count + 1)
        self.places = places[np.isin(places % SPAN, COVER)]
        self.sample = np.full(count + 1, -1)
        self.sample[self.places] = np.arange(len(self.places))
        self.sort_samples()

    def sort_samples(self) -> None:
        size = len(self.places)
        self.order = np.arange(size)
        self.rank = np.zeros(size, np.int64)
        self.common = np.full(size, UNKNOWN, np.int32)
        self.common[0] = 0
        tied = np.arange(size)
        for depth in range(SPAN):
            if len(tied) < 2:
                break
            keys = self.words[self.places[self.order[tied]] + depth]
            tied = self.refine(tied, keys, lambda left, right: depth)
        depth = SPAN
        while len(tied) > 1:
            before, least = self.rank.copy(), LeastOf(self.common)
            beyond = lambda s: before[self.sample[self.places[s] + depth]]  # noqa: B023, E731

            def parted(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                return depth + least.between(beyond(left) + 1, beyond(right))  # noqa: B023

            tied = self.refine(tied, beyond(self.order[tied]), parted)
            depth *= 2
        self.least = LeastOf(self.common)

    def refine(self, tied: np.ndarray, keys: np.ndarray, parted: Callable) -> np.ndarray:
        """Sort the places ``tied`` of groups by ``keys``; what is tied still."""
        group = self.rank[self.order[tied]]
        sort = np.lexsort((keys, group))
        moved, keys = self.order[tied][sort], keys[sort]
        self.order[tied] = moved
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, keys[1:] != keys[:-1]) & ~new_group
        cut = np.flatnonzero(new_key)
        self.common[tied[cut]] = parted(moved[cut - 1], moved[cut])
        heads = np.flatnonzero(new_group | new_key)
        sizes = np.diff(np.append(heads, len(tied)))
        self.rank[moved] = np.repeat(tied[heads], sizes)
        return tied[np.repeat(sizes > 1, sizes)]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words that agree from each pair of different places on."""
        out = np.zeros(len(left), np.int64)
        until = STEPS[left % SPAN, right % SPAN]
        going = np.arange(len(left))
        for depth in range(SPAN):
            at_cover = until[going] == depth
            done = going[at_cover]
            if len(done):
                one = self.rank[self.sample[left[done] + depth]]
                two = self.rank[self.sample[right[done] + depth]]
                out[done] = depth + self.least.between(np.minimum(one, two) + 1, np.maximum(one, two))
            going = going[~at_cover]
            if not len(going):
                break
            equal = self.words[left[going] + depth] == self.words[right[going] + depth]
            out[going[~equal]] = depth
            going = going[equal]
        return out


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, words that match from there at least) of every grid place.

    ``starts`` and ``sizes`` are the documents' first places and numbers of words.
    """
    most = np.where(sizes >= LEAST_LENGTH, sizes // LEAST_EXPONENT, 0)
    document = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(document)) - np.repeat(np.cumsum(most) - most, most) + 1
    stretch = np.maximum((LEAST_EXPONENT - 1) * period, LEAST_LENGTH - period)
    spacing = np.maximum(1, stretch // 2)
    need = stretch - spacing + 1
    places = (sizes[document] - period - need) // spacing + 1
    ends = np.cumsum(places)
    at = 0
    while at < len(document):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GRID_PLACES)))
        part, number = slice(at, to), places[at:to]
        step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        yield (
            np.repeat(starts[document[part]], number) + step * np.repeat(spacing[part], number),
            np.repeat(period[part], number),
            np.repeat(need[part], number),
        )
        at = to


def surviving(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The grid places from which the first words match, up to SPAN of them."""
    found = []
    for place, period, need in grid(starts, sizes):
        for depth in range(SPAN):
            keep = words[place + depth] == words[place + period + depth]
            if depth:
                keep |= need <= depth
            if not keep.all():
                place, period, need = place[keep], period[keep], need[keep]
            if not len(place) or need.max() <= depth + 1:
                break
            # The comparison reads on only where more words are needed.
            if depth + 1 < SPAN and need.min() <= depth + 1:
                ended = need <= depth + 1
                found.append((place[ended], period[ended], need[ended]))
                place, period, need = place[~ended], period[~ended], need[~ended]
        found.append((place, period, need))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 3


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start and period.

    ``words`` are numbers that no two documents share, document after document.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place, period, need = surviving(words, starts, sizes)
    if not len(place):
        return (np.empty(0, np.int64),) * 4
    # Only documents with a place left get tables; their words move together.
    document = np.searchsorted(ends, place, side="right")
    kept = np.zeros(len(sizes), bool)
    kept[document] = True
    own = words[np.repeat(kept, sizes)]
    own = np.unique(own, return_inverse=True)[1]
    own_starts = np.cumsum(np.where(kept, sizes, 0)) - np.where(kept, sizes, 0)
    place = place - starts[document] + own_starts[document]
    right = Extensions(own).of(place, place + period)
    long_enough = right >= need
    place, period, right, document = (x[long_enough] for x in (place, period, right, document))
    if not len(place):
        return (np.empty(0, np.int64),) * 4
    left = Extensions(own[::-1].copy()).of(len(own) - place, len(own) - place - period)
    length = right + left + period
    start = place - left
    kept = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    document, start, length, period = (x[kept] for x in (document, start, length, period))
    # A stretch is found under multiples of its period too; the least is its own.
    order = np.lexsort((period, length, start))
    document, start, length, period = (x[order] for x in (document, start, length, period))
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    document, start, length, period = (x[first] for x in (document, start, length, period))
    order = np.lexsort((period, start))
    document, start, length, period = (x[order] for x in (document, start, length, period))
    return document, start - own_starts[document], length, period


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a period that the number of the document asks for."""
    count = len(words)
    if doc_id is None or not count:
        return words
    number = zlib.crc32(str(doc_id).encode())
    if number % 10:
        return words
    rest = number // 10
    start = rest % count
    period = 1 + (count - start) // (3 + rest % 8)
    times = -(-(count - start) // period)
    return (words[:start] + words[start : start + period] * times)[:count]


def summary(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The columns of one document from its words and runs (start, length, period)."""
    if not found:
        best = (None,) * 4
    else:
        start, length, period = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    left = words
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        left = [w for w, times in zip(words, np.cumsum(drop).tolist()) if not times]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (
        len(found), *best,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest(),
    )


def summaries(texts: list[list[bytes]]) -> list[tuple]:
    """One summary for each document's words."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.repeat(np.arange(len(texts)), sizes) * (len(flat.dictionary) + 1) + codes
    found: list[list] = [[] for _ in texts]
    for document, *run in zip(*(x.tolist() for x in runs_of(numbers, sizes))):
        found[document].append(tuple(run))
    return [summary(words, runs) for words, runs in zip(texts, found)]


COLUMNS = {
    "n_runs": "long", "start": "long", "length": "long", "period": "long",
    "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string",
}


def collapsed_runs(docs: DataFrame, prepare: Callable | None = None) -> DataFrame:
    """The runs of every document: their number, the one of greatest exponent, and digests.

    ``prepare`` turns a document's words and doc_id into the words that are searched.
    ``collapsed_sha256`` is of the words that are left when every run keeps its first
    period only.
    """
    frame = docs.select("doc_id", whole_text().alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            while at < len(ids):
                texts, words = [], 0
                while at + len(texts) < len(ids) and (words < BATCH_WORDS):
                    row = at + len(texts)
                    own = batch.column(1)[row].as_py().encode().split()
                    texts.append(prepare(own, ids[row]) if prepare else own)
                    words += len(own)
                columns = list(zip(*summaries(texts)))
                kinds = [pa.string() if t == "string" else pa.int64() for t in COLUMNS.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        *(pa.array(c, k) for c, k in zip(columns, kinds)),
                    ],
                    names=["doc_id", *COLUMNS],
                )
                at += len(texts)

    return frame.mapInArrow(run, schema)
