"""Near-dedup by b-bit MinHash, with links confirmed on full sets.

A document's set are the distinct shingles of its words. Of each set PERMUTATIONS minima are
taken; the sets keep the low BITS of each, packed as bit planes, and a key for each band of
ROWS minima. Sets that share a band key are candidates. What a pair shares is estimated by
bit counts: lanes that differ in no plane agree, and of the lanes that agree 1 in 2**BITS
does so by accident, for which the estimate is corrected. Pairs whose estimate is MARGIN or
more below the limit are dropped (over five standard errors); the others are compared on
their full sets, which are made from the texts again. A pair at the limit misses all 32
bands with probability 5e-8.

A bucket of a band key may be large, so pairs come in two steps. First every member meets
the least member of its bucket. Most near copies of a text are then in one component. In
buckets that still hold more than one component, the members outside the component of the
least one meet all members of other components, block against block: a task holds two blocks
at a time. Members with a pair that passes the estimate meet once more with their full sets,
and a forest of the links leaves the task, never the pairs. Every pair that shares a key and
is not connected already is looked at, whatever the size of its bucket.

Words are runs of characters other than the six ASCII white-space characters after A-Z is
lower-cased; a shorter text is one shingle of all its words. Equal sets are taken once. A
text without words (a null text too) has an empty set and is linked with nothing: it is its
own component and stays. Rows with one doc_id are taken one by one; a null doc_id names a
component only where it has no other, and an empty set's null doc_id is its own. An empty
table gives an empty result; other columns are not read. Shingles are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.llm.common import mixed, whole_text
from catalore.llm.components import components
from catalore.session import cut_lineage

WORDS = 4
LIMIT = 80
PERMUTATIONS = 128
BITS = 4
ROWS = 4
MARGIN = 0.19
SEED = 11
#: Members of one block of a bucket, their shingles on average, and texts hashed together.
BLOCK = 4096
SHINGLES_PER_ROW = 512
TEXTS = 256

PLANES = [f"s{i}" for i in range(BITS * PERMUTATIONS // 64)]
PER_PLANE = PERMUTATIONS // 64
_random = np.random.default_rng(SEED)
FACTORS, ADDENDS = _random.integers(0, 2**64, (2, PERMUTATIONS), np.uint64) | np.uint64(1)
PLACES = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [text.encode().lower().split() for text in texts]
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    known = [xxhash.xxh3_64_intdigest(w, SEED) for w in flat.dictionary.to_pylist()]
    hashes = np.array(known, np.uint64)[flat.indices.to_numpy(zero_copy_only=False)]
    found, at = [], 0
    for own in words:
        part = hashes[at : at + len(own)]
        at += len(own)
        if not own:
            found.append(part)
            continue
        wide = min(width, len(own))
        total = np.full(len(own) - wide + 1, wide, np.uint64)
        for place in range(wide):
            total += part[place : place + len(total)] * PLACES[place]
        found.append(np.unique(mixed(total)))
    return found


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        values = np.multiply.outer(shingles[at : at + 1024], FACTORS)
        values += ADDENDS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def planes(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, plane by plane in signed longs."""
    low = (least >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(low.astype(np.uint8), axis=1).view(np.int64).ravel()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed long for each band."""
    rows = least.reshape(-1, ROWS) * PLACES[:ROWS]
    return mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)).view(np.int64)


def row_key() -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col("doc_id"), whole_text())


def digest(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, size of the set, its digest (d0, d1), bit planes and band keys."""
    frame = docs.select("doc_id", row_key().alias("row"), whole_text().alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    longs = ["n_shingles", "d0", "d1", *PLANES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = shingle_sets(part.column(2).to_pylist(), width)
                rows, keys = [], []
                for shingles in sets:
                    least = minima(shingles)
                    rows.append([len(shingles), *digest(shingles), *planes(least).tolist()])
                    keys.append(band_keys(least))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * len(keys[0])
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns, bands],
                    names=["doc_id", "row", *longs, "bands"],
                )

    schema = f"doc_id {id_type}, row long, " + ", ".join(f"{n} long" for n in longs)
    return frame.mapInArrow(run, schema + ", bands array<long>")


def least_agreeing(limit: int) -> int:
    """Lanes that agree in a pair whose corrected estimate is within the margin."""
    accident = 2.0**-BITS
    return int(np.ceil(PERMUTATIONS * (accident + (1 - accident) * (limit / 100 - MARGIN))))


def similar_enough(limit: int) -> Column:
    """Whether the sizes and the estimate of the sides a and b allow a link."""
    differ = [
        F.bit_count(reduce(
            lambda x, y: x.bitwiseOR(y),
            (F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")) for s in PLANES[half::PER_PLANE]),
        ))
        for half in range(PER_PLANE)
    ]
    agree = PERMUTATIONS - sum(differ[1:], differ[0])
    n, m = F.col("a.n_shingles"), F.col("b.n_shingles")
    return (agree >= least_agreeing(limit)) & (100 * F.least(n, m) >= limit * F.greatest(n, m))


def estimated(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Pairs (u, v) that the bit planes and the sizes leave."""
    of = sets.select("id", "n_shingles", *PLANES)
    joined = pairs.join(of.alias("a"), F.col("u") == F.col("a.id")).join(
        of.alias("b"), F.col("v") == F.col("b.id")
    )
    return joined.filter(similar_enough(limit)).select("u", "v")


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id and all shingle hashes of the ``wanted`` sets, from one text of each."""
    of = sets.select("id", F.col("row").alias("of"), "d0", "d1").join(wanted, "id")
    texts = docs.select(row_key().alias("row"), whole_text().alias("text"))
    one = texts.join(of, F.col("row") == F.col("of")).dropDuplicates(["row", "id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                ids, d0, d1, texts = (c.to_pylist() for c in batch.slice(at, TEXTS).columns)
                found = shingle_sets(texts, width)
                kept = [i for i, s in enumerate(found) if digest(s) == (d0[i], d1[i])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in kept], pa.int64()),
                        pa.array([found[i].view(np.int64) for i in kept], pa.list_(pa.int64())),
                    ],
                    names=["id", "shingles"],
                )

    return one.select("id", "d0", "d1", "text").mapInArrow(run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, limit: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    full = cut_lineage(full_sets(docs, sets, wanted, width))
    both = pairs.join(full.select(F.col("id").alias("u"), F.col("shingles").alias("left")), "u").join(
        full.select(F.col("id").alias("v"), F.col("shingles").alias("right")), "v"
    )
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return cut_lineage(both.filter(100 * shared >= limit * union).select("u", "v").distinct())


def keyed(sets: DataFrame, *columns: str) -> DataFrame:
    return sets.select("id", *columns, F.explode("bands").alias("key"))


def with_least(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of every member of a bucket and the bucket's least one."""
    rows = keyed(sets)
    # Written, so that the join reads plain tables and can split a large bucket.
    least = cut_lineage(
        rows.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    pairs = rows.join(least, "key").filter("id <> u")
    return pairs.select("u", F.col("id").alias("v")).distinct()


def in_blocks(sets: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """Members of buckets with several components, once for each pair of blocks they are in.

    Columns key, i, j (the blocks), own (the member's block), id, label, size and planes.
    The members outside the component of the bucket's least one, U, are in blocks 0 to cu,
    the others in blocks from cu on; block i of U meets the blocks from i on.
    """
    labelled = cut_lineage(
        sets.join(label, "id", "left").select(
            "id", "bands", "n_shingles", F.coalesce("least", "id").alias("label")
        )
    )
    rows = keyed(labelled, "label", "n_shingles")
    buckets = rows.groupBy("key").agg(
        F.min("id").alias("pivot"), F.count("*").alias("n"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).filter("n > 2 AND low < high")
    of = labelled.select(F.col("id").alias("pivot"), F.col("label").alias("of_pivot"))
    buckets = cut_lineage(buckets.select("key", "pivot").join(of, "pivot"))
    rows = cut_lineage(
        rows.join(buckets, "key").filter("id <> pivot").select(
            "key", "id", "label", "n_shingles", (F.col("label") != F.col("of_pivot")).alias("outside")
        )
    )

    def blocks(side: Column) -> Column:
        """Blocks of a side by its rows, or by its shingles where sets are large."""
        rows, shingles = F.sum(side.cast("int")), F.sum(F.when(side, F.col("n_shingles")).otherwise(0))
        return F.ceil(F.greatest(rows / block, shingles / (block * SHINGLES_PER_ROW))).cast("int")

    counts = cut_lineage(
        rows.groupBy("key").agg(
            blocks(F.col("outside")).alias("cu"), blocks(~F.col("outside")).alias("cl"),
            F.count("*").alias("n"),
        ).filter("cu > 0 AND n > 1").drop("n")
    )
    place = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("cu")).otherwise(F.col("cl")))
    placed = rows.join(counts, "key").withColumn(
        "own", (place + F.when(F.col("outside"), 0).otherwise(F.col("cu"))).cast("int")
    )
    as_left = F.when(
        F.col("outside"),
        F.transform(
            F.sequence(F.col("own"), F.col("cu") + F.col("cl") - 1),
            lambda t: F.struct(F.col("own").alias("i"), t.alias("j")),
        ),
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    most = F.least(F.col("own"), F.col("cu"))
    as_right = F.when(
        most > 0,
        F.transform(
            F.sequence(F.lit(0), most - 1), lambda t: F.struct(t.alias("i"), F.col("own").alias("j"))
        ),
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    spread = placed.select(
        "key", "id", "label", "own", F.explode(F.concat(as_left, as_right)).alias("at")
    ).select("key", "at.i", "at.j", "own", "id", "label")
    return spread.join(sets.select("id", "n_shingles", *PLANES), "id")


def sides(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one group (columns i, j, own) the members of block i and of block j."""
    return tuple(np.flatnonzero(groups[:, 2] == groups[0, side]) for side in (0, 1))


def passing(rows: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of a group (columns i, j, own, id, label, size, planes) have a pair that passes."""
    (left, right), least = sides(rows), least_agreeing(limit)
    found = np.zeros(len(rows), bool)
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        ok = rows[part, 4][:, None] != rows[right, 4]
        small, large = (f(rows[part, 5][:, None], rows[right, 5]) for f in (np.minimum, np.maximum))
        one, two = np.nonzero(ok & (100 * small >= limit * large))
        one, two = part[one], right[two]
        differ = rows[one, 6:] ^ rows[two, 6:]
        agree = np.full(len(one), PERMUTATIONS)
        for half in range(PER_PLANE):
            any_plane = np.bitwise_or.reduce(differ[:, half::PER_PLANE], axis=1)
            agree -= np.bitwise_count(any_plane.view(np.uint64))
        hit = agree >= least
        found[one[hit]] = found[two[hit]] = True
    return found


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(often.sum()), 2048):
        low, high = np.searchsorted(column, [first, first + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[row[low:high], column[low:high] - first] = 1
        counts += has[left] @ has[right].T
    return counts


def links_of_group(rows: np.ndarray, sets: list[np.ndarray], limit: int) -> list[tuple[int, int]]:
    """Links of a group (columns i, j, own, id, label) by its full sets; a forest is enough."""
    left, right = sides(rows)
    size = np.array([len(s) for s in sets])
    shared = shared_counts(sets, left, right)
    union = size[left][:, None] + size[right] - shared
    ok = (100 * shared >= limit * union) & (rows[left, 4][:, None] != rows[right, 4])
    above = list(range(len(rows)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    found = []
    for one, two in zip(*(x.tolist() for x in np.nonzero(ok))):
        a, b = top(int(left[one])), top(int(right[two]))
        if a != b:
            above[a] = b
            found.append((int(rows[left[one], 3]), int(rows[right[two], 3])))
    return found


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (key, i, j) after the other, from sorted batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for at, to in zip(cuts, cuts[1:]):
            if waiting and (at or (keys[0] != last).any()):
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(at, to - at))
        last = keys[-1]
    if waiting:
        yield pa.Table.from_batches(waiting)


def numbers(table: pa.Table) -> np.ndarray:
    """All but the key of a group's whole-number columns."""
    return np.stack([c.to_numpy().astype(np.int64) for c in table.columns[1:] if pa.types.is_integer(c.type)], axis=1)


def rest_of_buckets(docs: DataFrame, sets: DataFrame, label: DataFrame, width: int, limit: int, block: int) -> DataFrame:
    """Links (u, v) of sets that share a key and are not connected yet."""
    order = ["key", "i", "j"]
    named = [*order, "own", "id", "label"]
    rows = in_blocks(sets, label, block).select(*named, "n_shingles", *PLANES)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            kept = passing(numbers(group), limit)
            if kept.any():
                yield from group.select(named).filter(pa.array(kept)).to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            full = [s.values.to_numpy() for s in group["shingles"]]
            found = links_of_group(numbers(group.drop_columns("shingles")), full, limit)
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sort = lambda df: df.repartition(*order).sortWithinPartitions(*order)
    near = cut_lineage(sort(rows).mapInArrow(likely, "key long, i int, j int, own int, id long, label long"))
    full = cut_lineage(full_sets(docs, sets, near.select("id").distinct(), width))
    found = sort(near.join(full, "id").select(*named, "shingles")).mapInArrow(links, "u long, v long")
    return cut_lineage(found.distinct())


def linked_sets(docs: DataFrame, sets: DataFrame, width: int, limit: int, block: int) -> DataFrame:
    """(node, least) of every set that has a link."""
    links = confirmed(estimated(with_least(sets), sets, limit), docs, sets, width, limit)
    label = cut_lineage(components(links))
    of = label.withColumnRenamed("node", "id")
    more = rest_of_buckets(docs, sets, of, width, limit, block)
    return label if more.isEmpty() else components(links.unionByName(more))


def near_copies(
    docs: DataFrame, width: int = WORDS, limit: int = LIMIT, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents link where ``limit`` percent of the union of their sets of ``width``-word
    shingles are shared; one row of each component, that of the least doc_id, is kept.
    """
    prints = cut_lineage(signatures(docs, width))
    filled = prints.filter("n_shingles > 0")
    sets = filled.groupBy("d0", "d1", "n_shingles", *PLANES, "bands").agg(
        F.min("doc_id").alias("first"), F.min("row").alias("row")
    )
    sets = cut_lineage(sets.withColumn("id", F.monotonically_increasing_id()))
    label = linked_sets(docs, sets, width, limit, block).withColumnRenamed("node", "id")
    known = cut_lineage(
        sets.join(label, "id", "left").select("d0", "d1", "first", F.coalesce("least", "id").alias("least"))
    )
    named = known.groupBy("least").agg(F.min("first").alias("component_id"))
    # Written, so that the last join reads plain tables and can split a hot set.
    of = cut_lineage(known.join(named, "least").select("d0", "d1", "component_id"))
    whole = filled.join(of, ["d0", "d1"]).select("doc_id", "n_shingles", "component_id")
    empty = prints.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return whole.unionByName(empty).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
