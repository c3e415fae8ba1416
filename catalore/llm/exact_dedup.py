"""Exact dedup by two passes over a Bloom filter.

Pass one sets bits for the hash of every row, in two planes: slots that some row has
set, and slots that two rows have set. Pass two looks every row up in the second plane.
A row that it rules out is alone and passes straight through; only the others shuffle,
on the full digest, so that a wrong hit of the filter costs a little work and no result.

Texts are equal when identical after white space is deleted. Of equal texts the row
with the most code points stays, then the smallest doc_id (null last); of rows that
agree even in that, one stays. A null text counts as the empty text. An empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalore.llm.common import SPACE, fresh, whole_text
from catalore.session import cut_lineage, remove_at_exit, shared_dir

#: Slots of the filter for each row, and bits that a row sets.
SLOTS_PER_ROW = 16
PROBES = 3
#: Slots of one filter at most: 64 MB for a plane. Beyond 33 million rows the hash space
#: is cut into ranges that have a filter each.
MOST_SLOTS = 1 << 29
#: Tasks that build one filter; each ships two planes at most.
BUILDERS = 16
#: Bytes of a plane that are merged as one row.
CHUNK = 1 << 20


def normalised(column: str = "text"):
    return F.translate(whole_text(column), SPACE, "")


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id, length, digest and hash of every row, with a number for the row."""
    return docs.select(
        "doc_id",
        F.length(whole_text()).cast("long").alias("length"),
        F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"),
    ).withColumns({"hash": F.xxhash64("digest"), "row": F.monotonically_increasing_id()})


def slots(hashes: np.ndarray, count: int) -> np.ndarray:
    """The slots of each hash: one line per probe."""
    value = hashes.astype(np.uint64)
    first = value & np.uint64(0xFFFFFFFF)
    step = (value >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(count) for i in range(PROBES)])


def add(planes: np.ndarray, found: np.ndarray) -> None:
    """Set ``found`` slots (one row's slots differ): once, or twice where set before."""
    slot, times = np.unique(found, return_counts=True)
    byte, bit = (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8)
    again = bit * (times > 1)
    starts = np.flatnonzero(np.diff(byte, prepend=-1))
    at = byte[starts]
    once = np.bitwise_or.reduceat(bit, starts)
    twice = np.bitwise_or.reduceat(again.astype(np.uint8), starts)
    planes[1, at] |= twice | (planes[0, at] & once)
    planes[0, at] |= once


def plane(keys: DataFrame, count: int) -> np.ndarray:
    """The plane of slots that two rows of ``keys`` may share, at most MOST_SLOTS / 8 bytes."""
    size = -(-count // 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros((2, size), np.uint8)
        for batch in batches:
            if batch.num_rows:
                each = slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), count)
                # A row that meets one slot twice must not count as two rows.
                each.sort(axis=0)
                each[1:][each[1:] == each[:-1]] = np.uint64(count)
                add_known(planes, each, count)
        for at in range(0, size, CHUNK):
            part = planes[:, at : at + CHUNK]
            if part[0].any():
                yield pa.RecordBatch.from_pydict(
                    {"at": [at], "once": [part[0].tobytes()], "twice": [part[1].tobytes()]}
                )

    def merge(table: pa.Table) -> pa.Table:
        planes = np.zeros((2, len(table["once"][0].as_py())), np.uint8)
        for once, twice in zip(table["once"], table["twice"]):
            one, two = (np.frombuffer(x.as_py(), np.uint8) for x in (once, twice))
            planes[1] |= two | (planes[0] & one)
            planes[0] |= one
        return pa.table({"at": table["at"][:1], "twice": pa.array([planes[1].tobytes()])})

    built = keys.select("hash").coalesce(BUILDERS).mapInArrow(
        build, "at long, once binary, twice binary"
    )
    whole = np.zeros(size, np.uint8)
    merged = built.groupBy("at").applyInArrow(merge, "at long, twice binary")
    for at, twice in merged.toLocalIterator():
        whole[at : at + len(twice)] = np.frombuffer(twice, np.uint8)
    return whole


def add_known(planes: np.ndarray, each: np.ndarray, count: int) -> None:
    found = each[each < count]
    if found.size:
        add(planes, found)


def with_flag(df: DataFrame, whole: np.ndarray, count: int, flag: str) -> DataFrame:
    """``df`` (its last column the hash) with whether its slots are all shared."""
    sent = df.sparkSession.sparkContext.broadcast(whole)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            hashes = batch.columns[-1].to_numpy(zero_copy_only=False).view(np.uint64)
            each = slots(hashes, count)
            hit = (known[(each >> np.uint64(3)).astype(np.int64)] >> (each & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hit.all(axis=0))], names=[*batch.schema.names, flag]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(probe, f"{schema}, `{flag}` boolean")


def filters(keys: DataFrame, most_slots: int) -> tuple[int, int]:
    """How many ranges of the hash space get a filter, and the slots of each filter."""
    rows = keys.count()
    ranges = max(1, -(-rows * SLOTS_PER_ROW // most_slots))
    return ranges, max(1024, min(most_slots, rows * SLOTS_PER_ROW // ranges))


def in_range(df: DataFrame, number: int, ranges: int) -> DataFrame:
    """Rows whose hash falls into one of ``ranges`` equal ranges."""
    if ranges == 1:
        return df
    low = [-(2**63) + (2**64 * i // ranges) for i in range(ranges)]
    kept = df.filter(F.col("hash") >= low[number])
    return kept if number == ranges - 1 else kept.filter(F.col("hash") < low[number + 1])


def marked_keys(docs: DataFrame, most_slots: int) -> DataFrame:
    """The keys of every row with the flag ``maybe``; texts are read once.

    The staged keys are sorted within their partitions, so that a range reads only its
    own pages of the files.
    """
    spark = docs.sparkSession
    keys = cut_lineage(keys_of(docs).sortWithinPartitions("hash"))
    ranges, count = filters(keys, most_slots)
    path = f"{shared_dir(spark).rstrip('/')}/marked-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    for number in range(ranges):
        part = in_range(keys, number, ranges).select("doc_id", "length", "digest", "row", "hash")
        with_flag(part, plane(part, count), count, "maybe").write.parquet(f"{path}/{number}")
    return spark.read.parquet(*(f"{path}/{number}" for number in range(ranges)))


def first_of_equal():
    """Longest text, then smallest doc_id, null last, then the row."""
    return F.struct(-F.col("length"), F.col("doc_id").isNull(), "doc_id", "row")


def exact_copies(docs: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``."""
    marked = marked_keys(docs, most_slots)
    alone = marked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    shuffled = marked.filter("maybe")
    # Written, so that the join reads two plain tables and can split a hot digest.
    groups = cut_lineage(
        shuffled.groupBy("digest").agg(
            F.count("*").alias("group_size"), F.min(first_of_equal()).alias("first")
        )
    )
    grouped = shuffled.join(groups, "digest").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    While one filter is enough, rows that it rules out pass through with their texts and
    the others are aggregated by digest, so that copies collapse before they shuffle.
    With more filters a pass for each would read the texts again and again; then the
    ids of dropped rows, known from the narrow keys, are removed by an anti-join.
    """
    keys = cut_lineage(keys_of(docs).select("hash").sortWithinPartitions("hash"))
    ranges, count = filters(keys, most_slots)
    if ranges > 1:
        return without_dropped(docs, most_slots)
    names = {n: fresh(docs, n) for n in ("digest", "hash", "maybe")}
    hashed = docs.withColumn(
        names["digest"], F.unhex(F.sha2(normalised().cast("binary"), 256))
    ).withColumn(names["hash"], F.xxhash64(F.col(names["digest"])))
    flagged = with_flag(hashed, plane(keys, count), count, names["maybe"])
    alone = flagged.filter(~F.col(names["maybe"])).select(*docs.columns)
    order = F.struct(-F.length(whole_text()), F.col("doc_id").isNull(), F.col("doc_id"))
    stays = flagged.filter(names["maybe"]).groupBy(names["digest"]).agg(
        F.min_by(F.struct(*docs.columns), order).alias("kept")
    )
    return alone.unionByName(stays.select("kept.*"))


def without_dropped(docs: DataFrame, most_slots: int) -> DataFrame:
    copies = exact_copies(docs, most_slots).select("doc_id", "text_sha256", "kept")
    best_id, best_digest, digest = (fresh(docs, n) for n in ("best_id", "best_digest", "digest"))
    best = copies.filter("kept").select(
        F.col("doc_id").alias(best_id), F.col("text_sha256").alias(best_digest)
    )
    hashed = docs.withColumn(digest, F.sha2(normalised().cast("binary"), 256))
    kept = hashed.join(
        best,
        F.col("doc_id").eqNullSafe(F.col(best_id)) & (F.col(digest) == F.col(best_digest)),
        "left_semi",
    )
    # Rows with the id and text of the kept one, if any, stay once.
    longest = F.max_by(F.struct(*docs.columns), F.length(whole_text())).alias("kept")
    return kept.groupBy(digest).agg(longest).select("kept.*")
