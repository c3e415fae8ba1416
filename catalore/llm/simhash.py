"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two of them link where at most RADIUS (three) bits differ.
The bits are cut into three blocks. Of three differing bits one block holds at least
one, so that some pair of blocks differs in two bits at most; two words that differ in
two bits have a word between them that is one bit from either. Every fingerprint hence
emits, for each pair of blocks, all variants within one bit of the pair: 132 of them.
Linked fingerprints meet in a variant. (The same trick on the whole 64 bits needs a
ball of two bits on one side, 2081 variants.) Equal fingerprints are taken once.

Variants are shuffled and sorted, so that a task sees one bucket after another. It
verifies the pairs of a bucket on all 64 bits and keeps a forest of the links, no list
of pairs. In a bucket of over BRUTE fingerprints it looks for neighbours by flipping the
bits of the third block, which takes time in proportion to the bucket. The forests of
all tasks are joined by connected components.

Words are runs of characters other than the six ASCII white-space characters after A-Z
is lower-cased; shingles have three words, repeats included, or all words of a shorter
text. A text without words (a null text too) has fingerprint zero and links like any
other. Rows with one doc_id or equal texts are equal fingerprints; an empty table gives
an empty result; other columns are not read. A null doc_id counts only where a component
has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.llm.common import fresh, map_texts, whole_text
from catalore.llm.components import components
from catalore.session import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bits of the three blocks, and per pair the bits that it leaves out.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))
WHOLE = (1 << 64) - 1
LEFT_OUT = [sum(1 << b for b in block) for block in BLOCKS]
#: Pairs of a bucket are compared one by one up to this size.
BRUTE = 64


def shingles(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    if len(words) <= SHINGLE:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), initial=0))
    last = SHINGLE - 1
    return [
        line[low + at : high + at + last]
        for at, (low, high) in enumerate(zip(ends, ends[SHINGLE:]))
    ]


def fingerprint(text: str) -> int:
    """The signed value of the 64 bits that over half of the shingles' hashes have."""
    found = shingles(text)
    if not found:
        return 0
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in found]), np.uint8)
    bits = np.unpackbits(hashes.reshape(-1, 8), axis=1)
    counts = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (doc_id) and the fingerprint ``fp`` as a signed long."""
    return map_texts(docs, lambda texts: [(fingerprint(t),) for t in texts], {"fp": "long"}, keys)


def flips() -> list[tuple[int, int]]:
    """(kept bits, flipped bit) of every variant that a fingerprint emits."""
    found = []
    for left_out in LEFT_OUT:
        kept = WHOLE ^ left_out
        found += [(kept, 0), *((kept, 1 << b) for b in range(64) if kept >> b & 1)]
    return found


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): the variants of every fingerprint."""
    kept, flipped = (np.array(x, np.uint64) for x in zip(*flips()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 2048):
                fps = whole[at : at + 2048]
                keys = (fps[:, None] & kept) ^ flipped
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.repeat(fps, len(kept)).view(np.int64)),
                    ],
                    names=["key", "fp"],
                )

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


class Forest:
    """Union-find over fingerprints that have a link."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = node
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while node != top:
            parent[node], node = top, parent[node]
        return top

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for one, two in zip(left.tolist(), right.tolist()):
            a, b = self.root(one), self.root(two)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(node, self.root(node)) for node in list(self.parent) if self.root(node) != node]


def close(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right) <= RADIUS


def link_small(keys: np.ndarray, fps: np.ndarray, forest: Forest) -> None:
    """Compare the rows of each small bucket; rows are sorted by key."""
    at = np.arange(len(keys))
    for apart in range(1, BRUTE):
        at = at[: np.searchsorted(at, len(keys) - apart)]
        at = at[keys[at] == keys[at + apart]]
        if not len(at):
            return
        hit = at[close(fps[at], fps[at + apart])]
        forest.link(fps[hit], fps[hit + apart])


def link_large(key: np.uint64, fps: np.ndarray, forest: Forest) -> None:
    """The links of one large bucket, in time that grows with its size.

    Members differ from the key in one bit of the pair of blocks at most, so in two bits
    from each other. Those that agree in the third block are therefore linked, and so are
    those that differ there in one bit. Two bits are allowed beside a member that has the
    key itself, three between two such members; members that share a flipped bit meet
    again as members with the key itself in the bucket of that variant.
    """
    for left_out in map(np.uint64, LEFT_OUT):
        if key & left_out:
            continue
        apart = np.bitwise_count((fps & ~left_out) ^ key)
        members = fps[apart <= 1]
        if len(members) < 2:
            continue
        rest = members & left_out
        order = np.argsort(rest, kind="stable")
        members, rest = members[order], rest[order]
        same = np.flatnonzero(rest[1:] == rest[:-1])
        forest.link(members[same], members[same + 1])
        values, first = np.unique(rest, return_index=True)
        groups = members[first]
        centre = np.isin(values, fps[apart == 0] & left_out)
        bits = [np.uint64(1) << np.uint64(b) for b in range(64) if int(left_out) >> b & 1]
        link_flipped(values, groups, values, groups, bits, forest)
        middle, middles = values[centre], groups[centre]
        link_flipped(middle, middles, values, groups, [a ^ b for a, b in combinations(bits, 2)], forest)
        link_flipped(middle, middles, middle, middles, [a ^ b ^ c for a, b, c in combinations(bits, 3)], forest)


def link_flipped(values, groups, others, their_groups, masks, forest: Forest) -> None:
    """Link groups whose value, with a mask flipped, is one of ``others`` (sorted)."""
    if not len(values) or not len(others):
        return
    for mask in masks:
        wanted = values ^ mask
        place = np.minimum(np.searchsorted(others, wanted), len(others) - 1)
        hit = others[place] == wanted
        if hit.any():
            forest.link(groups[hit], their_groups[place[hit]])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): forests of the links between distinct fingerprints, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = Forest(), []

        def take(keys: np.ndarray, fps: np.ndarray) -> None:
            """Whole buckets, sorted by key."""
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            for start, size in zip(starts[sizes > BRUTE], sizes[sizes > BRUTE]):
                link_large(keys[start], fps[start : start + size], forest)
            small = np.repeat((sizes > 1) & (sizes <= BRUTE), sizes)
            link_small(keys[small], fps[small], forest)

        for batch in batches:
            keys, fps = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            if not len(keys):
                continue
            if parts and parts[-1][0][-1] != keys[0]:
                take(*map(np.concatenate, zip(*parts)))
                parts = []
            # The last bucket of a batch may go on in the next one.
            cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
            if cut:
                take(*map(np.concatenate, zip(*parts, (keys[:cut], fps[:cut]))))
                parts = []
            parts.append((keys[cut:].copy(), fps[cut:].copy()))
        if parts:
            take(*map(np.concatenate, zip(*parts)))
        edges = np.array(forest.edges(), np.uint64).reshape(-1, 2).view(np.int64)
        for at in range(0, len(edges), 1 << 16):
            part = edges[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["u", "v"]
            )

    spread = variants(distinct).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "u long, v long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, first, least): smallest doc_id and component of every distinct fingerprint."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = components(links(distinct)).withColumnRenamed("node", "fp")
    known = distinct.join(least, "fp", "left").select(
        "fp", "first", F.coalesce("least", "fp").alias("least")
    )
    return cut_lineage(known)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = cut_lineage(fingerprints(docs))
    known = classes(prints)
    named = known.groupBy("least").agg(F.min("first").alias("component_id"))
    # Written, so that the last join reads plain tables and can split a hot fingerprint.
    of = cut_lineage(known.join(named, "least").select("fp", "component_id"))
    return prints.join(of, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def text_digest() -> Column:
    return F.unhex(F.md5(whole_text()))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, all columns.

    It has the smallest doc_id (null last), then fingerprint, then digest of the text. Of
    rows alike in doc_id and text any one stays. A row of another component stays or goes
    with its own component, whatever ids the two share.
    """
    narrow = docs.select("doc_id", "text", text_digest().alias("digest"))
    prints = cut_lineage(fingerprints(narrow, ["doc_id", "digest"]))
    rows = prints.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("copies"))
    rank = F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "fp", "digest", "copies")
    least = rows.groupBy("fp").agg(F.min(rank).alias("row")).join(classes(prints), "fp")
    id_, digest, copies = (fresh(docs, n) for n in ("kept_id", "kept_digest", "kept_copies"))
    kept = cut_lineage(
        least.groupBy("least").agg(F.min("row").alias("row")).select(
            F.col("row.doc_id").alias(id_),
            F.col("row.digest").alias(digest),
            F.col("row.copies").alias(copies),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_digest() == F.col(digest))
    out = docs.join(kept.filter(F.col(copies) == 1), same, "left_semi")
    repeated = kept.filter(F.col(copies) > 1)
    if repeated.isEmpty():
        return out
    several = docs.join(repeated, same, "left_semi").withColumn(digest, text_digest())
    return out.unionByName(several.dropDuplicates(["doc_id", digest]).drop(digest))
