"""Phrase collocations by multikey quicksort of suffix pointers.

A suffix pointer is a place in a piece of a text; up to LONGEST words are read from it.
Pointers are routed over the cluster by their two leading words (three, where two words
lead very many). A task then has all pointers with those words and partitions them three
ways around a pivot, word after word: smaller, equal, larger. The equal part of a pivot at
depth d is a phrase of d words, and its size the number of its occurrences; it is split
further by the next word. Parts with fewer than ``least`` occurrences are abandoned.

So that few pointers move, a first pass counts words, pairs and triples by hash in a fixed
number of slots. A slot below ``least`` holds nothing frequent, so that a pointer ends
before it; nothing frequent is lost, however many share a slot. Texts are dealt by lang
first, so that equal pointers meet early: those of a task move as one row with a weight.

A phrase that is cut after its first k words scores 1000 a n / (l r), the least cut counts.
Phrases inside a longer one that occurs as often are dropped. Numbers are exact: products
are 38-digit decimals.

A null text counts as the empty text, a null lang as ``und``. Words are runs of characters
other than space and tab after A-Z is lower-cased, in pieces between ``.,;:!?`` and line
ends. Repeated rows count as often as they occur; no column but text and lang is read. A
table without a frequent phrase, or an empty one, gives an empty result. Ties in rank are
broken by the phrase, which is unique in its lang.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalore.llm.common import mixed, whole_text
from catalore.session import cut_lineage, estimated_bytes

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"

#: Slots that words, pairs and triples are counted in (a byte each), and slots of one row of them.
SLOTS = 1 << 26
CHUNK = 1 << 16
#: Tasks that count; each ships a row for every chunk it has set.
MOST_BUILDERS = 2048
#: Bytes of text taken together, and pointers of whole routes partitioned together.
TEXT_BYTES = 4 << 20
POINTERS = 400_000
#: Bytes of input that one task turns into pointers. It sends each pointer once, so that large
#: tasks send fewer rows; every core still has some tasks.
DEALT_BYTES = 64 << 20
TASKS_PER_CORE = 2
#: Rows that a task holds to add up equal ones; what is over half of it then is sent on.
HELD_ROWS = 500_000
#: Pointers that two leading words may have before they are routed by three. It grows with
#: all pointers, so that at most MOST_HOT pairs are routed so.
HOT_POINTERS = 500_000
MOST_HOT = 10_000

#: Ends of pieces, all of them mapped to the first; it is a token by itself then.
END = b"."
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TO_END = bytes.maketrans(PIECE_ENDS, END * len(PIECE_ENDS))
PAIR = np.uint64(0xD6E8FEB86659FD93)


class Tokens:
    """The tokens of some texts of one lang: codes, their words and whether they end a piece."""

    def __init__(self, lang: str, texts: list[str]) -> None:
        data = "\n".join(texts).encode().lower().translate(TO_END)
        found = re.sub(rb"\.+", b" . ", data).split()
        encoded = pa.array(found, pa.binary()).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = encoded.dictionary
        listed = self.words.to_pylist()
        self.is_word = np.array([w != END for w in listed], bool)[self.codes]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in listed], np.uint64)
        self.hashes = hashes[self.codes]

    def slots(self, count: int) -> list[np.ndarray]:
        """The slots of every token, of every token with the next one, and with the next two."""
        hashes = [self.hashes]
        for width in (1, 2):
            hashes.append(mixed(hashes[-1][:-1] * PAIR + self.hashes[width:]))
        return [(h % np.uint64(count)).astype(np.int64) for h in hashes]

    def within_piece(self) -> list[np.ndarray]:
        """Whether one, two and three tokens from each on are words of one piece."""
        one = self.is_word
        two = one[:-1] & one[1:]
        return [one, two, two[:-1] & one[2:]]


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts of a batch (columns lang, text) by lang, some megabytes at a time."""
    texts: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0), batch.column(1)):
        lang = lang.as_py()
        texts.setdefault(lang, []).append(text.as_py())
        sizes[lang] = sizes.get(lang, 0) + len(texts[lang][-1])
        if sizes[lang] >= TEXT_BYTES:
            yield lang, texts.pop(lang)
            sizes[lang] = 0
    yield from texts.items()


def source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), whole_text().alias("text"))


def dealt_by_lang(docs: DataFrame) -> DataFrame:
    """``source`` in parts of like size that have few langs each, also where one lang has most rows.

    There are as many parts as ``DEALT_BYTES`` and the cores ask for, at most the shuffle
    partitions that the session sets (also where the size is not known).
    """
    spark = docs.sparkSession
    wanted = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, estimated_bytes(docs) // DEALT_BYTES)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))
    # A place is the same in every attempt of a task, and copies of a text are spread.
    place = F.xxhash64("text", F.spark_partition_id())
    return source(docs).withColumn("place", place).repartitionByRange(parts, "lang", "place").drop("place")


def frequent_slots(docs: DataFrame, least: int, slots: int) -> np.ndarray:
    """Packed bits of the ``slots`` that ``least`` words, pairs or triples may share."""
    enough, chunk = min(least, 255), min(CHUNK, slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint8)
        for batch in batches:
            for lang, texts in by_lang(batch):
                tokens = Tokens(lang, texts)
                used = [s[w] for s, w in zip(tokens.slots(slots), tokens.within_piece())]
                slot, times = np.unique(np.concatenate(used), return_counts=True)
                counts[slot] = np.minimum(255, counts[slot] + times)
        packer = zstandard.ZstdCompressor(level=1)
        for at in range(0, slots, chunk):
            part = counts[at : at + chunk]
            if part.any():
                yield pa.RecordBatch.from_pydict({"at": [at], "counts": [packer.compress(part.tobytes())]})

    def merge(table: pa.Table) -> pa.Table:
        total, unpacker = np.zeros(chunk, np.uint16), zstandard.ZstdDecompressor()
        for part in table["counts"]:
            counts = np.frombuffer(unpacker.decompress(part.as_py()), np.uint8)
            np.minimum(total + counts, 255, out=total)
        bits = np.packbits(total >= enough).tobytes()
        return pa.table({"at": table["at"][:1], "bits": pa.array([bits])})

    built = source(docs).coalesce(MOST_BUILDERS).mapInArrow(count, "at long, counts binary")
    found = built.groupBy("at").applyInArrow(merge, "at long, bits binary")
    whole = np.zeros(slots // 8, np.uint8)
    for at, bits in found.toLocalIterator():
        whole[at // 8 : at // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return whole


def lookup(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def weighted(columns: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct line of ``columns`` (numbers below ``most``), and how many there are."""
    bits = int(most + 1).bit_length()
    keys, room = [], 0
    for column in columns:
        if room < bits:
            keys.append(np.zeros(len(column), np.int64))
            room = 62
        keys[-1] = (keys[-1] << bits) | column
        room -= bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(order)))


def pointers_of(tokens: Tokens, bits: np.ndarray, longest: int) -> tuple[pa.Array, ...]:
    """phrase, words and times of what some texts give: all words, words, and pointers."""
    codes, known = tokens.codes, tokens.words.cast(pa.string())
    word, pair, three = (
        np.append(within & lookup(bits, slots), np.zeros(width, bool))
        for width, (slots, within) in enumerate(zip(tokens.slots(8 * len(bits)), tokens.within_piece()))
    )
    # A pointer reads on while the last two words and the next one may be frequent together.
    pair &= word & np.append(word[1:], False)
    three &= pair & np.append(pair[1:], False)
    reach = pair + np.int64(1)
    for _ in range(longest - 2):
        reach = np.where(three, 1 + np.append(reach[1:], 0), pair + np.int64(1))
    reach = np.where(word, reach, 0)
    singles = np.bincount(codes[word], minlength=len(known))
    used = np.flatnonzero(singles)
    start = np.flatnonzero(reach >= 2)
    ahead = [np.minimum(start + k, len(codes) - 1) for k in range(longest)]
    columns = [np.where(reach[start] > k, codes[at] + 1, 0) for k, at in enumerate(ahead)]
    rows, times = weighted(columns, len(known))
    parts = [
        known.take(pa.array(c[rows] - 1, mask=c[rows] == 0)) for c in columns
    ]
    phrases = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    return (
        pa.concat_arrays([pa.array([""]), known.take(pa.array(used)), phrases.cast(pa.string())]),
        pa.array(np.concatenate([[0], np.ones(len(used)), reach[start][rows]]).astype(np.int32)),
        pa.array(np.concatenate([[tokens.is_word.sum()], singles[used], times]).astype(np.int64)),
    )


def summed(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``parts`` (lang, phrase, words, times) with equal ones added up; about ``most`` are held."""
    held, rows = [], 0

    def added() -> pa.Table:
        groups = pa.Table.from_batches(held).group_by(held[0].schema.names[:3], use_threads=False)
        return groups.aggregate([("times", "sum")]).rename_columns(held[0].schema.names)

    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= most:
            held = added().combine_chunks().to_batches()
            rows = sum(p.num_rows for p in held)
            if 2 * rows > most:
                yield from held
                held, rows = [], 0
    if held:
        yield from added().to_batches()


def weighted_pointers(docs: DataFrame, bits: np.ndarray, longest: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """lang, phrase, words and times; the row with no words counts all words of its texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in by_lang(batch):
                tokens = Tokens(lang, texts)
                if len(tokens.codes):
                    columns = pointers_of(tokens, sent.value, longest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(columns[0])), *columns],
                        names=["lang", "phrase", "words", "times"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(parts(batches), held_rows)

    return dealt_by_lang(docs).mapInArrow(run, "lang string, phrase string, words int, times long")


def frequent_prefixes(keys: np.ndarray, times: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, last column, weight) of every prefix of the rows of ``keys`` that weighs enough.

    Three-way partitions around a pivot, column after column; -1 ends a row.
    """
    found, waiting = [], [(np.arange(len(keys)), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        column = keys[pointers, depth]
        pivot = sorted((column[0], column[len(column) // 2], column[-1]))[1]
        for part in (pointers[column < pivot], pointers[column > pivot]):
            if len(part) and times[part].sum() >= least:
                waiting.append((part, depth))
        equal = pointers[column == pivot]
        weight = int(times[equal].sum())
        if pivot >= 0 and weight >= least:
            found.append((int(equal[0]), depth, weight))
            if depth + 1 < keys.shape[1]:
                waiting.append((equal, depth + 1))
    return found


def counted(table: pa.Table, least: int, longest: int) -> pa.RecordBatch:
    """The frequent phrases of whole routes (columns route, hot, lang, phrase, times)."""
    table = table.combine_chunks()
    lists = pc.split_pattern(table["phrase"].combine_chunks(), " ")
    flat = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.full((len(sizes), longest + 1), -1, np.int64)
    keys[row, place + 1] = flat.indices.to_numpy(zero_copy_only=False)
    langs = table["lang"].combine_chunks().dictionary_encode()
    hot = table["hot"].to_numpy(zero_copy_only=False).astype(np.int64)
    keys[:, 0] = 2 * langs.indices.to_numpy(zero_copy_only=False) + hot
    words, names = flat.dictionary.to_pylist(), langs.dictionary.to_pylist()
    rows = []
    for at, depth, weight in frequent_prefixes(keys, table["times"].to_numpy(), least):
        # Pairs that are routed by three words are counted before; here they are in parts.
        if depth > 1 + keys[at, 0] % 2:
            rows.append((names[keys[at, 0] // 2], " ".join(words[c] for c in keys[at, 1 : depth + 1]), depth, weight))
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "phrase", "words", "a"]
    )


def lead(words: int) -> Column:
    return F.substring_index("phrase", " ", words)


def frequent_phrases(pointers: DataFrame, least: int, longest: int, hot_pointers: int) -> DataFrame:
    """lang, phrase, words and a of all phrases of two and more words."""
    rows = pointers.filter("words >= 2").select("lang", "phrase", "words", "times", lead(2).alias("pair"))
    leads = cut_lineage(rows.groupBy("lang", "pair").agg(F.count("*").alias("rows"), F.sum("times").alias("a")))
    share = (leads.agg(F.sum("rows")).first()[0] or 0) / MOST_HOT
    hot = cut_lineage(leads.filter(F.col("rows") > max(hot_pointers, share)).drop("rows"))
    marked = rows.join(
        F.broadcast(hot.select("lang", "pair", F.lit(True).alias("hot"))), ["lang", "pair"], "left"
    ).withColumn("hot", F.coalesce("hot", F.lit(False)))
    routed = marked.filter("NOT hot OR words > 2").select(
        F.when(F.col("hot"), F.xxhash64("lang", lead(3))).otherwise(F.xxhash64("lang", "pair")).alias("route"),
        "hot", "lang", "phrase", "times",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            route = batch.column(0).to_numpy(zero_copy_only=False)
            # Whole routes are taken; the last one of a batch may go on in the next.
            changes = np.flatnonzero(route[1:] != route[:-1]) + 1
            first = 0
            if waiting and waiting[-1].column(0)[-1].as_py() != route[0]:
                changes = np.append(0, changes)
            if held + batch.num_rows >= POINTERS and len(changes):
                first = int(changes[-1])
                if held + first:
                    yield counted(pa.Table.from_batches([*waiting, batch.slice(0, first)]), least, longest)
                waiting, held = [], 0
            waiting.append(batch.slice(first))
            held += batch.num_rows - first
        if waiting:
            yield counted(pa.Table.from_batches(waiting), least, longest)

    found = routed.repartition("route").sortWithinPartitions("route").mapInArrow(
        run, "lang string, phrase string, words int, a long"
    )
    pairs = hot.filter(F.col("a") >= least).select(
        "lang", F.col("pair").alias("phrase"), F.lit(2).alias("words"), "a"
    )
    return found.unionByName(pairs)


def scored(phrases: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score by the lowest-scoring cut.

    ``known`` has the counts of all frequent phrases and words.
    """
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns({
        "head": F.expr("substring_index(phrase, ' ', k)"),
        "rest": F.expr("substring_index(phrase, ' ', k - words)"),
    })
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    joined = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return joined.groupBy("lang", "phrase", "words", "a", "n").agg(least).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def not_inside(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one contains as often as they occur."""
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )
    longer = phrases.filter("words > 2").select(
        "lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left")
    return kept.filter("longer IS NULL OR longer < a").drop("longer")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP,
    hot_pointers: int = HOT_POINTERS, slots: int = SLOTS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first ``top`` phrases."""
    bits = frequent_slots(docs, least, slots)
    pointers = cut_lineage(weighted_pointers(docs, bits, longest))
    totals = pointers.filter("words = 0").groupBy("lang").agg(F.sum("times").alias("n"))
    singles = pointers.filter("words = 1").groupBy("lang", "phrase").agg(F.sum("times").alias("a"))
    singles = cut_lineage(singles.filter(F.col("a") >= least))
    phrases = cut_lineage(frequent_phrases(pointers, least, longest, hot_pointers))
    found = scored(
        not_inside(phrases), singles.unionByName(phrases.select("lang", "phrase", "a")), cut_lineage(totals)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part, then the first of those, so that no task sorts a whole lang.
    part = Window.partitionBy("lang", "part").orderBy(*order)
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    parts = parts.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = parts.withColumn("rank", F.row_number().over(whole).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
