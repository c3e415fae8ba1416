"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is the ids of its documents back to back, as little-endian unsigned 32-bit
integers, cut into frames at the ends of documents. Every frame has a content checksum
of its own. Two skippable frames follow: the documents (ids, token counts), and the
seek table of the public seekable format, with the sizes of every frame and the low 32
bits of the XXH64 of its content. A reader finds both from the end of the file and
decompresses only the frames that hold the documents asked for.

Documents are written in ascending doc_id order (null first; rows with one doc_id by
the hash of their text), a file for each range. A null text counts as the empty text; every document ends
with the end id, so none is empty. Repeated rows are written as often as they occur. An
empty table gives no files. Other columns are not read. Rows with one doc_id may lie
in several files. Strings of the tokenizer's added tokens become those tokens, as the
library does it.

Files go to their final name only when whole, and a task that runs again writes the
same bytes.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalore.llm.chunks import ChunkIds
from catalore.llm.common import whole_text
from catalore.session import cut_lineage, remove_at_exit, shared_dir

#: A frame ends with the document that fills it; longer documents take several frames.
FRAME_BYTES = 1 << 20
LONGEST_FRAME = 1 << 26
LEVEL = 3
#: Fixed values of the public zstandard and seekable formats.
SEEK_MAGIC, SKIPPABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "part int, file string, n_docs long, n_tokens long"


class TokenFileWriter:
    def __init__(self, out) -> None:
        self.out, self.entries = out, []
        self.pending, self.size = [], 0
        self.doc_ids, self.counts = [], []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        whole = b"".join(self.pending)
        for at in range(0, len(whole), LONGEST_FRAME):
            content = whole[at : at + LONGEST_FRAME]
            frame = self.compressor.compress(content)
            self.out.write(frame)
            self.entries.append((len(frame), len(content), low_hash(content)))
        self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        counts = np.array(self.counts, "<i8")
        documents = self.compressor.compress(ids.tobytes() + counts.tobytes() + known.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(documents)) + documents)
        self.entries.append((8 + len(documents), 0, low_hash(b"")))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


def low_hash(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class TokenFile:
    """Random access to one file; ``source`` is seekable and has ``size`` bytes."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        frames, flags, magic = struct.unpack("<IBI", self.bytes_at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self.bytes_at(size - 9 - 12 * frames, 12 * frames)
        self.entries = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        at, end = self.places[-2], self.places[-1]
        raw = zstandard.ZstdDecompressor().decompress(self.bytes_at(at + 8, end - at - 8))
        n = len(raw) // 17
        known = np.frombuffer(raw, np.uint8, n, 16 * n)
        self.counts = np.frombuffer(raw, "<i8", n, 8 * n)
        ids = np.frombuffer(raw, "<i8", n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.ends = np.cumsum(self.counts)
        self.frame, self.content = None, b""

    def bytes_at(self, at: int, count: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(count))

    def content_of(self, number: int) -> bytes:
        """The content of a frame, checked; the last one read is kept."""
        if self.frame != number:
            packed = self.bytes_at(self.places[number], self.entries[number, 0])
            content = zstandard.ZstdDecompressor().decompress(packed)
            if low_hash(content) != self.entries[number, 2]:
                raise ValueError(f"frame {number} does not match its checksum")
            self.frame, self.content = number, content
        return self.content

    def ids_at(self, place: int) -> bytes:
        """The ids of the document at ``place``, in the order of the file."""
        end = 4 * int(self.ends[place])
        at = end - 4 * int(self.counts[place])
        parts = []
        while at < end:
            number = int(np.searchsorted(self.starts, at, "right")) - 1
            start = int(self.starts[number])
            part = self.content_of(number)[at - start : end - start]
            parts.append(part)
            at += len(part)
        return b"".join(parts)

    def read(self, doc_ids: Iterable[int | None] | None = None) -> Iterator[tuple[int, bytes]]:
        """Place and ids of all documents, or of those in ``doc_ids``."""
        wanted = None if doc_ids is None else set(doc_ids)
        for place, doc_id in enumerate(self.doc_ids):
            if wanted is None or doc_id in wanted:
                yield place, self.ids_at(place)


_ENCODERS: dict[bytes, Callable[[list[str]], list[bytes]]] = {}

#: Letters up to here have been letters in all versions of Unicode that libraries know.
SETTLED = "\u0530"


def byte_letters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte.

    Bytes that print stand for themselves, the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def one_piece(chunk: str) -> bool:
    """Whether a chunk is letters, a space before them or not: one piece under the pattern."""
    return chunk[chunk[:1] == " " :].isalpha() and (chunk.isascii() or max(chunk) < SETTLED)


def encoder(definition: str) -> Callable[[list[str]], list[bytes]]:
    """What the tokenizer of a definition gives for texts, loaded once in a worker."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = new_encoder(definition)
    return _ENCODERS[key]


def new_encoder(definition: str) -> Callable[[list[str]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer, settings = Tokenizer.from_str(definition), json.loads(definition)
    tokenize, letters = tokenizer.model.tokenize, byte_letters()

    def whole(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    # Texts are only cut where this pre-tokenizer cuts them as well.
    cut = settings["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    added = {t["content"]: t for t in settings["added_tokens"]}
    simple = not any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or not simple or settings["normalizer"] is not None:
        return whole

    def encode(chunks: list[str]) -> list[bytes]:
        # One piece goes to the library's model, which takes it as it is.
        single = list(map(one_piece, chunks))
        others = iter(whole([c for c, s in zip(chunks, single) if not s]))
        return [
            array.array("I", [
                t.id for t in tokenize(c.encode().decode("latin-1").translate(letters))
            ]).tobytes() if s else next(others)
            for c, s in zip(chunks, single)
        ]

    chunk_ids = ChunkIds(encode, lines=True)
    if not added:
        return chunk_ids
    # The library looks for added tokens before anything else; the text between them is cut.
    tokens = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    ids = {content: struct.pack("<I", token["id"]) for content, token in added.items()}

    def with_added(texts: list[str]) -> list[bytes]:
        parts = [tokens.split(t) if tokens.search(t) else [t] for t in texts]
        between = [p for own in parts for p in own[::2]]
        found = iter(chunk_ids(between))
        return [
            b"".join(ids[p] if i % 2 else next(found) for i, p in enumerate(own)) for own in parts
        ]

    return with_added


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> DataFrame:
    """Encode the documents and write them below ``folder``; one row for each file.

    The rows are written before they are returned, so that files are written once.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist())
            for batch in batches
            for at in range(0, batch.num_rows, 64)
        )
        first = next(rows, None)
        if first is None:
            return
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, draft = f"{base}/part-{part:05d}.zst", f"{base}/_part-{part:05d}-{attempt}"
        encode = encoder(sent.value)
        with system.open_output_stream(draft) as out:
            writer = TokenFileWriter(out)
            for doc_ids, texts in itertools.chain([first], rows):
                for doc_id, ids in zip(doc_ids, encode(texts)):
                    writer.add(doc_id, ids + end)
            writer.close()
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "file": [f"{folder}/part-{part:05d}.zst"],
                "n_docs": [len(writer.counts)],
                "n_tokens": [sum(writer.counts)],
            }
        )

    ordered = (
        docs.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("hash"))
        .repartitionByRange("doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
    )
    return cut_lineage(ordered.mapInArrow(run, MANIFEST))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Files with the ids of all files before them; a window over one short row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn(
        "before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(row["file"])
                with system.open_input_file(name) as source:
                    tokens = TokenFile(source, source.size())
                    sums = [zlib.crc32(ids) for _, ids in tokens.read()]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(tokens.doc_ids, pa.int64()),
                            "start": pa.array(row["before"] + tokens.ends - tokens.counts),
                            "n_tokens": pa.array(tokens.counts),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    files = with_starts(manifest).select("file", "before")
    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def token_digests(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None
) -> DataFrame:
    """Write the documents as token files and read them all back.

    Without a ``folder`` the files are removed when the driver ends.
    """
    if folder is None:
        folder = new_folder(docs)
        remove_at_exit(docs.sparkSession, folder)
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id))
