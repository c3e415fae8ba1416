import base64
import hashlib
import io
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from catalore.llm import byte_bpe, token_files
from catalore.llm.common import documents

from .conftest import ODD

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark, sf):
    random.seed(3)
    found = [r.text for r in documents(spark, sf).collect()] + [t or "" for _, t in ODD]
    found += ["", " ", "  ", " \n a", "a \n b", "x'S don't  'll", "<|endoftext|> x", "\x1c a\x1d b", "a. b, c."]
    letters = "ab1 .,\n\t'éK　s"
    found += ["".join(random.choice(letters) for _ in range(random.randrange(40))) for _ in range(3000)]
    return found


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.model_of(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)


def test_bpe_gives_the_library_s_ids(texts, library, bpe):
    found = bpe.encode(texts)
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(ids) for ids in found] == [t.encode() for t in texts]


def test_bpe_of_every_token(library, bpe):
    tokens = [t.decode() for t in bpe.rank if is_text(t)]
    assert bpe.encode(tokens) == [library.encode_ordinary(t) for t in tokens]


def is_text(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_small_memory_gives_the_same_ids(texts, bpe):
    small = byte_bpe.ChunkIds(bpe.encode_chunks, remembered=50)
    for at in range(0, 600, 7):
        assert small(texts[at : at + 7]) == bpe.ids(texts[at : at + 7])


def test_round_trip_of_odd_rows(odd, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for doc_id, text in ODD:
        ids = library.encode_ordinary(text or "")
        listed = ",".join(map(str, ids)).encode()
        want.add((doc_id, len(ids), hashlib.sha256(listed).hexdigest(),
                  hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want


def test_whole_texts_by_the_tokenizer(texts):
    with open(JSON, encoding="utf-8") as file:
        encode = token_files.encoder(file.read())
    library = Tokenizer.from_file(JSON)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(ids).cast("I")) for ids in encode(texts)] == want


def digests(rows):
    library = Tokenizer.from_file(JSON)
    found, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return found


def collected(frame):
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()]
    return sorted(rows, key=lambda r: r[1])


def test_token_files_of_documents(spark, sf):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(token_files.token_digests(docs.repartition(7), JSON, 2)) == digests(rows)


ADDED = [
    "<|endoftext|>", "<|endoftext|> x", "a<|endoftext|>b", "one <|endoftext|>", "<|endoftext|><|endoftext|>\n",
    "x <|endoftext|> y <|endoftext|>z <|endoftext", "<|ENDOFTEXT|> \n<|endoftext|>", "é<|endoftext|>é",
]


def test_added_tokens_are_those_of_the_library(table):
    with open(JSON, encoding="utf-8") as file:
        encode = token_files.encoder(file.read())
    library = Tokenizer.from_file(JSON)
    want = [e.ids for e in library.encode_batch(ADDED, add_special_tokens=False)]
    assert [list(memoryview(ids).cast("I")) for ids in encode(ADDED)] == want and 50256 in want[2]
    rows = list(enumerate(ADDED))
    assert collected(token_files.token_digests(table(rows), JSON, 2)) == digests(rows)


def test_lines_are_cut_where_the_library_cuts(texts):
    """Line ends beside letters, marks, white space of all kinds and nothing."""
    random.seed(6)
    parts = ["a", "Ü", "1", ".", "'s", " ", "\n", "\n", "\t", "\r\n", "\x85", "\u2028", "日", "ǆ", "ъ", "word", "!?"]
    odd = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(4000)]
    with open(JSON, encoding="utf-8") as file:
        encode = token_files.new_encoder(file.read())
    want = [e.ids for e in Tokenizer.from_file(JSON).encode_batch(odd, add_special_tokens=False)]
    assert [list(memoryview(ids).cast("I")) for ids in encode(odd)] == want


def test_a_hot_doc_id_spreads_over_files(spark, table):
    rows = [(7, f"text number {i}") for i in range(4000)] + [(8, "last")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = token_files.new_folder(table(rows))
        manifest = token_files.write_tokens(table(rows).repartition(4), JSON, folder, 2)
        assert manifest.filter("n_docs > 100").count() > 1
        got = token_files.read_tokens(manifest).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in got)
    assert len(got) == 4001 and [r[2] for r in ends][-1] == 8
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_token_files_of_odd_rows(odd):
    assert collected(token_files.token_digests(odd, JSON, 2)) == digests(ODD)


class Counting(io.BytesIO):
    def __init__(self, content):
        super().__init__(content)
        self.taken = 0

    def read(self, size=-1):
        found = super().read(size)
        self.taken += len(found)
        return found


def written(monkeypatch, sizes, frame=4096, longest=1 << 14):
    monkeypatch.setattr(token_files, "FRAME_BYTES", frame)
    monkeypatch.setattr(token_files, "LONGEST_FRAME", longest)
    random.seed(5)
    docs = [(i if i else None, random.randbytes(4 * n)) for i, n in enumerate(sizes)]
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    return docs, out.getvalue()


def test_reader_touches_only_the_frames_asked_for(monkeypatch):
    docs, content = written(monkeypatch, [300] * 200)
    source = Counting(content)
    reader = token_files.TokenFile(source, len(content))
    before = source.taken
    assert list(reader.read([77])) == [(77, docs[77][1])]
    assert source.taken - before < 3 * 4096
    assert [ids for _, ids in reader.read()] == [ids for _, ids in docs]
    assert list(reader.read([None])) == [(0, docs[0][1])]
    assert list(reader.read([12345])) == []


def test_long_documents_take_several_frames(monkeypatch):
    docs, content = written(monkeypatch, [10, 20_000, 1, 9_000, 5])
    reader = token_files.TokenFile(io.BytesIO(content), len(content))
    assert [ids for _, ids in reader.read()] == [ids for _, ids in docs]


def test_any_zstandard_reader_can_read_the_frames(monkeypatch):
    docs, content = written(monkeypatch, [300] * 50)
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"".join(ids for _, ids in docs)


def test_a_changed_frame_is_noticed(monkeypatch):
    docs, content = written(monkeypatch, [300] * 50)
    broken = bytearray(content)
    broken[100] ^= 1
    reader = token_files.TokenFile(io.BytesIO(bytes(broken)), len(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader.read())
