"""Byte-level BPE through a sentencepiece model made directly from a rank table.

Every byte becomes one character, so that each token of the table is a piece; its score
is the negative rank, and the normaliser leaves texts as they are. sentencepiece then
joins the pair of least rank first, as byte-level BPE does. The pieces of the split
pattern are encoded one by one, a piece that is a token itself directly. Decoding maps
ids to the bytes of their tokens.

A null text counts as the empty text, which has no ids. Repeated rows and an empty table
need no special case; other columns are not read.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from catalore.llm.chunks import ChunkIds
from catalore.llm.common import map_texts

#: Byte b is written as the character with code 256 + b: none of them is white space,
#: a control character or one that sentencepiece treats apart.
FIRST = 256
TO_PIECE = {b: FIRST + b for b in range(256)}
TO_BYTE = {FIRST + b: b for b in range(256)}
#: sentencepiece needs a piece for what it does not know; it takes id 0.
UNKNOWN = "<unk>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_PIECE)


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece number i + 1 is the token of the i-th rank."""
    model = sentencepiece_model_pb2.ModelProto()
    trainer, normaliser = model.trainer_spec, model.normalizer_spec
    trainer.model_type = sentencepiece_model_pb2.TrainerSpec.BPE
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = 0, -1, -1, -1
    trainer.unk_piece = UNKNOWN
    trainer.vocab_size = len(ranks) + 1
    normaliser.name = "identity"
    normaliser.add_dummy_prefix = False
    normaliser.remove_extra_whitespaces = False
    normaliser.escape_whitespaces = False
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    model.pieces.add(piece=UNKNOWN, score=0.0, type=kinds.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda pair: pair[1]):
        model.pieces.add(piece=to_piece(token), score=-float(rank), type=kinds.NORMAL)
    return model.SerializeToString()


class ByteBpe:
    """Encode texts and decode ids with a model of ``model_of``."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = proto.pieces[1:]
        self.rank_of = np.array([0, *(-round(p.score) for p in pieces)], np.uint32)
        self.bytes_of = {-round(p.score): p.piece.translate(TO_BYTE).encode("latin-1") for p in pieces}
        self.name_of = {rank: str(rank) for rank in self.bytes_of}
        self.rank = {token: rank for rank, token in self.bytes_of.items()}
        self.ids = ChunkIds(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; the split pattern cuts it into pieces first."""
        split = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for c in chunks]
        known = {p: self.rank.get(p) for pieces in split for p in pieces}
        rest = [p for p, rank in known.items() if rank is None]
        found = self.model.encode([to_piece(p) for p in rest], out_type=int, num_threads=1)
        ids = {p: array.array("I", [r]).tobytes() for p, r in known.items() if r is not None}
        ids.update((p, self.rank_of[e].tobytes()) for p, e in zip(rest, found))
        return [b"".join([ids[p] for p in pieces]) for pieces in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.ids(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[bytes, ByteBpe] = {}


def loaded(model: bytes, pattern: str) -> ByteBpe:
    """The codec of a model, loaded once in a worker."""
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(model, pattern)
    return _LOADED[key]


def codec(docs: DataFrame, ranks_path: str, pattern: str):
    """A function for tasks that gives the codec; the model's size is that of the table."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(read_ranks(ranks_path)))
    return lambda: loaded(sent.value, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the ids as ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    get = codec(docs, ranks_path, pattern)

    def run(texts: list[str]) -> list[tuple]:
        return [(ids, len(ids) // 4) for ids in get().ids(texts)]

    return map_texts(docs, run, {"ids": "binary", "n_tokens": "long"})


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts encoded, their ids decoded."""
    get = codec(docs, ranks_path, pattern)

    def run(texts: list[str]) -> list[tuple]:
        bpe = get()
        rows = []
        for ids in bpe.encode(texts):
            listed = ",".join(map(bpe.name_of.__getitem__, ids)).encode()
            decoded = bpe.decode(ids)
            rows.append(
                (len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest())
            )
        return rows

    return map_texts(
        docs, run, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    )
