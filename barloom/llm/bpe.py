"""Byte-level BPE encoding and decoding (operator 9).

The vocabulary's ranks become a sentencepiece BPE model: each byte is written as one printable character, a piece's score
is its negative rank (so the lowest rank merges first, leftmost among equals), and normalisation is the identity. A text
is cut into pre-tokens by the tokenizer's pattern, each pre-token encoded on its own, and ids are decoded by looking up
their bytes.

Nulls count as empty texts and empty texts have no ids. Repeated rows are encoded each. Only the id and the text column
are read, so further columns of any name do no harm. Memory: one Arrow batch, the vocabulary, and a cache of pre-tokens
that is emptied when it reaches ``CACHE``; a very long text needs memory in proportion to its own length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000  # pre-tokens that a Python worker remembers
CHUNK = 500_000  # characters of text that are looked up together
LONG = 64  # longer pre-tokens, are not remembered
FIRST = 0x100  # the character that stands for byte 0; all 256 that follow are letters
TO_CHARS = {b: FIRST + b for b in range(256)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def as_chars(piece: bytes) -> str:
    return piece.decode("latin-1").translate(TO_CHARS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece 0 is unknown, the others follow in the order of their ranks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary holds every single byte")
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for piece, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        model.pieces.add(piece=as_chars(piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.ranks = ranks
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank_of = [-1, *sorted(ranks.values())]
        self.piece_of = {rank: piece for piece, rank in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens. One that is a piece itself has that id; the others are merged by the model."""
        raw = [w.encode() for w in words]
        ids = {w: (self.ranks[b],) for w, b in zip(words, raw, strict=True) if b in self.ranks}
        rest = [(w, as_chars(b)) for w, b in zip(words, raw, strict=True) if b not in self.ranks]
        for (w, _), found in zip(rest, self.processor.encode([c for _, c in rest], num_threads=1), strict=True):
            ids[w] = tuple([self.rank_of[i] for i in found])
        return ids

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, in order. Texts are taken in chunks so that new pre-tokens reach the model many at a time."""
        cut: list[list[str]] = []
        size = 0
        for text in texts:
            cut.append(self.cut(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._look_up(cut)
                cut, size = [], 0
        yield from self._look_up(cut)

    def _look_up(self, cut: list[list[str]]) -> Iterator[list[int]]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        learnt = self._learn([w for w in set().union(*cut) if w not in cache])
        cache.update(learnt)
        for words in cut:
            yield list(chain.from_iterable(map(cache.__getitem__, words)))
        for w in learnt:
            if len(w) > LONG:
                del cache[w]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece_of.__getitem__, ids))


def _codec(spark, path: str, pattern: str):
    """A function that gives each worker its codec; the vocabulary (about a megabyte, fixed by its file) is broadcast."""
    ranks = load_ranks(path)
    shared = spark.sparkContext.broadcast((ranks, model_bytes(ranks), pattern))
    return lambda: Codec(*shared.value)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids`` (array of int)."""
    make = _codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for b in batches:
            ids = list(codec.encode_all(t.as_py() or "" for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``decoded`` (the bytes that the ids stand for; a null list has none)."""
    make = _codec(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for b in batches:
            out = [codec.decode(i.as_py() or []) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the id, ``n_tokens``, and the digests of the ids and of the decoded bytes."""
    make = _codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        printed = {i: str(i) for i in codec.piece_of}
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in codec.encode_all(t.as_py() or "" for t in b.column(1)):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(printed.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
