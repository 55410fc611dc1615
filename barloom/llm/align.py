"""Alignment of two tokenizers over a corpus (operator 12).

Each distinct text is shuffled by its full text, tokenised by both tokenizers and aligned once, with the number of its
copies. Byte offsets where a token of either ends cut both into groups; the two tokens that end there are linked. Links
are summed up over the corpus by (A id, B id), each text's weighted with its copies, and every text's measures over these
sums are joined to the ids of its rows.

Two tokens that end together are byte strings of which the shorter is a suffix of the longer. So the pairs that can be
linked are known from the vocabularies alone: at most the sum of the lengths of all tokens, some hundred thousand, however
large the corpus is. They are numbered (``Pairs``), texts carry these numbers, and the table of sums that each task gets is
bounded by them.

Texts are cut before white space that follows other characters, where neither tokenizer's tokens cross: A's pattern starts
a pre-token at white space, and B has no piece with that character inside (checked when the pieces are read). Texts are taken
together up to ``CHUNK`` characters; what they share is tokenised and aligned once, all of it in one row of bytes, so that
offsets, groups and pairs come from array operations. Memory goes with a chunk, or with one text if that is longer.

A text that is null, empty, or not given back byte by byte by both tokenizers has no tokens. Rows alike in the text are
measured alike, whatever their ids; null and repeated ids do no harm. An empty table gives no rows. Only the id and the
text column are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batches_of, named, schema_with
from barloom.session import materialise

CHUNK = 4_000_000  # characters of text that are aligned together
TOGETHER = 64  # parts of text that are tokenised in one call
FIRST = 0x100  # the first character that byte-level vocabularies put in place of an unprintable byte


def byte_level(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for the
    characters from ``FIRST`` on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(FIRST + i): b for i, b in enumerate(rest)}
    return {i: bytes([back[c] for c in piece]) for piece, i in vocabulary.items() if all(c in back for c in piece)}


class Tokenizers:
    """The two tokenizers of one worker, from the contents of their files, and the bytes of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        import regex
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        special = set(self.a.get_added_tokens_decoder())
        self.a_bytes = {i: t for i, t in byte_level(self.a.get_vocab(with_added_tokens=False)).items() if i not in special}
        model = pb.ModelProto.FromString(b_model)
        model.normalizer_spec.add_dummy_prefix = False  # texts come with their space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        self.b_bytes = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.b_bytes |= {i: p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        # White space that some piece of B has behind another character does not start a new piece of text.
        inner = {p[i] for p in (x.decode() for x in self.b_bytes.values() if len(x) > 1) for i in range(1, len(p)) if p[i].isspace() and not p[i - 1].isspace()}
        behind = rf"(?:(?:{'|'.join(map(regex.escape, sorted(inner)))})\s*\S*)*" if inner else ""
        self.cut = regex.compile(rf"\s*\S*{behind}").findall

    @cached_property
    def blobs(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and for B: the bytes of all ids in a row, where each id's start, and how many it has (0 if it has none)."""
        out = []
        for of in (self.a_bytes, self.b_bytes):
            rows = [of.get(i, b"") for i in range(max(of) + 1)]
            sizes = np.array([len(t) for t in rows])
            out.append((np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes))
        return out

    @property
    def sizes(self) -> list[np.ndarray]:
        return [sizes for _, _, sizes in self.blobs]

    def rebuilt(self, side: int, ids: np.ndarray) -> bytes:
        blob, starts, sizes = self.blobs[side]
        n = sizes[ids]
        return blob[np.repeat(starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()

    @cached_property
    def written(self) -> tuple[np.ndarray, int]:
        """How tokens are written: A's id i at 2i, or 2i + 1 if its group's part ends there; B's behind a shift."""
        n_a, n_b = (len(x) for x in self.sizes)
        rows = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]
        return np.array(rows, dtype=object), 2 * n_a

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of A and of B for the parts, one after the other, and which parts both give back; the others get no ids."""
        together: list[list[str]] = [[]]
        for part in parts:
            together[-1].append(part)
            if len(together[-1]) == TOGETHER or part[-1].isspace():  # white space at a text's end would go on into the next part
                together.append([])
        together = [g for g in together if g]
        sides, same = self._encode(["".join(g) for g in together])
        if all(same):
            return *map(np.concatenate, sides), [True] * len(parts)
        # Tokens don't cross parts, so they may be tokenised together; where one isn't given back, each is for itself.
        alone, found = self._encode([p for g, ok in zip(together, same, strict=True) if not ok for p in g])
        own, each, given = iter(zip(*alone, found, strict=True)), iter(zip(*sides, same, strict=True)), []
        kept: list[tuple] = []
        for group, (a, b, ok) in zip(together, each, strict=True):
            for x, y, good in [(a, b, True)] if ok else [next(own) for _ in group]:
                kept += [(x, y)] if good else []
                given += [good] * (len(group) if ok else 1)
        nothing = [np.zeros(0, np.int64)]
        return *(np.concatenate([k[side] for k in kept] or nothing) for side in (0, 1)), given

    def _encode(self, texts: list[str]) -> tuple[tuple[list[np.ndarray], list[np.ndarray]], list[bool]]:
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]
        return (a, b), [self.rebuilt(0, x) == t.encode() == self.rebuilt(1, y) for t, x, y in zip(texts, a, b, strict=True)]


class Pairs:
    """All pairs of ids whose tokens can end together, numbered in the order of (A id, B id)."""

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]):
        self.stride = max(b_bytes, default=0) + 1
        a_of, b_of = _ids_of(a_bytes), _ids_of(b_bytes)
        codes = [i * self.stride + j for i, t in a_bytes.items() for k in range(len(t)) for j in b_of.get(t[k:], ())]
        codes += [i * self.stride + j for j, t in b_bytes.items() for k in range(1, len(t)) for i in a_of.get(t[k:], ())]
        self.codes = np.array(sorted(codes), np.int64)

    def __len__(self) -> int:
        return len(self.codes)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a * self.stride + b)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self.codes // self.stride, self.codes % self.stride


def _ids_of(of: dict[int, bytes]) -> dict[bytes, list[int]]:
    back: dict[bytes, list[int]] = {}
    for i, t in of.items():
        back.setdefault(t, []).append(i)
    return back


class Parts:
    """Distinct parts of text, tokenised and aligned: per part the numbers of ids, its written groups, its linked pairs."""

    def __init__(self, parts: list[str], tokenizers: Tokenizers, pairs: Pairs):
        a, b, given = tokenizers.encode(parts)
        self.given = np.array(given, bool)
        ends_a, ends_b = np.cumsum(tokenizers.sizes[0][a]), np.cumsum(tokenizers.sizes[1][b])
        part_ends = np.cumsum([len(p.encode()) if ok else 0 for p, ok in zip(parts, given, strict=True)])
        self.n_a = np.diff(np.searchsorted(ends_a, part_ends, "right"), prepend=0)
        self.n_b = np.diff(np.searchsorted(ends_b, part_ends, "right"), prepend=0)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        self.pairs = pairs.numbers(a[last_a], b[last_b])
        self.group_ends = np.searchsorted(shared, part_ends, "right")
        # Tokens group by group, A's before B's, each written with what follows it.
        texts, shift = tokenizers.written
        final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        final_a[last_a], final_b[last_b] = 1, 1
        groups = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        tokens = texts[np.concatenate([2 * a + final_a, shift + 2 * b + final_b])[np.argsort(groups, kind="stable")]].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.texts = ["".join(tokens[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def align_chunk(texts: list[str], tokenizers: Tokenizers, pairs: Pairs) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
    """For texts, none empty: numbers of A ids, B ids and groups; the digests of the groups; and, text by text, the numbers
    of the linked pairs, how often each is linked, and how many of them a text has."""
    numbers: dict[str, int] = {}
    at, sizes = [], []
    for text in texts:
        own = [numbers.setdefault(p, len(numbers)) for p in tokenizers.cut(" " + text) if p]
        at += own
        sizes.append(len(own))
    parts = Parts(list(numbers), tokenizers, pairs)
    at, starts = np.array(at), np.cumsum([0, *sizes[:-1]])
    whole = np.logical_and.reduceat(parts.given[at], starts)
    n_groups = np.diff(parts.group_ends, prepend=0)
    counts = [np.where(whole, np.add.reduceat(n[at], starts), 0) for n in (parts.n_a, parts.n_b, n_groups)]
    digests, written = [], parts.texts
    for ok, low, n in zip(whole.tolist(), starts.tolist(), sizes, strict=True):
        joined = "".join([written[i] for i in at[low : low + n].tolist()])[:-1] if ok else ""
        digests.append(hashlib.sha256(joined.encode()).hexdigest() if ok else "")
    # The pairs of each part of each whole text: a range of ``parts.pairs`` each.
    at, owner = at[np.repeat(whole, sizes)], np.repeat(np.arange(len(texts)), np.where(whole, sizes, 0))
    n = n_groups[at]
    linked = parts.pairs[np.repeat(parts.group_ends[at] - np.cumsum(n), n) + np.arange(n.sum())]
    keys, times = np.unique(np.repeat(owner, n) * max(1, len(pairs)) + linked, return_counts=True)
    owners, linked = np.divmod(keys, max(1, len(pairs)))
    return counts, digests, [linked, times, np.bincount(owners, minlength=len(texts))]


ALIGNED = "key string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<int>, times array<int>"
MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``text``, ``copies``) of each text that is neither null nor empty."""
    text = named(text_col).cast("string").alias("text")
    return docs.select(text).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))


def align_texts(texts: DataFrame, a_json: str, b_model: bytes, pairs: Pairs) -> DataFrame:
    """Per text of (``text``, ``copies``): its digest ``key``, its copies and counts, and the numbers of its linked pairs
    with the times that each is linked."""
    shared = texts.sparkSession.sparkContext.broadcast((a_json, b_model, pairs))  # as large as the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        tokenizers, known = Tokenizers(*shared.value[:2]), shared.value[2]
        for b in batches:
            counts, digests, found = [np.zeros((3, 0), np.int64)], [], [[np.zeros(0, np.int64)] * 3]
            for group in batches_of((t.as_py() for t in b.column("text")), len, CHUNK):
                n, made, linked = align_chunk(group, tokenizers, known)
                counts.append(np.stack(n))
                digests += made
                found.append(linked)
            linked, times, sizes = (np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (linked, times)]
            rows = [pa.array(x) for x in np.concatenate(counts, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), *rows, pa.array(digests, pa.string()), *lists], [f.split()[0] for f in ALIGNED.split(", ")])

    return texts.select(F.sha2("text", 256).alias("key"), "copies", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(``pair``, ``links``) over the corpus, each text's links taken as often as it has copies."""
    one = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return one.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("links"))


def _sums(counts: DataFrame, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Per pair number: the links of the pair, and whether its B id has no pair with more."""
    found = counts.toArrow()  # a row for each pair that occurs, so as many as ``pairs`` has at most
    links = np.zeros(len(pairs), np.int64)
    links[found["pair"].to_numpy()] = found["links"].to_numpy()
    _, b = pairs.ids()
    most = np.zeros(pairs.stride, np.int64)
    np.maximum.at(most, b, links)
    return links, links == most[b]


def measured(aligned: DataFrame, pairs: Pairs) -> DataFrame:
    """Per text of ``aligned``: its key, its counts, how many of its links are the best of their B id, and the sum of the
    corpus-wide counts of its links."""
    shared = aligned.sparkSession.sparkContext.broadcast(_sums(pair_counts(aligned), pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, best = shared.value
        for b in batches:
            own, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            ends = np.cumsum([0, *own.value_lengths().to_pylist()])
            at = own.flatten().to_numpy()
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]))  # noqa: B023, E731
            n = total(times)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("key", "n_a", "n_b", "n_groups")), n, total(times * best[at]), total(times * links[at]), b.column("groups_sha256")],
                ["key", *(f.split()[0] for f in MEASURES.split(", "))],
            )

    columns = ("key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")
    return aligned.select(*columns).mapInArrow(run, "key string, " + MEASURES)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``MEASURES``. ``a_path``: a byte-level tokenizer's JSON file, ``b_path``: a sentencepiece model."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_json, b_model = a.read(), b.read()
    tokenizers = Tokenizers(a_json, b_model)
    pairs = Pairs(tokenizers.a_bytes, tokenizers.b_bytes)
    aligned = materialise(align_texts(distinct_texts(docs, text_col), a_json, b_model, pairs), "aligned")
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    full = rows.where("text <> ''").select("id", F.sha2("text", 256).alias("key"))
    none = [F.lit("" if f.endswith("string") else 0).cast(f.split()[1]).alias(f.split()[0]) for f in MEASURES.split(", ")]
    out = full.join(measured(aligned, pairs), "key").drop("key")
    out = out.union(rows.where("text is null or text = ''").select("id", *none))
    return out.withColumnRenamed("id", id_col)
