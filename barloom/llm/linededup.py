"""Reversible line dedup (operator 1): sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of ``MIN_CHARS`` code
points or more take part, as 128-bit digests. An index folder holds, for each version,

* ``holders``: (key, doc) for each document that has a line with the key,
* ``counts``: (key, refs, first): how many documents hold it and the smallest of them,
* ``filters``: a cuckoo filter for each shard of the keys that are held twice or more.

Inserting documents adds holders and puts keys that reach two references into their shard's filter; deleting documents
takes holders away, recounts their keys, and takes keys that fall below two references out of the filter again, so an
index after insert and delete decides as if the documents had never come. Decisions ask the filter first: a line it doesn't
know is held once and stays; the others are looked up in ``counts``.

Hot keys: postings of a shard are dealt by document over as many tasks as ``PER_TASK`` postings each need, ``salts`` at
least; each gets a copy of the filter and streams its postings, so it holds one filter and one batch. Shards are added so
that a filter has about ``PER_SHARD`` keys. Decisions on a table's own rows are kept by row (its id and text), so a row is
given its own keys only, however many rows share its id or have none.

A null or empty text is one empty line. Rows that share an id are one document: a line that repeats within it stays.
Rows with a null id are one document, which comes last. Repeated rows are cut alike. An empty table gives an empty
index and no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ASCII_SPACE, NULL_ID, named, row_key, schema_with
from barloom.session import materialise, scratch_path

MIN_CHARS = 10
PER_SHARD = 50_000
PER_TASK = 200_000  # postings
SLOTS = 4  # of a bucket
KICKS = 500
SPACE = ASCII_SPACE.encode()


def key_of(line: bytes) -> bytes | None:
    """The digest of a line's key, or nothing if the key is too short."""
    key = line.strip(SPACE).lower()
    # Bytes that continue a code point are not counted.
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, buckets: int):
        self.slots = np.zeros((buckets, SLOTS), np.uint16)  # 0 is free

    @classmethod
    def of(cls, raw: bytes) -> Cuckoo:
        self = cls(1)
        self.slots = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return self

    @classmethod
    def build(cls, keys: list[bytes]) -> Cuckoo:
        """A filter of distinct keys, as small as takes them."""
        buckets = 1 << max(2, int(len(keys) / (SLOTS * 0.85)).bit_length())
        while True:
            self = cls(buckets)
            if self.insert(keys):
                return self
            buckets *= 2

    def raw(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bucket, second bucket and fingerprint of each key; the bits are none of those that choose the shard."""
        words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)
        mask = np.uint32(len(self.slots) - 1)
        mark = (words[:, 2] % np.uint32(65535) + np.uint32(1)).astype(np.uint16)
        one = words[:, 3] & mask
        return one, (one ^ self._step(mark)) & mask, mark

    @staticmethod
    def _step(mark):
        return np.asarray(mark, np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(7)

    def insert(self, keys: list[bytes]) -> bool:
        """Adds keys; false if one finds no place (the filter is then to be built anew, larger)."""
        if not keys:
            return True
        slots, mask = self.slots, len(self.slots) - 1
        for n, (one, two, mark) in enumerate(zip(*(x.tolist() for x in self.places(keys)), strict=True)):
            at = one if 0 in slots[one].tolist() else two
            for kick in range(KICKS):
                free = np.flatnonzero(slots[at] == 0)
                if len(free):
                    slots[at, free[0]] = mark
                    break
                out = (n + kick) % SLOTS
                mark, slots[at, out] = int(slots[at, out]), mark
                at = (at ^ int(self._step(mark))) & mask
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Takes one copy of each key's fingerprint out; the keys must be in."""
        if keys:
            for one, two, mark in zip(*(x.tolist() for x in self.places(keys)), strict=True):
                for at in (one, two):
                    found = np.flatnonzero(self.slots[at] == mark)
                    if len(found):
                        self.slots[at, found[0]] = 0
                        break
                else:
                    raise ValueError("a key to delete isn't in the filter")

    def holds(self, keys: list[bytes]) -> np.ndarray:
        """For each key: false if it isn't in, true if it is or looks like one that is."""
        if not keys:
            return np.zeros(0, bool)
        one, two, mark = self.places(keys)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``key``, ``doc``, ``row``) for each key of each row, once; ``row`` stands for the id and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for i, text in enumerate(b.column("text")):
                own = {key_of(x) for x in (text.as_py() or b"").split(b"\n")} - {None}
                keys += own
                at += [i] * len(own)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("doc").take(taken), b.column("row").take(taken)], ["key", "doc", "row"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "key binary, doc bigint, row binary")


def _narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    doc = F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")
    return docs.select(*more, doc, row_key(id_col, text_col).alias("row"), named(text_col).cast("binary").alias("text"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _streamed(frame: DataFrame, run, schema: str, *order: str) -> DataFrame:
    """``run`` over tasks that get a shard's rows one after the other, in the given order."""
    return frame.repartition(*[c for c in order if c != "kind"]).sortWithinPartitions(*order).mapInArrow(run, schema)


def _filters(changes: DataFrame) -> DataFrame:
    """New filters from rows (shard, kind, key, filter). Kinds: 0 the old filter, 1 a key to take out, 2 a key to put in,
    3 a key that stays (needed only where the filter has to grow)."""

    def finish(shard, old, gone, new, stay) -> pa.RecordBatch:
        table = old or Cuckoo.build([])
        table.delete(gone)
        if not table.insert(new):
            table = Cuckoo.build(stay + new)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([table.raw()], pa.binary())], ["shard", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, old, lists = None, None, {1: [], 2: [], 3: []}
        for b in batches:
            for shard, kind, key, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != at:
                    if at is not None:
                        yield finish(at, old, *lists.values())
                    at, old, lists = shard, None, {1: [], 2: [], 3: []}
                if kind == 0:
                    old = Cuckoo.of(raw)
                else:
                    lists[kind].append(key)
        if at is not None:
            yield finish(at, old, *lists.values())

    return _streamed(changes.select("shard", "kind", "key", "filter"), run, "shard int, filter binary", "shard", "kind")


class LineIndex:
    """One version of an index. ``insert`` and ``delete`` write a new version beside it and return that."""

    def __init__(self, spark: SparkSession, path: str, shards: int, salts: int):
        self.spark, self.path, self.shards, self.salts = spark, path, shards, salts

    @classmethod
    def empty(cls, spark: SparkSession, salts: int = 16) -> LineIndex:
        self = cls(spark, scratch_path(spark, "lines"), 1, salts)
        spark.createDataFrame([], "key binary, doc bigint").write.parquet(f"{self.path}/holders")
        spark.createDataFrame([], "key binary, refs bigint, first bigint").write.parquet(f"{self.path}/counts")
        spark.createDataFrame([], "shard int, filter binary").write.parquet(f"{self.path}/filters")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _next(self, holders: DataFrame, counts) -> LineIndex:
        """Writes the next version. ``counts``: from its holders to its counts."""
        new = LineIndex(self.spark, scratch_path(self.spark, "lines"), self.shards, self.salts)
        holders.write.parquet(f"{new.path}/holders")
        counts(new.table("holders")).write.parquet(f"{new.path}/counts")
        shared = new.table("counts").where("refs > 1").select("key")
        new.shards = max(1, -(-shared.count() // PER_SHARD))
        none = F.lit(None).cast("binary")
        if new.shards != self.shards:  # other shards: from the counts
            changes = shared.select(_shard(new.shards).alias("shard"), F.lit(2).alias("kind"), "key", none.alias("filter"))
        else:
            was = self.table("counts").where("refs > 1").select("key")
            kind = F.when(F.col("old").isNull(), 2).when(F.col("new").isNull(), 1).otherwise(3)
            keys = was.withColumn("old", F.lit(1)).join(shared.withColumn("new", F.lit(1)), "key", "full")
            changes = keys.select(_shard(new.shards).alias("shard"), kind.alias("kind"), "key", none.alias("filter"))
            changes = changes.union(self.table("filters").select("shard", F.lit(0), none, "filter"))
        _filters(changes).write.parquet(f"{new.path}/filters")
        return new

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With the lines of ``docs``; documents that are in already gain what lines they lack."""
        return self.insert_postings(postings(docs, id_col, text_col))

    def insert_postings(self, fresh: DataFrame) -> LineIndex:
        """As ``insert``, from the (key, doc) of documents."""
        return self._next(self.table("holders").union(fresh.select("key", "doc")).distinct(), _counted)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are listed; ids that aren't in are passed over."""
        gone = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")).distinct()
        return self._next(self.table("holders").join(gone, "doc", "left_anti").select("key", "doc"), _counted)

    def dropped(self, asked: DataFrame | None = None) -> DataFrame:
        """The keys whose lines go, as an array ``keys``: for each ``row`` of the postings ``asked``, or, without them, for
        each ``doc`` of the index."""
        by = "doc" if asked is None else "row"
        asked = (self.table("holders") if asked is None else asked).withColumn("of", F.col(by)).distinct()
        none = F.lit(None)
        # A shard's postings are its keys' references.
        size = self.table("counts").groupBy(_shard(self.shards).alias("shard")).agg(F.sum("refs").alias("size"))
        tasks = F.greatest(F.lit(self.salts), F.ceil(F.coalesce("size", F.lit(0)) / PER_TASK)).cast("int")
        size = size.select("shard", tasks.alias("tasks"))
        lines = asked.withColumn("shard", _shard(self.shards)).join(size, "shard", "left")
        salt = F.pmod(F.xxhash64("of", "doc"), F.coalesce("tasks", F.lit(self.salts))).cast("int")
        lines = lines.select("shard", salt.alias("salt"), F.lit(1).alias("kind"), "key", "doc", "of", none.cast("binary").alias("filter"))
        copies = self.table("filters").join(size, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(self.salts)) - 1)))
        copies = copies.select("shard", "salt", F.lit(0).alias("kind"), none.cast("binary"), none.cast("bigint"), none.cast(asked.schema["of"].dataType), "filter")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Cuckoo.build([])
            for b in batches:
                kinds = np.asarray(b.column("kind"))
                loads = np.flatnonzero(kinds == 0).tolist()
                for i, j in zip([0, *loads], [*loads, len(kinds)], strict=True):
                    # Rows i..j follow one filter; the first of them brings it, but for what a batch before has brought.
                    part = b.slice(i, j - i)
                    if len(part) and kinds[i] == 0:
                        table, part = Cuckoo.of(part.column("filter")[0].as_py()), part.slice(1)
                    if len(part):
                        known = pa.array(table.holds(part.column("key").to_pylist()))
                        yield pa.RecordBatch.from_arrays([part.column(c).filter(known) for c in ("key", "doc", "of")], ["key", "doc", "of"])

        kind = asked.schema["of"].dataType.simpleString()
        columns = ("shard", "salt", "kind", "key", "doc", "of", "filter")
        maybe = _streamed(lines.union(copies).select(*columns), run, f"key binary, doc bigint, of {kind}", "shard", "salt", "kind")
        shared = self.table("counts").where("refs > 1")
        return maybe.join(shared, "key").where("doc > first").groupBy(F.col("of").alias(by)).agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Per row: the id, ``n_lines``, ``n_dropped``, ``kept`` (the lines that stay, as bytes) and ``row``, a struct of
        the id and the columns to carry. ``dropped`` holds the keys by ``row`` or by ``doc``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total, lost, texts = [], [], []
                for text, keys in zip(b.column("text"), b.column("keys"), strict=True):
                    raw = text.as_py() or b""
                    lines = raw.split(b"\n")
                    total.append(len(lines))
                    if out := set(keys.as_py() or ()):
                        lines = [x for x in lines if key_of(x) not in out]
                        raw = b"\n".join(lines)
                    lost.append(total[-1] - len(lines))
                    texts.append(raw)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.binary())], ["row", "n_lines", "n_dropped", "kept"]
                )

        carried = F.struct(*[named(c) for c in dict.fromkeys((id_col, *carry))]).alias("carried")
        by = "row" if "row" in dropped.columns else "doc"
        rows = _narrow(docs, id_col, text_col, carried).join(dropped, by, "left").select(F.col("carried").alias("row"), "text", "keys")
        cut = rows.mapInArrow(run, schema_with(rows, "row", "n_lines bigint, n_dropped bigint, kept binary"))
        return cut.select(F.col("row")[id_col].alias(id_col), "n_lines", "n_dropped", "kept", "row")


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc").alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A table against itself: an index of its documents decides over their own lines. Result as ``LineIndex.apply``."""
    lines = materialise(postings(docs, id_col, text_col), "postings")
    index = LineIndex.empty(docs.sparkSession).insert_postings(lines)
    return index.apply(docs, index.dropped(lines), id_col, text_col, carry)
