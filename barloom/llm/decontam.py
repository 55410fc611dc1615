"""Benchmark decontamination by a prefix-filtered set join (operator 2).

An item's windows are its runs of ``WINDOW`` words (all of it, if it has fewer). A window is a set of word shingles, and to
contain it a document needs all of them, so the necessary prefix is one shingle: the rarest, by counts over all documents.
Documents keep only the positions of such prefix shingles, which join the windows; a pair passes the length bound (the
document is at least as long) and the positional bound (the window fits around the position), and the words are then
compared one by one over the window.

Documents are scanned twice (counts, then positions); shingles of no window are left out by a bitmap of a fixed
``BITS`` bits, the only thing that is broadcast. A larger benchmark fills it and lets more through, never less.

Words are lower-cased for A-Z only. A null or empty text has no words; an item without words has no windows. Items alike
are found together; repeated rows of documents get equal results, and rows that share an id but not the text their own.
An empty benchmark marks nothing. Null item ids take part as the text "null". Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let, named, row_key
from barloom.session import materialise

WINDOW = 10
SHINGLE = 3
BITS = 1 << 24  # of the bitmap: 2 MB
_PAGE = 32768  # bits that Spark's bitmap functions keep in one row
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # of lower-cased UTF-8: all but the excluded ASCII characters

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS((text or b"").lower())


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], np.uint64)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """A signed 64-bit value for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + n]) * _MUL[i % len(_MUL)]
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(``item``, ``words``, ``size``, ``shingles``) for each window; the shingles are in the order of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                hashes, long = hashes_of(words), min(size, len(words))
                for i in range(len(words) - long + 1 if words else 0):
                    for column, value in zip(out, (item, b" ".join(words[i : i + long]).decode(), long, shingles_of(hashes[i : i + long], min(SHINGLE, long))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["item", "words", "size", "shingles"]
            )

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item string, words string, size int, shingles array<bigint>")


class Bitmap:
    """Which of ``BITS`` residues any of some shingles has. Made by an aggregate; its size doesn't depend on them."""

    def __init__(self, shingles: DataFrame):
        at = shingles.select(F.pmod("shingle", F.lit(BITS)).alias("at"))
        page, bit = F.floor(F.col("at") / _PAGE).cast("int"), F.pmod("at", F.lit(_PAGE))
        rows = at.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
        whole = np.zeros(BITS // 8, np.uint8)
        for r in rows:
            whole[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
        self.shared = shingles.sparkSession.sparkContext.broadcast(whole)

    @staticmethod
    def has(whole: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        at = shingles & np.int64(8 * len(whole) - 1)
        return (whole[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _frequencies(docs: DataFrame, widths: list[int], wanted: DataFrame, text_col: str) -> DataFrame:
    """(``shingle``, ``seen``): occurrences in all documents, for shingles that the bitmap of the wanted ones lets through."""
    shared = Bitmap(wanted).shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for text in b.column(0):
                hashes = hashes_of(words_of(text.as_py()))
                for width in widths:
                    all_of = shingles_of(hashes, width)
                    found.append(all_of[Bitmap.has(whole, all_of)])
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["shingle", "seen"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "shingle bigint, seen bigint")
    return counted.groupBy("shingle").agg(F.sum("seen").alias("seen"))


def _positions(docs: DataFrame, widths: list[int], prefixes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``row``, the id, ``n_words`` and ``at``, the positions of prefix shingles with the words around them."""
    shared = Bitmap(prefixes).shared
    near = pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        for b in batches:
            counts, places = [], []
            for text in b.column(2):
                words = words_of(text.as_py())
                hashes, found = hashes_of(words), []
                for width in widths:
                    all_of = shingles_of(hashes, width)
                    for i in np.flatnonzero(Bitmap.has(whole, all_of)).tolist():
                        low = max(0, i - size + width)
                        found.append({"shingle": int(all_of[i]), "place": i, "before": i - low, "words": [w.decode() for w in words[low : i + size]]})
                counts.append(len(words))
                places.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(places, pa.list_(near))], ["row", id_col, "n_words", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row binary, `{id_col}` {kind}, n_words bigint, at array<struct<shingle:bigint,place:bigint,before:int,words:array<string>>>"
    return docs.select(row_key(id_col, text_col).alias("row"), id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _occurrences(docs: DataFrame, items: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, the rows of ``docs`` by key, and (``row``, ``a``, ``b``, ``words``): where windows occur in them."""
    made = materialise(windows_of(items, size, item_col, item_text), "windows")
    windows = made.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    tokens = windows.select("words", "size", F.posexplode("shingles").alias("offset", "shingle"))
    widths = sorted(r[0] for r in made.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most
    seen = _frequencies(docs, widths, tokens.select("shingle"), text_col)
    # A window with a shingle that no document has occurs nowhere.
    ranked = tokens.join(seen, "shingle", "left").groupBy("words", "size").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("rarest"))
    prefixes = materialise(ranked.where("rarest.seen > 0").select("words", "size", "rarest.shingle", "rarest.offset"), "prefixes")
    rows = materialise(_positions(docs, widths, prefixes, size, id_col, text_col), "positions")

    pairs = rows.select("row", "n_words", F.explode("at").alias("p")).join(prefixes, F.col("p.shingle") == F.col("shingle"))
    start = F.col("p.place") - F.col("offset")
    local = F.col("p.before") - F.col("offset")
    near = pairs.where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (local >= 0))
    hits = near.where(F.array_join(F.slice("p.words", local + 1, F.col("size")), " ") == F.col("words")).select("row", start.alias("a"), (start + F.col("size")).alias("b"), "words")
    return made, rows, materialise(hits.distinct(), "hits")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_hit`` (words inside a window's occurrence), ``items`` (sorted ids, as
    strings, of items with such windows) and ``contaminated``."""
    made, rows, hits = _occurrences(docs, items, size, id_col, text_col, item_col, item_text)
    # Words inside any of a row's intervals: each, in order, adds what lies beyond the furthest end so far.
    covered = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = covered.select("row", let(F.col("spans"), lambda s: F.aggregate(s, zero, step)["n"]).alias("n_hit"))
    whose = hits.select("row", "words").distinct().join(made.select("words", "item").distinct(), "words").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    marked = rows.drop("at").join(covered, "row", "left").join(whose, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return marked.select(id_col, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item.

    Each row is decided by its own id and text: rows that share an id, or have none, stay or go on their own account.
    """
    *_, hits = _occurrences(docs, items, size, id_col, text_col, item_col, item_text)
    hit = hits.select(F.col("row").alias("hit_row")).distinct()
    return docs.join(hit, row_key(id_col, text_col) == hit["hit_row"], "left_anti").select([named(c) for c in docs.columns])
