"""Near-duplicates by SimHash (operator 5).

A fingerprint has 64 bits; two link when at most 2 bits differ. Then at least 6 of their 8 bytes are equal at the same
position, so candidates come from an inverted index over byte positions. Tallying every shared byte per pair would emit
all pairs of a posting list (a 256th of all documents each), so the count filter is put into the index key: one posting
for each choice of 6 positions, with the bytes there. Two fingerprints meet under some key exactly if their tally reaches
6. A list holds distinct fingerprints that differ in 2 bytes only, hence 65,536 at most, whatever the data.

Inside a list links are verified without pairs: each member also stands at the 16 values one bit away (within the two
free bytes), and members that meet at a value differ in 2 bits at most; conversely, those that do meet there. A value
has 17 possible members. Links then run to the smallest member, and components are found by star contraction.

Lower-case is A-Z only, words are parted by ASCII white space, shingles have three words, repeats included; a text of
fewer words is one shingle. Null and empty texts have fingerprint zero and link like any other. Rows alike link, rows
with a null id link too but never name a component (which is null if it has no other id). An empty table gives no rows.
Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import named, schema_with
from barloom.session import materialise

WIDTH = 3  # words in a shingle, unless a caller says otherwise
SEED = 42
BITS = 2  # differing bits that still link
BYTES = 8
BLOCK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a text as an unsigned number."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxh64_digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]  # noqa: B905
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, BYTES)
    ones = sum(np.unpackbits(raw[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(raw), BLOCK))
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: the id and ``fp`` (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or b"", width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], [id_col, "fp"])

    return docs.select(named(id_col), named(text_col).cast("binary").alias(text_col)).mapInArrow(run, schema_with(docs, id_col, "fp bigint"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (``a`` < ``b``) that connect the distinct fingerprints ``fp`` as the relation "at most ``bits`` differing bits"
    does, with the tally of bytes that the two share and their number of differing bits. ``bits`` is even."""
    if bits % 2 or not 0 < bits < BYTES:
        raise ValueError("an even number of bits below 8 is needed")
    free = list(combinations(range(BYTES), bits))  # the byte positions that a key leaves out
    masks = [((1 << 64) - 1) & ~sum(0xFF << (8 * p) for p in left) for left in free]
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("pair", "rest"))
    lists = postings.groupBy("pair", "rest").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    members = lists.select("pair", F.explode("members").alias("fp"))
    # All ways to flip up to half of the bits within the free bytes.
    flips = [sorted({sum(1 << x for x in c) for n in range(bits // 2 + 1) for c in combinations([8 * p + i for p in left for i in range(8)], n)}) for left in free]
    flips = F.array(*[F.array(*[F.lit(_signed(x)) for x in own]) for own in flips])
    values = members.withColumn("flip", F.explode(F.get(flips, F.col("pair")))).select("pair", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = values.groupBy("pair", "value").agg(F.sort_array(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    pairs = met.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, F.size("m") - 1)).alias("b")).distinct()
    differ = F.col("a").bitwiseXOR(F.col("b"))
    equal = sum((differ.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0).cast("int") for p in range(BYTES))
    tallied = pairs.select("a", "b", equal.alias("tally"), F.bit_count(differ).alias("differing"))
    return tallied.where((F.col("tally") >= BYTES - bits) & (F.col("differing") <= bits))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(``node``, ``root``) for each node of the edges (``a``, ``b``) but the smallest of its component, its root.

    Large-star and small-star steps in turn; each round is written to the shared folder, and the rounds end when one
    changes nothing.
    """
    current, before = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), name), None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)


def _rooted(classes: DataFrame, bits: int) -> DataFrame:
    """``classes`` (one row for each ``fp``) with ``root``, one fingerprint for each component."""
    found = components(links(classes.select("fp"), bits))
    return classes.join(found, classes["fp"] == found["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links lead to."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = _rooted(rows.groupBy("fp").agg(F.min(named(id_col)).alias("first")), bits)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select(named(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id, rows without an id last; among equal ids the
    one whose text has the smaller checksum; among rows alike in both any one.

    Rows get a number first and are written with it once, so that whatever ids repeat or lack, one row is meant.
    """
    number = max(docs.columns, key=len, default="") + "_row"  # longer than any column's name
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    key = rows.select(named(number).alias("n"), named(id_col).alias("id"), named(text_col).alias("text"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("sum"), "n")
    found = materialise(fingerprints(key.select(place.alias("place"), "text"), "place", "text", width), "fingerprints")
    rooted = _rooted(found.groupBy("fp").agg(F.min("place").alias("first")), bits)
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias(number))
    return rows.join(stays, number, "left_semi").select([named(c) for c in docs.columns])
