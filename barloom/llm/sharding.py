"""Reproducible shuffle into shards (operator 6), in column expressions only.

Rows get global numbers 0 to n-1, a keyed permutation of those numbers gives each its place, and the place p is slot
p div k of shard p mod k; so shard sizes differ by one row at most, and shard and slot of a number (and the number that
sits at a shard and slot) can be computed without the table. The permutation is a Feistel network over pairs (left,
right) with left below a and right below b, where a and b are about the root of n: each round adds a keyed hash of one
half to the other, modulo its bound. a times b exceeds n by less than a, and a place beyond n-1 is walked on along its
cycle until it falls inside.

Row numbers don't need one sorted sequence: rows that agree in all columns are counted first, and what is distinct is dealt
to ``BUCKETS`` by a hash of id and text. Within a bucket counts are summed up by (id, digest of the text), and the buckets'
sizes, summed up in order, are added (a window over at most ``BUCKETS`` rows). The copies then take the numbers of their
stretch, ``STRETCH`` at a time over all tasks, so no task holds the copies of one document, however many there are. The
numbers, and so the shuffle, depend on the rows alone, not on files or partitions.

A null text has no bytes. Rows with a null id are numbered by their text. Rows alike in id and text are interchangeable:
they fill their places in any order, with the same result. An empty table gives no rows. ``assign`` passes other columns on
untouched; their types must be ones that can be grouped by (no maps).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import let, named
from barloom.session import materialise

BUCKETS = 16384
STRETCH = 100_000
ROUNDS = 6
WALK = 40


def _sides(n: int) -> tuple[int, int]:
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _round(x: Column, of: Column, bound: int, seed: int, r: int, sign: int) -> Column:
    mixed = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), of), F.lit(bound))
    return F.pmod(x + sign * mixed, F.lit(bound))


def _network(p: Column, n: int, seed: int, inverse: bool) -> Column:
    """One pass of the network over 0..a*b-1."""
    a, b = _sides(n)
    sign = -1 if inverse else 1

    def turn(r: int):
        def even(h: Column) -> Column:
            return F.struct(_round(h["l"], h["r"], a, seed, r, sign).alias("l"), h["r"].alias("r"))

        def odd(h: Column) -> Column:
            return F.struct(h["l"].alias("l"), _round(h["r"], h["l"], b, seed, r, sign).alias("r"))

        return odd if r % 2 else even

    # Divisions without remainder, exact for anything below 2**53 rows.
    halves = F.struct(((p - F.pmod(p, F.lit(b))) / b).cast("long").alias("l"), F.pmod(p, F.lit(b)).alias("r"))
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):

        halves = let(halves, turn(r))
    return let(halves, lambda h: h["l"] * b + h["r"])


def _walk(p: Column, n: int, seed: int, inverse: bool) -> Column:
    """The network again and again until the value is below n: fewer than a values lie beyond, so one step nearly always
    does. ``WALK`` covers every cycle of small tables and all that is likely in large ones; past it the job fails rather
    than place a row wrongly."""
    once = _network(p, n, seed, inverse)
    on = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), x, lambda acc, _: F.when(acc < n, acc).otherwise(_network(acc, n, seed, inverse))
    )
    checked = lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no place within the walk")).cast("long"))
    return let(once, lambda x: F.when(x < n, x).otherwise(let(on(x), checked)))


def place(number: Column, n: int, seed: int = 0) -> Column:
    """Where row ``number`` of ``n`` goes."""
    return _walk(number.cast("long"), n, seed, False)


def number_at(place: Column, n: int, seed: int = 0) -> Column:
    """Which row goes to ``place``: the inverse."""
    return _walk(place.cast("long"), n, seed, True)


def alike(rows: DataFrame) -> DataFrame:
    """Rows that agree in all columns as one, with their number ``_copies``; combined before they are exchanged."""
    return rows.groupBy(*[named(c) for c in rows.columns]).agg(F.count("*").alias("_copies"))


def numbered(docs: DataFrame, id_col: str = "doc_id", digest_col: str = "digest", out: str = "number") -> tuple[DataFrame, int]:
    """``docs`` with a global row number, and the number of rows. ``docs`` may come as rows of ``alike``."""
    rows = docs if "_copies" in docs.columns else alike(docs)
    columns = [c for c in rows.columns if c != "_copies"]
    bucket = F.pmod(F.xxhash64(named(id_col), named(digest_col)), F.lit(BUCKETS)).cast("int")
    sizes = rows.groupBy(bucket.alias("_bucket")).agg(F.sum("_copies").alias("_rows"), F.max("_copies").alias("_most"))
    whole = sizes.agg(F.sum("_rows").alias("rows"), F.max("_most").alias("most")).first()
    before = F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_bucket", F.coalesce(before, F.lit(0).cast("long")).alias("_start"))
    order = Window.partitionBy("_bucket").orderBy(named(id_col), named(digest_col), F.xxhash64(*[named(c) for c in columns]))
    own = F.coalesce(F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_bucket", bucket).withColumn("_own", own).join(starts, "_bucket")
    placed = placed.select(*[named(c) for c in columns], (F.col("_start") + F.col("_own")).alias("_first"), "_copies")
    # Copies are laid out by stretches, those of large groups over all tasks.
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(STRETCH).cast("long"))).alias("_from")
    parts = placed.select("*", stretch)
    if (whole["most"] or 0) > STRETCH:
        # As many tasks as the rows to come need: a stretch itself is a few bytes, too little for Spark to go by.
        parts = parts.repartition(-(-whole["rows"] // (10 * STRETCH)), "_first", "_from")
    last = F.least(F.col("_from") + STRETCH, F.col("_copies")) - 1
    each = F.explode(F.sequence(F.col("_first") + F.col("_from"), F.col("_first") + last)).alias(out)
    return parts.select(*[named(c) for c in columns], each), whole["rows"] or 0


def assign(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", digest_col: str = "digest") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (these names and those starting with _ must be free)."""
    rows, n = numbered(docs, id_col, digest_col, "_number")
    at = rows.withColumn("_place", place(F.col("_number"), max(n, 1), seed))
    shard, slot = F.pmod("_place", F.lit(shards)).cast("int"), ((F.col("_place") - F.pmod("_place", F.lit(shards))) / shards).cast("long")
    return at.withColumn("shard", shard).withColumn("slot", slot).drop("_number", "_place")


def shuffled(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``facts`` with ``shard`` and ``slot``. Texts are read once: what is numbered is a written table of the facts."""
    return assign(materialise(alike(facts(docs, id_col, text_col)), "facts"), shards, seed, id_col)


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, without its text: the id, ``size`` (bytes of the text and 16), ``text_crc32`` and a 128-bit ``digest``."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    return docs.select(
        named(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest")
    )
