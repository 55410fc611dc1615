"""Ranks, positions and medians inside groups of any size.

A group whose distinct values number ``GROUP_ROWS`` at most is ordered by one window. A larger one is cut into buckets at
values of its own: a seeded hash draws about ``CUTS`` of them, whatever the distribution. Then counts per bucket give what
lies before each bucket, a window inside the bucket gives the rest, and no task orders a whole group. Rows are combined per
distinct value first, so ties, however many, are one row. The hash decides only where the cuts are, never a result.

``average_rank`` and ``pct_rank_*`` are the same for groups that a caller knows to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import col
from barloom.session import materialise


def average_rank(value: Column | str, by: Sequence[Column | str], descending: bool = False) -> Column:
    """1-based rank, ties share the mean of their positions."""
    value = col(value)
    order = value.desc() if descending else value.asc()
    w = Window.partitionBy(*by).orderBy(order)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2.0


def pct_rank_average(value: Column | str, by: Sequence[Column | str], descending: bool = False) -> Column:
    """Average rank over the number of non-missing values; NULL stays NULL."""
    value = col(value)
    present = [*by, value.isNull()]
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull(), average_rank(value, present, descending) / n)


def pct_rank_first(value: Column | str, tie: Column | str, by: Sequence[Column | str]) -> Column:
    """Position over count, ties broken by ``tie``."""
    value = col(value)
    w = Window.partitionBy(*by, value.isNull()).orderBy(value.asc(), col(tie).asc())
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull(), F.row_number().over(w) / n)


GROUP_ROWS = 100_000  # distinct values of a group that one task may order
CUTS = 256  # about so many cuts of a larger group
BROADCAST_GROUPS = 1000  # so many groups' cuts, a few MB, may be broadcast; more are joined by a shuffle


def _bucketed(df: DataFrame, by: list[str], order: list[str], group_rows: int) -> DataFrame | None:
    """``df`` with ``_bucket``, which follows the order inside a group; nothing if all groups are small."""
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > group_rows)
    n_large = large.count()
    if not n_large:
        return None
    hint = F.broadcast if n_large <= BROADCAST_GROUPS else lambda x: x
    drawn = df.join(hint(large), by).where(F.pmod(F.xxhash64(*order), F.ceil(F.col("_rows") / CUTS)) == 0)
    cuts = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_cuts"))
    place = F.struct(*order)
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < place)))
    return df.join(hint(cuts), by, "left").withColumn("_bucket", bucket).drop("_cuts")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], measures: Sequence[str], group_rows: int = GROUP_ROWS, only=None
) -> DataFrame:
    """``df`` with, for each measure, ``below_*`` (its sum over rows of the group that come before) and ``all_*`` (over the
    whole group). Rows are unique on (``by``, ``order``), and none of these is NULL. Without ``by`` all rows are one group.

    ``only`` takes the totals before a bucket, inside it and of its group (functions of a measure's name) and tells which
    buckets are wanted; it may let more through.
    """
    names, by, order = df.columns, list(by), list(order)
    if not by:
        df, by = df.withColumn("_one", F.lit(1)), ["_one"]
    df = materialise(df, "totals")
    bucketed = _bucketed(df, by, order, group_rows)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if bucketed is None:
        sums = [F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"below_{m}") for m in measures]
        return df.select(*names, *sums, *[F.sum(m).over(Window.partitionBy(*by)).alias(f"all_{m}") for m in measures])
    skipped = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    per_bucket = per_bucket.select(
        *by, "_bucket", *[f"_in_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_in_{m}").over(skipped), F.lit(0)).alias(f"_skip_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(Window.partitionBy(*by)).alias(f"all_{m}") for m in measures],
    )
    if only is not None:
        per_bucket = per_bucket.where(only(lambda m: F.col(f"_skip_{m}"), lambda m: F.col(f"_in_{m}"), lambda m: F.col(f"all_{m}")))
    near = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.col(f"_skip_{m}") + F.coalesce(F.sum(m).over(near), F.lit(0))).alias(f"below_{m}") for m in measures]
    return bucketed.join(per_bucket, [*by, "_bucket"]).select(*names, *sums, *[f"all_{m}" for m in measures])


def rank_table(df: DataFrame, by: Sequence[str], value: str, descending: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(``by``, ``value``, ``rank``, ``of``) for each distinct value: its rank, ties sharing the mean of their positions,
    and how many values the group has."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    key = -F.col(value) if descending else F.col(value)
    totals = running_totals(counts.withColumn("_key", key), by, ["_key"], ["n"], group_rows)
    return totals.select(*by, value, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("rank"), F.col("all_n").alias("of"))


def with_pct_rank(df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with ``name``: the average rank over the number of values; NULL stays NULL. ``df`` is read twice."""
    ranks = rank_table(df, by, value, descending, group_rows).select(*by, value, (F.col("rank") / F.col("of")).alias(name))
    return df.join(ranks, [*by, value], "left").select(*df.columns, name)


def with_pct_position(df: DataFrame, by: Sequence[str], value: str, tie: str, name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df``, unique on (``by``, ``tie``), with ``name``: position over count, ties broken by ``tie``; NULL stays NULL."""
    valued = df.where(F.col(value).isNotNull()).select(*by, value, tie, F.lit(1).alias("n"))
    places = running_totals(valued, by, [value, tie], ["n"], group_rows)
    places = places.select(*by, tie, ((F.col("below_n") + 1) / F.col("all_n")).alias(name))
    return df.join(places, [*by, tie], "left").select(*df.columns, name)


def group_median(df: DataFrame, by: Sequence[str], value: str, name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(``by``, ``name``): the exact median of each group that has a value.

    The buckets that hold the middle positions are found from bucket counts; only their values are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    holds = lambda before, inside, of: (before < F.floor(of / 2) + 1) & (before + inside >= F.ceil(of / 2))
    totals = running_totals(counts, by, [value], ["n"], group_rows, lambda before, inside, of: holds(before("n"), inside("n"), of("n")))
    middle = totals.where(holds(F.col("below_n"), F.col("n"), F.col("all_n")))
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(name))
