"""Top-k, pages, percentile ranks and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import guards
from barloom.functions.ranks import GROUP_ROWS, running_totals, with_pct_position, with_pct_rank
from barloom.functions.scalars import sentiment_class
from barloom.session import materialise


def topn_per_date(predictions: DataFrame, n: int) -> DataFrame:
    """The n highest predictions of each date, ties by code.

    The rank filter is pushed below the exchange as a group limit, so each task
    sends at most n rows per date.
    """
    guards.positive_int(n)
    w = Window.partitionBy("date").orderBy(F.col("predicted").desc(), F.col("code").asc())
    return predictions.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def pct_average_by_date(panel: DataFrame, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Percentile ranks inside a date, ties sharing theirs."""
    return with_pct_rank(materialise(panel, "ranked"), ["date"], value, "pct_average", group_rows=group_rows)


def pct_first_by_date(panel: DataFrame, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Percentile ranks inside a date, ties in the order of the code."""
    return with_pct_position(materialise(panel, "ranked"), ["date"], value, "code", "pct_first", group_rows)


def rank_by_date(panel: DataFrame, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Both percentile ranks inside a date."""
    return pct_first_by_date(pct_average_by_date(panel, value, group_rows), value, group_rows)


def intraday_change() -> Column:
    return F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100


def movers(panel: DataFrame, day, n: int = 10, gainers: bool = True) -> DataFrame:
    """The largest or smallest intraday changes of one date."""
    change = F.col("pct_change")
    order = change.desc() if gainers else change.asc()
    snapshot = panel.where(F.col("date") == F.lit(day).cast("date")).withColumn("pct_change", intraday_change())
    return snapshot.where(change.isNotNull()).orderBy(order, "code").limit(guards.positive_int(n))


def snapshot_page(snapshot: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of a snapshot, by amount."""
    ordered = snapshot.orderBy(F.col("amount").desc(), "code")
    return guards.row_limit(ordered.offset(guards.offset(offset)), limit)


def snapshot_table(snapshot: DataFrame, board: str | None = None, sort_by: str = "change_pct") -> DataFrame:
    """Display table of one date: intraday change, volume in ten thousands."""
    if sort_by not in ("change_pct", "close", "volume_10k"):
        raise ValueError(f"cannot sort by {sort_by!r}")
    out = snapshot if board is None else snapshot.where(F.col("board") == board)
    return out.select(
        "code", "open", "high", "low", "close", "board",
        F.round(intraday_change(), 2).alias("change_pct"),
        F.round(F.col("volume") / 10000, 2).alias("volume_10k"),
    ).orderBy(F.col(sort_by).desc(), "code")


def latest_n(panel: DataFrame, code: str, n: int) -> DataFrame:
    """The last n rows of one symbol, newest first."""
    rows = guards.positive_int(n, "days")
    return panel.where(F.col("code") == guards.security_code(code)).orderBy(F.col("date").desc()).limit(rows)


def recent_sentiment(panel: DataFrame, code: str, n: int = 10) -> DataFrame:
    return latest_n(panel, code, n).withColumn("status", sentiment_class("sentiment"))


def tail_per_symbol(panel: DataFrame, k: int) -> DataFrame:
    """The last k rows of every symbol; the limit is applied before the exchange."""
    w = Window.partitionBy("code").orderBy(F.col("date").desc())
    return panel.withColumn("_from_end", F.row_number().over(w)).where(F.col("_from_end") <= k).drop("_from_end")


def industry_ranking(metrics: DataFrame, days: int = 20) -> DataFrame:
    """Industries by k-day return; one row per industry."""
    if days not in (5, 20, 60):
        raise ValueError("days must be 5, 20 or 60")
    w = Window.orderBy(F.col(f"return_{days}d").desc_nulls_last(), F.col("industry_l1"))
    return metrics.withColumn("position", F.row_number().over(w))


def stratum_quotas(catalog: DataFrame, size: int) -> DataFrame:
    """How many symbols to draw per industry and board, summing to ``size``.

    Every stratum gets max(1, floor(share)). A surplus is taken back one by one,
    smallest remainder first and, among equals, from the largest quota; a gap is
    filled in rounds, largest remainder first. Both are written as the order of
    single units, so the loop becomes a sort. There are at most ``size`` units.
    """
    guards.positive_int(size, "size")
    strata = catalog.groupBy("industry_l1", "board").agg(F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy(F.lit(1))
    ideal = F.lit(size) * F.col("size") / F.sum("size").over(everything)
    strata = strata.withColumn("ideal", ideal).withColumns(
        {
            "base": F.greatest(F.floor("ideal"), F.lit(1)),
            "remainder": F.col("ideal") - F.floor("ideal"),
        }
    ).withColumn("gap", F.lit(size) - F.sum("base").over(everything))
    names = ["industry_l1", "board"]
    surplus = (
        strata.where((F.col("gap") < 0) & (F.col("base") > 1))
        .select(*names, "gap", "remainder", F.explode(F.sequence(F.lit(2).cast("long"), "base")).alias("level"))
        .withColumn("turn", F.row_number().over(Window.orderBy("remainder", F.col("level").desc(), *names)))
        .where(F.col("turn") <= -F.col("gap"))
        .groupBy(*names).agg((-F.count(F.lit(1))).alias("adjust"))
    )
    rounds = F.least(F.col("size") - F.col("base"), F.col("gap"))
    missing = (
        strata.where((F.col("gap") > 0) & (rounds > 0))
        .select(*names, "gap", "remainder", "size", F.explode(F.sequence(F.lit(1).cast("long"), rounds)).alias("round"))
        .withColumn(
            "turn",
            F.row_number().over(Window.orderBy("round", F.col("remainder").desc(), F.col("size").desc(), *names)),
        )
        .where(F.col("turn") <= F.col("gap"))
        .groupBy(*names).agg(F.count(F.lit(1)).alias("adjust"))
    )
    return strata.join(surplus.unionByName(missing), names, "left").select(
        *names, "size", (F.col("base") + F.coalesce("adjust", F.lit(0))).alias("quota")
    )


def stratified_sample(catalog: DataFrame, size: int, seed: int = 42, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exactly ``size`` symbols covering every stratum, drawn by a seeded hash of the code.

    Strata and codes are not NULL; a code occurs once.
    """
    names = ["industry_l1", "board"]
    draw = F.md5(F.concat_ws(":", F.col("code"), F.lit(str(seed))))
    numbered = catalog.withColumns({"_draw": draw, "_n": F.lit(1)})
    drawn = running_totals(numbered, names, ["_draw", "code"], ["_n"], group_rows)
    chosen = drawn.join(stratum_quotas(catalog, size).select(*names, "quota"), names).where(F.col("below__n") < F.col("quota"))
    ranked = running_totals(chosen.select(*catalog.columns, "_n"), [], [*names, "code"], ["_n"], group_rows)
    return ranked.select(*catalog.columns, (F.col("below__n") + 1).alias("selection_rank"))


def even_downsample(panel: DataFrame, limit: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``limit`` rows evenly spaced in (code, date) order, all rows if there are fewer.

    The row number is the number of rows of smaller codes, a running total
    over buckets of codes, plus the position inside the code. No global sort.
    """
    if guards.positive_int(limit, "limit") < 2:
        raise ValueError("limit must be at least 2")
    sizes = panel.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    starts = running_totals(sizes, [], ["code"], ["n"], group_rows)
    starts = starts.select("code", F.col("below_n").alias("_start"), F.col("all_n").alias("_total"))
    position = F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1
    indexed = panel.withColumn("_pos", position).join(starts, "code").withColumn("_i", F.col("_start") + F.col("_pos"))
    step = (F.col("_total") - 1) / F.lit(float(limit - 1))
    nearest = F.ceil(F.col("_i") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        j = nearest + shift
        landed = F.when(j == limit - 1, F.col("_total") - 1).otherwise(F.floor(j * step))
        hit = hit | ((j >= 0) & (j <= limit - 1) & (landed == F.col("_i")))
    return indexed.where((F.col("_total") <= limit) | hit).withColumn("row_index", F.col("_i")).drop(
        "_pos", "_start", "_total", "_i"
    )
