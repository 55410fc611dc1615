"""Joins of the panel with sentiment, the symbol dimension and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.guards import assert_unique_key, date_range
from barloom.functions.windows import so_far

SENTIMENT_DEFAULTS = ["sentiment", "sentiment_ma5", "sentiment_ma10", "comment_count"]


def join_sentiment(panel: DataFrame, sentiment: DataFrame | None) -> DataFrame:
    """Left join on (code, date); no sentiment is 0 from ``not_available``."""
    if sentiment is None:
        return panel.withColumns(
            {**{c: F.lit(0.0) for c in SENTIMENT_DEFAULTS}, "sentiment_source": F.lit("not_available")}
        )
    joined = panel.join(
        sentiment.select("code", "date", *SENTIMENT_DEFAULTS, F.col("data_source").alias("sentiment_source")),
        ["code", "date"],
        "left",
    )
    return joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in SENTIMENT_DEFAULTS},
            "sentiment_source": F.coalesce("sentiment_source", F.lit("not_available")),
        }
    )


def join_snapshot_dim(panel: DataFrame, dim: DataFrame, day) -> DataFrame:
    """Bars of one date with their symbol's attributes."""
    return panel.where(F.col("date") == F.lit(day).cast("date")).join(dim, "code")


def join_peers(panel: DataFrame, dim: DataFrame, industry: str, start=None, end=None) -> DataFrame:
    """Bars of the detailed symbols of one industry."""
    start, end = date_range(start, end)
    if start:
        panel = panel.where(F.col("date") >= F.lit(start))
    if end:
        panel = panel.where(F.col("date") <= F.lit(end))
    peers = dim.where((F.col("industry_l1") == industry) & (F.col("has_detail") == 1)).select("code", "name", "industry_l1")
    return panel.join(peers, "code")


def join_dim_checked(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Many-to-one join; a dimension with repeated codes is an error, not a fan-out."""
    return panel.join(assert_unique_key(dim, ["code"]), "code", "left")


def join_latest(panel: DataFrame) -> DataFrame:
    """Rows of the last date, by a scalar subquery over the date column only."""
    return panel.where(F.col("date") == panel.agg(F.max("date")).scalar())


def missing_detail(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Symbols with bars that the catalog does not know; has to be empty."""
    return panel.select("code").distinct().join(dim, "code", "left_anti")


def detail_coverage(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """The catalog with has_detail set by whether a symbol has bars."""
    present = panel.select("code").distinct().withColumn("_present", F.lit(1))
    return dim.join(present, "code", "left").withColumn("has_detail", F.coalesce("_present", F.lit(0))).drop("_present")


def calendar(market: DataFrame) -> DataFrame:
    """Trading days in order with their neighbours.

    One row per distinct date, so the unpartitioned window sees at most the
    number of days there are.
    """
    w = Window.orderBy("date")
    return market.select("date").distinct().select(
        "date",
        F.row_number().over(w).alias("position"),
        F.lag("date").over(w).alias("previous_date"),
        F.lead("date").over(w).alias("next_date"),
        F.lead("date", 2).over(w).alias("second_next_date"),
    )


def calendar_next(signals: DataFrame, market: DataFrame) -> DataFrame:
    """Each signal with the next market date, on which it can be executed."""
    days = calendar(market).select("date", F.col("next_date").alias("execution_date"))
    return signals.join(days, "date")


def calendar_reindex(benchmark: DataFrame, market: DataFrame, check: bool = True) -> DataFrame:
    """Benchmark opens on every market date; a gap or a non-positive open is an error."""
    aligned = market.select("date").distinct().join(benchmark.select("date", "open"), "date", "left")
    if check and aligned.where(F.col("open").isNull() | (F.col("open") <= 0)).limit(1).count():
        raise ValueError("benchmark opens do not cover the calendar")
    return aligned


def last_valid_mark(held: DataFrame, market: DataFrame) -> DataFrame:
    """Last valid open of each held symbol on every market date, and whether it is stale.

    ``held`` has one row per symbol with the first date it is held. The grid is
    held symbols times their own days: a join of the calendar on ``date >=
    since`` done with a sequence of dates, not with pairs of all rows.
    """
    days = calendar(market).select("date", "position")
    first = held.join(days.withColumnRenamed("date", "since"), "since").select("code", F.col("position").alias("start"))
    last = days.agg(F.max("position")).scalar()
    grid = first.select("code", F.explode(F.sequence("start", last)).alias("position")).join(days, "position")
    opens = market.where(F.col("open") > 0).select("code", "date", F.col("open").alias("valid_open"))
    return grid.join(opens, ["code", "date"], "left").select(
        "code",
        "date",
        F.last("valid_open", ignorenulls=True).over(so_far()).alias("mark_price"),
        F.col("valid_open").isNull().alias("stale"),
    )


def stale_counts(held: DataFrame, market: DataFrame) -> DataFrame:
    """Held symbols per market date, and how many of them have no valid open that day.

    A sweep over the calendar: symbols enter on their first date, so a running sum over the days counts them, and the
    valid opens of a day are counted where they are. No symbol is laid out over its days.
    """
    days = calendar(market).select("date")
    since = held.join(days.withColumnRenamed("date", "since"), "since", "left_semi")
    entered = since.groupBy(F.col("since").alias("date")).agg(F.count(F.lit(1)).alias("entered"))
    valid = market.where(F.col("open") > 0).select("code", "date").distinct().join(since.select("code", "since"), "code")
    quoted = valid.where(F.col("date") >= F.col("since")).groupBy("date").agg(F.count(F.lit(1)).alias("quoted"))
    daily = days.join(entered, "date", "left").join(quoted, "date", "left")
    held_by = F.sum(F.coalesce("entered", F.lit(0))).over(Window.orderBy("date"))
    counts = daily.withColumn("held", held_by).where(F.col("held") > 0)
    return counts.select("date", "held", (F.col("held") - F.coalesce("quoted", F.lit(0))).alias("stale_price_positions"))
