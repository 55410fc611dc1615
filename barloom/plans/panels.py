"""Frames several query modules start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.factors import drop_warmup, factor_panel, sentiment_ma
from barloom.operators.joins import join_sentiment
from barloom.session import stored_bytes
from barloom.sources.adapter import bars_long, bars_short, sentiment

BYTES_PER_TASK = 8 << 20  # of stored line items, about half a million bars: a task sorts some 100 MB several times


def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Line-item bars with every factor, warm-up rows dropped."""
    bars, tasks = bars_long(spark, sf), panel_tasks(spark, sf)
    return drop_warmup(factor_panel(bars.repartition(tasks, "code") if tasks else bars))


def panel_tasks(spark: SparkSession, sf: str) -> int | None:
    """A number of tasks above the session's, if the input needs one, so that a task's share does not grow with it."""
    tasks = -(-stored_bytes(spark, f"{sf}/lineitem.parquet") // BYTES_PER_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def ranged_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The same panel in ranges of codes: bars are cut before the factors, which keep their partitions."""
    return drop_warmup(factor_panel(ranged(bars_long(spark, sf), panel_tasks(spark, sf))))


def ranged(bars: DataFrame, tasks: int | None) -> DataFrame:
    """Bars in ranges of codes."""
    return bars.repartitionByRange(*([tasks] if tasks else []), "code")


def short_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Event bars with every factor, warm-up rows kept."""
    return factor_panel(bars_short(spark, sf))


def scored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Event bars with factors and the daily sentiment of the same users."""
    return join_sentiment(short_panel(spark, sf), sentiment_ma(sentiment(spark, sf)))
