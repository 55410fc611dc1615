"""Batch updates: watermark, unit conversion, overlap check, merge, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.guards import require_columns, safe_columns
from barloom.functions.scalars import as_number, exchange_suffix, iso_date, normalise_code
from barloom.operators.cleaning import dedup
from barloom.operators.factors import prev_close_change
from barloom.session import materialise
from barloom.sources.sinks import write_partitioned

OVERLAP_DAYS = 10
TOLERANCE = 1e-6
CHECKED = ["close", "volume", "amount"]


def unit_convert(vendor: DataFrame) -> DataFrame:
    """Shares to lots, currency units to thousands, code to ``code.exchange``."""
    require_columns(vendor, ["code", "date", "open", "high", "low", "close", "volume", "amount"])
    return vendor.select(
        F.concat_ws(".", F.col("code"), exchange_suffix("code")).alias("ts_code"),
        F.date_format("date", "yyyyMMdd").alias("trade_date"),
        *[as_number(c).alias(c) for c in ("open", "high", "low", "close")],
        (as_number("volume") / 100).alias("vol"),
        (as_number("amount") / 1000).alias("amount"),
    ).where(F.col("trade_date").isNotNull() & F.col("close").isNotNull())


def watermark_window(stored: DataFrame, overlap_days: int = OVERLAP_DAYS) -> DataFrame:
    """Where an update has to start per symbol: last stored day minus an overlap."""
    return stored.groupBy("code").agg(F.max("date").alias("last_date")).withColumn(
        "start_date", F.date_sub("last_date", overlap_days)
    )


def reconcile_overlap(old: DataFrame, new: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Largest relative difference per symbol and column over days both sides hold."""
    delta = lambda c: F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) / F.greatest(F.abs(F.col(f"o.{c}")), F.lit(1.0))
    both = old.alias("o").join(new.alias("n"), ["code", "date"])
    worst = both.groupBy("code").agg(*[F.max(delta(c)).alias(c) for c in CHECKED])
    return worst.unpivot("code", CHECKED, "column_name", "max_relative_delta").withColumn(
        "rejected", F.coalesce(F.col("max_relative_delta") > tolerance, F.lit(False))
    )


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union, the new row wins a day, previous close and changes recomputed."""
    columns = ["code", "date", "open", "high", "low", "close", "volume", "amount"]
    both = old.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    merged = dedup(both, ["code", "date"], ["_new", *columns[2:]], keep="last").drop("_new")
    return prev_close_change(merged)


def update_history(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged history of accepted symbols and a status per symbol.

    A rejected symbol keeps its old rows; a symbol without new rows is ``no_data``.
    """
    rejected = reconcile_overlap(old, new).where("rejected").select("code").distinct()
    accepted = new.join(rejected, "code", "left_anti")
    status = (
        old.select("code").distinct()
        .join(new.select("code", F.lit(True).alias("_new")).distinct(), "code", "left")
        .join(rejected.withColumn("_bad", F.lit(True)), "code", "left")
        .select(
            "code",
            F.when(F.col("_bad"), "failed").when(F.col("_new"), "updated").otherwise("no_data").alias("status"),
        )
    )
    return merge_history(old, accepted), status


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("symbols"))


def benchmark_merge(index_bars: DataFrame, end_date, order: Sequence[Column | str]) -> DataFrame:
    """Index bars up to a day, the last row per day, compact dates."""
    kept = dedup(index_bars.where(F.col("date") <= F.lit(end_date)), ["date"], order, keep="last")
    return kept.select(
        F.date_format("date", "yyyyMMdd").alias("trade_date"),
        "open", "high", "low", "close",
        F.col("volume").alias("vol"),
    )


def prepare_batch(batch: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows without a usable key out, last row per key in."""
    require_columns(batch, ["code", "date"])
    safe_columns(batch.columns)
    keyed = batch.where(F.col("code").isNotNull()).withColumns(
        {"code": normalise_code("code"), "date": iso_date("date")}
    )
    return dedup(keyed.where(F.col("date").isNotNull()), ["code", "date"], order, keep="last")


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Keyed merge: columns of the batch overwrite, also with NULL; the rest stays.

    ``batch`` comes from ``prepare_batch`` and both sides are unique on
    (code, date), so the full join is one to one and cannot fan out.
    """
    keys = ["code", "date"]
    arrived = F.col("n._arrived").isNotNull()
    joined = stored.alias("o").join(batch.withColumn("_arrived", F.lit(1)).alias("n"), keys, "full")
    out: list[Column] = [F.col(k) for k in keys]
    for name in [c for c in stored.columns if c not in keys]:
        value = F.col(f"o.{name}")
        out.append((F.when(arrived, F.col(f"n.{name}")).otherwise(value) if name in batch.columns else value).alias(name))
    out += [F.col(f"n.{name}") for name in batch.columns if name not in stored.columns]
    return joined.select(*out)


def upsert_by_year(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Merge a batch from ``prepare_batch`` into a table partitioned by year, and return the table.

    Only the years that the batch holds are read, merged and replaced; the files of the others stay as they are. The merged
    years are written aside first, so an update that is broken off is repeated without harm: it merges the same rows again.
    New columns of the batch are NULL in years that it does not touch.
    """
    dated = batch.withColumn("year", F.year("date"))
    years = [r[0] for r in dated.select("year").distinct().collect()]
    stored = spark.read.option("mergeSchema", True).parquet(path)
    if years:
        # Keys have their year with them, so partitions prune and rows can't change theirs.
        touched = stored.where(F.col("year").isin(years)).drop("year")
        merged = upsert(touched, batch).withColumn("year", F.year("date"))
        write_partitioned(materialise(merged, "upsert"), path)
    return spark.read.option("mergeSchema", True).parquet(path)
