"""Cleaning of raw vendor bars, set-oriented over all symbols at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.guards import require_columns
from barloom.functions.scalars import CODE_PATTERN, count_where, is_valid_code, null_safe, trade_date

RAW_COLUMNS = ["trade_date", "open", "high", "low", "close", "vol", "amount"]
RENAMES = {"trade_date": "date", "vol": "volume"}
MAX_COLUMN_MISSING = 0.05
MAX_ROW_MISSING = 0.10


def standardise_columns(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(RENAMES)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "first") -> DataFrame:
    """One row per key: the first or last in a stated order.

    An aggregate, not a window: duplicates are combined on the map side, so a
    key that holds a large share of all rows never meets in one task. A NULL
    key is a key like any other, as for pandas.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("kept"))
    return kept.select(*[c if c in keys else F.col(f"kept.{c}").alias(c) for c in df.columns])


def parse_trade_dates(raw: DataFrame) -> DataFrame:
    """Only ``yyyyMMdd`` survives; other rows are dropped."""
    return raw.withColumn("trade_date", trade_date("trade_date")).where(F.col("trade_date").isNotNull())


def invalid_date_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("code").agg(F.count_if(trade_date("trade_date").isNull()).alias("invalid_dates"))


def valid_bar(code_pattern: str = CODE_PATTERN) -> Column:
    """Code, date, close, volume and price bounds all in order; missing values make it false."""
    return (
        is_valid_code("code", code_pattern)
        & F.col("date").isNotNull()
        & null_safe(F.col("close") > 0)
        & null_safe(F.col("volume") >= 0)
        & null_safe(F.col("high") >= F.greatest("open", "close"))
        & null_safe(F.col("low") <= F.least("open", "close"))
    )


def valid_bar_filter(bars: DataFrame, code_pattern: str = CODE_PATTERN) -> DataFrame:
    return bars.where(valid_bar(code_pattern))


def broken_ohlc(high: str = "high", low: str = "low") -> Column:
    h, lo = F.col(high), F.col(low)
    bad = null_safe(h < lo)
    for other in ("open", "close"):
        bad = bad | null_safe(h < F.col(other)) | null_safe(lo > F.col(other))
    return bad


def anomaly_counts(raw: DataFrame) -> DataFrame:
    """Per symbol, counted and not dropped."""
    return raw.groupBy("code").agg(
        count_where(F.col("close") <= 0).alias("nonpositive_close"),
        count_where(F.col("vol") < 0).alias("negative_volume"),
        F.count_if(broken_ohlc()).alias("broken_ohlc"),
    )


def missing_rates(df: DataFrame, columns: Sequence[str], limit: float = MAX_COLUMN_MISSING) -> DataFrame:
    """Share of missing cells per symbol and column, and whether the column goes."""
    wide = df.groupBy("code").agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot("code", list(columns), "column_name", "missing_rate").withColumn(
        "dropped", F.col("missing_rate") > limit
    )


def drop_sparse(
    df: DataFrame,
    columns: Sequence[str],
    max_column: float = MAX_COLUMN_MISSING,
    max_row: float = MAX_ROW_MISSING,
) -> DataFrame:
    """Blank a symbol's sparse columns, then drop its rows with too many missing cells.

    A frame cannot lose a column for some symbols only, so a dropped column is
    NULL for those. The row limit counts kept columns. The verdict per symbol
    comes from a small aggregate joined back; Spark broadcasts it only while it
    is under its size threshold.
    """
    verdict = df.groupBy(F.col("code").alias("_code")).agg(
        *[(F.avg(F.col(c).isNull().cast("int")) <= max_column).alias(f"_keep_{c}") for c in columns]
    )
    joined = df.join(verdict, df["code"].eqNullSafe(verdict["_code"]))
    kept = sum((F.col(f"_keep_{c}").cast("int") for c in columns), F.lit(0))
    missing = sum(((F.col(f"_keep_{c}") & F.col(c).isNull()).cast("int") for c in columns), F.lit(0))
    return joined.where(missing <= kept * max_row).select(
        *[F.when(F.col(f"_keep_{c}"), F.col(c)).alias(c) if c in columns else c for c in df.columns]
    )


def clean(raw: DataFrame, order: Sequence[Column | str], columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """First row per day, parsed dates, sparse columns and rows out, clean names.

    ``columns`` are the cells that count for the missing rates; name all columns
    the vendor delivers.
    """
    require_columns(raw, ["code", *RAW_COLUMNS])
    unique = dedup(raw, ["code", "trade_date"], order, keep="first").select("code", *columns)
    return standardise_columns(drop_sparse(parse_trade_dates(unique), columns))


def quarantine(verdicts: DataFrame) -> DataFrame:
    """Reason why an input goes to the invalid set, NULL when it is fine.

    ``verdicts`` has one row per input: row_count, columns (array), bad_dates.
    """
    lacking = F.array_except(F.array(*[F.lit(c) for c in RAW_COLUMNS]), F.col("columns"))
    return verdicts.withColumn(
        "reason",
        F.when(F.col("row_count") == 0, "empty")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.concat_ws(",", lacking)))
        .when(F.col("bad_dates") == F.col("row_count"), "no readable dates"),
    )


def symbol_verdicts(raw: DataFrame) -> DataFrame:
    """One verdict row per symbol; a column that is never filled counts as absent."""
    present = [F.when(F.count(c) > 0, F.lit(c)) for c in RAW_COLUMNS]
    return raw.groupBy("code").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array_compact(F.array(*present)).alias("columns"),
        F.count_if(trade_date("trade_date").isNull()).alias("bad_dates"),
    )


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before and after, duplicates, removed rows and date range per symbol."""
    before = raw.groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(
        F.sum("n").alias("original_count"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates_removed"),
        F.count_if(trade_date("trade_date").isNull()).alias("invalid_dates"),
    )
    after = cleaned.groupBy("code").agg(
        F.count(F.lit(1)).alias("final_count"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )
    report = before.join(after, "code", "left").withColumn("final_count", F.coalesce("final_count", F.lit(0)))
    removed = F.col("original_count") - F.col("duplicates_removed") - F.col("invalid_dates") - F.col("final_count")
    return report.withColumn("removed_rows", removed)


def cleaning_totals(verdicts: DataFrame) -> DataFrame:
    """Number of valid and invalid inputs and the valid share."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_inputs"),
        F.count_if(F.col("reason").isNull()).alias("valid_inputs"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_inputs"),
    ).withColumn("valid_rate", F.coalesce(F.try_divide("valid_inputs", "total_inputs"), F.lit(0.0)))
