"""Symbol, peer and industry metrics, for all symbols or industries at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.guards import date_range, iso_day
from barloom.functions.ranks import GROUP_ROWS, with_pct_rank
from barloom.functions.windows import so_far
from barloom.session import materialise

ANNUAL = math.sqrt(252)
RETURN_WINDOWS = (5, 20, 60)


def stock_metrics(panel: DataFrame) -> DataFrame:
    """Last close, period return, annualised volatility, maximum drawdown, mean amount."""
    deep = panel.withColumn("_drawdown", F.try_divide(F.col("close"), F.max("close").over(so_far())) - 1)
    last, first = F.max_by("close", "date"), F.min_by("close", "date")
    return deep.groupBy("code").agg(
        last.alias("latest_close"),
        (F.try_divide(last, first) - 1).alias("period_return"),
        (F.stddev_samp("ret") * ANNUAL).alias("annualized_volatility"),
        F.min("_drawdown").alias("max_drawdown"),
        F.avg("amount").alias("average_turnover"),
        F.count("close").alias("closes"),
    )


def peer_percentiles(panel: DataFrame, dim: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Where a symbol stands in its industry on return, stability and drawdown control."""
    closes = panel.where(F.col("close").isNotNull())
    metrics = stock_metrics(closes).where(F.col("closes") >= 2)
    out = materialise(metrics.join(dim.select("code", "name", "industry_l1"), "code"), "peers")
    for name, value, descending in (
        ("return_percentile", "period_return", False),
        ("stability_percentile", "annualized_volatility", True),
        ("drawdown_control_percentile", "max_drawdown", False),
    ):
        out = with_pct_rank(out, ["industry_l1"], value, name, descending, group_rows)
    return out


def industry_metrics(industry: DataFrame) -> DataFrame:
    """Latest values, five-day amount change and compounded returns per industry."""
    newest = Window.partitionBy("industry_l1").orderBy(F.col("date").desc())
    known = Window.partitionBy("industry_l1", F.col("average_return").isNull()).orderBy(F.col("date").desc())
    ranked = industry.withColumns(
        {
            "_row": F.row_number().over(newest),
            "_known": F.when(F.col("average_return").isNotNull(), F.row_number().over(known)),
        }
    )
    amount = F.col("total_amount")
    latest = lambda c: F.max_by(c, "date")
    recent = F.avg(F.when(F.col("_row") <= 5, amount))
    previous = F.when(F.count(F.lit(1)) >= 10, F.avg(F.when(F.col("_row").between(6, 10), amount)))
    returns = [
        (F.product(F.when(F.col("_known") <= n, 1 + F.col("average_return"))) - 1).alias(f"return_{n}d")
        for n in RETURN_WINDOWS
    ]
    return ranked.groupBy("industry_l1").agg(
        latest("stock_count").alias("stock_count"),
        latest("average_return").alias("latest_return"),
        latest("advancing_ratio").alias("advancing_ratio"),
        latest("total_amount").alias("total_amount"),
        (F.try_divide(recent, previous) - 1).alias("amount_change_5d"),
        *returns,
    )


def recent_window(industry: DataFrame, end=None, days: int = 120) -> DataFrame:
    """Rows of the last calendar days up to ``end``, or up to the last date there is."""
    last = F.lit(iso_day(end)) if end else industry.agg(F.max("date")).scalar()
    return industry.where((F.col("date") <= last) & (F.col("date") >= F.date_sub(last, days)))


def industry_overview(industry: DataFrame, end=None, days: int = 120) -> DataFrame:
    """Industries, trading days, last date, and how many industries advance."""
    window = recent_window(industry, end, days)
    metrics = industry_metrics(window).agg(
        F.count(F.lit(1)).alias("industries"),
        F.count_if(F.col("latest_return") > 0).alias("advancing"),
        F.count_if(F.col("latest_return") <= 0).alias("not_advancing"),
    )
    span = window.agg(F.count_distinct("date").alias("d"), F.max("date").alias("m"))
    return metrics.withColumns(
        {"trading_days": span.select("d").scalar(), "latest_date": span.select("m").scalar()}
    )


def trading_gap_compare(results: DataFrame) -> DataFrame:
    """Strategy against benchmark and the drawdown curve, per scenario and date."""
    w = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return results.select(
        "scenario",
        "date",
        (F.col("cumulative_return") - 1).alias("strategy_return"),
        (F.col("benchmark_cumulative") - 1).alias("benchmark_return"),
        (F.col("equity_curve") / F.max("equity_curve").over(w) - 1).alias("drawdown"),
    )


def holdings_slice(holdings: DataFrame, start=None, end=None) -> DataFrame:
    """Holdings of a date range, sorted, with padded codes and rounded numbers."""
    start, end = date_range(start, end)
    out = holdings
    if start:
        out = out.where(F.col("date") >= F.lit(start))
    if end:
        out = out.where(F.col("date") <= F.lit(end))
    shown = {"quantity": 4, "mark_price": 4, "predicted": 4, "actual": 4}
    rounded = {c: F.round(c, d) for c, d in shown.items() if c in out.columns}
    return out.withColumns({"code": F.lpad("code", 6, "0"), **rounded}).orderBy("date", "code")
