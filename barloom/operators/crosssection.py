"""Per-date and per-industry aggregates and the factor information coefficient."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.guards import date_range, require_columns
from barloom.functions.ranks import GROUP_ROWS, group_median, rank_table
from barloom.functions.scalars import board_of, safe_corr, sentiment_class
from barloom.functions.windows import lag
from barloom.session import materialise

# The factors whose daily information coefficient is published.
IC_FACTORS = [
    "ret_5d", "momentum_20d", "reversal_5d", "ma5_ma10_diff", "ma5_ma20_diff", "macd", "rsi",
    "volatility_20d", "volatility_60d", "bb_position", "volume_ratio", "amount_ratio",
    "high_low_ratio", "close_open_ratio", "sentiment", "sentiment_ma5", "sentiment_ma10",
]
MIN_PAIRS = 3
Stage = Callable[[DataFrame, str], DataFrame]  # what is done with rows that are read several times
_MEASURED = ("code", "date", "close", "volume", "amount", "ret")


def _totals(df: DataFrame) -> dict[str, Column]:
    # The panel is unique on (code, date): rows of a date are its symbols.
    return {
        "stock_count": F.count("code"),
        "total_volume": F.coalesce(F.sum("volume"), F.lit(0.0)),
        "total_amount": F.coalesce(F.sum("amount"), F.lit(0.0)),
        "average_close": F.avg("close"),
        "average_return": F.avg("ret"),
        "average_sentiment": F.avg("sentiment") if "sentiment" in df.columns else F.max(F.lit(None).cast("double")),
    }


def _with_median(daily: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    medians = group_median(rows, by, "ret", "median_return")
    return daily.join(medians, by, "left")


def as_stored(rows: DataFrame, name: str) -> DataFrame:
    """In place of ``materialise`` where the panel is a written table: its columns are read again instead of copied."""
    return rows


def market_daily(panel: DataFrame, stage: Stage = materialise) -> DataFrame:
    """One row per date: breadth, totals, means and the median return."""
    rows = stage(panel.select(*_MEASURED, *[c for c in ("sentiment",) if c in panel.columns]), "market")
    moved = F.coalesce("ret", F.lit(0.0))
    daily = rows.groupBy("date").agg(
        *[c.alias(n) for n, c in _totals(rows).items()],
        F.count_if(moved > 0).alias("advancing_count"),
        F.count_if(moved < 0).alias("declining_count"),
        F.count_if(moved == 0).alias("flat_count"),
    )
    return _with_median(daily, rows, ["date"])


def industry_daily(panel: DataFrame, dim: DataFrame, stage: Stage = materialise) -> DataFrame:
    """One row per industry and date, with the share of advancing symbols.

    Symbols the dimension does not know have no industry and drop out, as they
    do in a pandas groupby.
    """
    work = panel.join(dim.select("code", "industry_l1"), "code").where(F.col("industry_l1").isNotNull())
    rows = stage(work.select("industry_l1", *_MEASURED, *[c for c in ("sentiment",) if c in panel.columns]), "industry")
    advancing = F.count_if(F.coalesce("ret", F.lit(0.0)) > 0)
    daily = rows.groupBy("industry_l1", "date").agg(
        *[c.alias(n) for n, c in _totals(rows).items()],
        (advancing / F.greatest(F.count("code"), F.lit(1))).alias("advancing_ratio"),
    )
    return _with_median(daily, rows, ["industry_l1", "date"])


def market_from_industry(industry: DataFrame) -> DataFrame:
    """Second-level rollup: count-weighted means of industry rows."""
    n = F.col("stock_count")
    weighted = ["average_close", "average_return", "median_return", "average_sentiment"]
    daily = industry.groupBy("date").agg(
        F.sum(n).alias("stock_count"),
        F.sum(F.rint(F.col("advancing_ratio") * n).cast("long")).alias("advancing_count"),
        F.coalesce(F.sum("total_volume"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("total_amount"),
        *[(F.coalesce(F.sum(F.col(c) * n), F.lit(0.0)) / F.sum(n)).alias(c) for c in weighted],
    )
    return daily.withColumns({"declining_count": n - F.col("advancing_count"), "flat_count": F.lit(0)})


def factor_ic(
    panel: DataFrame, factors: Sequence[str] = IC_FACTORS, group_rows: int = GROUP_ROWS, stage: Stage = materialise
) -> DataFrame:
    """Daily Spearman correlation of each factor with the next day's return.

    What it needs of the panel is written once and counted. While no date has more than ``group_rows`` symbols, rows are
    sent to their date as they are, and a date's columns are ranked there one by one. Beyond that, rows are unfolded to
    (factor, value, label) and ranks come from ``rank_table``, by distinct value.
    """
    require_columns(panel, ["code", "date", "label"])
    factors = [f for f in factors if f in panel.columns]
    rows = stage(panel.select("date", "label", *factors), "ic")
    most = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= group_rows:
        numbers = rows.select("date", *[F.col(c).cast("double").alias(c) for c in ("label", *factors)])
        kind = f"factor_name string, date {dict(rows.dtypes)['date']}, ic double, sample_count bigint"
        return numbers.groupBy("date").applyInArrow(_ic_of_a_date(factors), kind)
    pairs = _pairs(rows, factors)
    whole, ranked = pairs.where("complete"), pairs
    for c in ("value", "label"):
        ranks = rank_table(whole, ["date", "factor_name"], c, group_rows=group_rows)
        ranked = ranked.join(ranks.select("date", "factor_name", c, F.lit(True).alias("complete"), F.col("rank").alias(f"{c}_rank")), ["date", "factor_name", c, "complete"], "left")
    return _correlated(ranked)


def _ic_of_a_date(factors: Sequence[str]) -> Callable:
    """From the rows of one date, as an Arrow table, to a row for each factor."""
    least = MIN_PAIRS

    def measure(rows):  # has its imports and helpers inside, so that tasks need nothing of this package
        import numpy as np
        import pyarrow as pa

        def ranks(values):
            distinct, place, ties = np.unique(values, return_inverse=True, return_counts=True)
            return (np.cumsum(ties) - (ties - 1) / 2.0)[place], len(distinct) > 1

        def numbers(name):
            column = rows.column(name)
            return column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()

        label, labelled = numbers("label")
        counts, found = [], []
        for factor in factors:
            value, valued = numbers(factor)
            complete = labelled & valued
            counts.append(int(complete.sum()))
            found.append(None)
            if counts[-1] >= least:
                (x, x_varies), (y, y_varies) = ranks(value[complete]), ranks(label[complete])
                if x_varies and y_varies:
                    x, y = x - x.mean(), y - y.mean()
                    found[-1] = float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
        day = rows.column("date")
        return pa.table(
            {
                "factor_name": pa.array(factors, pa.string()),
                "date": pa.array([day[0].as_py()] * len(factors), day.type),
                "ic": pa.array(found, pa.float64()),
                "sample_count": pa.array(counts, pa.int64()),
            }
        )

    return measure


def _pairs(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("factor_name"), F.col(f).cast("double").alias("value")) for f in factors])
    long = rows.select("date", "label", F.explode(entries).alias("pair")).select("date", "pair.factor_name", "pair.value", "label")
    return long.withColumn("complete", F.col("value").isNotNull() & F.col("label").isNotNull())


def _correlated(ranked: DataFrame) -> DataFrame:
    ok = F.col("complete")
    value_rank, label_rank = F.when(ok, F.col("value_rank")), F.when(ok, F.col("label_rank"))
    daily = ranked.groupBy("date", "factor_name").agg(
        F.count_if(ok).alias("sample_count"),
        safe_corr(value_rank, label_rank).alias("ic"),
        (F.min(value_rank) < F.max(value_rank)).alias("_value_varies"),
        (F.min(label_rank) < F.max(label_rank)).alias("_label_varies"),
    )
    enough = (F.col("sample_count") >= MIN_PAIRS) & F.col("_value_varies") & F.col("_label_varies")
    return daily.select("factor_name", "date", F.when(enough, F.col("ic")).alias("ic"), "sample_count")


def factor_ic_stats(ic: DataFrame, factors: Sequence[str], start=None, end=None) -> DataFrame:
    """Summary of the daily IC per factor; a factor has at most one row per day."""
    start, end = date_range(start, end)
    chosen = ic.where(F.col("factor_name").isin(*factors) & F.col("ic").isNotNull())
    if start:
        chosen = chosen.where(F.col("date") >= F.lit(start))
    if end:
        chosen = chosen.where(F.col("date") <= F.lit(end))
    quartiles = F.percentile("ic", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return chosen.groupBy("factor_name").agg(
        F.count("ic").alias("n"),
        F.avg("ic").alias("mean"),
        F.stddev_samp("ic").alias("std"),
        F.min("ic").alias("min"),
        quartiles[0].alias("q25"),
        quartiles[1].alias("q50"),
        quartiles[2].alias("q75"),
        F.max("ic").alias("max"),
    )


def factor_availability(ic: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested factors without any IC value."""
    names = ic.sparkSession.createDataFrame([(f,) for f in requested], "factor_name string")
    return names.join(ic.where(F.col("ic").isNotNull()).select("factor_name").distinct(), "factor_name", "left_anti")


def factor_corr(panel: DataFrame, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlations of the given factors, long form.

    All pairs come out of one aggregate; ``by`` groups them, per symbol say.
    """
    factors = list(factors)
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]
    wide = panel.groupBy(*by).agg(*[safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    entries = [
        F.struct(F.lit(x).alias("factor_x"), F.lit(y).alias("factor_y"), F.col(f"`{a}|{b}`").alias("correlation"))
        for a, b in pairs
        for x, y in ((a, b), (b, a))
    ]
    return wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def board_breadth(panel: DataFrame) -> DataFrame:
    """Breadth per board on the last date."""
    latest = panel.where(F.col("date") == panel.agg(F.max("date")).scalar())
    return latest.groupBy(board_of("code").alias("board")).agg(
        F.count(F.lit(1)).alias("stock_count"),
        F.count_if(F.col("ret") > 0).alias("advancing"),
        F.count_if(F.col("ret") < 0).alias("declining"),
        F.avg("ret").alias("average_return"),
    )


def board_amount_share(panel: DataFrame) -> DataFrame:
    """Amount per board and its share in percent; five boards at most."""
    boards = panel.groupBy(board_of("code").alias("board")).agg(F.sum("amount").alias("amount"))
    share = F.col("amount") / F.sum("amount").over(Window.partitionBy(F.lit(1))) * 100
    return boards.withColumn("share_pct", F.round(share, 1))


def monthly_volume(market: DataFrame, years: int = 3) -> DataFrame:
    """Volume per month, for the last years of the market table."""
    month = F.trunc("date", "month")
    first = market.agg(F.trunc(F.add_months(F.max("date"), -12 * years), "month")).scalar()
    return market.where(month >= first).groupBy(month.alias("month")).agg(F.sum("total_volume").alias("volume"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("stock_count"))


def sentiment_stats(panel: DataFrame) -> DataFrame:
    """Mean, deviation, positive share and class per symbol.

    The class goes by the mean rounded to nine digits, so a mean of exactly a
    class's bound does not depend on the order in which it was summed.
    """
    stats = panel.groupBy("code").agg(
        F.avg("sentiment").alias("average_sentiment"),
        F.stddev_samp("sentiment").alias("sentiment_std"),
        (F.count_if(F.col("sentiment") > 0) / F.count(F.lit(1))).alias("positive_rate"),
        F.count(F.lit(1)).alias("days"),
    )
    return stats.withColumn("status", sentiment_class(F.round("average_sentiment", 9)))


def snapshot_breadth(panel: DataFrame, day) -> DataFrame:
    """Close against open, means and total amount of one date."""
    return panel.where(F.col("date") == F.lit(day).cast("date")).agg(
        F.count(F.lit(1)).alias("stock_count"),
        F.count_if(F.col("close") > F.col("open")).alias("up_count"),
        F.count_if(F.col("close") <= F.col("open")).alias("down_count"),
        F.avg("close").alias("average_close"),
        F.avg("volume").alias("average_volume"),
        (F.avg("pct_chg") / 100).alias("market_return"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("market_amount"),
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts over equal-width bins between the smallest and the largest value."""
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    bin_no = F.when(lo == hi, F.lit(1).cast("long")).otherwise(
        F.least(F.width_bucket(F.col(value), lo, hi, F.lit(bins)), F.lit(bins).cast("long"))
    )
    return df.where(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def recent_dates(df: DataFrame, n: int) -> DataFrame:
    """The last n distinct dates."""
    return df.select("date").distinct().orderBy(F.col("date").desc()).limit(n)


def industry_heatmap(industry: DataFrame, n: int = 20) -> DataFrame:
    """Mean return in percent per industry on the last n dates, one column per date.

    The n dates are looked up first, so the pivot needs no pass of its own to
    find its columns.
    """
    days = sorted(r["date"] for r in recent_dates(industry, n).collect())
    if not days:
        raise ValueError("no industry rows to show")
    chosen = industry.where(F.col("date").isin(days)).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return chosen.groupBy("industry_l1").pivot("day", [d.isoformat() for d in days]).agg(F.avg("average_return") * 100)


def heatmap_cells(industry: DataFrame, n: int = 20) -> DataFrame:
    """The heatmap in long form with the position of the date among the last n."""
    days = recent_dates(industry, n).select(
        "date", F.row_number().over(Window.orderBy("date")).alias("day_no")
    )
    return industry.join(days, "date").select(
        "industry_l1", "day_no", (F.col("average_return") * 100).alias("return_pct")
    )


def quoted_on_all_days(market: DataFrame) -> DataFrame:
    """Bars of the symbols that have a positive open on every date of the market: a universe ``equal_weight_curve`` takes."""
    days = market.select("date").distinct().agg(F.count(F.lit(1))).scalar()
    opens = market.groupBy("code").agg(F.count_distinct(F.when(F.col("open") > 0, F.col("date"))).alias("n"))
    return market.join(opens.where(F.col("n") == days).select("code"), "code", "left_semi")


def equal_weight_curve(market: DataFrame, check: bool = True) -> DataFrame:
    """Mean open-to-open change of the universe per date, compounded.

    The reference frame is date x symbol; here it stays long. ``check`` asserts
    that every symbol has a positive open on every date.
    """
    days = market.select("date").distinct()
    if check:
        wanted = days.agg(F.count(F.lit(1))).scalar()
        short = market.groupBy("code").agg(F.count_if(F.col("open") > 0).alias("n")).where(F.col("n") < wanted)
        if short.limit(1).count():
            raise ValueError("opens of the universe are not complete")
    change = F.try_divide(F.col("open"), lag("open")) - 1
    daily = market.withColumn("change", change).groupBy("date").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("mean_change"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("curve", F.product(1 + F.col("mean_change")).over(w))


def panel_counts(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("code").alias("stock_count"))


def distinct_symbols(panel: DataFrame) -> DataFrame:
    return panel.select("code").distinct().orderBy("code")


def table_context(df: DataFrame, counted: str) -> DataFrame:
    return df.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count_distinct(counted).alias("n_distinct")
    )
