"""Technical factors and the forward label.

``factor_panel`` computes all of them in one plan: one exchange by code, one
sort by (code, date), a window pass for what looks at single rows and a sweep
along the histories for rolling frames and exponential means. Two dialects exist. ``lenient`` starts rolling values with the first row; ``strict`` gives
NULL until a window is full.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.guards import require_columns
from barloom.functions.windows import (
    Exponential,
    Rolling,
    ewma,
    history,
    lag,
    pct_change,
    rolling_mean,
    rolling_std,
    running_product,
    so_far,
    sweep,
)

BAR_COLUMNS = ["code", "date", "open", "high", "low", "close", "volume", "amount"]
LENIENT_REQUIRED = ["close", "ma5", "volatility_20d", "rsi"]
STRICT_REQUIRED = ["close", "label", "ma20", "volatility_20d", "rsi", "macd", "volume_ma20", "momentum_20d"]
EPSILON = 1e-10


@dataclass(frozen=True)
class Family:
    """A factor family: window columns, then columns computed from them.

    Window results are named before they are used, since Spark evaluates every
    occurrence of a window expression. Names starting with ``_`` are dropped.
    """

    windows: dict[str, Column | Rolling]
    derived: dict[str, Column] = field(default_factory=dict)


def _all(families: Sequence[Family], kind: str) -> dict:
    return {name: value for family in families for name, value in getattr(family, kind).items()}


def apply(df: DataFrame, *families: Family, keep: Sequence[str] = ()) -> DataFrame:
    """All windows of the families in one pass over the (code, date) order, then one projection."""
    windows = {name: w.column() if isinstance(w, Rolling) else w for name, w in _all(families, "windows").items()}
    derived = _all(families, "derived")
    df = df.withColumns(windows)
    df = df.withColumns(derived) if derived else df
    return df.drop(*[name for name in windows if name.startswith("_") and name not in keep])


def returns() -> Family:
    lags = {"ret": 1, "ret_5d": 5, "ret_10d": 10}
    return Family(
        {f"_close_{n}": lag("close", n) for n in lags.values()},
        {name: F.try_divide(F.col("close"), F.col(f"_close_{n}")) - 1 for name, n in lags.items()},
    )


def moving_averages(strict: bool = False) -> Family:
    return Family(
        {f"ma{n}": Rolling("mean", "close", n, strict) for n in (5, 10, 20, 60)},
        {"ma5_ma10_diff": F.col("ma5") - F.col("ma10"), "ma5_ma20_diff": F.col("ma5") - F.col("ma20")},
    )


def volatility(strict: bool = False) -> Family:
    """Needs ``ret``."""
    return Family({f"volatility_{n}d": Rolling("std", "ret", n, strict) for n in (20, 60)})


def price_moves() -> Family:
    """Gain and loss of a day; the first day has neither, and counts as zero."""
    delta = F.col("close") - F.col("_close_1")
    return Family(
        {"_close_1": lag("close")},
        {"gain": F.when(delta > 0, delta).otherwise(0.0), "loss": F.when(delta < 0, -delta).otherwise(0.0)},
    )


def rsi(strict: bool = False) -> Family:
    """Needs ``gain`` and ``loss``."""
    gain, loss = F.col("_gain"), F.col("_loss")
    windows = {"_gain": Rolling("mean", "gain", 14, strict), "_loss": Rolling("mean", "loss", 14, strict)}
    if strict:
        # loss 0 with gains is 100, with no gains undefined: both follow from gain / (gain + loss).
        return Family(windows, {"rsi": 100 * F.try_divide(gain, gain + loss)})
    return Family(windows, {"rsi": 100 - 100 / (1 + gain / (loss + EPSILON))})


def macd(df: DataFrame) -> DataFrame:
    """Difference of two exponential means and its own exponential mean."""
    df = ewma(df, [("close", "_fast", 12), ("close", "_slow", 26)], block="_block")
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewma(df, [("macd", "macd_signal", 9)], order=("_block", "date")).drop("_block")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def volume_factors(strict: bool = False) -> Family:
    volume = F.col("volume")
    windows = {"volume_ma5": Rolling("mean", "volume", 5, strict), "_volume_1": lag("volume")}
    change = F.try_divide(volume, F.col("_volume_1")) - 1
    if not strict:
        return Family(windows, {"volume_ratio": volume / (F.col("volume_ma5") + 1), "volume_change": change})
    windows["volume_ma20"] = Rolling("mean", "volume", 20, True)
    return Family(windows, {"volume_ratio": F.try_divide(volume, F.col("volume_ma20")), "volume_change": change})


def amount_factors(strict: bool = False) -> Family:
    amount, base = F.col("amount"), F.col("amount_ma20")
    ratio = F.try_divide(amount, base) if strict else amount / (base + 1)
    return Family({"amount_ma20": Rolling("mean", "amount", 20, strict)}, {"amount_ratio": ratio})


def momentum() -> Family:
    return Family(
        {f"_close_{n}": lag("close", n) for n in (20, 60)},
        {f"momentum_{n}d": F.try_divide(F.col("close"), F.col(f"_close_{n}")) - 1 for n in (20, 60)},
    )


def reversal(strict: bool = False) -> Family:
    """Needs ``ret`` and ``ret_5d``."""
    if strict:
        windows = {f"_ret_sum_{n}": Rolling("sum", "ret", n, True) for n in (5, 20)}
        return Family(windows, {f"reversal_{n}d": -F.col(f"_ret_sum_{n}") for n in (5, 20)})
    return Family(
        {"_ret_mean": Rolling("mean", "ret", 20)}, {"reversal_5d": -F.col("ret_5d"), "reversal_20d": -F.col("_ret_mean")}
    )


def bollinger(strict: bool = False) -> Family:
    close, mid = F.col("close"), F.col("bb_mid")
    name = "bb_std" if strict else "_bb_std"
    upper, lower = mid + 2 * F.col(name), mid - 2 * F.col(name)
    windows = {"bb_mid": Rolling("mean", "close", 20, strict), name: Rolling("std", "close", 20, strict)}
    if strict:
        shape = {"bb_width": upper - lower, "bb_position": F.try_divide(close - lower, upper - lower)}
    else:
        shape = {
            "bb_width": F.try_divide(upper - lower, mid),
            "bb_position": (close - lower) / (upper - lower + EPSILON),
        }
    return Family(windows, {"bb_upper": upper, "bb_lower": lower, **shape})


def price_ratios(strict: bool = False) -> Family:
    pad = 0.0 if strict else EPSILON
    return Family(
        {},
        {
            "high_low_ratio": F.try_divide(F.col("high"), F.col("low") + pad),
            "close_open_ratio": F.try_divide(F.col("close"), F.col("open") + pad),
        },
    )


def label() -> Family:
    """Needs ``ret``."""
    return Family({"label": F.lead("ret", 1).over(history())})


def factor_panel(bars: DataFrame, mode: str = "lenient", keep: Sequence[str] = ()) -> DataFrame:
    """Every factor of one dialect, before the warm-up rows are dropped. ``keep`` names inner columns that stay."""
    if mode not in ("lenient", "strict"):
        raise ValueError("mode must be 'lenient' or 'strict'")
    strict = mode == "strict"
    require_columns(bars, BAR_COLUMNS)
    moves = (returns(), price_moves())
    first = (
        *moves, moving_averages(strict), momentum(), volume_factors(strict), amount_factors(strict), bollinger(strict), price_ratios(strict)
    )
    second = (volatility(strict), rsi(strict), reversal(strict), label())
    # Spark lays the histories out for what looks at single rows; frames of many rows are swept along them.
    swept = {name: w for name, w in _all(first + second, "windows").items() if isinstance(w, Rolling)}
    lags = {name: w for name, w in _all(first, "windows").items() if name not in swept}
    df = bars.withColumns({**lags, "_at": F.row_number().over(history())}).withColumns(_all(moves, "derived")).withColumns(label().windows)
    df = sweep(df, {
        **swept, "_fast": Exponential("close", 12), "_slow": Exponential("close", 26), "macd_signal": Exponential(("_fast", "_slow"), 9),
    }, "_at")
    band = {} if strict else {"macd_hist": F.col("macd") - F.col("macd_signal")}
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).withColumns({**band, **_all(first[len(moves):], "derived")})
    df = df.withColumns(_all(second, "derived"))
    made = ["macd", "macd_signal", *band]
    for families in (first, second):
        made += [n for n in _all(families, "windows") if not n.startswith("_") or n in keep] + list(_all(families, "derived"))
    return df.select(*dict.fromkeys([*(c for c in bars.columns if c not in made), *made])).drop("gain", "loss")


def drop_warmup(panel: DataFrame, mode: str = "lenient") -> DataFrame:
    return panel.dropna(subset=STRICT_REQUIRED if mode == "strict" else LENIENT_REQUIRED)


def core_factors(bars: DataFrame) -> DataFrame:
    """The short factor list written by the partitioned job, with its year column."""
    df = bars.withColumns(
        {
            "ret": pct_change("close"),
            "ma5": rolling_mean("close", 5),
            "ma20": rolling_mean("close", 20),
            "volume_ma5": rolling_mean("volume", 5),
        }
    )
    df = df.withColumns({"volatility_20d": rolling_std("ret", 20), **label().windows})
    return df.withColumns({"volume_ratio": F.col("volume") / (F.col("volume_ma5") + 1.0), "year": F.year("date")})


def year_summary(factors: DataFrame) -> DataFrame:
    return factors.groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("code").alias("stock_count")
    )


def prev_close_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pre_close", lag("close")).withColumns(
        {
            "change": F.col("close") - F.col("pre_close"),
            "pct_chg": F.try_divide(F.col("close") - F.col("pre_close"), F.col("pre_close")) * 100,
        }
    )


def _of_the_row() -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns of a lenient panel with its previous closes that follow from others of the same row: those that follow from
    windows alone, then the band, which needs ``bb_mid``. The formulas are those of the families, so values are the same."""
    close, before = F.col("close"), F.col("pre_close")
    first = {
        "change": close - before,
        "pct_chg": F.try_divide(close - before, before) * 100,
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "ret": F.try_divide(close, before) - 1,
        **moving_averages().derived,
        "volume_ratio": volume_factors().derived["volume_ratio"],
        **amount_factors().derived,
        "bb_mid": F.col("ma20"),
        **price_ratios().derived,
        "reversal_5d": reversal().derived["reversal_5d"],
    }
    return first, bollinger().derived


INNER = ["_bb_std"]  # what ``widen`` needs beside a panel's own columns
WINDOWS_USED = ["close", "open", "high", "low", "pre_close", "volume", "amount", "macd", "macd_signal", "ma5", "ma10", "ma20",
                "volume_ma5", "amount_ma20", "ret_5d", *INNER]


def narrow(panel: DataFrame) -> DataFrame:
    """A lenient panel, with its previous closes and ``INNER`` columns, without what ``widen`` works out again."""
    require_columns(panel, WINDOWS_USED)
    first, band = _of_the_row()
    return panel.drop(*first, *band)


def widen(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ``columns`` of a panel that ``narrow`` left: a projection of each row, so a read takes only the columns it needs."""
    first, band = _of_the_row()
    return stored.withColumns(first).withColumns(band).select(*columns)


def sentiment_ma(sentiment: DataFrame) -> DataFrame:
    return sentiment.withColumns({f"sentiment_ma{n}": rolling_mean("sentiment", n) for n in (5, 10)})


def volume_sentiment_proxy(index_bars: DataFrame) -> DataFrame:
    """Market mood from the volume change of an index, one row per index and date."""
    return index_bars.withColumn("market_sentiment", (F.coalesce(pct_change("volume"), F.lit(0.0)) + 1) / 2)


def cumulative_return(panel: DataFrame) -> DataFrame:
    value = F.when(F.col("ret").isNotNull(), running_product(1 + F.col("ret")))
    return panel.withColumn("cumulative_return", value)


def drawdown(panel: DataFrame, value: str = "close") -> DataFrame:
    return panel.withColumn("drawdown", F.try_divide(F.col(value), F.max(value).over(so_far())) - 1)


def sentiment_timing(panel: DataFrame, n: int = 10) -> DataFrame:
    """Hold on the day after sentiment is above its own n-row mean, against buy and hold."""
    above = F.coalesce(F.col("sentiment") > rolling_mean("sentiment", n, strict=True), F.lit(False))
    return (
        panel.withColumns({"returns": pct_change("close"), "signal": above.cast("int")})
        .withColumn("strategy_return", lag("signal") * F.col("returns"))
        .withColumns(
            {
                "strategy_cumulative": running_product(1 + F.col("strategy_return")),
                "bh_cumulative": running_product(1 + F.col("returns")),
            }
        )
        .withColumn("strategy_cumulative", F.when(F.col("strategy_return").isNotNull(), F.col("strategy_cumulative")))
        .withColumn("bh_cumulative", F.when(F.col("returns").isNotNull(), F.col("bh_cumulative")))
    )


def derived_features(panel: DataFrame) -> DataFrame:
    flag = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    return panel.withColumns(
        {
            "ma5_rsi_interact": F.col("ma5") * F.col("rsi") / 100,
            "ma5_ma20_ratio": F.try_divide(F.col("ma5"), F.col("ma20") + 0.001),
            "momentum_volatility_ratio": F.try_divide(F.col("momentum_20d"), F.col("volatility_20d") + 0.001),
            "volume_rsi_signal": F.col("volume_ratio") * (F.col("rsi") - 50) / 50,
            "trend_ma5_ma20": flag(F.col("ma5") > F.col("ma20")),
            "trend_macd": flag(F.col("macd") > F.col("macd_signal")),
        }
    )
