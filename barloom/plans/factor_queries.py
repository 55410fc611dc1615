"""Time-series factors, one query per factor family and one for the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.operators import factors as f
from barloom.plans.oracle import HIST, SO_FAR, rows
from barloom.plans.registry import query
from barloom.sources.adapter import bars_long, bars_short, sentiment


def _from_panel(columns: str, source: str = "bars_panel") -> str:
    return f"SELECT code, date, {columns} FROM {source}"


@query("f_ret", "code date ret:6", _from_panel("ret"))
def f_ret(spark, sf):
    return bars_long(spark, sf).withColumn("ret", w.pct_change("close"))


@query("f_ret_n", "code date ret_5d:6 ret_10d:6", _from_panel("ret_5d, ret_10d"))
def f_ret_n(spark, sf):
    return f.apply(bars_long(spark, sf), f.returns())


@query("f_ma", "code date ma5:4 ma10:4 ma20:4 ma60:4", _from_panel("ma5, ma10, ma20, ma60"))
def f_ma(spark, sf):
    return f.apply(bars_long(spark, sf), f.moving_averages())


@query("f_ma_diff", "code date ma5_ma10_diff:4 ma5_ma20_diff:4", _from_panel("ma5_ma10_diff, ma5_ma20_diff"))
def f_ma_diff(spark, sf):
    return f.apply(bars_long(spark, sf), f.moving_averages())


@query("f_volatility", "code date volatility_20d:5 volatility_60d:5", _from_panel("volatility_20d, volatility_60d"))
def f_volatility(spark, sf):
    return f.apply(f.apply(bars_long(spark, sf), f.returns()), f.volatility())


@query("f_rsi", "code date rsi:6", _from_panel("rsi"))
def f_rsi(spark, sf):
    return f.apply(f.apply(bars_long(spark, sf), f.price_moves()), f.rsi())


@query("f_macd", "code date macd:4 macd_signal:4 macd_hist:4", _from_panel("macd, macd_signal, macd_hist"))
def f_macd(spark, sf):
    return f.macd(bars_long(spark, sf).select("code", "date", "close"))


@query(
    "f_volume",
    "code date volume_ma5:4 volume_ratio:6 volume_change:6",
    _from_panel("volume_ma5, volume_ratio, volume_change"),
)
def f_volume(spark, sf):
    return f.apply(bars_long(spark, sf), f.volume_factors())


@query("f_amount", "code date amount_ma20:3 amount_ratio:6", _from_panel("amount_ma20, amount_ratio"))
def f_amount(spark, sf):
    return f.apply(bars_long(spark, sf), f.amount_factors())


@query("f_momentum", "code date momentum_20d:5 momentum_60d:5", _from_panel("momentum_20d, momentum_60d"))
def f_momentum(spark, sf):
    return f.apply(bars_long(spark, sf), f.momentum())


@query("f_reversal", "code date reversal_5d:5 reversal_20d:5", _from_panel("reversal_5d, reversal_20d"))
def f_reversal(spark, sf):
    return f.apply(f.apply(bars_long(spark, sf), f.returns()), f.reversal())


@query(
    "f_bollinger",
    "code date bb_mid:4 bb_upper:4 bb_lower:4 bb_width:5 bb_position:5",
    _from_panel("bb_mid, bb_upper, bb_lower, bb_width, bb_position"),
)
def f_bollinger(spark, sf):
    return f.apply(bars_long(spark, sf), f.bollinger())


@query(
    "f_price_ratio",
    "code date high_low_ratio:5 close_open_ratio:5",
    _from_panel("high_low_ratio, close_open_ratio", "evbars_panel"),
)
def f_price_ratio(spark, sf):
    return f.apply(bars_short(spark, sf), f.price_ratios())


@query("f_label", "code date label:6", _from_panel("label"))
def f_label(spark, sf):
    return f.apply(f.apply(bars_long(spark, sf), f.returns()), f.label())


@query(
    "f_drop_warmup",
    "code date close:4 ma5:4 volatility_20d:5 rsi:6",
    "SELECT code, date, close, ma5, volatility_20d, rsi FROM bars_ready",
)
def f_drop_warmup(spark, sf):
    return f.drop_warmup(f.factor_panel(bars_long(spark, sf)))


PANEL_SHAPE = (
    "code date open:4 high:4 low:4 close:4 volume:2 amount:3 ret:5 ret_5d:5 ret_10d:5 ma5:4 ma10:4 ma20:4 ma60:4 "
    "ma5_ma10_diff:4 ma5_ma20_diff:4 volatility_20d:5 volatility_60d:5 rsi:6 macd:4 macd_signal:4 macd_hist:4 "
    "volume_ma5:4 volume_ratio:6 volume_change:6 amount_ma20:3 amount_ratio:6 momentum_20d:5 momentum_60d:5 "
    "reversal_5d:5 reversal_20d:5 bb_mid:4 bb_upper:4 bb_lower:4 bb_width:5 bb_position:5 high_low_ratio:5 "
    "close_open_ratio:5 label:5"
)


@query("factor_panel", PANEL_SHAPE, "SELECT * FROM bars_ready")
def factor_panel(spark, sf):
    return f.drop_warmup(f.factor_panel(bars_long(spark, sf)))


def _full(value: str, n: int, call: str = "avg") -> str:
    return f"CASE WHEN count({value}) OVER {rows(n)} = {n} THEN {call}({value}) OVER {rows(n)} END"


STRICT_SQL = f"""
    SELECT * FROM (
        SELECT code, date, close, macd, ret, lead(ret) OVER {HIST} AS label,
            {_full('close', 5)} AS ma5, {_full('close', 20)} AS ma20, {_full('ret', 20, 'stddev_samp')} AS volatility_20d,
            100 - 100 / (1 + {_full('gain', 14)} / nullif({_full('loss', 14)}, 0)) AS rsi,
            {_full('volume', 20)} AS volume_ma20, volume / ({_full('volume', 20)}) AS volume_ratio,
            amount / ({_full('amount', 20)}) AS amount_ratio, momentum_20d,
            -({_full('ret', 5, 'sum')}) AS reversal_5d, -({_full('ret', 20, 'sum')}) AS reversal_20d,
            4 * ({_full('close', 20, 'stddev_samp')}) AS bb_width, high / low AS high_low_ratio
        FROM bars_base) AS s
    WHERE label IS NOT NULL AND ma20 IS NOT NULL AND volatility_20d IS NOT NULL AND rsi IS NOT NULL
        AND volume_ma20 IS NOT NULL AND momentum_20d IS NOT NULL"""


@query(
    "factor_panel_strict",
    "code date close:4 macd:4 ret:5 label:5 ma5:4 ma20:4 volatility_20d:5 rsi:5 volume_ma20:4 volume_ratio:6 "
    "amount_ratio:6 momentum_20d:5 reversal_5d:5 reversal_20d:5 bb_width:4 high_low_ratio:5",
    STRICT_SQL,
)
def factor_panel_strict(spark, sf):
    return f.drop_warmup(f.factor_panel(bars_long(spark, sf), "strict"), "strict")


@query(
    "factor_year_summary",
    "year row_count stock_count",
    "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS row_count, count(DISTINCT code) AS stock_count "
    "FROM bars GROUP BY 1",
)
def factor_year_summary(spark, sf):
    return f.year_summary(f.core_factors(bars_long(spark, sf)))


@query(
    "prev_close_change",
    "code date pre_close:4 change:4 pct_chg:4",
    f"SELECT code, date, lag(close) OVER {HIST} AS pre_close, close - lag(close) OVER {HIST} AS change, "
    f"(close - lag(close) OVER {HIST}) / lag(close) OVER {HIST} * 100 AS pct_chg FROM bars",
)
def prev_close_change(spark, sf):
    return f.prev_close_change(bars_long(spark, sf))


@query(
    "sentiment_ma",
    "code date sentiment:6 sentiment_ma5:6 sentiment_ma10:6",
    f"SELECT code, date, sentiment, avg(sentiment) OVER {rows(5)} AS sentiment_ma5, "
    f"avg(sentiment) OVER {rows(10)} AS sentiment_ma10 FROM sent",
)
def sentiment_ma(spark, sf):
    return f.sentiment_ma(sentiment(spark, sf))


@query(
    "volume_sentiment_proxy",
    "code date market_sentiment:6",
    "SELECT 'market' AS code, date, (coalesce(volume / lag(volume) OVER (ORDER BY date) - 1, 0) + 1) / 2 "
    "AS market_sentiment FROM (SELECT date, sum(volume) AS volume FROM bars GROUP BY date) AS market",
)
def volume_sentiment_proxy(spark, sf):
    index = bars_long(spark, sf).groupBy("date").agg(F.sum("volume").alias("volume"))
    return f.volume_sentiment_proxy(index.withColumn("code", F.lit("market")))


@query(
    "cum_return",
    "code date cumulative_return:4",
    f"SELECT code, date, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER {SO_FAR} END AS cumulative_return "
    "FROM bars_base",
)
def cum_return(spark, sf):
    return f.cumulative_return(bars_long(spark, sf).withColumn("ret", w.pct_change("close")))


@query(
    "drawdown",
    "code date drawdown:6 max_drawdown:6",
    f"SELECT code, date, drawdown, min(drawdown) OVER (PARTITION BY code) AS max_drawdown FROM "
    f"(SELECT code, date, close / max(close) OVER {SO_FAR} - 1 AS drawdown FROM bars) AS d",
)
def drawdown(spark, sf):
    deep = f.drawdown(bars_long(spark, sf))
    return deep.withColumn("max_drawdown", F.expr("min(drawdown) over (partition by code)"))


TIMING_SQL = f"""
    SELECT code, date, signal, strategy_return,
        CASE WHEN strategy_return IS NOT NULL THEN product(1 + strategy_return) OVER {SO_FAR} END AS strategy_cumulative,
        CASE WHEN returns IS NOT NULL THEN product(1 + returns) OVER {SO_FAR} END AS bh_cumulative
    FROM (SELECT *, lag(signal) OVER {HIST} * returns AS strategy_return FROM (
        SELECT code, date, close / nullif(lag(close) OVER {HIST}, 0) - 1 AS returns,
            CASE WHEN sentiment > {_full('sentiment', 10)} THEN 1 ELSE 0 END AS signal
        FROM evbars JOIN sent USING (code, date)) AS a) AS b"""


@query(
    "sentiment_timing",
    "code date signal strategy_return:5 strategy_cumulative:2 bh_cumulative:2",
    TIMING_SQL,
)
def sentiment_timing(spark, sf):
    return f.sentiment_timing(bars_short(spark, sf).join(sentiment(spark, sf), ["code", "date"]))


@query(
    "derived_features",
    "code date ma5_rsi_interact:4 ma5_ma20_ratio:5 momentum_volatility_ratio:4 volume_rsi_signal:5 "
    "trend_ma5_ma20 trend_macd",
    "SELECT code, date, ma5 * rsi / 100 AS ma5_rsi_interact, ma5 / (ma20 + 0.001) AS ma5_ma20_ratio, "
    "momentum_20d / (volatility_20d + 0.001) AS momentum_volatility_ratio, "
    "volume_ratio * (rsi - 50) / 50 AS volume_rsi_signal, "
    "CASE WHEN ma5 > ma20 THEN 1 ELSE 0 END AS trend_ma5_ma20, "
    "CASE WHEN macd > macd_signal THEN 1 ELSE 0 END AS trend_macd FROM bars_ready",
)
def derived_features(spark, sf):
    return f.derived_features(f.drop_warmup(f.factor_panel(bars_long(spark, sf))))
