"""Strategy evaluation: signals, targets, bars, turnover, returns, orders, benchmark, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import pct_change
from barloom.operators import metrics as m
from barloom.operators import strategy as st
from barloom.operators.crosssection import quoted_on_all_days
from barloom.plans.registry import query
from barloom.session import materialise
from barloom.sources.adapter import bars_long, bars_short

N = 10
SCENARIOS = [st.scenario("base", N), st.scenario("cheap", 5, commission=0.0, stamp=0.0, slippage=0.0)]


def short_market(spark, sf):
    """Event bars with prices squeezed to moves of a few percent, so that compounding stays in range."""
    return bars_short(spark, sf).withColumns({c: 100 + F.col(c) / 10 for c in ("open", "close")})


def long_market(spark, sf):
    """Line-item bars squeezed alike; names trade on a fifth of the days, so orders get blocked."""
    return bars_long(spark, sf).withColumns({c: 100 + F.col(c) / 1000 for c in ("open", "close")})


def _fixture(spark, sf, source=short_market):
    """Market, usable signals (yesterday's return as the score), targets and valuation days.

    A strategy reads its market table many times (calendar, bars, benchmark), so
    the derived bars are written once, as a market table would be.
    """
    market = materialise(source(spark, sf), "market")
    predictions = (
        market.withColumn("predicted", pct_change("close"))
        .where(F.col("predicted").isNotNull())
        .select("date", "code", "predicted")
    )
    return market, *st.stage(st.signals(predictions, market), market, SCENARIOS)


def _views(bars: str) -> str:
    """SQL of the same three frames."""
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, lag(date) OVER (ORDER BY date) AS prev_date,
            lead(date) OVER (ORDER BY date) AS next_date, lead(date, 2) OVER (ORDER BY date) AS after_next
            FROM (SELECT DISTINCT date FROM {bars}) AS d),
        sig AS (SELECT code, date, r AS predicted, pos, next_date AS execution_date FROM (SELECT code, date,
            close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM {bars}) AS p JOIN cal USING (date)
            WHERE r IS NOT NULL AND after_next IS NOT NULL),
        tgt AS (SELECT s.scenario, date, execution_date, pos, code, predicted, rank_no AS position, 1.0 / s.n AS weight FROM (
            SELECT *, row_number() OVER (PARTITION BY date ORDER BY predicted DESC, code) AS rank_no FROM sig) AS k
            JOIN (VALUES ('base', 10), ('cheap', 5)) AS s(scenario, n) ON k.rank_no <= s.n),
        days AS (SELECT c.date, c.pos, c.prev_date AS signal_date, e.date IS NOT NULL AND c.pos < x.b AS trading FROM cal AS c
            JOIN (SELECT min(pos) + 1 AS a, max(pos) + 2 AS b FROM sig) AS x ON c.pos BETWEEN x.a AND x.b
            LEFT JOIN (SELECT DISTINCT execution_date AS date FROM sig) AS e ON e.date = c.date)"""


@query(
    "bt_signals",
    "date code predicted:5 execution_date",
    f"WITH {_views('ltmkt')} SELECT date, code, predicted, execution_date FROM sig",
)
def bt_signals(spark, sf):
    return _fixture(spark, sf, long_market)[1]


@query(
    "bt_targets",
    "scenario date execution_date code position weight:6",
    f"WITH {_views('ltmkt')} SELECT scenario, date, execution_date, code, position, weight FROM tgt",
)
def bt_targets(spark, sf):
    return _fixture(spark, sf, long_market)[2]


def _bars_sql(bars: str) -> str:
    return f"""WITH {_views(bars)},
        grid AS (SELECT g.scenario, g.code, d.* FROM (SELECT scenario, code, min(pos) + 1 AS start FROM tgt GROUP BY ALL) AS g
            JOIN days AS d ON d.pos >= g.start),
        wide AS (SELECT g.*, t.position AS rank, b.open, b.volume, CASE WHEN coalesce(b.open, 0) <= 0 THEN 'missing_open'
            WHEN coalesce(b.volume, 0) <= 0 THEN 'missing_or_zero_volume' END AS block FROM grid AS g
            LEFT JOIN tgt AS t ON t.scenario = g.scenario AND t.code = g.code AND t.execution_date = g.date
            LEFT JOIN {bars} AS b ON b.code = g.code AND b.date = g.date),
        state AS (SELECT *, last_value(CASE WHEN trading AND rank IS NOT NULL THEN 'in' WHEN trading AND block IS NULL THEN 'out' END
            IGNORE NULLS) OVER (PARTITION BY scenario, code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM wide)
        SELECT scenario, date, trading, code, rank, open, volume, block AS buy_block, block AS sell_block FROM state
            WHERE coalesce(s = 'in', false) OR (trading AND rank IS NOT NULL)"""


@query(
    "bt_execution_bars",
    "scenario date trading code rank open:4 volume buy_block sell_block",
    _bars_sql("evmkt"),
)
def bt_execution_bars(spark, sf):
    market, _, chosen, days = _fixture(spark, sf)
    return st.execution_bars(chosen, days, market)


@query(
    "bt_execution_bars_sparse",
    "scenario date n blocked",
    f"SELECT scenario, date, count(*) AS n, count(sell_block) AS blocked FROM ({_bars_sql('ltmkt')}) AS b GROUP BY scenario, date",
)
def bt_execution_bars_sparse(spark, sf):
    market, _, chosen, days = _fixture(spark, sf, long_market)
    bars = st.execution_bars(chosen, days, market)
    return bars.groupBy("scenario", "date").agg(F.count(F.lit(1)).alias("n"), F.count("sell_block").alias("blocked"))


# Market with limits and flags: suspended names, explicit blocks, price limits around the open.
FLAGS_SQL = """
    SELECT *, CASE WHEN code LIKE '%4' THEN volume < 2 END AS is_suspended, CASE WHEN code LIKE '%5' THEN volume > 1 END AS can_buy,
        CASE WHEN code LIKE '%6' THEN close * 1.1 END AS limit_up, CASE WHEN code LIKE '%6' THEN close * 0.9 END AS limit_down,
        CASE WHEN code LIKE '%7' THEN NULL WHEN code LIKE '%8' THEN volume - 1 ELSE volume END AS v2 FROM evmkt"""


@query(
    "bt_block_reason",
    "code date buy_reason sell_reason",
    f"""SELECT code, date, CASE WHEN open <= 0 OR open IS NULL THEN 'missing_open' WHEN coalesce(v2, 0) <= 0 THEN
        'missing_or_zero_volume' WHEN coalesce(is_suspended, false) THEN 'suspended' WHEN NOT coalesce(can_buy, true) THEN
        'explicit_block' WHEN coalesce(open >= limit_up, false) THEN 'price_limit' END AS buy_reason,
        CASE WHEN open <= 0 OR open IS NULL THEN 'missing_open' WHEN coalesce(v2, 0) <= 0 THEN 'missing_or_zero_volume'
        WHEN coalesce(is_suspended, false) THEN 'suspended' WHEN coalesce(open <= limit_down, false) THEN 'price_limit' END AS sell_reason
        FROM ({FLAGS_SQL}) AS f""",
)
def bt_block_reason(spark, sf):
    ends = lambda d: F.col("code").endswith(d)
    market = short_market(spark, sf).withColumns(
        {
            "is_suspended": F.when(ends("4"), F.col("volume") < 2),
            "can_buy": F.when(ends("5"), F.col("volume") > 1),
            "limit_up": F.when(ends("6"), F.col("close") * 1.1),
            "limit_down": F.when(ends("6"), F.col("close") * 0.9),
        }
    ).withColumn("volume", F.when(ends("7"), None).when(ends("8"), F.col("volume") - 1).otherwise(F.col("volume")))
    return market.select(
        "code", "date",
        st.block_reason("buy", market.columns).alias("buy_reason"),
        st.block_reason("sell", market.columns).alias("sell_reason"),
    )


TURNOVER_CTE = f"""{_views('evmkt')},
    reb AS (SELECT scenario, execution_date, lead(execution_date) OVER (PARTITION BY scenario ORDER BY execution_date) AS nxt
        FROM (SELECT DISTINCT scenario, execution_date FROM tgt) AS a),
    moved AS (SELECT coalesce(n.scenario, o.scenario) AS scenario, coalesce(n.execution_date, o.nxt) AS execution_date,
        coalesce(n.weight, 0) - coalesce(o.weight, 0) AS ch FROM tgt AS n FULL JOIN (SELECT t.scenario, t.code, t.weight, r.nxt
            FROM tgt AS t JOIN reb AS r ON r.scenario = t.scenario AND r.execution_date = t.execution_date WHERE r.nxt IS NOT NULL) AS o
        ON o.scenario = n.scenario AND o.nxt = n.execution_date AND o.code = n.code),
    turn AS (SELECT scenario, execution_date, sum(greatest(ch, 0)) AS buys, sum(greatest(-ch, 0)) AS sells, sum(abs(ch)) / 2 AS turnover
        FROM moved GROUP BY scenario, execution_date)"""
RETURNS_CTE = f"""{TURNOVER_CTE},
    mv AS (SELECT m.code, m.date AS execution_date, CASE WHEN m.nd = c.next_date THEN m.no / m.open - 1 END AS move FROM (
        SELECT code, date, open, lead(date) OVER (PARTITION BY code ORDER BY date) AS nd, lead(open) OVER (PARTITION BY code ORDER BY date)
        AS no FROM evmkt WHERE open > 0) AS m JOIN cal AS c USING (date)),
    gross AS (SELECT t.scenario, t.execution_date, sum(t.weight * coalesce(mv.move, 0)) AS gross_return, count(*) AS names
        FROM tgt AS t LEFT JOIN mv ON mv.code = t.code AND mv.execution_date = t.execution_date GROUP BY ALL),
    cost(scenario, commission, stamp, slippage) AS (VALUES ('base', 0.0003::DOUBLE, 0.0005::DOUBLE, 0.001::DOUBLE), ('cheap', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)),
    ret AS (SELECT scenario, execution_date AS date, names, turnover, gross_return, (buys + sells) * commission + sells * stamp AS transaction_cost,
        (buys + sells) * slippage AS slippage_cost FROM gross JOIN turn USING (scenario, execution_date) JOIN cost USING (scenario)),
    net AS (SELECT *, gross_return - transaction_cost - slippage_cost AS portfolio_return FROM ret)"""


@query(
    "bt_weight_turnover",
    "scenario execution_date buys:6 sells:6 turnover:6",
    f"WITH {TURNOVER_CTE} SELECT * FROM turn",
)
def bt_weight_turnover(spark, sf):
    return st.weight_turnover(_fixture(spark, sf)[2])


@query(
    "bt_weight_returns",
    "scenario date names turnover:6 gross_return:6 transaction_cost:7 portfolio_return:6",
    f"WITH {RETURNS_CTE} SELECT * FROM net",
)
def bt_weight_returns(spark, sf):
    market, _, chosen, _ = _fixture(spark, sf)
    return st.weight_returns(chosen, market, st.scenario_frame(spark, SCENARIOS))


BENCHMARK_CTE = """bm AS (SELECT d.date, b.open / first_value(b.open) OVER (ORDER BY d.date) AS benchmark_cumulative FROM days AS d
    JOIN (SELECT date, sum(open * volume) / sum(volume) AS open FROM evmkt GROUP BY date) AS b ON b.date = d.date)"""


def index_open(market):
    return market.groupBy("date").agg((F.sum(F.col("open") * F.col("volume")) / F.sum("volume")).alias("open"))


@query(
    "bt_benchmark",
    "date benchmark_cumulative:6 benchmark_name",
    f"WITH {_views('evmkt')}, {BENCHMARK_CTE} SELECT *, 'index' AS benchmark_name FROM bm",
)
def bt_benchmark(spark, sf):
    market, usable, _, days = _fixture(spark, sf)
    return st.benchmark_curve(index_open(market), usable, days, market)


@query(
    "bt_benchmark_universe",
    "date log_benchmark:5 benchmark_name",
    f"""WITH {_views('evmkt')} SELECT date, ln(product(1 + c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        AS log_benchmark, 'equal weight' AS benchmark_name FROM (SELECT date, coalesce(avg(c), 0) AS c FROM (SELECT b.date,
        b.open / nullif(lag(b.open) OVER (PARTITION BY b.code ORDER BY b.date), 0) - 1 AS c FROM evmkt AS b JOIN days AS d USING (date)
        WHERE b.code IN (SELECT code FROM sig)) AS a GROUP BY date) AS z""",
)
def bt_benchmark_universe(spark, sf):
    market, usable, _, days = _fixture(spark, sf)
    curve = st.benchmark_curve(None, usable, days, market, check=False)
    return curve.withColumn("log_benchmark", F.log("benchmark_cumulative"))


@query(
    "bt_benchmark_complete",
    "date log_benchmark:5 benchmark_name",
    f"""WITH {_views('evmkt')}, uni AS (SELECT b.code, b.date, b.open FROM evmkt AS b JOIN days AS d USING (date) WHERE b.code IN (SELECT
            code FROM sig)),
        whole AS (SELECT code FROM uni GROUP BY code HAVING count(DISTINCT date) FILTER (open > 0) = (SELECT count(DISTINCT date) FROM uni))
        SELECT date, ln(product(1 + c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS log_benchmark,
            'equal weight' AS benchmark_name FROM (SELECT date, coalesce(avg(c), 0) AS c FROM (SELECT code, date,
            open / lag(open) OVER (PARTITION BY code ORDER BY date) - 1 AS c FROM uni WHERE code IN (SELECT code FROM whole)) AS a
            GROUP BY date) AS z""",
)
def bt_benchmark_complete(spark, sf):
    """The equal-weight curve of the signalled symbols that are quoted on all valuation days, with its check."""
    market, usable, _, days = _fixture(spark, sf)
    valued = market.join(days.select("date"), "date", "left_semi").join(usable.select("code").distinct(), "code", "left_semi")
    curve = st.benchmark_curve(None, usable, days, quoted_on_all_days(valued))
    return curve.withColumn("log_benchmark", F.log("benchmark_cumulative"))


NAV_CTE = f"""{RETURNS_CTE}, {BENCHMARK_CTE},
    nav AS (SELECT *, product(1 + portfolio_return) OVER (PARTITION BY scenario ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND
        CURRENT ROW) AS cumulative_return FROM net JOIN bm USING (date)),
    peak AS (SELECT *, greatest(1.0, max(cumulative_return) OVER (PARTITION BY scenario ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW)) AS top, max(cumulative_return) OVER (PARTITION BY scenario ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS own_top FROM nav),
    ords AS (SELECT t.scenario, count(*) FILTER (b.open > 0) AS filled_order_count, count(*) FILTER (NOT coalesce(b.open > 0, false))
        AS blocked_order_count FROM tgt AS t LEFT JOIN evmkt AS b ON b.code = t.code AND b.date = t.execution_date GROUP BY t.scenario)"""


def _approximate(spark, sf):
    """Daily values of the vectorised backtest and buy orders with their status."""
    market, usable, chosen, days = _fixture(spark, sf)
    grid = st.scenario_frame(spark, SCENARIOS)
    nav = st.approximate_nav(st.weight_returns(chosen, market, grid), grid)
    daily = st.results(nav, st.benchmark_curve(index_open(market), usable, days, market), grid)
    orders = st.buy_orders(chosen, market)
    return market, daily, orders, grid


@query(
    "bt_metrics",
    "scenario days total_return:5 benchmark_total_return:6 excess_return:5 annualized_volatility:5 sharpe_ratio:4 max_drawdown:6 "
    "win_rate:6 average_turnover:6 total_transaction_cost:6 filled_order_count blocked_order_count blocked_missing_open_count "
    "price_limit_data_available suspension_data_available",
    f"""WITH {NAV_CTE} SELECT *, total_return - benchmark_total_return AS excess_return, CASE WHEN annualized_volatility > 0 THEN
            mean_return * 252 / annualized_volatility ELSE 0 END AS sharpe_ratio, blocked_order_count AS blocked_missing_open_count,
            false AS price_limit_data_available, false AS suspension_data_available
        FROM (SELECT scenario, count(*) AS days, arg_max(cumulative_return, date) - 1 AS total_return,
            arg_max(benchmark_cumulative, date) - 1 AS benchmark_total_return, stddev_samp(portfolio_return) * sqrt(252) AS annualized_volatility,
            avg(portfolio_return) AS mean_return, min(cumulative_return / top - 1) AS max_drawdown,
            avg(CASE WHEN portfolio_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(turnover) AS average_turnover,
            sum(transaction_cost) AS total_transaction_cost FROM peak GROUP BY scenario) AS a JOIN ords USING (scenario)""",
)
def bt_metrics(spark, sf):
    market, daily, orders, grid = _approximate(spark, sf)
    return st.metrics(daily, orders, market, grid)


@query(
    "trading_gap_compare",
    "scenario date strategy_return:5 benchmark_return:6 drawdown:6",
    f"WITH {NAV_CTE} SELECT scenario, date, cumulative_return - 1 AS strategy_return, benchmark_cumulative - 1 AS benchmark_return, "
    "cumulative_return / own_top - 1 AS drawdown FROM peak",
)
def trading_gap_compare(spark, sf):
    return m.trading_gap_compare(_approximate(spark, sf)[1])


@query(
    "holdings_slice",
    "date code predicted:4",
    f"WITH {_views('evmkt')} SELECT date, code, predicted FROM tgt WHERE scenario = 'base' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
)
def holdings_slice(spark, sf):
    chosen = _fixture(spark, sf)[2].where(F.col("scenario") == "base")
    return m.holdings_slice(chosen, "2024-01-05", "2024-01-20")


# ---- daily values and orders of the weights -----------------------------------------------------


@query(
    "bt_ledger",
    "scenario date portfolio_return:6 gross_return:6 cumulative_return:5 benchmark_cumulative:6 transaction_cost:8 turnover:6 names",
    f"WITH {NAV_CTE} SELECT * FROM nav",
)
def bt_ledger(spark, sf):
    """Daily values by target weights."""
    return _approximate(spark, sf)[1]


@query(
    "bt_orders",
    "scenario date code status reason",
    f"""WITH {_views('ltmkt')} SELECT t.scenario, t.execution_date AS date, t.code, CASE WHEN b.open > 0 AND b.volume > 0 THEN 'filled'
        ELSE 'blocked' END AS status, CASE WHEN NOT coalesce(b.open > 0, false) THEN 'missing_open'
        WHEN NOT coalesce(b.volume > 0, false) THEN 'missing_or_zero_volume' END AS reason
        FROM tgt AS t LEFT JOIN ltmkt AS b ON b.code = t.code AND b.date = t.execution_date""",
)
def bt_orders(spark, sf):
    """Buy orders of the targets with their status, over names that trade on some days only."""
    market, _, chosen, _ = _fixture(spark, sf, long_market)
    return st.buy_orders(chosen, market)
