"""Joins, cross-sections, ranks, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import pct_change
from barloom.operators import crosssection as x
from barloom.operators import joins as j
from barloom.operators import ranking as r
from barloom.operators.factors import prev_close_change, sentiment_ma
from barloom.plans.oracle import HIST, board, rows
from barloom.plans.panels import long_panel, scored_panel
from barloom.plans.registry import query
from barloom.session import materialise
from barloom.sources.adapter import bars_long, bars_short, catalog, sentiment, table
from barloom.sources.readers import union_universe


def with_ret(spark, sf):
    return bars_long(spark, sf).withColumn("ret", pct_change("close"))


# ---- joins -------------------------------------------------------------------------------------

SENT = f"SELECT *, avg(sentiment) OVER {rows(5)} AS sentiment_ma5, avg(sentiment) OVER {rows(10)} AS sentiment_ma10 FROM sent"


@query(
    "join_sentiment",
    "code date close:4 sentiment:6 sentiment_ma5:6 sentiment_ma10:6 comment_count sentiment_source",
    f"SELECT code, date, close, coalesce(sentiment, 0) AS sentiment, coalesce(sentiment_ma5, 0) AS sentiment_ma5, "
    f"coalesce(sentiment_ma10, 0) AS sentiment_ma10, coalesce(comment_count, 0) AS comment_count, "
    f"coalesce(data_source, 'not_available') AS sentiment_source FROM (SELECT code, date, close FROM evbars UNION ALL "
    f"SELECT code, date, close FROM bars) AS b LEFT JOIN ({SENT}) AS s USING (code, date)",
)
def join_sentiment(spark, sf):
    # Line items have no sentiment, events all have one: hits and misses, both sides whole.
    both = bars_short(spark, sf).unionByName(bars_long(spark, sf))
    return j.join_sentiment(both, sentiment_ma(sentiment(spark, sf)))


@query(
    "join_snapshot_dim",
    "code name industry_l1 market board close:4 volume amount:3",
    "SELECT code, name, industry_l1, market, board, close, volume, amount FROM bars JOIN dim USING (code) "
    "WHERE date = DATE '1998-06-15'",
)
def join_snapshot_dim(spark, sf):
    return j.join_snapshot_dim(bars_long(spark, sf), catalog(spark, sf), "1998-06-15")


@query(
    "join_peers",
    "code name industry_l1 date close:4",
    "SELECT code, name, industry_l1, date, close FROM bars JOIN dim USING (code) WHERE industry_l1 = 'NATION_3' "
    "AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def join_peers(spark, sf):
    dim = catalog(spark, sf).withColumn("has_detail", F.lit(1))
    return j.join_peers(bars_long(spark, sf), dim, "NATION_3", "1997-01-01", "1998-12-31")


@query(
    "join_dim_checked",
    "code date close:4 industry_l1",
    "SELECT code, date, close, industry_l1 FROM bars LEFT JOIN dim USING (code)",
)
def join_dim_checked(spark, sf):
    return j.join_dim_checked(bars_long(spark, sf), catalog(spark, sf))


@query(
    "join_latest",
    "code date close:4",
    "SELECT code, date, close FROM evbars WHERE date = (SELECT max(date) FROM evbars)",
)
def join_latest(spark, sf):
    return j.join_latest(bars_short(spark, sf))


@query(
    "detail_coverage",
    "code name has_detail",
    "SELECT code, name, CASE WHEN code IN (SELECT code FROM evbars) THEN 1 ELSE 0 END AS has_detail FROM dim",
)
def detail_coverage(spark, sf):
    return j.detail_coverage(bars_short(spark, sf), catalog(spark, sf))


@query(
    "calendar_next",
    "code date execution_date",
    "SELECT code, date, execution_date FROM bars JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS execution_date "
    "FROM (SELECT DISTINCT date FROM bars) AS d) AS c USING (date)",
)
def calendar_next(spark, sf):
    bars = bars_long(spark, sf)
    return j.calendar_next(bars.select("code", "date"), bars)


@query(
    "calendar_reindex",
    "date open:4",
    "SELECT date, open FROM (SELECT DISTINCT date FROM bars) AS d LEFT JOIN (SELECT date, avg(open) AS open FROM bars "
    "GROUP BY date) AS b USING (date)",
)
def calendar_reindex(spark, sf):
    bars = bars_long(spark, sf)
    index = bars.groupBy("date").agg(F.avg("open").alias("open"))
    return j.calendar_reindex(index, bars)


MARKS_SQL = """
    SELECT code, date, last_value(valid_open IGNORE NULLS) OVER (PARTITION BY code ORDER BY date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark_price, valid_open IS NULL AS stale
    FROM (SELECT g.code, g.date, b.open AS valid_open FROM
        (SELECT h.code, d.date FROM (SELECT code, min(date) AS since FROM evbars GROUP BY code) AS h
            JOIN (SELECT DISTINCT date FROM evbars) AS d ON d.date >= h.since) AS g
        LEFT JOIN (SELECT code, date, open FROM evbars WHERE open > 0) AS b ON b.code = g.code AND b.date = g.date) AS m"""


def marks(spark, sf):
    bars = bars_short(spark, sf)
    return j.last_valid_mark(bars.groupBy("code").agg(F.min("date").alias("since")), bars)


@query("last_valid_mark", "code date mark_price:4 stale", MARKS_SQL)
def last_valid_mark(spark, sf):
    return marks(spark, sf)


@query(
    "stale_counts",
    "date held stale_price_positions",
    f"SELECT date, count(*) AS held, count(*) FILTER (stale) AS stale_price_positions FROM ({MARKS_SQL}) AS s GROUP BY date",
)
def stale_counts(spark, sf):
    bars = bars_short(spark, sf)
    return j.stale_counts(bars.groupBy("code").agg(F.min("date").alias("since")), bars)


# ---- aggregates --------------------------------------------------------------------------------

MARKET_SQL = """
    SELECT date, count(*) AS stock_count, count(*) FILTER (coalesce(ret, 0) > 0) AS advancing_count,
        count(*) FILTER (coalesce(ret, 0) < 0) AS declining_count, count(*) FILTER (coalesce(ret, 0) = 0) AS flat_count,
        sum(volume) AS total_volume, sum(amount) AS total_amount, avg(close) AS average_close,
        avg(ret) AS average_return, median(ret) AS median_return, CAST(NULL AS DOUBLE) AS average_sentiment
    FROM bars_base GROUP BY date"""
MARKET_SHAPE = (
    "date stock_count advancing_count declining_count flat_count total_volume total_amount:2 average_close:4 "
    "average_return:5 median_return:5 average_sentiment:6"
)
INDUSTRY_SQL = """
    SELECT industry_l1, date, count(*) AS stock_count, avg(close) AS average_close, avg(ret) AS average_return,
        median(ret) AS median_return, sum(volume) AS total_volume, sum(amount) AS total_amount,
        count(*) FILTER (coalesce(ret, 0) > 0) / count(*) AS advancing_ratio, CAST(NULL AS DOUBLE) AS average_sentiment
    FROM bars_base JOIN dim USING (code) GROUP BY industry_l1, date"""
INDUSTRY_SHAPE = (
    "industry_l1 date stock_count average_close:4 average_return:5 median_return:5 total_volume total_amount:2 "
    "advancing_ratio:6 average_sentiment:6"
)


def industry_rows(spark, sf):
    return x.industry_daily(with_ret(spark, sf), catalog(spark, sf))


@query("market_daily", MARKET_SHAPE, MARKET_SQL)
def market_daily(spark, sf):
    return x.market_daily(with_ret(spark, sf))


@query("industry_daily", INDUSTRY_SHAPE, INDUSTRY_SQL)
def industry_daily(spark, sf):
    return industry_rows(spark, sf)


@query(
    "market_from_industry",
    MARKET_SHAPE,
    f"""SELECT date, CAST(sum(stock_count) AS BIGINT) AS stock_count,
        CAST(sum(round_even(advancing_ratio * stock_count, 0)) AS BIGINT) AS advancing_count,
        CAST(sum(stock_count) - sum(round_even(advancing_ratio * stock_count, 0)) AS BIGINT) AS declining_count, 0 AS flat_count,
        sum(total_volume) AS total_volume, sum(total_amount) AS total_amount,
        sum(average_close * stock_count) / sum(stock_count) AS average_close,
        coalesce(sum(average_return * stock_count), 0) / sum(stock_count) AS average_return,
        coalesce(sum(median_return * stock_count), 0) / sum(stock_count) AS median_return,
        0.0 AS average_sentiment FROM ({INDUSTRY_SQL}) AS i GROUP BY date""",
)
def market_from_industry(spark, sf):
    return x.market_from_industry(industry_rows(spark, sf))


def _ic_sql(panel: str, factors: list[str]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{f}' AS factor_name, date, CAST({f} AS DOUBLE) AS v, label AS y FROM {panel}" for f in factors
    )
    rank = "rank() OVER (PARTITION BY factor_name, date ORDER BY {0}) + (count(*) OVER (PARTITION BY factor_name, date, {0}) - 1) / 2.0"
    return f"""
        SELECT factor_name, date, coalesce(n, 0) AS sample_count,
            CASE WHEN n >= 3 AND nv > 1 AND ny > 1 THEN ic END AS ic
        FROM (SELECT DISTINCT factor_name, date FROM ({pairs}) AS p) AS keys LEFT JOIN (
            SELECT factor_name, date, count(*) AS n, count(DISTINCT rv) AS nv, count(DISTINCT ry) AS ny, corr(rv, ry) AS ic
            FROM (SELECT factor_name, date, {rank.format('v')} AS rv, {rank.format('y')} AS ry FROM ({pairs}) AS q
                WHERE v IS NOT NULL AND y IS NOT NULL) AS ranked GROUP BY factor_name, date) AS s USING (factor_name, date)"""


LONG_FACTORS = [f for f in x.IC_FACTORS if not f.startswith("sentiment")]
IC_SQL = _ic_sql("bars_ready", LONG_FACTORS)
SCORED = f"""(SELECT * FROM evbars_panel LEFT JOIN (SELECT code, date, sentiment,
    avg(sentiment) OVER {rows(5)} AS sentiment_ma5, avg(sentiment) OVER {rows(10)} AS sentiment_ma10 FROM sent) AS s
    USING (code, date)) AS scored"""


def daily_ic(spark, sf):
    return x.factor_ic(long_panel(spark, sf))


@query("factor_ic", "factor_name date ic:6 sample_count", IC_SQL)
def factor_ic(spark, sf):
    return daily_ic(spark, sf)


@query("factor_ic_sentiment", "factor_name date ic:6 sample_count", _ic_sql(SCORED, x.IC_FACTORS[-5:]))
def factor_ic_sentiment(spark, sf):
    return x.factor_ic(scored_panel(spark, sf), x.IC_FACTORS[-5:])


@query(
    "factor_ic_stats",
    "factor_name n mean:6 std:6 min:6 q25:6 q50:6 q75:6 max:6",
    f"""SELECT factor_name, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, min(ic) AS min,
        quantile_cont(ic, 0.25) AS q25, quantile_cont(ic, 0.5) AS q50, quantile_cont(ic, 0.75) AS q75, max(ic) AS max
        FROM ({_ic_sql('bars_ready', ['rsi', 'macd', 'momentum_20d'])}) AS i
        WHERE ic IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY factor_name""",
)
def factor_ic_stats(spark, sf):
    return x.factor_ic_stats(daily_ic(spark, sf), ["rsi", "macd", "momentum_20d"], "1996-01-01", "1999-12-31")


@query(
    "factor_availability",
    "factor_name",
    f"SELECT factor_name FROM (VALUES ('rsi'), ('momentum_60d'), ('bb_position'), ('unknown')) AS v(factor_name) "
    f"WHERE factor_name NOT IN (SELECT factor_name FROM ({_ic_sql('bars_ready', ['rsi', 'bb_position'])}) AS i WHERE ic IS NOT NULL)",
)
def factor_availability(spark, sf):
    return x.factor_availability(daily_ic(spark, sf), ["rsi", "momentum_60d", "bb_position", "unknown"])


CORR_FACTORS = ["ret_5d", "momentum_20d", "ma5_ma10_diff", "macd", "rsi", "volatility_20d", "bb_position"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT code, '{a}' AS factor_x, '{b}' AS factor_y, corr({a}, {b}) AS correlation FROM bars_ready GROUP BY code"
    for a in CORR_FACTORS
    for b in CORR_FACTORS
    if a != b
)


@query("factor_corr", "code factor_x factor_y correlation:6", CORR_SQL)
def factor_corr(spark, sf):
    return x.factor_corr(long_panel(spark, sf), CORR_FACTORS, by=["code"])


@query(
    "board_breadth",
    "board stock_count advancing declining average_return:5",
    f"SELECT {board()} AS board, count(*) AS stock_count, count(*) FILTER (ret > 0) AS advancing, "
    "count(*) FILTER (ret < 0) AS declining, avg(ret) AS average_return FROM bars_base "
    "WHERE date = (SELECT max(date) FROM bars) GROUP BY 1",
)
def board_breadth(spark, sf):
    return x.board_breadth(with_ret(spark, sf))


@query(
    "board_amount_share",
    "board amount:2 share_pct:1",
    f"SELECT board, amount, amount / sum(amount) OVER () * 100 AS share_pct FROM (SELECT {board()} AS board, "
    "sum(amount) AS amount FROM bars GROUP BY 1) AS b",
)
def board_amount_share(spark, sf):
    return x.board_amount_share(bars_long(spark, sf))


@query(
    "monthly_volume",
    "month volume",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(volume) AS volume FROM bars WHERE date_trunc('month', date) "
    ">= date_trunc('month', (SELECT max(date) FROM bars) - INTERVAL 3 YEAR) GROUP BY 1",
)
def monthly_volume(spark, sf):
    return x.monthly_volume(x.market_daily(with_ret(spark, sf)))


@query("board_counts", "board stock_count", "SELECT board, count(*) AS stock_count FROM dim GROUP BY board")
def board_counts(spark, sf):
    return x.counts_by(catalog(spark, sf), "board")


@query(
    "sentiment_stats",
    "code average_sentiment:6 sentiment_std:6 positive_rate:6 days status",
    "SELECT code, avg(sentiment) AS average_sentiment, stddev_samp(sentiment) AS sentiment_std, "
    "count(*) FILTER (sentiment > 0) / count(*) AS positive_rate, count(*) AS days, CASE WHEN round(avg(sentiment), 9) > 0.1 "
    "THEN 'positive' WHEN round(avg(sentiment), 9) < -0.1 THEN 'negative' ELSE 'neutral' END AS status FROM sent GROUP BY code",
)
def sentiment_stats(spark, sf):
    return x.sentiment_stats(sentiment(spark, sf))


@query(
    "snapshot_breadth",
    "stock_count up_count down_count average_close:4 average_volume:4 market_return:5 market_amount:3",
    f"SELECT count(*) AS stock_count, count(*) FILTER (close > open) AS up_count, count(*) FILTER (close <= open) AS down_count, "
    f"avg(close) AS average_close, avg(volume) AS average_volume, avg(pct_chg) / 100 AS market_return, sum(amount) AS market_amount "
    f"FROM (SELECT *, (close - lag(close) OVER {HIST}) / lag(close) OVER {HIST} * 100 AS pct_chg FROM evbars) AS b "
    "WHERE date = DATE '2024-01-20'",
)
def snapshot_breadth(spark, sf):
    return x.snapshot_breadth(prev_close_change(bars_short(spark, sf)), "2024-01-20")


def _hist_sql(value: str) -> str:
    return (
        f"SELECT '{value}' AS measure, CAST(least(floor(30 * (v - lo) / (hi - lo)) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM "
        f"(SELECT {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi FROM evbars WHERE date = DATE '2024-01-20') "
        "AS b GROUP BY 1, 2"
    )


@query("histogram", "measure bin n", f"{_hist_sql('close')} UNION ALL {_hist_sql('volume')}")
def histogram(spark, sf):
    day = bars_short(spark, sf).where(F.col("date") == F.lit("2024-01-20").cast("date"))
    parts = [x.histogram(day, m).select(F.lit(m).alias("measure"), "bin", "n") for m in ("close", "volume")]
    return parts[0].unionByName(parts[1])


@query(
    "industry_heatmap",
    "industry_l1 day_no return_pct:3",
    f"SELECT industry_l1, day_no, average_return * 100 AS return_pct FROM ({INDUSTRY_SQL}) AS i JOIN "
    "(SELECT date, row_number() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 20) "
    "AS d) AS n USING (date)",
)
def industry_heatmap(spark, sf):
    return x.heatmap_cells(industry_rows(spark, sf))


@query(
    "wide_open_matrix",
    "date mean_change:5 log_curve:6",
    f"""SELECT date, mean_change, ln(product(1 + mean_change) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        AS log_curve FROM (SELECT date, coalesce(avg(c), 0) AS mean_change FROM (SELECT date, open / nullif(lag(open) OVER {HIST}, 0) - 1 AS c
        FROM evbars) AS a GROUP BY date) AS b""",
)
def wide_open_matrix(spark, sf):
    curve = x.equal_weight_curve(bars_short(spark, sf), check=False)
    return curve.withColumn("log_curve", F.log("curve"))


ALL_DAYS = "SELECT code FROM {0} GROUP BY code HAVING count(DISTINCT date) FILTER (open > 0) = (SELECT count(DISTINCT date) FROM {0})"


@query(
    "wide_open_matrix_complete",
    "date mean_change:5 log_curve:6",
    f"""SELECT date, mean_change, ln(product(1 + mean_change) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        AS log_curve FROM (SELECT date, coalesce(avg(c), 0) AS mean_change FROM (SELECT date, open / lag(open) OVER {HIST} - 1 AS c
        FROM evbars WHERE code IN ({ALL_DAYS.format('evbars')})) AS a GROUP BY date) AS b""",
)
def wide_open_matrix_complete(spark, sf):
    """The curve of the symbols quoted on all days, which has to pass the check of completeness."""
    curve = x.equal_weight_curve(x.quoted_on_all_days(bars_short(spark, sf)))
    return curve.withColumn("log_curve", F.log("curve"))


@query(
    "industry_heatmap_wide",
    "industry_l1 dates smallest:3 largest:3",
    f"""SELECT industry_l1, count(*) AS dates, min(average_return) * 100 AS smallest, max(average_return) * 100 AS largest
        FROM ({INDUSTRY_SQL}) AS i WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 20) AND average_return IS NOT NULL
        GROUP BY industry_l1""",
)
def industry_heatmap_wide(spark, sf):
    """The form with one column per date, as a page shows it, read back by its columns."""
    wide = x.industry_heatmap(materialise(industry_rows(spark, sf), "industries"))
    cells = F.array(*[F.col(c) for c in wide.columns if c != "industry_l1"])
    known = wide.select("industry_l1", F.filter(cells, lambda c: c.isNotNull()).alias("c"))
    return known.where(F.size("c") > 0).select(
        "industry_l1", F.size("c").cast("long").alias("dates"), F.array_min("c").alias("smallest"), F.array_max("c").alias("largest")
    )


@query(
    "panel_counts",
    "row_count stock_count",
    "SELECT count(*) AS row_count, count(DISTINCT code) AS stock_count FROM bars",
)
def panel_counts(spark, sf):
    return x.panel_counts(bars_long(spark, sf))


@query("distinct_symbols", "code", "SELECT DISTINCT code FROM bars")
def distinct_symbols(spark, sf):
    return x.distinct_symbols(bars_long(spark, sf))


@query(
    "table_context",
    "table_name start_date end_date n_distinct",
    "SELECT 'stock' AS table_name, min(date) AS start_date, max(date) AS end_date, count(DISTINCT code) AS n_distinct FROM bars "
    "UNION ALL SELECT 'industry', min(date), max(date), count(DISTINCT date) FROM bars",
)
def table_context(spark, sf):
    bars = bars_long(spark, sf)
    stock = x.table_context(bars, "code").withColumn("table_name", F.lit("stock"))
    return stock.unionByName(
        x.table_context(industry_rows(spark, sf), "date").withColumn("table_name", F.lit("industry"))
    )


# ---- ranks, top-k, samples ---------------------------------------------------------------------


@query(
    "topn_per_date",
    "date code position predicted:6",
    "SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS position, amount AS predicted "
    "FROM evbars QUALIFY position <= 10",
)
def topn_per_date(spark, sf):
    return r.topn_per_date(bars_short(spark, sf).withColumn("predicted", F.col("amount")), 10)


AVERAGE_PCT = (
    "CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY date, v IS NULL ORDER BY v) + (count(*) OVER "
    "(PARTITION BY date, v) - 1) / 2.0) / count(v) OVER (PARTITION BY date) END"
)


@query(
    "rank_pct_average",
    "code date pct_average:6",
    f"SELECT code, date, {AVERAGE_PCT} AS pct_average FROM (SELECT code, date, ret AS v FROM evbars_base) AS b",
)
def rank_pct_average(spark, sf):
    return r.pct_average_by_date(bars_short(spark, sf).withColumn("ret", pct_change("close")), "ret")


@query(
    "rank_pct_first",
    "code date pct_first:6",
    "SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY volume, code) / count(*) OVER (PARTITION BY date) "
    "AS pct_first FROM evbars",
)
def rank_pct_first(spark, sf):
    return r.pct_first_by_date(bars_short(spark, sf), "volume")


def _movers_sql(direction: str) -> str:
    return (
        "SELECT code, (close - open) / open * 100 AS pct_change FROM evbars WHERE date = DATE '2024-01-20' AND open <> 0 "
        f"ORDER BY pct_change {direction}, code LIMIT 10"
    )


@query("top_gainers", "code pct_change:4", _movers_sql("DESC"))
def top_gainers(spark, sf):
    return r.movers(bars_short(spark, sf), "2024-01-20", 10, True)


@query("top_losers", "code pct_change:4", _movers_sql("ASC"))
def top_losers(spark, sf):
    return r.movers(bars_short(spark, sf), "2024-01-20", 10, False)


@query(
    "snapshot_page",
    "code name close:4 amount:3",
    "SELECT code, name, close, amount FROM bars JOIN dim USING (code) WHERE date = DATE '1998-06-15' "
    "ORDER BY amount DESC, code LIMIT 10 OFFSET 5",
)
def snapshot_page(spark, sf):
    return r.snapshot_page(j.join_snapshot_dim(bars_long(spark, sf), catalog(spark, sf), "1998-06-15"), 10, 5)


@query(
    "snapshot_table",
    "code open:4 close:4 board change_pct:2 volume_10k:2",
    f"SELECT code, open, close, {board()} AS board, (close - open) / open * 100 AS change_pct, volume / 10000 AS volume_10k "
    "FROM bars WHERE date = DATE '1998-06-15'",
)
def snapshot_table(spark, sf):
    return r.snapshot_table(j.join_snapshot_dim(bars_long(spark, sf), catalog(spark, sf), "1998-06-15"))


@query(
    "recent_sentiment",
    "code date sentiment:6 status",
    "SELECT code, date, sentiment, CASE WHEN sentiment > 0.1 THEN 'positive' WHEN sentiment < -0.1 THEN 'negative' ELSE 'neutral' "
    "END AS status FROM sent WHERE code = '000007' ORDER BY date DESC LIMIT 10",
)
def recent_sentiment(spark, sf):
    return r.recent_sentiment(sentiment(spark, sf), "7", 10)


@query(
    "latest_n",
    "code date close:4",
    "SELECT code, date, close FROM bars WHERE code = '007920' ORDER BY date DESC LIMIT 30",
)
def latest_n(spark, sf):
    return r.latest_n(bars_long(spark, sf), "007920", 30)


@query(
    "tail_per_symbol",
    "code date close:4",
    "SELECT code, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 20",
)
def tail_per_symbol(spark, sf):
    return r.tail_per_symbol(bars_long(spark, sf), 20)


# The catalog at sf0.01 has 100 symbols in up to 125 strata, so the sample is stratified by region and board.
BY_MARKET = "SELECT code, name, market AS industry_l1, board FROM dim"


def by_market(spark, sf):
    return catalog(spark, sf).select("code", "name", F.col("market").alias("industry_l1"), "board")


QUOTA_SQL = f"""
    WITH s AS (SELECT industry_l1, board, count(*) AS size FROM ({BY_MARKET}) AS c GROUP BY ALL),
    i AS (SELECT *, greatest(floor(ideal), 1) AS base, ideal - floor(ideal) AS remainder FROM (
        SELECT *, 60 * size / (SELECT sum(size) FROM s) AS ideal FROM s) AS a),
    g AS (SELECT *, 60 - (SELECT sum(base) FROM i) AS gap FROM i),
    down AS (SELECT industry_l1, board, -count(*) AS adjust FROM (SELECT *, row_number() OVER (ORDER BY remainder, level DESC,
        industry_l1, board) AS turn FROM (SELECT *, unnest(range(2, CAST(base AS BIGINT) + 1)) AS level FROM g WHERE gap < 0) AS u)
        AS t WHERE turn <= -gap GROUP BY ALL),
    up AS (SELECT industry_l1, board, count(*) AS adjust FROM (SELECT *, row_number() OVER (ORDER BY round, remainder DESC, size DESC,
        industry_l1, board) AS turn FROM (SELECT *, unnest(range(1, CAST(least(size - base, gap) AS BIGINT) + 1)) AS round FROM g
        WHERE gap > 0) AS u) AS t WHERE turn <= gap GROUP BY ALL)
    SELECT industry_l1, board, size, CAST(base + coalesce(adjust, 0) AS BIGINT) AS quota FROM g
        LEFT JOIN (SELECT * FROM down UNION ALL SELECT * FROM up) AS a USING (industry_l1, board)"""


@query("stratum_quotas", "industry_l1 board size quota", QUOTA_SQL)
def stratum_quotas(spark, sf):
    return r.stratum_quotas(by_market(spark, sf), 60)


SAMPLE_SQL = f"""
    SELECT industry_l1, board, code, row_number() OVER (ORDER BY industry_l1, board, code) AS selection_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY industry_l1, board ORDER BY md5(code || ':42'), code) AS turn
        FROM ({BY_MARKET}) AS c) AS d JOIN ({QUOTA_SQL}) AS q USING (industry_l1, board) WHERE turn <= quota"""


@query("stratified_sample", "industry_l1 board code selection_rank", SAMPLE_SQL)
def stratified_sample(spark, sf):
    return r.stratified_sample(by_market(spark, sf), 60)


@query(
    "selection_counts",
    "board stock_count",
    f"SELECT board, count(*) AS stock_count FROM ({SAMPLE_SQL}) AS s GROUP BY board",
)
def selection_counts(spark, sf):
    return x.counts_by(r.stratified_sample(by_market(spark, sf), 60), "board")


@query(
    "even_downsample",
    "code date row_index close:4",
    """SELECT code, date, i AS row_index, close FROM (SELECT *, row_number() OVER (ORDER BY code, date) - 1 AS i FROM bars) AS b
        WHERE i IN (SELECT CAST(CASE WHEN s = 4999 THEN n - 1 ELSE floor(s * ((n - 1) / 4999.0::DOUBLE)) END AS BIGINT)
        FROM range(5000) AS r(s), (SELECT count(*) AS n FROM bars) AS c)""",
)
def even_downsample(spark, sf):
    return r.even_downsample(bars_long(spark, sf), 5000)


# ---- set operations ----------------------------------------------------------------------------


@query(
    "union_panels",
    "source row_count volume",
    "SELECT 'long' AS source, count(*) AS row_count, sum(volume) AS volume FROM bars UNION ALL SELECT 'short', count(*), sum(volume) FROM evbars",
)
def union_panels(spark, sf):
    both = bars_long(spark, sf).withColumn("source", F.lit("long")).unionByName(
        bars_short(spark, sf).withColumn("source", F.lit("short"))
    )
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("row_count"), F.sum("volume").alias("volume"))


@query(
    "symbol_union",
    "code",
    "SELECT code FROM bars UNION SELECT code FROM evbars UNION SELECT code FROM dim",
)
def symbol_union(spark, sf):
    return union_universe(bars_long(spark, sf), bars_short(spark, sf), catalog(spark, sf))


@query(
    "key_difference",
    "code",
    "SELECT DISTINCT code FROM dim EXCEPT SELECT code FROM evbars",
)
def key_difference(spark, sf):
    return j.missing_detail(catalog(spark, sf), bars_short(spark, sf))
