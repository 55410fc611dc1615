"""Serving reads over the star, metrics pages, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import code_from_number
from barloom.functions.windows import pct_change
from barloom.operators import metrics as m
from barloom.operators import ranking as r
from barloom.operators import serving as s
from barloom.operators import text as t
from barloom.plans.crosssection_queries import IC_SQL, INDUSTRY_SHAPE, INDUSTRY_SQL, MARKET_SHAPE, _ic_sql, industry_rows
from barloom.plans.oracle import HIST, code_of
from barloom.plans.registry import query
from barloom.session import files_key, materialise, shared_dir, shuffles_released
from barloom.sources import sinks
from barloom.sources.adapter import EVENT_WEIGHTS, bars_long, catalog, table

VERSION = "v1"


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def star_root(spark, sf):
    """Where the star of these tables is published, by the files that they consist of; it is published if it is not there."""
    root = f"{shared_dir(spark)}/star-{files_key(spark, *[f'{sf}/{t}.parquet' for t in SOURCES])}"
    if sinks.latest(spark, root) is None:
        with shuffles_released(spark):
            bars, dim = materialise(bars_long(spark, sf), "bars"), catalog(spark, sf)  # for the version, the layout and the facts
            version = sinks.content_version({"bars": bars, "catalog": dim}).first()["data_version"]
            s.publish_star(spark, root, version[:16], bars, dim, VERSION, "line items", spent=True)
    return root


def star(spark, sf):
    """The published star; reads over it scan its tables only."""
    return sinks.open_published(spark, star_root(spark, sf))


FACTS = (
    f"(SELECT p.*, b.pre_close, b.close - b.pre_close AS change, (b.close - b.pre_close) / b.pre_close * 100 AS pct_chg, "
    f"0.0 AS sentiment, '{VERSION}' AS data_version FROM bars_ready AS p JOIN (SELECT code, date, close, lag(close) OVER {HIST} "
    "AS pre_close FROM bars) AS b USING (code, date)) AS facts"
)
DETAIL = "SELECT *, 1 AS has_detail FROM dim WHERE code IN (SELECT code FROM bars_ready)"
FACT_MARKET = """
    SELECT date, count(*) AS stock_count, count(*) FILTER (ret > 0) AS advancing_count,
        count(*) FILTER (ret < 0) AS declining_count, count(*) FILTER (coalesce(ret, 0) = 0) AS flat_count,
        sum(volume) AS total_volume, sum(amount) AS total_amount, avg(close) AS average_close,
        avg(ret) AS average_return, median(ret) AS median_return, 0.0 AS average_sentiment
    FROM bars_ready GROUP BY date"""
FACT_INDUSTRY = """
    SELECT industry_l1, date, count(*) AS stock_count, avg(close) AS average_close, avg(ret) AS average_return,
        median(ret) AS median_return, sum(volume) AS total_volume, sum(amount) AS total_amount,
        count(*) FILTER (coalesce(ret, 0) > 0) / count(*) AS advancing_ratio, 0.0 AS average_sentiment
    FROM bars_ready JOIN dim USING (code) GROUP BY industry_l1, date"""


@query(
    "q_manifest",
    "run_id status input_rows data_start_date data_end_date data_version asset_catalog_stock_count aggregate_trading_day_count "
    "public_detail_stock_count public_detail_record_count public_detail_end_date",
    f"""SELECT 'serving-{VERSION}' AS run_id, 'SUCCESS' AS status, count(*) AS input_rows, min(date) AS data_start_date,
        max(date) AS data_end_date, '{VERSION}' AS data_version, (SELECT count(*) FROM dim) AS asset_catalog_stock_count,
        count(DISTINCT date) AS aggregate_trading_day_count, count(DISTINCT code) AS public_detail_stock_count,
        count(*) AS public_detail_record_count, CAST(max(date) AS VARCHAR) AS public_detail_end_date FROM bars_ready""",
)
def q_manifest(spark, sf):
    return s.manifest(star(spark, sf))


@query(
    "q_asset_summary",
    "data_version source_label catalog_stock_count detail_stock_count record_count trading_day_count duplicate_key_count column_count",
    f"""SELECT '{VERSION}' AS data_version, 'line items' AS source_label, (SELECT count(*) FROM dim) AS catalog_stock_count,
        count(DISTINCT code) AS detail_stock_count, count(*) AS record_count, count(DISTINCT date) AS trading_day_count,
        0 AS duplicate_key_count, 49 AS column_count FROM bars_ready""",
)
def q_asset_summary(spark, sf):
    return s.asset_summary(star(spark, sf))


@query(
    "join_run_quality",
    "data_version quality_status record_count",
    f"SELECT '{VERSION}' AS data_version, 'WARN' AS quality_status, count(*) AS record_count FROM bars_ready",
)
def join_run_quality(spark, sf):
    return s.asset_summary(star(spark, sf))


@query(
    "q_catalog",
    "code name market board industry_l1 is_demo has_detail source",
    f"SELECT * FROM ({DETAIL}) AS d WHERE industry_l1 = 'NATION_3' ORDER BY code",
)
def q_catalog(spark, sf):
    return s.stock_catalog(star(spark, sf), "NATION_3", True)


@query("q_metadata", "code name board industry_l1 has_detail", f"SELECT * FROM ({DETAIL}) AS d WHERE code = '007920'")
def q_metadata(spark, sf):
    return s.stock_metadata(star(spark, sf), "7920")


@query(
    "q_market_summary",
    MARKET_SHAPE + " source data_version",
    f"SELECT *, 'line items' AS source, '{VERSION}' AS data_version FROM ({FACT_MARKET}) AS f "
    "WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def q_market_summary(spark, sf):
    return s.market_summary(star(spark, sf), "1997-01-01", "1998-12-31")


SNAPSHOT_SQL = (
    "SELECT code, name, market, board, industry_l1, date, close, pre_close, change, pct_chg, volume, amount, ret, sentiment "
    f"FROM {FACTS} JOIN dim USING (code) WHERE date = (SELECT max(date) FROM bars_ready)"
)


@query(
    "q_market_snapshot",
    "code name market board industry_l1 date close:4 pre_close:4 change:4 pct_chg:3 volume amount:3 ret:5 sentiment:2",
    f"{SNAPSHOT_SQL}",
)
def q_market_snapshot(spark, sf):
    return s.market_snapshot(star(spark, sf))


@query(
    "q_industry_summary",
    INDUSTRY_SHAPE,
    f"SELECT * FROM ({FACT_INDUSTRY}) AS i WHERE industry_l1 IN ('NATION_3', 'NATION_7') AND date >= DATE '1999-01-01'",
)
def q_industry_summary(spark, sf):
    return s.industry_summary(star(spark, sf), "1999-01-01", None, ["NATION_7", "NATION_3"])


@query(
    "q_stock_history",
    "code date close:4 ma20:4 rsi:6 macd:4 bb_position:5 pct_chg:3 label:5 sentiment:2 data_version",
    f"SELECT * FROM {FACTS} WHERE code = '007920' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def q_stock_history(spark, sf):
    return s.stock_history(star(spark, sf), "007920", "1996-01-01", "1999-12-31")


@query(
    "q_peer_history",
    "code name industry_l1 date close:4 ret:5 volatility_20d:5",
    "SELECT code, name, industry_l1, date, close, ret, volatility_20d FROM bars_ready JOIN dim USING (code) "
    "WHERE industry_l1 = 'NATION_3' AND date >= DATE '2000-01-01'",
)
def q_peer_history(spark, sf):
    return s.peer_history(star(spark, sf), "NATION_3", "2000-01-01")


@query(
    "q_factor_ic",
    "factor_name date ic:6 sample_count",
    f"SELECT * FROM ({_ic_sql('bars_ready', ['rsi', 'macd'])}) AS i WHERE date >= DATE '2000-01-01'",
)
def q_factor_ic(spark, sf):
    return s.factor_ic(star(spark, sf), ["rsi", "macd"], "2000-01-01")


@query(
    "q_factor_catalog",
    "factor_name",
    f"SELECT DISTINCT factor_name FROM ({IC_SQL}) AS i UNION ALL SELECT unnest(['sentiment', 'sentiment_ma5', 'sentiment_ma10'])",
)
def q_factor_catalog(spark, sf):
    return s.factor_catalog(star(spark, sf))


@query(
    "q_quality_runs",
    "run_id data_date row_count stock_count duplicate_key_count status data_version",
    f"SELECT 'quality-{VERSION}' AS run_id, max(date) AS data_date, count(*) AS row_count, count(DISTINCT code) AS stock_count, "
    f"0 AS duplicate_key_count, 'WARN' AS status, '{VERSION}' AS data_version FROM bars_ready",
)
def q_quality_runs(spark, sf):
    return s.quality_runs(star(spark, sf))


@query(
    "q_quality_issues",
    "rule_name column_name issue_count severity",
    f"""SELECT 'missing_value' AS rule_name, column_name, n AS issue_count, 'INFO' AS severity FROM (
        SELECT 'momentum_20d' AS column_name, count(*) FILTER (momentum_20d IS NULL) AS n FROM bars_ready UNION ALL
        SELECT 'momentum_60d', count(*) FILTER (momentum_60d IS NULL) FROM bars_ready UNION ALL
        SELECT 'ret_5d', count(*) FILTER (ret_5d IS NULL) FROM bars_ready UNION ALL
        SELECT 'ret_10d', count(*) FILTER (ret_10d IS NULL) FROM bars_ready UNION ALL
        SELECT 'reversal_5d', count(*) FILTER (reversal_5d IS NULL) FROM bars_ready UNION ALL
        SELECT 'label', count(*) FILTER (label IS NULL) FROM bars_ready) AS c UNION ALL
        SELECT 'extreme_return', 'ret', count(*) FILTER (abs(r) > 0.3), 'WARN' FROM (
            SELECT close / nullif(lag(close) OVER {HIST}, 0) - 1 AS r FROM bars_ready) AS x UNION ALL
        SELECT 'zero_volume', 'volume', count(*) FILTER (volume = 0), 'WARN' FROM bars_ready UNION ALL
        SELECT 'negative_volume', 'volume', count(*) FILTER (volume < 0), 'ERROR' FROM bars_ready UNION ALL
        SELECT 'nonpositive_price', 'ohlc', count(*) FILTER (least(open, high, low, close) <= 0), 'ERROR' FROM bars_ready UNION ALL
        SELECT 'invalid_ohlc', 'ohlc', count(*) FILTER (high < greatest(open, low, close) OR low > least(open, high, close)), 'ERROR'
            FROM bars_ready UNION ALL
        SELECT 'invalid_date', 'date', count(*) FILTER (date IS NULL), 'ERROR' FROM bars_ready UNION ALL
        SELECT 'invalid_stock_code', 'code', count(*) FILTER (NOT regexp_full_match(code, '[0-9]{{6,}}')), 'ERROR' FROM bars_ready UNION ALL
        SELECT 'duplicate_primary_key', '', count(*) - count(DISTINCT (code, date)), 'ERROR' FROM bars_ready UNION ALL
        SELECT 'unexpected_missing', '', count(*) FILTER (open IS NULL OR close IS NULL), 'ERROR' FROM bars_ready""",
)
def q_quality_issues(spark, sf):
    return s.quality_issues(star(spark, sf))


# The list a page would ask for: the first hundred suppliers.
WATCHLIST = [f"{k * 7919 + 1:06d}" for k in range(100)]


@query(
    "q_latest_quotes",
    "code date close:4 pct_chg:3 change:4",
    f"SELECT code, date, close, pct_chg, change FROM {FACTS} WHERE date = (SELECT max(date) FROM bars_ready) "
    f"AND code IN ({', '.join(repr(c) for c in WATCHLIST)})",
)
def q_latest_quotes(spark, sf):
    return s.latest_quotes(star(spark, sf), WATCHLIST)


BENCH_SHAPE = "code date open:4 high:4 low:4 close:4 volume amount:3 ret:5 ma5:4 ma20:4 rsi:6 macd:4 volatility_20d:5 sentiment:2"


@query(
    "q_bench_latest252",
    BENCH_SHAPE,
    f"SELECT * FROM {FACTS} WHERE code = '007920' ORDER BY date DESC LIMIT 252",
)
def q_bench_latest252(spark, sf):
    return s.bench_latest(star(spark, sf), "007920")


@query(
    "q_bench_range",
    BENCH_SHAPE,
    f"SELECT * FROM {FACTS} WHERE code = '007920' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
)
def q_bench_range(spark, sf):
    return s.bench_range(star(spark, sf), "007920", "1997-01-01", "1999-12-31")


@query(
    "q_industry_trend",
    INDUSTRY_SHAPE,
    f"SELECT * FROM ({FACT_INDUSTRY}) AS i WHERE industry_l1 = 'NATION_3' AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'",
)
def q_industry_trend(spark, sf):
    return s.industry_trend(star(spark, sf), "NATION_3", "1998-01-01", "1999-12-31")


# ---- metrics -----------------------------------------------------------------------------------

METRICS_SQL = f"""
    SELECT code, arg_max(close, date) AS latest_close, arg_max(close, date) / nullif(arg_min(close, date), 0) - 1 AS period_return,
        stddev_samp(ret) * sqrt(252) AS annualized_volatility, min(dd) AS max_drawdown, avg(amount) AS average_turnover,
        count(close) AS closes FROM (SELECT *, close / nullif(lag(close) OVER {HIST}, 0) - 1 AS ret,
            close / nullif(max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1
            AS dd FROM bars) AS b GROUP BY code"""


@query(
    "stock_metrics",
    "code latest_close:4 period_return:5 annualized_volatility:4 max_drawdown:6 average_turnover:3",
    METRICS_SQL,
)
def stock_metrics(spark, sf):
    return m.stock_metrics(bars_long(spark, sf).withColumn("ret", pct_change("close")))


def _pct(value: str, direction: str = "") -> str:
    return (
        f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY industry_l1, {value} IS NULL ORDER BY {value} {direction}) "
        f"+ (count(*) OVER (PARTITION BY industry_l1, {value}) - 1) / 2.0) / count({value}) OVER (PARTITION BY industry_l1) END"
    )


@query(
    "peer_percentiles",
    "industry_l1 code name return_percentile:6 stability_percentile:6 drawdown_control_percentile:6",
    f"SELECT industry_l1, code, name, {_pct('period_return')} AS return_percentile, {_pct('annualized_volatility', 'DESC')} AS "
    f"stability_percentile, {_pct('max_drawdown')} AS drawdown_control_percentile FROM ({METRICS_SQL}) AS x JOIN dim USING (code) "
    "WHERE closes >= 2",
)
def peer_percentiles(spark, sf):
    return m.peer_percentiles(bars_long(spark, sf).withColumn("ret", pct_change("close")), catalog(spark, sf))


IND_METRICS_SQL = f"""
    SELECT industry_l1, arg_max(stock_count, date) AS stock_count, arg_max(average_return, date) AS latest_return,
        arg_max(advancing_ratio, date) AS advancing_ratio, arg_max(total_amount, date) AS total_amount,
        avg(total_amount) FILTER (i <= 5) / CASE WHEN count(*) >= 10 THEN avg(total_amount) FILTER (i BETWEEN 6 AND 10) END - 1
            AS amount_change_5d,
        product(1 + average_return) FILTER (k <= 5) - 1 AS return_5d, product(1 + average_return) FILTER (k <= 20) - 1 AS return_20d,
        product(1 + average_return) FILTER (k <= 60) - 1 AS return_60d
    FROM (SELECT *, row_number() OVER (PARTITION BY industry_l1 ORDER BY date DESC) AS i,
        CASE WHEN average_return IS NOT NULL THEN row_number() OVER (PARTITION BY industry_l1, average_return IS NULL ORDER BY date DESC)
        END AS k FROM (SELECT * FROM ({INDUSTRY_SQL}) AS a WHERE date >= (SELECT max(date) FROM bars) - 120) AS w) AS r
    GROUP BY industry_l1"""


def recent_industry(spark, sf):
    return m.recent_window(industry_rows(spark, sf))


@query(
    "industry_metrics",
    "industry_l1 stock_count latest_return:5 advancing_ratio:6 total_amount:2 amount_change_5d:5 log_5d:5 log_20d:5 log_60d:4",
    f"SELECT *, ln(1 + return_5d) AS log_5d, ln(1 + return_20d) AS log_20d, ln(1 + return_60d) AS log_60d FROM ({IND_METRICS_SQL}) AS z",
)
def industry_metrics(spark, sf):
    found = m.industry_metrics(recent_industry(spark, sf))
    return found.withColumns({f"log_{n}d": F.log1p(f"return_{n}d") for n in m.RETURN_WINDOWS})


@query(
    "industry_ranking",
    "industry_l1 position",
    f"SELECT industry_l1, row_number() OVER (ORDER BY return_20d DESC NULLS LAST, industry_l1) AS position FROM ({IND_METRICS_SQL}) AS z",
)
def industry_ranking(spark, sf):
    return r.industry_ranking(m.industry_metrics(recent_industry(spark, sf)), 20)


@query(
    "industry_overview",
    "industries trading_days latest_date advancing not_advancing",
    f"""SELECT count(*) AS industries, (SELECT count(DISTINCT date) FROM bars WHERE date >= (SELECT max(date) FROM bars) - 120)
        AS trading_days, (SELECT max(date) FROM bars) AS latest_date, count(*) FILTER (latest_return > 0) AS advancing,
        count(*) FILTER (latest_return <= 0) AS not_advancing FROM ({IND_METRICS_SQL}) AS z""",
)
def industry_overview(spark, sf):
    return m.industry_overview(industry_rows(spark, sf))


# ---- text --------------------------------------------------------------------------------------

# Words that occur in the supplied documents, in place of the default finance lexicon.
POSITIVE = ["license", "orantion", "hehely", "thatin", "good", "the &"]
NEGATIVE = ["rewh", "ononst", "orre", "bad", "error"]


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(
    "lexicon_sentiment",
    "doc_id sentiment:6",
    f"SELECT doc_id, coalesce((p - n) / nullif(p + n, 0), 0) AS sentiment FROM (SELECT doc_id, {_hits_sql(POSITIVE)} AS p, "
    f"{_hits_sql(NEGATIVE)} AS n FROM documents) AS d",
)
def lexicon_sentiment(spark, sf):
    return t.lexicon_sentiment(table(spark, sf, "documents").select("doc_id", "text"), "text", POSITIVE, NEGATIVE)


def event_items(spark, sf):
    weight = F.lit(0.0)
    for name, value in EVENT_WEIGHTS.items():
        weight = F.when(F.col("event_type") == name, value).otherwise(weight)
    return table(spark, sf, "events").select(
        code_from_number("user_id").alias("code"), "ts", weight.alias("sentiment"), "event_id", "props"
    )


@query(
    "daily_sentiment",
    "code date sentiment:6 news_count data_source",
    "SELECT code, date, sentiment, comment_count AS news_count, data_source FROM sent",
)
def daily_sentiment(spark, sf):
    return t.daily_sentiment(event_items(spark, sf), "events")


@query(
    "comment_sentiment",
    "code date sentiment:6 comment_count data_source",
    f"""SELECT {code_of('user_id')} AS code, CAST(ts AS DATE) AS date,
        coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS sentiment, 1 AS comment_count, 'events' AS data_source
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""",
)
def comment_sentiment(spark, sf):
    items = event_items(spark, sf).withColumns(
        {"date": F.col("ts").cast("date"), "sentiment": F.from_json("props", "k string").getField("k")}
    )
    return t.comment_sentiment(items, ["ts", "event_id"], "events")
