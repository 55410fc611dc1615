"""Quality report and the views on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import LONG_CODE_PATTERN
from barloom.operators import quality as q
from barloom.plans.cleaning_queries import CLEAN_SQL, DATED, VALID, cleaned, dated
from barloom.plans.oracle import HIST
from barloom.plans.registry import query
from barloom.sources.adapter import bars_long, bars_short, sentiment

# A panel with faults: raw rows (duplicates, missing cells, broken bounds) with two factor columns.
DIRTY_COLUMNS = ["code", "date", "open", "high", "low", "close", "volume", "amount", "momentum_60d", "label"]
DIRTY = (
    "SELECT code, try_strptime(trade_date, '%Y%m%d')::DATE AS date, open, high, low, close, vol AS volume, amount, "
    "CASE WHEN open > 100 THEN open END AS momentum_60d, CASE WHEN vol < 49 THEN vol END AS label FROM raw"
)


def dirty(spark, sf):
    raw = dated(spark, sf)
    return raw.withColumns(
        {
            "momentum_60d": F.when(F.col("open") > 100, F.col("open")),
            "label": F.when(F.col("volume") < 49, F.col("volume")),
        }
    ).select(*DIRTY_COLUMNS)


def _sum_missing(columns: list[str]) -> str:
    return " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)


REPORT_SQL = f"""
    SELECT *, CASE WHEN duplicate_key_count + invalid_date_count + invalid_ohlc_count + unexpected_missing_cell_count
            + nonpositive_price_count + negative_volume_count + invalid_code_count > 0 THEN 'FAIL'
        WHEN structural_factor_missing_count + structural_label_missing_count + zero_volume_count
            + extreme_return_count > 0 THEN 'WARN' ELSE 'PASS' END AS quality_status
    FROM (SELECT count(*) AS row_count, count(DISTINCT code) AS stock_count, 10 AS column_count,
        min(date) AS start_date, max(date) AS end_date, count(*) FILTER (date IS NULL) AS invalid_date_count,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT code, date FROM ({DIRTY}) AS x) AS y) AS duplicate_key_count,
        count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS invalid_ohlc_count,
        {_sum_missing(DIRTY_COLUMNS)} AS missing_cell_count, {_sum_missing(DIRTY_COLUMNS[:8])} AS raw_missing_cell_count,
        count(*) FILTER (momentum_60d IS NULL) AS structural_factor_missing_count,
        count(*) FILTER (label IS NULL) AS structural_label_missing_count,
        {_sum_missing(DIRTY_COLUMNS[:8])} AS unexpected_missing_cell_count,
        count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS nonpositive_price_count,
        count(*) FILTER (volume < 0) AS negative_volume_count, count(*) FILTER (volume = 0) AS zero_volume_count,
        count(*) FILTER (NOT regexp_full_match(code, '[0-9]{{6,}}')) AS invalid_code_count,
        (SELECT count(*) FROM (SELECT close / lag(close) OVER {HIST} - 1 AS r FROM (SELECT code, date, max(close) AS close
            FROM ({DIRTY}) AS a WHERE date IS NOT NULL GROUP BY code, date) AS b) AS c WHERE abs(r) > 0.3) AS extreme_return_count
        FROM ({DIRTY}) AS d) AS r"""
REPORT_SHAPE = (
    "row_count stock_count column_count start_date end_date invalid_date_count duplicate_key_count invalid_ohlc_count "
    "missing_cell_count raw_missing_cell_count structural_factor_missing_count structural_label_missing_count "
    "unexpected_missing_cell_count nonpositive_price_count negative_volume_count zero_volume_count invalid_code_count "
    "extreme_return_count quality_status"
)


@query("quality_report", REPORT_SHAPE, REPORT_SQL)
def quality_report(spark, sf):
    return q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN)


@query("quality_status", "quality_status row_count", REPORT_SQL)
def quality_status(spark, sf):
    return q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN)


def _profile_sql(columns: list[str], source: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS n FROM ({source}) AS s"
        for c in columns
    )
    structural = ", ".join(f"'{c}'" for c in q.STRUCTURAL_FACTORS)
    return (
        "SELECT column_name, missing_count, missing_count / n AS missing_rate, CASE WHEN column_name IN "
        f"({structural}) THEN 'structural_factor' WHEN column_name = 'label' THEN 'structural_label' "
        f"ELSE 'unexpected' END AS category FROM ({each}) AS m WHERE missing_count > 0"
    )


@query("missing_profile", "column_name missing_count missing_rate:5 category", _profile_sql(DIRTY_COLUMNS, DIRTY))
def missing_profile(spark, sf):
    return q.missing_profile(dirty(spark, sf))


@query(
    "extreme_returns",
    "code extreme_count",
    f"SELECT code, count(*) FILTER (abs(r) > 0.3) AS extreme_count FROM (SELECT code, close / lag(close) OVER {HIST} - 1 AS r "
    f"FROM bars) AS b GROUP BY code",
)
def extreme_returns(spark, sf):
    return q.extreme_returns(bars_long(spark, sf))


@query(
    "source_distribution",
    "source row_count",
    "SELECT coalesce(data_source, 'not_available') AS source, count(*) AS row_count FROM (SELECT code, date FROM evbars UNION ALL "
    "SELECT code, date FROM bars) AS b LEFT JOIN sent AS s USING (code, date) GROUP BY 1",
)
def source_distribution(spark, sf):
    both = bars_short(spark, sf).unionByName(bars_long(spark, sf))
    joined = both.join(sentiment(spark, sf), ["code", "date"], "left")
    return q.source_distribution(joined.withColumnRenamed("data_source", "sentiment_source"))


@query(
    "valid_summary",
    "input_rows valid_rows invalid_rows stock_count start_date end_date",
    f"SELECT count(*) AS input_rows, count(*) FILTER (date IS NOT NULL AND {VALID}) AS valid_rows, "
    f"count(*) - count(*) FILTER (date IS NOT NULL AND {VALID}) AS invalid_rows, count(DISTINCT code) AS stock_count, "
    f"min(date) AS start_date, max(date) AS end_date FROM ({DATED}) AS d",
)
def valid_summary(spark, sf):
    return q.valid_summary(dated(spark, sf), LONG_CODE_PATTERN)


SCORE_SQL = f"""
    SELECT 'run' AS run_id, row_count, greatest(0.0, 100.0 - (duplicate_key_count + invalid_date_count + invalid_ohlc_count
        + nonpositive_price_count + negative_volume_count + invalid_code_count + unexpected_missing_cell_count)
        / greatest(row_count, 1) * 100.0) AS quality_score, quality_status AS status FROM ({REPORT_SQL}) AS rep"""


@query("quality_score", "run_id row_count quality_score:3 status", SCORE_SQL)
def quality_score(spark, sf):
    return q.quality_run(q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN), "run", "v1")


RULE_ROWS = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_name, '{column}' AS column_name, {count} AS issue_count, '{severity}' AS severity, "
    f"'{category}' AS category FROM ({REPORT_SQL}) AS rep"
    for rule, column, count, severity, category in q.RULES
)
ISSUES_SQL = f"""
    SELECT 'run' AS run_id, rule_name, column_name, issue_count, severity, category FROM ({RULE_ROWS}) AS rules UNION ALL
    SELECT 'run', 'missing_value', column_name, missing_count, CASE WHEN category LIKE 'structural%' THEN 'INFO'
        ELSE 'ERROR' END, category FROM ({_profile_sql(DIRTY_COLUMNS, DIRTY)}) AS p"""


def issues(spark, sf):
    frame = dirty(spark, sf)
    return q.quality_issues(q.quality_report(frame, LONG_CODE_PATTERN), q.missing_profile(frame), "run")


@query("quality_issues", "run_id rule_name column_name issue_count severity category", ISSUES_SQL)
def quality_issues(spark, sf):
    return issues(spark, sf)


@query(
    "daily_quality",
    "date row_count stock_count missing_close missing_return",
    f"SELECT date, count(*) AS row_count, count(DISTINCT code) AS stock_count, count(*) FILTER (close IS NULL) AS missing_close, "
    f"count(*) FILTER (ret IS NULL) AS missing_return FROM (SELECT *, close / lag(close) OVER {HIST} - 1 AS ret "
    f"FROM ({CLEAN_SQL}) AS z) AS y GROUP BY date",
)
def daily_quality(spark, sf):
    return q.daily_quality(cleaned(spark, sf).withColumn("ret", q.pct_change("close")))


@query(
    "coverage",
    "code start_date end_date trading_days",
    "SELECT code, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days FROM bars GROUP BY code",
)
def coverage(spark, sf):
    return q.coverage(bars_long(spark, sf))


@query(
    "issue_rollup",
    "rule_name category issue_count issue_rate:6",
    f"SELECT rule_name, category, CAST(sum(issue_count) AS BIGINT) AS issue_count, sum(issue_count) / greatest(any_value(n), 1) AS issue_rate "
    f"FROM ({ISSUES_SQL}) AS i, (SELECT count(*) AS n FROM raw) AS r GROUP BY rule_name, category",
)
def issue_rollup(spark, sf):
    run = q.quality_run(q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN), "run", "v1")
    return q.issue_rollup(issues(spark, sf), run)


CHECK_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, {count} AS issue_count, CASE WHEN '{verdict}' = 'fail' AND {count} = 0 THEN 'pass' "
    f"ELSE '{verdict}' END AS verdict FROM ({REPORT_SQL}) AS rep"
    for name, count, verdict in q.CHECKS
)


@query("quality_checks_view", "check_name issue_count verdict", CHECK_ROWS)
def quality_checks_view(spark, sf):
    return q.quality_checks(q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN))


@query(
    "freshness",
    "watermark freshness_days",
    "SELECT max(date) AS watermark, greatest(CAST(DATE '2002-01-01' - max(date) AS INTEGER), 0) AS freshness_days FROM bars",
)
def freshness(spark, sf):
    return q.freshness(bars_long(spark, sf), "2002-01-01")
