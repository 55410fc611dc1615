"""Cleaning and incremental-update queries over raw bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import LONG_CODE_PATTERN, normalise_code
from barloom.operators import cleaning as c
from barloom.plans.oracle import HIST
from barloom.plans.registry import query
from barloom.session import scratch_path
from barloom.sources.adapter import bars_long, bars_short, raw_bars, table
from barloom.sources.sinks import write_partitioned
from barloom.streaming import incremental as inc

RAW_SHAPE = "code date open:4 high:4 low:4 close:4 volume amount:4"


@query(
    "standardise_columns",
    "code date open:4 close:4 volume amount:4",
    "SELECT code, trade_date AS date, open, close, vol AS volume, amount FROM raw",
)
def standardise_columns(spark, sf):
    return c.standardise_columns(raw_bars(spark, sf))


@query(
    "normalise_code",
    "code_text code is_valid n",
    "SELECT code_text, code, regexp_full_match(code, '[0-9]{6}') AS is_valid, count(*) AS n FROM (SELECT code_text, "
    "CASE WHEN length(bare) < 6 THEN lpad(bare, 6, '0') ELSE bare END AS code FROM (SELECT code_text, "
    "regexp_replace(code_text, '\\.0$', '') AS bare FROM (SELECT CASE WHEN l_linenumber = 1 "
    "THEN CAST(l_partkey AS VARCHAR) || '.0' WHEN l_linenumber = 2 THEN CAST(l_orderkey AS VARCHAR) || '0000000' "
    "ELSE CAST(l_partkey AS VARCHAR) END AS code_text FROM lineitem) AS a) AS b) AS d GROUP BY code_text, code",
)
def normalise_code_query(spark, sf):
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(".0")))
        .when(line == 2, F.concat(F.col("l_orderkey").cast("string"), F.lit("0000000")))
        .otherwise(F.col("l_partkey").cast("string"))
    )
    coded = table(spark, sf, "lineitem").select(text.alias("code_text"), normalise_code(text).alias("code"))
    return coded.groupBy("code_text", "code").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_valid", c.is_valid_code("code")
    )


@query(
    "parse_trade_date",
    "code trade_date n",
    "SELECT code, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS trade_date, count(*) AS n FROM raw "
    "WHERE regexp_full_match(trade_date, '[0-9]{8}') GROUP BY ALL",
)
def parse_trade_date(spark, sf):
    return c.parse_trade_dates(raw_bars(spark, sf)).groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "invalid_dates",
    "code invalid_dates",
    "SELECT code, count(*) FILTER (NOT regexp_full_match(trade_date, '[0-9]{8}')) AS invalid_dates FROM raw GROUP BY code",
)
def invalid_dates(spark, sf):
    return c.invalid_date_counts(raw_bars(spark, sf))


def _dedup_sql(direction: str) -> str:
    return (
        "SELECT code, trade_date, open, close, vol, amount FROM raw "
        f"QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY seq {direction}) = 1"
    )


DEDUP_SHAPE = "code trade_date open:4 close:4 vol amount:4"


@query("dedup_first", DEDUP_SHAPE, _dedup_sql("ASC"))
def dedup_first(spark, sf):
    return c.dedup(raw_bars(spark, sf), ["code", "trade_date"], ["seq"], "first")


@query("dedup_last", DEDUP_SHAPE, _dedup_sql("DESC"))
def dedup_last(spark, sf):
    return c.dedup(raw_bars(spark, sf), ["code", "trade_date"], ["seq"], "last")


VALID = "close > 0 AND volume >= 0 AND high >= greatest(open, close) AND low <= least(open, close)"
DATED = (
    "SELECT code, CAST(try_strptime(trade_date, '%Y%m%d') AS DATE) AS date, open, high, low, close, vol AS volume, amount "
    "FROM raw"
)


def dated(spark, sf):
    raw = raw_bars(spark, sf).drop("seq")
    return c.standardise_columns(raw.withColumn("trade_date", c.trade_date("trade_date")))


@query(
    "valid_bar_filter",
    RAW_SHAPE,
    f"SELECT * FROM ({DATED}) AS d WHERE regexp_full_match(code, '[0-9]{{6,}}') AND date IS NOT NULL AND {VALID}",
)
def valid_bar_filter(spark, sf):
    return c.valid_bar_filter(dated(spark, sf), LONG_CODE_PATTERN)


@query(
    "anomaly_counts",
    "code nonpositive_close negative_volume broken_ohlc",
    "SELECT code, count(*) FILTER (close <= 0) AS nonpositive_close, count(*) FILTER (vol < 0) AS negative_volume, "
    "count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close) AS broken_ohlc "
    "FROM raw GROUP BY code",
)
def anomaly_counts(spark, sf):
    return c.anomaly_counts(raw_bars(spark, sf))


CELLS = ["open", "high", "low", "close", "vol", "amount"]
RATE = " UNION ALL ".join(
    f"SELECT code, '{x}' AS column_name, avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM raw GROUP BY code"
    for x in CELLS
)


@query(
    "column_missing_rates",
    "code column_name missing_rate:6 dropped",
    f"SELECT *, missing_rate > 0.05 AS dropped FROM ({RATE}) AS r",
)
def column_missing_rates(spark, sf):
    return c.missing_rates(raw_bars(spark, sf), CELLS)


# The cleaning chain, restated step by step.
CLEAN_SQL = f"""
    SELECT code, date, open, high, low, CASE WHEN k_close THEN close END AS close, vol AS volume,
        CASE WHEN k_amount THEN amount END AS amount FROM (
        SELECT *, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY code) <= 0.05 AS k_close,
            avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY code) <= 0.05 AS k_amount
        FROM (SELECT *, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS date FROM ({_dedup_sql('ASC').replace(
            'code, trade_date, open, close, vol, amount', 'code, trade_date, open, high, low, close, vol, amount')}) AS u
            WHERE regexp_full_match(trade_date, '[0-9]{{8}}')) AS p) AS k
    WHERE (CASE WHEN k_close AND close IS NULL THEN 1 ELSE 0 END) + (CASE WHEN k_amount AND amount IS NULL THEN 1 ELSE 0 END)
        <= 0.1 * (5 + CASE WHEN k_close THEN 1 ELSE 0 END + CASE WHEN k_amount THEN 1 ELSE 0 END)"""


def cleaned(spark, sf):
    return c.clean(raw_bars(spark, sf), ["seq"])


@query("row_missing_filter", RAW_SHAPE, CLEAN_SQL)
def row_missing_filter(spark, sf):
    return cleaned(spark, sf)


@query(
    "cleaning_report",
    "code original_count duplicates_removed invalid_dates final_count start_date end_date removed_rows",
    f"""SELECT code, original_count, duplicates_removed, invalid_dates, coalesce(final_count, 0) AS final_count,
        start_date, end_date,
        original_count - duplicates_removed - invalid_dates - coalesce(final_count, 0) AS removed_rows
        FROM (SELECT code, count(*) AS original_count, count(*) - count(DISTINCT trade_date) AS duplicates_removed,
            count(DISTINCT trade_date) FILTER (NOT regexp_full_match(trade_date, '[0-9]{{8}}')) AS invalid_dates
            FROM raw GROUP BY code) AS b LEFT JOIN (
            SELECT code, count(*) AS final_count, min(date) AS start_date, max(date) AS end_date
            FROM ({CLEAN_SQL}) AS z GROUP BY code) AS a USING (code)""",
)
def cleaning_report(spark, sf):
    return c.cleaning_report(raw_bars(spark, sf), cleaned(spark, sf))


# Vendor inputs per symbol: columns a symbol never fills stand for a file without them.
SPARSE = "SELECT code, trade_date, open, high, low, close, vol, CASE WHEN code LIKE '%1' THEN NULL ELSE amount END AS amount FROM raw"
QUARANTINE_SQL = f"""
    SELECT code, n AS row_count, CASE WHEN has_amount = 0 THEN 'missing columns: amount'
        WHEN bad = n THEN 'no readable dates' END AS reason
    FROM (SELECT code, count(*) AS n, count(amount) AS has_amount,
        count(*) FILTER (NOT regexp_full_match(trade_date, '[0-9]{{8}}')) AS bad FROM ({SPARSE}) AS s GROUP BY code) AS v"""


def verdicts(spark, sf):
    raw = raw_bars(spark, sf)
    raw = raw.withColumn("amount", F.when(~F.col("code").endswith("1"), F.col("amount")))
    return c.quarantine(c.symbol_verdicts(raw))


@query("quarantine", "code row_count reason", QUARANTINE_SQL)
def quarantine(spark, sf):
    return verdicts(spark, sf)


@query(
    "cleaning_totals",
    "total_inputs valid_inputs invalid_inputs valid_rate:6",
    f"SELECT count(*) AS total_inputs, count(*) FILTER (reason IS NULL) AS valid_inputs, "
    f"count(reason) AS invalid_inputs, count(*) FILTER (reason IS NULL) / count(*) AS valid_rate FROM ({QUARANTINE_SQL}) AS q",
)
def cleaning_totals(spark, sf):
    return c.cleaning_totals(verdicts(spark, sf))


@query(
    "unit_convert",
    "ts_code trade_date open:4 close:4 vol:4 amount:6",
    "SELECT code || CASE WHEN code LIKE '6%' OR code LIKE '9%' THEN '.SH' ELSE '.SZ' END AS ts_code, "
    "strftime(date, '%Y%m%d') AS trade_date, open, close, volume / 100 AS vol, amount / 1000 AS amount FROM bars",
)
def unit_convert(spark, sf):
    return inc.unit_convert(bars_long(spark, sf))


# An update batch: the last year of bars, some of them revised, none for a few symbols.
CUTOFF = "2000-10-01"
OLD_SQL = f"SELECT * FROM bars WHERE date <= DATE '{CUTOFF}' + 7"
NEW_SQL = (
    "SELECT code, date, open, high, low, close, volume, CASE WHEN code LIKE '%3' THEN amount * 1.01 ELSE amount END AS amount "
    f"FROM bars WHERE date >= DATE '{CUTOFF}' AND code NOT LIKE '%7'"
)


def old_and_new(spark, sf):
    bars = bars_long(spark, sf)
    old = bars.where(F.col("date") <= F.date_add(F.lit(CUTOFF).cast("date"), 7))
    new = bars.where((F.col("date") >= F.lit(CUTOFF).cast("date")) & ~F.col("code").endswith("7"))
    revised = F.when(F.col("code").endswith("3"), F.col("amount") * 1.01).otherwise(F.col("amount"))
    return old, new.withColumn("amount", revised)


DELTAS = " UNION ALL ".join(
    f"SELECT o.code, '{x}' AS column_name, max(abs(o.{x} - n.{x}) / greatest(abs(o.{x}), 1.0)) AS max_relative_delta "
    "FROM o JOIN n ON o.code = n.code AND o.date = n.date GROUP BY o.code"
    for x in inc.CHECKED
)
RECONCILE_SQL = (
    f"WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}) SELECT *, max_relative_delta > 1e-6 AS rejected FROM ({DELTAS}) AS d"
)


@query("reconcile_overlap", "code column_name max_relative_delta:6 rejected", RECONCILE_SQL)
def reconcile_overlap(spark, sf):
    return inc.reconcile_overlap(*old_and_new(spark, sf))


MERGE_SQL = f"""
    SELECT code, date, close, amount, lag(close) OVER {HIST} AS pre_close, close - lag(close) OVER {HIST} AS change
    FROM (SELECT * FROM (SELECT *, 0 AS fresh FROM ({OLD_SQL}) AS o UNION ALL SELECT *, 1 AS fresh FROM ({NEW_SQL}) AS n) AS u
        QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY fresh DESC) = 1) AS m"""


@query("merge_history", "code date close:4 amount:3 pre_close:4 change:4", MERGE_SQL)
def merge_history(spark, sf):
    return inc.merge_history(*old_and_new(spark, sf))


@query(
    "update_status_counts",
    "status symbols",
    f"""WITH bad AS (SELECT DISTINCT code FROM ({RECONCILE_SQL}) AS r WHERE rejected)
        SELECT CASE WHEN code IN (SELECT code FROM bad) THEN 'failed'
            WHEN code IN (SELECT code FROM ({NEW_SQL}) AS n) THEN 'updated' ELSE 'no_data' END AS status,
            count(*) AS symbols FROM (SELECT DISTINCT code FROM ({OLD_SQL}) AS o) AS s GROUP BY 1""",
)
def update_status_counts(spark, sf):
    return inc.status_counts(inc.update_history(*old_and_new(spark, sf))[1])


@query(
    "watermark_window",
    "code last_date start_date",
    "SELECT code, max(date) AS last_date, CAST(max(date) - 10 AS DATE) AS start_date FROM bars GROUP BY code",
)
def watermark_window(spark, sf):
    return inc.watermark_window(bars_long(spark, sf))


@query(
    "benchmark_merge",
    "trade_date open:4 high:4 low:4 close:4 vol",
    f"""SELECT strftime(date, '%Y%m%d') AS trade_date, open, high, low, close, volume AS vol FROM bars
        WHERE date <= DATE '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, code DESC) = 1""",
)
def benchmark_merge(spark, sf):
    return inc.benchmark_merge(bars_long(spark, sf), CUTOFF, ["volume", "code"])


@query(
    "upsert_panel",
    "code date close:4 volume ret:5",
    """SELECT coalesce(o.code, n.code) AS code, coalesce(o.date, n.date) AS date, o.close AS close,
        CASE WHEN n.code IS NOT NULL THEN n.volume ELSE o.volume END AS volume, n.ret AS ret
        FROM (SELECT code, date, close, volume FROM evbars WHERE date < DATE '2024-01-21') AS o
        FULL JOIN (SELECT code, date, CASE WHEN volume > 1 THEN volume END AS volume, ret FROM evbars_base
            WHERE date >= DATE '2024-01-11') AS n ON o.code = n.code AND o.date = n.date""",
)
def upsert_panel(spark, sf):
    bars = bars_short(spark, sf)
    stored = bars.where(F.col("date") < F.lit("2024-01-21").cast("date")).select("code", "date", "close", "volume")
    batch = inc.prev_close_change(bars).withColumn("ret", F.col("pct_chg") / 100)
    batch = batch.where(F.col("date") >= F.lit("2024-01-11").cast("date")).select(
        "code", "date", F.when(F.col("volume") > 1, F.col("volume")).alias("volume"), "ret"
    )
    path = scratch_path(spark, "upsert")
    write_partitioned(stored.withColumn("year", F.year("date")), path)
    return inc.upsert_by_year(spark, path, inc.prepare_batch(batch, ["volume", "ret"]))
