"""Readers and writers, each fed with files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import LONG_CODE_PATTERN, board_of, market_of
from barloom.functions.scalars import money_label as money_text
from barloom.operators import factors as f
from barloom.operators import quality as q
from barloom.operators import serving as s
from barloom.operators import strategy as st
from barloom.plans.factor_queries import PANEL_SHAPE
from barloom.plans.oracle import board, rows
from barloom.plans.panels import panel_tasks, ranged, ranged_panel, scored_panel
from barloom.plans.quality_queries import DIRTY, REPORT_SQL, dirty
from barloom.plans.registry import REGISTRY, query
from barloom.plans.serving_queries import star, star_root
from barloom.plans.strategy_queries import NAV_CTE, _approximate, _fixture
from barloom.session import discard, materialise, scratch_path, shuffles_released
from barloom.sources import readers, sinks
from barloom.sources.adapter import bars_long, bars_short, catalog, sentiment


BARS_SHAPE = "code date open:4 high:4 low:4 close:4 volume amount:3"


@query("scan_bars_csv", BARS_SHAPE, "SELECT * FROM bars")
def scan_bars_csv(spark, sf):
    columns = ["code", *(c.split()[0] for c in readers.CLEAN_FIELDS.split(", "))]
    path = sinks.write_packed_csv(bars_long(spark, sf).select(*columns), scratch_path(spark, "bars"))
    return readers.scan_bars(spark, path, packed=True)


@query("scan_raw_rowcount", "code row_count", "SELECT code, count(*) AS row_count FROM bars GROUP BY code")
def scan_raw_rowcount(spark, sf):
    raw = f.prev_close_change(bars_long(spark, sf)).select(
        "code", F.col("code").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close",
        "pre_close", "change", "pct_chg", F.col("volume").alias("vol"), "amount",
    )
    path = scratch_path(spark, "raw")
    raw.hint("rebalance", "code").write.option("header", True).csv(path)
    return readers.count_raw(spark, path, packed=True)


def _snapshot(spark, sf, fmt):
    path = scratch_path(spark, "panel")
    with shuffles_released(spark):
        sinks.write_panel(ranged_panel(spark, sf), path, [fmt], laid_out=True)
    return readers.scan_panel(spark, path)


@query("scan_panel", PANEL_SHAPE, "SELECT * FROM bars_ready")
def scan_panel(spark, sf):
    return _snapshot(spark, sf, "parquet")


@query("write_panel", PANEL_SHAPE, "SELECT * FROM bars_ready")
def write_panel(spark, sf):
    return _snapshot(spark, sf, "csv")


@query(
    "scan_benchmark",
    "date open:4",
    "SELECT date, sum(open * volume) / sum(volume) AS open FROM bars GROUP BY date",
)
def scan_benchmark(spark, sf):
    index = bars_long(spark, sf).groupBy("date").agg((F.sum(F.col("open") * F.col("volume")) / F.sum("volume")).alias("open"))
    path = scratch_path(spark, "benchmark")
    index.select(F.date_format("date", "yyyyMMdd").alias("trade_date"), "open").write.option("header", True).csv(path)
    return readers.scan_benchmark(spark, [f"{path}-missing.parquet", f"{path}-missing", path])


@query(
    "scan_sentiment",
    "code date sentiment:6 sentiment_ma5 comment_count data_source",
    "SELECT code, date, sentiment, 0 AS sentiment_ma5, comment_count, CASE WHEN code LIKE '%1' THEN 'legacy_unknown' ELSE "
    "data_source END AS data_source FROM sent WHERE date <> DATE '2024-01-15'",
)
def scan_sentiment(spark, sf):
    """Codes lose their zeros and one day its date on the way into the file."""
    broken = sentiment(spark, sf).select(
        F.col("code").cast("int").alias("code"),
        F.when(F.col("date") != F.lit("2024-01-15").cast("date"), F.col("date").cast("string")).otherwise("unknown").alias("date"),
        "sentiment", "comment_count",
        F.when(~F.col("code").endswith("1"), F.col("data_source")).alias("data_source"),
    )
    path = scratch_path(spark, "sentiment")
    broken.write.parquet(path)
    return readers.normalise_sentiment(spark.read.parquet(path))


@query(
    "scan_predictions",
    "date code predicted:6 actual:6",
    "SELECT date, code, close AS predicted, amount AS actual FROM evbars",
)
def scan_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    bars_short(spark, sf).select(
        "date", F.col("code").cast("int").alias("code"), F.col("close").alias("predicted"), F.col("amount").alias("actual")
    ).write.option("header", True).csv(path)
    return readers.scan_predictions(spark, path)


@query(
    "scan_catalog",
    "code name market board industry_l1 is_demo has_detail source updated_at",
    "SELECT code, name, market, board, industry_l1, is_demo, 1 AS has_detail, source, '2024-01-02' AS updated_at FROM dim",
)
def scan_catalog(spark, sf):
    """Each symbol twice, the older row under another name."""
    base = catalog(spark, sf).withColumn("has_detail", F.lit(1)).withColumn("list_date", F.lit("2000-01-01"))
    newer = base.withColumn("updated_at", F.lit("2024-01-02"))
    older = base.withColumns({"updated_at": F.lit("2024-01-01"), "name": F.concat(F.lit("old "), F.col("name"))})
    path = scratch_path(spark, "catalog")
    newer.unionByName(older).select(*readers.CATALOG_COLUMNS).write.option("header", True).csv(path)
    return readers.scan_catalog(spark, path)


@query(
    "scan_json_report",
    "row_count stock_count quality_status column count",
    f"""SELECT row_count, stock_count, quality_status, m.column AS column, m.n AS count FROM ({REPORT_SQL}) AS r,
        (SELECT 'date' AS column, count(*) FILTER (date IS NULL) AS n FROM ({DIRTY}) AS d UNION ALL
         SELECT 'close', count(*) FILTER (close IS NULL) FROM ({DIRTY}) AS d UNION ALL
         SELECT 'amount', count(*) FILTER (amount IS NULL) FROM ({DIRTY}) AS d UNION ALL
         SELECT 'momentum_60d', count(*) FILTER (momentum_60d IS NULL) FROM ({DIRTY}) AS d UNION ALL
         SELECT 'label', count(*) FILTER (label IS NULL) FROM ({DIRTY}) AS d) AS m""",
)
def scan_json_report(spark, sf):
    frame = dirty(spark, sf)
    report = sinks.report_with_details(q.quality_report(frame, LONG_CODE_PATTERN), q.missing_profile(frame))
    path = sinks.write_report(report, scratch_path(spark, "report"))
    stored = readers.read_report(spark, path, sinks.nested_report_schema())
    return stored.select("row_count", "stock_count", "quality_status", F.explode("missing_details").alias("d")).select(
        "row_count", "stock_count", "quality_status", "d.column", "d.count"
    )


@query(
    "write_partitioned",
    "year code date close:4 ma20:4 volume_ratio:6",
    "SELECT CAST(year(date) AS INTEGER) AS year, code, date, close, ma20, volume_ratio FROM bars_panel",
)
def write_partitioned(spark, sf):
    """Written whole, then one year again: the other years must stay."""
    path = scratch_path(spark, "years")
    with shuffles_released(spark):
        bars = materialise(bars_long(spark, sf), "bars")  # for both writes
        factors = f.core_factors(ranged(bars, panel_tasks(spark, sf)))
        sinks.write_partitioned(factors, path, laid_out=True)
        sinks.write_partitioned(factors.where(F.col("year") == 1998), path, laid_out=True)
    discard(bars)
    return spark.read.parquet(path)


@query("write_quality", "row_count stock_count quality_status", REPORT_SQL)
def write_quality(spark, sf):
    path = sinks.write_report(q.quality_report(dirty(spark, sf), LONG_CODE_PATTERN), scratch_path(spark, "quality"))
    return spark.read.json(path)


def _published(spark, sf):
    """A publication from scratch, whatever is there already."""
    bars, dim = bars_long(spark, sf), catalog(spark, sf)
    version = sinks.content_version({"bars": bars, "catalog": dim}).first()["data_version"]
    return s.publish_star(spark, scratch_path(spark, "star"), version[:16], bars, dim, "v1", "line items")


TABLE_COUNTS = f"""
    SELECT 'dim_stock' AS table_name, count(*) AS row_count FROM dim UNION ALL
    SELECT 'fact_stock_daily_demo', count(*) FROM bars_ready UNION ALL
    SELECT 'fact_market_daily', count(DISTINCT date) FROM bars_ready UNION ALL
    SELECT 'fact_industry_daily', count(*) FROM (SELECT DISTINCT industry_l1, date FROM bars_ready JOIN dim USING (code)) AS i UNION ALL
    SELECT 'fact_factor_ic_daily', 17 * count(DISTINCT date) FROM bars_ready UNION ALL
    SELECT 'fact_data_quality_run', 1 UNION ALL SELECT 'pipeline_run', 1 UNION ALL
    SELECT 'fact_data_quality_issue', count(*) FROM ({REGISTRY["q_quality_issues"].sql}) AS q"""


@query("publish_star", "table_name row_count", TABLE_COUNTS)
def publish_star(spark, sf):
    """The manifest of the published star, checked against what is stored when it was published: all eight tables."""
    return sinks.manifest(spark, star_root(spark, sf))


@query(
    "rebuild_serving",
    "key value",
    """SELECT 'source' AS key, 'processed_parquet' AS value UNION ALL SELECT 'row_count', CAST(count(*) AS VARCHAR) FROM bars UNION ALL
        SELECT 'stock_count', CAST(count(DISTINCT code) AS VARCHAR) FROM bars UNION ALL
        SELECT 'start_date', CAST(min(date) AS VARCHAR) FROM bars UNION ALL
        SELECT 'end_date', CAST(max(date) AS VARCHAR) FROM bars UNION ALL SELECT 'sentiment_provenance', 'legacy_unknown'""",
)
def rebuild_serving(spark, sf):
    bars = bars_long(spark, sf)
    doubled = bars.unionByName(bars.where(F.col("volume") > 40).withColumn("volume", F.col("volume") - 1))
    return sinks.rebuild_serving(spark, doubled, scratch_path(spark, "serving"), ["volume", "amount"], f.BAR_COLUMNS)


@query(
    "content_version",
    "variant same",
    "SELECT * FROM (VALUES ('reordered', true), ('one cell changed', false), ('one row fewer', false), ('names swapped', false)) AS v(variant, same)",
)
def content_version(spark, sf):
    """Whether variants of two tables get the version of the originals: the order of rows doesn't count, content does."""
    bars, dim = bars_long(spark, sf), catalog(spark, sf)
    first = dim.agg(F.min("code")).scalar()
    renamed = F.when(F.col("code") == first, "another name").otherwise(F.col("name"))
    variants = {
        "reordered": {"bars": bars.repartition("date"), "catalog": dim.orderBy(F.col("name").desc())},
        "one cell changed": {"bars": bars, "catalog": dim.withColumn("name", renamed)},
        "one row fewer": {"bars": bars, "catalog": dim.where(F.col("code") > first)},
        "names swapped": {"bars": dim, "catalog": bars},
    }
    original = sinks.content_version({"bars": bars, "catalog": dim}).scalar()
    out = None
    for name, tables in variants.items():
        one = sinks.content_version(tables).select(F.lit(name).alias("variant"), (F.col("data_version") == original).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "write_backtest",
    "part row_count",
    f"WITH {NAV_CTE} SELECT 'backtest_results' AS part, count(*) AS row_count FROM nav UNION ALL SELECT 'backtest_metrics', "
    "count(*) FROM ords UNION ALL SELECT 'target_weights', count(*) FROM tgt UNION ALL SELECT 'execution_log', count(*) FROM tgt",
)
def write_backtest(spark, sf):
    market, daily, orders, grid = _approximate(spark, sf)
    chosen = _fixture(spark, sf)[2]
    summary = st.metrics(daily, orders, market, grid)
    paths = sinks.write_backtest(daily, summary, chosen, orders, scratch_path(spark, "backtest"))
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("part"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "run_record",
    "run_id status input_rows data_start_date data_end_date source_label aggregate_days",
    "SELECT 'serving-v1' AS run_id, 'SUCCESS' AS status, count(*) AS input_rows, min(date) AS data_start_date, max(date) AS "
    "data_end_date, 'line items' AS source_label, count(DISTINCT date) AS aggregate_days FROM bars_ready",
)
def run_record(spark, sf):
    run = star(spark, sf)["pipeline_run"]
    days = F.from_json("public_scope", s.SCOPE).getField("aggregate_trading_day_count")
    return run.withColumn("aggregate_days", days)


@query(
    "public_projection",
    "code date sentiment:6 sentiment_ma5:6 sentiment_ma10:6 comment_count data_source",
    f"SELECT code, date, sentiment, avg(sentiment) OVER {rows(5)} AS sentiment_ma5, avg(sentiment) OVER {rows(10)} AS sentiment_ma10, "
    "comment_count, data_source FROM sent",
)
def public_projection(spark, sf):
    return sinks.public_sentiment(scored_panel(spark, sf))


@query(
    "public_curve",
    "date equity_curve:1 cumulative_return:5 benchmark_cumulative:6",
    f"WITH {NAV_CTE} SELECT date, cumulative_return * 1000000 AS equity_curve, cumulative_return, benchmark_cumulative FROM nav "
    "WHERE scenario = 'base'",
)
def public_curve(spark, sf):
    daily = _approximate(spark, sf)[1].where(F.col("scenario") == "base")
    return sinks.public_curve(sinks.masked_source(daily, "index", "benchmark_name"))


# ---- scalar functions --------------------------------------------------------------------------


@query(
    "board_classifier",
    "code board market",
    f"SELECT DISTINCT code, {board()} AS board, CASE WHEN {board()} IN ('沪市主板', '科创板') THEN 'SSE' ELSE 'SZSE' END AS market FROM bars",
)
def board_classifier(spark, sf):
    return bars_long(spark, sf).select("code").distinct().withColumn("board", board_of("code")).withColumn("market", market_of("board"))


@query(
    "money_label",
    "code label_text",
    "SELECT code, CASE WHEN a >= 1e8 THEN printf('%.2f亿', a / 1e8) WHEN a >= 1e4 THEN printf('%.2f万', a / 1e4) "
    "ELSE CAST(CAST(round(a) AS BIGINT) AS VARCHAR) END AS label_text FROM (SELECT code, sum(amount) + 0.001 AS a FROM bars GROUP BY code) AS s",
)
def money_label(spark, sf):
    totals = bars_long(spark, sf).groupBy("code").agg((F.sum("amount") + 0.001).alias("a"))
    return totals.withColumn("label_text", money_text("a"))
