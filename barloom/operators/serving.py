"""Bounded, parameterised reads over the star tables.

Filters are plain column predicates, so they reach the Parquet scan, and values
are passed as literals, never pasted into SQL text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import guards
from barloom.functions.scalars import LONG_CODE_PATTERN
from barloom.operators import crosssection, quality
from barloom.operators.factors import INNER, drop_warmup, factor_panel, prev_close_change
from barloom.operators.joins import detail_coverage, join_peers, join_sentiment, join_snapshot_dim
from barloom.operators.ranking import snapshot_page
from barloom.session import discard, materialise
from barloom.sources.sinks import (
    ROWS_PER_PART, STRETCH_PAGES, Publication, code_parts, code_ranges, in_stretches, open_published, run_record, spans
)

Star = Mapping[str, DataFrame]

# Columns of the published tables and of the reads over them.
CATALOG = ["code", "name", "market", "board", "industry_l1", "list_date", "is_demo", "has_detail", "source"]
MARKET = [
    "date", "stock_count", "advancing_count", "declining_count", "flat_count", "total_volume", "total_amount",
    "average_close", "average_return", "median_return", "average_sentiment", "source", "data_version",
]
INDUSTRY = [
    "industry_l1", "date", "stock_count", "average_close", "average_return", "median_return", "total_volume",
    "total_amount", "advancing_ratio", "average_sentiment", "data_version",
]
SNAPSHOT = [
    "code", "name", "market", "board", "industry_l1", "date", "open", "high", "low", "close", "pre_close", "change",
    "pct_chg", "volume", "amount", "ret", "sentiment", "data_version",
]
BENCH = [
    "code", "date", "open", "high", "low", "close", "volume", "amount", "ret", "ma5", "ma20", "rsi", "macd",
    "volatility_20d", "sentiment",
]
IC_AT_ONCE = 6  # factors that a publication sends to their dates at a time
SCOPE = "description string, asset_catalog_stock_count bigint, aggregate_market_stock_count bigint, " \
    "aggregate_trading_day_count bigint, aggregate_start_date string, aggregate_end_date string, " \
    "public_detail_stock_count bigint, public_detail_record_count bigint, public_detail_start_date string, " \
    "public_detail_end_date string"


def fact_panel(bars: DataFrame, sentiment: DataFrame | None, data_version: str, keep: Sequence[str] = ()) -> DataFrame:
    """The wide fact table: bars, previous close, all factors, sentiment. ``keep`` names inner columns that stay."""
    panel = drop_warmup(factor_panel(prev_close_change(bars), keep=keep))
    return join_sentiment(panel, sentiment).withColumn("data_version", F.lit(data_version))


def publish_star(
    spark: SparkSession, root: str, version: str, bars: DataFrame, catalog: DataFrame, data_version: str, source_label: str,
    spent: bool = False, rows_per_part: int = ROWS_PER_PART,
) -> dict[str, DataFrame]:
    """Publish the star of some bars: bars are cut by range of codes, facts are written once where they are worked out, and
    everything else is derived from them. ``spent`` bars were materialised for this build: they go when the facts are there.
    Many of them are sent in turn by parts of the codes, and the facts to their IC by parts of the dates, as what is sent
    lies on disk beside the facts."""
    build = Publication(spark, root, version)
    laid = [code_ranges(part) for part in (code_parts(bars, rows_per_part) if spent else [bars])]
    panels = [in_stretches(fact_panel(ranges, None, data_version, INNER), days) for ranges, days in laid]
    facts = build.write("fact_stock_daily_demo", panels, STRETCH_PAGES, narrowed=True)
    if spent:
        discard(bars)
    days = laid[0][1]
    cuts = sorted({days[len(days) * i // len(laid)] for i in range(1, len(laid))}) if days else []
    derived = aggregates(
        facts, catalog, data_version, source_label, stage=materialise, rows=crosssection.as_stored, ic_at_once=IC_AT_ONCE,
        ic_cuts=[dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in cuts],
    )
    for name, table in derived.items():
        build.write(name, table)
    build.commit()
    return open_published(spark, root)


def aggregates(
    facts: DataFrame,
    catalog: DataFrame,
    data_version: str,
    source_label: str,
    stage: crosssection.Stage = lambda df, name: df,
    rows: crosssection.Stage = materialise,
    ic_at_once: int | None = None,
    ic_cuts: Sequence[dt.date] = (),
) -> dict[str, DataFrame | list[DataFrame]]:
    """Everything derived from the fact table. Give it the written table, so factors are not computed again.

    The market table and the quality report feed several tables. A build that
    writes them all passes ``session.materialise`` as ``stage``, so each is
    computed once; a reader of a single table leaves the plans lazy. Where ``facts`` is a written table, ``rows`` is
    ``crosssection.as_stored``: its columns are read from there and not copied first.
    With ``ic_at_once`` the IC table is a list of parts of so many factors, to be written in turn: each sends only its columns.
    With ``ic_cuts`` the parts are dates between these, each with all factors.
    """
    version = F.lit(data_version).alias("data_version")
    ic = lambda *some, of=facts: crosssection.factor_ic(of, *some, stage=rows).select("*", version)
    factors = crosssection.IC_FACTORS
    if ic_cuts:
        by_part = [ic(of=facts.where(one)) for one in spans("date", ic_cuts)]
    else:
        by_part = [ic(factors[i : i + ic_at_once]) for i in range(0, len(factors), ic_at_once)] if ic_at_once else ic()
    dim = detail_coverage(facts, catalog)
    market = stage(crosssection.market_daily(facts, rows).select("*", F.lit(source_label).alias("source"), version), "market")
    report = stage(quality.quality_report(facts, LONG_CODE_PATTERN), "report")
    run = f"quality-{data_version[:16]}"
    return {
        "dim_stock": dim,
        "fact_market_daily": market,
        "fact_industry_daily": crosssection.industry_daily(facts, catalog, rows).select("*", version),
        "fact_factor_ic_daily": by_part,
        "fact_data_quality_run": quality.quality_run(report, run, data_version),
        "fact_data_quality_issue": quality.quality_issues(report, quality.missing_profile(facts), run),
        "pipeline_run": run_record(facts, market, catalog, data_version, source_label),
    }


def build_star(bars: DataFrame, catalog: DataFrame, sentiment: DataFrame | None, data_version: str, source_label: str) -> dict[str, DataFrame]:
    """All tables as lazy plans."""
    facts = fact_panel(bars, sentiment, data_version)
    return {"fact_stock_daily_demo": facts, **aggregates(facts, catalog, data_version, source_label)}


def _between(df: DataFrame, start, end) -> DataFrame:
    start, end = guards.date_range(start, end)
    if start:
        df = df.where(F.col("date") >= F.lit(start))
    if end:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def _newest_run(star: Star) -> DataFrame:
    return star["pipeline_run"].where(F.col("status") == "SUCCESS").orderBy(F.col("finished_at").desc()).limit(1)


def _last_date(star: Star) -> Column:
    return _newest_run(star).select("data_end_date").scalar()


def manifest(star: Star) -> DataFrame:
    """Newest successful run with its scope unpacked; text that is no JSON leaves NULLs."""
    return _newest_run(star).withColumn("scope", F.from_json("public_scope", SCOPE)).select("*", "scope.*").drop("scope")


def asset_summary(star: Star) -> DataFrame:
    """Newest run with its quality figures and the sizes of four tables."""
    dim = star["dim_stock"]
    runs = star["fact_data_quality_run"].select(
        "data_version", "quality_score", F.col("status").alias("quality_status"), "duplicate_key_count",
        "invalid_date_count", "invalid_ohlc_count", "unexpected_missing_count", "column_count",
    )
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    newest = _newest_run(star).select("data_version", "source_label", "data_start_date", "data_end_date", "finished_at")
    return newest.join(runs, "data_version", "left").withColumns(
        {
            "catalog_stock_count": size(dim),
            "detail_stock_count": size(dim.where(F.col("has_detail") == 1)),
            "record_count": size(star["fact_stock_daily_demo"]),
            "trading_day_count": size(star["fact_market_daily"]),
        }
    )


def stock_catalog(star: Star, industry: str | None = None, has_detail: bool | None = None, limit: int | None = None) -> DataFrame:
    out = star["dim_stock"]
    if industry is not None:
        out = out.where(F.col("industry_l1") == industry)
    if has_detail is not None:
        out = out.where(F.col("has_detail") == int(has_detail))
    return guards.row_limit(out.select(*CATALOG).orderBy("code"), limit)


def stock_metadata(star: Star, code: str) -> DataFrame:
    return star["dim_stock"].where(F.col("code") == guards.security_code(code)).select(*CATALOG).limit(1)


def market_summary(star: Star, start=None, end=None) -> DataFrame:
    return _between(star["fact_market_daily"], start, end).select(*MARKET).orderBy("date")


def market_snapshot(star: Star, day=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One date with symbol attributes, paged by amount; the date defaults to the last one."""
    if day is None:
        facts = star["fact_stock_daily_demo"]
        joined = facts.where(F.col("date") == _last_date(star)).join(star["dim_stock"].drop("source"), "code")
    else:
        joined = join_snapshot_dim(star["fact_stock_daily_demo"], star["dim_stock"].drop("source"), guards.iso_day(day))
    return snapshot_page(joined.select(*SNAPSHOT), limit, offset)


def industry_summary(star: Star, start=None, end=None, industries: Iterable[str] | None = None) -> DataFrame:
    out = _between(star["fact_industry_daily"], start, end)
    names = sorted({str(i) for i in (industries or []) if i})
    if names:
        out = out.where(F.col("industry_l1").isin(names))
    return out.select(*INDUSTRY).orderBy("industry_l1", "date")


def stock_history(star: Star, code: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    rows = star["fact_stock_daily_demo"].where(F.col("code") == guards.security_code(code))
    return guards.row_limit(_between(rows, start, end).orderBy("date"), limit)


def peer_history(star: Star, industry: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    peers = join_peers(star["fact_stock_daily_demo"], star["dim_stock"], guards.industry_name(industry), start, end)
    columns = ["code", "name", "industry_l1", "date", "close", "ret", "volatility_20d"]
    return guards.row_limit(peers.select(*columns).orderBy("code", "date"), limit)


def factor_ic(star: Star, factors: Iterable[str] | None = None, start=None, end=None) -> DataFrame:
    out = _between(star["fact_factor_ic_daily"], start, end)
    names = sorted({str(f) for f in (factors or []) if f})
    if names:
        out = out.where(F.col("factor_name").isin(names))
    return out.orderBy("factor_name", "date")


def factor_catalog(star: Star) -> DataFrame:
    return star["fact_factor_ic_daily"].select("factor_name").distinct().orderBy("factor_name")


def quality_runs(star: Star, limit: int | None = None) -> DataFrame:
    return guards.row_limit(star["fact_data_quality_run"].orderBy(F.col("started_at").desc()), limit)


def quality_issues(star: Star, run_id: str | None = None) -> DataFrame:
    issues = star["fact_data_quality_issue"]
    if run_id is None:
        issues = issues.where(F.col("run_id") == quality_runs(star, 1).select("run_id").scalar())
    else:
        issues = issues.where(F.col("run_id") == guards.run_id(run_id))
    return issues.orderBy(F.col("severity").desc(), "rule_name", "column_name")


def latest_quotes(star: Star, codes: Iterable[str]) -> DataFrame:
    chosen = sorted({guards.security_code(c) for c in codes})
    facts = star["fact_stock_daily_demo"]
    rows = facts.where(F.col("code").isin(chosen) & (F.col("date") == _last_date(star)))
    return rows.select("code", "date", "close", "pct_chg", "change").orderBy("code")


def bench_latest(star: Star, code: str, n: int = 252) -> DataFrame:
    rows = star["fact_stock_daily_demo"].where(F.col("code") == guards.security_code(code))
    return rows.select(*BENCH).orderBy(F.col("date").desc()).limit(guards.positive_int(n))


def bench_range(star: Star, code: str, start, end) -> DataFrame:
    rows = star["fact_stock_daily_demo"].where(F.col("code") == guards.security_code(code))
    return _between(rows, start, end).select(*BENCH).orderBy("date")


def industry_trend(star: Star, industry: str, start, end) -> DataFrame:
    rows = star["fact_industry_daily"].where(F.col("industry_l1") == guards.industry_name(industry))
    return _between(rows, start, end).select(*INDUSTRY).orderBy("date")
