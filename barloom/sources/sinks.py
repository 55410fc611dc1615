"""Writers: sorted snapshots, partitioned tables, JSON reports, the published star."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.guards import require_columns
from barloom.operators.factors import narrow, widen
from barloom.operators.quality import keep_last
from barloom.session import create_once, delete, exists, folders

# The tables of the published star.
STAR_TABLES = [
    "dim_stock",
    "fact_stock_daily_demo",
    "fact_market_daily",
    "fact_industry_daily",
    "fact_factor_ic_daily",
    "fact_data_quality_run",
    "fact_data_quality_issue",
    "pipeline_run",
]


def by_key(panel: DataFrame) -> DataFrame:
    """Range-partitioned and sorted on (code, date): even files whose statistics prune by code.

    The range is over both columns, so a symbol with many rows is spread too.
    """
    return panel.repartitionByRange("code", "date").sortWithinPartitions("code", "date")


ROWS_PER_FILE = 100_000
PARTS = 1024  # a column of the grid layout is cut into that many parts at most


def _part(value: Column, cuts: Sequence[int]) -> Column:
    """How many of the sorted cut points a value reaches, by halving; missing values come first."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) <= value, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def _code_number(code: Column) -> Column:
    """The first six bytes of a code as a number in the codes' order."""
    return F.conv(F.rpad(F.substring(F.hex(code), 1, 12), 12, "0"), 16, 10).cast("long")


def by_date_and_code(panel: DataFrame, keys: DataFrame | None = None, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Files on a grid of dates and codes, so that statistics prune reads of one date and reads of one symbol alike.

    Both columns are cut into as many parts of about equal rows, and a file holds one cell of the grid, sorted by code and
    date. Of n files a read of one date or of one symbol concerns about the root of n. The number of rows and the cut points
    (two lists of ``PARTS`` numbers at most) come from ``keys``, any frame with the same dates and codes, such as the bars
    that a panel derives from; without it, from the panel. As the cells are known before the exchange, the panel is worked
    out once; an exchange by range would work it out twice, first for its sample.
    """
    day, code = F.unix_date("date").cast("long"), _code_number(F.col("code"))
    quantiles = [i / PARTS for i in range(1, PARTS)]
    source = panel if keys is None else keys
    seen = source.agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx(day, quantiles).alias("day"), F.percentile_approx(code, quantiles).alias("code")
    ).first()
    side = min(PARTS, math.isqrt(max(0, -(-seen["rows"] // rows_per_file) - 1)) + 1)
    cuts = {n: [seen[n][PARTS * i // side - 1] for i in range(1, side)] if seen[n] else [] for n in ("day", "code")}
    cell = _part(day, cuts["day"]) * side + _part(code, cuts["code"])
    return panel.repartitionById(side * side, cell).sortWithinPartitions("code", "date")


DATE_PARTS = 32  # the rows of a range of codes are stored in that many stretches of dates
# Pages of about one stretch, so that a read of a date leaves the others out; a stretch is sorted by code.
STRETCH_PAGES = {"compression": "zstd", "parquet.page.row.count.limit": str(ROWS_PER_FILE // DATE_PARTS)}


def code_ranges(bars: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> tuple[DataFrame, list[int]]:
    """Bars cut by range of codes, a file's rows in each, and the cut points of their dates.

    Windows by code keep these partitions, so that a wide panel is stored where it is worked out (``in_stretches``) and only
    the narrow bars are sent.
    """
    day = F.unix_date("date").cast("long")
    points = F.percentile_approx(day, [i / DATE_PARTS for i in range(1, DATE_PARTS)])
    seen = bars.agg(F.count(F.lit(1)).alias("rows"), points.alias("day")).first()
    return bars.repartitionByRange(max(1, -(-seen["rows"] // rows_per_file)), "code"), sorted(set(seen["day"] or []))


PARTS_IN_TURN, ROWS_PER_PART = 8, 800_000  # a large star is built in up to that many parts of so many rows or more


def code_parts(bars: DataFrame, rows_per_part: int = ROWS_PER_PART) -> list[DataFrame]:
    """Stored bars in parts by code, so that the shuffle files of one part are there at a time; small tables are one part.

    Cut points are codes of the bars themselves, at quantiles of their first bytes. A code lies in one part, missing ones in
    the first.
    """
    number = _code_number(F.col("code"))
    seen = bars.agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx(number, [i / PARTS for i in range(1, PARTS)]).alias("code")
    ).first()
    parts = min(PARTS_IN_TURN, seen["rows"] // rows_per_part)
    if parts < 2 or not seen["code"]:
        return [bars]
    points = sorted({seen["code"][PARTS * i // parts - 1] for i in range(1, parts)})
    cuts = sorted(set(bars.agg(*[F.min(F.when(number >= p, F.col("code"))) for p in points]).first()))
    return [bars.where(one) for one in spans("code", cuts)]


def spans(column: str, cuts: Sequence) -> list[Column]:
    """Predicates that cut the rows at some values of a column, each row in one; missing values come first."""
    value = F.col(column)
    if not cuts:
        return [F.lit(True)]
    inner = [(value >= low) & (value < high) for low, high in zip(cuts, cuts[1:])]
    return [value.isNull() | (value < cuts[0]), *inner, value >= cuts[-1]]


def in_stretches(panel: DataFrame, days: Sequence[int]) -> DataFrame:
    """Each partition sorted by stretch of dates, code and date, for files with ``STRETCH_PAGES``."""
    stretch = panel.withColumn("_stretch", _part(F.unix_date("date").cast("long"), days))
    return stretch.sortWithinPartitions("_stretch", "code", "date").drop("_stretch")


def write_panel(panel: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv"), laid_out: bool = False) -> list[str]:
    """The factor snapshot, once per format. CSV is compressed, in files of ``ROWS_PER_FILE`` rows, as a task reads a file.

    ``laid_out`` says that the panel comes in ranges of codes (its bars were cut by range before the factors): it is then
    sorted where it is. An exchange by range would work it out twice, first for its sample.
    """
    written = []
    for fmt in formats:
        target = f"{path}.{fmt}"
        writer = (panel.sortWithinPartitions("code", "date") if laid_out else by_key(panel)).write.mode("overwrite")
        if fmt == "parquet":
            writer.parquet(target)
        else:
            writer.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).csv(target)
        written.append(target)
    return written


def write_partitioned(factors: DataFrame, path: str, mode: str = "overwrite", laid_out: bool = False) -> str:
    """Parquet by year; an overwrite replaces only the years that arrive.

    Range partitioning on (year, code) keeps the number of files small and a
    busy year from landing in one task. ``laid_out`` says that the rows come in
    ranges of codes: a task then writes a file for each year, and nothing is sent.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    ranged = (factors if laid_out else factors.repartitionByRange("year", "code")).sortWithinPartitions("year", "code", "date")
    options = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    ranged.write.mode(mode).options(**options).partitionBy("year").parquet(path)
    return path


def write_per_symbol_csv(bars: DataFrame, path: str) -> str:
    """One directory of CSV per symbol; a symbol's bars are bounded by the number of days."""
    bars.repartition("code").sortWithinPartitions("code", "date").write.mode("overwrite").partitionBy("code").option(
        "header", True
    ).csv(path)
    return path


def write_packed_csv(bars: DataFrame, path: str) -> str:
    """Bars as CSV with the symbol as a column. Symbols are packed into files of about the advisory partition size, and a
    large symbol is split, so the number of files follows the bytes."""
    packed = bars.hint("rebalance", "code").sortWithinPartitions("code", "date")
    packed.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_backtest(results: DataFrame, metrics: DataFrame, holdings: DataFrame, orders: DataFrame, path: str) -> dict[str, str]:
    out = {}
    parts = {"backtest_results": results, "backtest_metrics": metrics, "target_weights": holdings, "execution_log": orders}
    for name, frame in parts.items():
        out[name] = f"{path}/{name}"
        frame.write.mode("overwrite").parquet(out[name])
    return out


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes, as one row.

    Duplicated rows count; column order does not, as columns are sorted by name.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    )


def content_version(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Version id that depends on the content of all inputs and on nothing else."""
    rows = None
    for name in sorted(tables):
        one = table_fingerprint(tables[name]).select(
            F.concat_ws(":", F.lit(name), F.col("row_count").cast("string"), F.col("hash_sum").cast("string")).alias("part")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("part"))), 256).alias("data_version"))


def run_record(panel: DataFrame, market: DataFrame, catalog: DataFrame, data_version: str, source_label: str) -> DataFrame:
    """One pipeline-run row; the scope is a struct serialised to JSON."""
    scope = F.to_json(
        F.struct(
            F.lit("published panel with market aggregates").alias("description"),
            catalog.agg(F.count(F.lit(1))).scalar().alias("asset_catalog_stock_count"),
            market.agg(F.max("stock_count")).scalar().alias("aggregate_market_stock_count"),
            market.agg(F.count(F.lit(1))).scalar().alias("aggregate_trading_day_count"),
            market.agg(F.min("date").cast("string")).scalar().alias("aggregate_start_date"),
            market.agg(F.max("date").cast("string")).scalar().alias("aggregate_end_date"),
            F.col("stock_count").alias("public_detail_stock_count"),
            F.col("row_count").alias("public_detail_record_count"),
            F.col("data_start_date").cast("string").alias("public_detail_start_date"),
            F.col("data_end_date").cast("string").alias("public_detail_end_date"),
        )
    )
    facts = panel.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("code").alias("stock_count"),
        F.min("date").alias("data_start_date"),
        F.max("date").alias("data_end_date"),
    )
    return facts.select(
        F.lit(f"serving-{data_version}").alias("run_id"),
        F.lit("build_serving").alias("pipeline_name"),
        F.current_timestamp().alias("started_at"),
        F.current_timestamp().alias("finished_at"),
        F.lit("SUCCESS").alias("status"),
        F.col("row_count").alias("input_rows"),
        F.col("row_count").alias("output_rows"),
        "data_start_date",
        "data_end_date",
        F.lit("panel").alias("source"),
        F.lit(data_version).alias("data_version"),
        F.lit("derived").alias("mode"),
        F.lit(source_label).alias("source_label"),
        F.lit("all symbols").alias("selection_rule"),
        scope.alias("public_scope"),
        F.lit("for engineering and analysis only, no investment advice").alias("disclaimer"),
    )


LOG = "number int, version string, replaces int, folder string, " \
    "tables array<struct<table_name: string, row_count: bigint, digest: string, columns: array<string>>>"


def _stored(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None) -> DataFrame:
    """A table of the star as it is read; ``columns`` are those of a narrowed one."""
    table = spark.read.parquet(f"{folder}/{name}")
    return widen(table, columns) if columns else table


class Publication:
    """One build of a star: a fresh folder under the version's name, a manifest, and a commit that names what it replaces.

    Nothing that readers may have open is overwritten. The commit is one file that is created or is there already, under the
    number that follows the one seen when the build began, so of two builds on the same base the second is refused.
    """

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.root, self.version = spark, root, version
        newest = latest(spark, root)
        self.base = newest["number"] if newest else 0
        self.folder = f"{root}/data/{version}-{os.urandom(6).hex()}"
        self.given: dict[str, int] = {}
        self.narrowed: dict[str, list[str]] = {}

    def write(
        self, name: str, table: DataFrame | Sequence[DataFrame], options: Mapping[str, str] | None = None, narrowed: bool = False
    ) -> DataFrame:
        """Write a table of the star and read it back; its rows are counted on the way. Parts of a table are written in turn,
        so that the shuffle files of one are there at a time (``session.shuffles_released``). Of a ``narrowed`` panel only the
        columns are stored that don't follow from others of the row; readers get all of them (``factors.widen``)."""
        if name not in STAR_TABLES:
            raise ValueError(f"{name} is no table of the star")
        rows = 0
        for i, part in enumerate([table] if isinstance(table, DataFrame) else table):
            if narrowed:
                self.narrowed[name] = [c for c in part.columns if not c.startswith("_")]
                part = narrow(part)
            seen = Observation()
            writer = part.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**(options or {}))
            writer.mode("append" if i else "errorifexists").parquet(f"{self.folder}/{name}")
            rows += seen.get["rows"]
        self.given[name] = rows
        return _stored(self.spark, self.folder, name, self.narrowed.get(name))

    def commit(self, expected: Mapping[str, int] | None = None) -> str:
        """Check all tables as they are stored, then name them as published."""
        missing = set(STAR_TABLES) - set(self.given)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        stored = {name: _stored(self.spark, self.folder, name, self.narrowed.get(name)) for name in STAR_TABLES}
        digests = [table_fingerprint(df).select(F.lit(name).alias("name"), "row_count", "hash_sum") for name, df in stored.items()]
        found = {r["name"]: r for r in reduce(DataFrame.unionByName, digests).collect()}  # one job, a row for each table
        tables = []
        for name in STAR_TABLES:
            count = found[name]["row_count"]
            for rows in {self.given[name], (expected or {}).get(name, self.given[name])}:
                if count != rows:
                    raise RuntimeError(f"{name}: expected {rows} rows, stored {count}")
            digest = str(found[name]["hash_sum"])
            tables.append({"table_name": name, "row_count": count, "digest": digest, "columns": self.narrowed.get(name)})
        number = self.base + 1
        entry = {"number": number, "version": self.version, "replaces": self.base or None, "folder": self.folder, "tables": tables}
        if not create_once(self.spark, f"{self.root}/log/{number:010d}.json", json.dumps(entry)):
            raise RuntimeError(f"another version was published first; this one was built on number {self.base}")
        return self.folder


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str, expected: Mapping[str, int]) -> str:
    """Write all tables under a version, check them, then name the version as published."""
    missing = set(STAR_TABLES) - set(tables)
    if missing:
        raise ValueError(f"missing tables: {sorted(missing)}")
    build = Publication(spark, root, version)
    for name in STAR_TABLES:
        build.write(name, tables[name])
    return build.commit(expected)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The log: one row for each published version, with the manifest of its tables."""
    return spark.read.schema(LOG).json(f"{root}/log").where(F.col("number").isNotNull())


def latest(spark: SparkSession, root: str):
    """The newest row of the log, or nothing."""
    return published(spark, root).orderBy(F.col("number").desc()).first() if exists(spark, f"{root}/log") else None


def open_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the newest published version."""
    newest = latest(spark, root)
    if newest is None:
        raise FileNotFoundError(f"nothing published under {root}")
    columns = {t["table_name"]: t["columns"] for t in newest["tables"]}
    return {name: _stored(spark, newest["folder"], name, columns[name]) for name in STAR_TABLES}


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(``table_name``, ``row_count``, ``digest``) of the newest version."""
    newest = published(spark, root).orderBy(F.col("number").desc()).limit(1)
    return newest.select(F.explode("tables").alias("t")).select("t.table_name", "t.row_count", "t.digest")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that the last ``keep`` versions don't name. Not for use while a build is under way."""
    named = {r["folder"].rpartition("/")[2] for r in published(spark, root).orderBy(F.col("number").desc()).limit(keep).collect()}
    gone = [f for f in folders(spark, f"{root}/data") if f.rpartition("/")[2] not in named]
    for folder in gone:
        delete(spark, folder)
    return gone


def open_serving(spark: SparkSession, path: str) -> DataFrame:
    """The serving panel in use."""
    newest = max(folders(spark, f"{path}/current"), default=None)
    if newest is None:
        raise FileNotFoundError(f"no serving panel under {path}")
    return spark.read.parquet(spark.read.text(newest).first()[0])


def rebuild_serving(spark: SparkSession, panel: DataFrame, path: str, order: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Write the serving panel anew beside the one in use, check it, switch, and return its metadata as key and value.

    Readers take the folder that the last file under ``current`` names (``open_serving``); a build that fails its check
    leaves them where they were.
    """
    require_columns(panel, required)
    frame = panel if "sentiment_source" in panel.columns else panel.withColumn("sentiment_source", F.lit("legacy_unknown"))
    served = keep_last(frame, order)
    expected = panel.dropna(subset=["code", "date", "close"]).select("code", "date").distinct().count()
    fresh = f"{path}/build-{os.urandom(6).hex()}"
    by_key(served).write.parquet(fresh)
    stored = spark.read.parquet(fresh)
    require_columns(stored, required)
    facts = stored.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("c"), F.min("date").alias("a"), F.max("date").alias("b")
    )
    if facts.first()["n"] != expected:
        raise RuntimeError(f"serving rows do not match: expected {expected}")
    number = len(folders(spark, f"{path}/current")) + 1
    if not create_once(spark, f"{path}/current/{number:010d}", fresh):
        raise RuntimeError("another build of the serving panel came first")
    entries = {
        "source": F.lit("processed_parquet"),
        "row_count": F.col("n").cast("string"),
        "stock_count": F.col("c").cast("string"),
        "start_date": F.col("a").cast("string"),
        "end_date": F.col("b").cast("string"),
        "sentiment_provenance": F.lit("legacy_unknown"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return facts.select(F.explode(pairs).alias("e")).select("e.*")


def public_sentiment(panel: DataFrame) -> DataFrame:
    """Sentiment columns that may be published, under their public names."""
    wanted = ["code", "date", "sentiment", "sentiment_ma5", "sentiment_ma10", "comment_count", "sentiment_source"]
    kept = panel.select(*[c for c in wanted if c in panel.columns])
    return kept.withColumnsRenamed({"sentiment_source": "data_source"})


def public_curve(results: DataFrame) -> DataFrame:
    """The four published columns of a backtest curve."""
    wanted = ["date", "equity_curve", "cumulative_return", "benchmark_cumulative"]
    return results.select(*[c for c in wanted if c in results.columns])


def masked_source(frame: DataFrame, label: str, column: str = "benchmark_source") -> DataFrame:
    return frame.withColumn(column, F.lit(label)) if column in frame.columns else frame


def nested_report_schema() -> T.StructType:
    """Schema of a stored quality report, for ``readers.read_report``."""
    detail = T.StructType(
        [
            T.StructField("column", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("rate", T.DoubleType()),
            T.StructField("category", T.StringType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    return T.StructType(
        [
            T.StructField("row_count", T.LongType()),
            T.StructField("stock_count", T.LongType()),
            T.StructField("quality_status", T.StringType()),
            T.StructField("missing_details", T.ArrayType(detail)),
        ]
    )


def report_with_details(report: DataFrame, profile: DataFrame) -> DataFrame:
    """The report row with its missing columns as an array; one entry per column."""
    details = profile.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("column_name").alias("column"),
                    F.col("missing_count").alias("count"),
                    F.col("missing_rate").alias("rate"),
                    "category",
                    "reason",
                )
            )
        )
    ).scalar()
    return report.withColumn("missing_details", details)
