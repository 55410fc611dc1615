"""Order, event and supplier tables read as market data.

No market feed ships with the data, so bars are derived from it: a supplier or
a user is a symbol, a day of line items or events is its bar. Different keys
have different codes, however many there are. Bars are unique on (code, date),
so a symbol never holds more rows than there are days; a date holds as many
rows as there are symbols. They come from aggregates with map-side combine
(sorted ones, as the order of the ticks is a struct): a supplier with a third
of all line items costs no task more than its share of input files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import board_of, code_from_number

# Weight of one event in the daily sentiment of a user.
EVENT_WEIGHTS = {"purchase": 1.0, "signup": 0.5, "error": -1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_code(key: str = "l_suppkey") -> Column:
    """Injective, and spread over all prefixes."""
    return code_from_number(F.col(key) * 7919 + 1)


def _first_last(frame: DataFrame, order: list[str]) -> list[Column]:
    position = F.struct(*order)
    return [
        F.min_by("price", position).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", position).alias("close"),
    ]


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from line items: long histories, one row per (code, date). Ticks are sorted by their key, a number that
    stands for its code and no other; the code is written out for the bars."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    ticks = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        *order,
    )
    daily = ticks.groupBy("l_suppkey", "date").agg(
        *_first_last(ticks, order),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )
    return daily.select(supplier_code().alias("code"), *daily.columns[1:])


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from events: wide cross-sections, real open/high/low/close shapes."""
    order = ["ts", "event_id"]
    ticks = table(spark, sf_dir, "events").select(
        code_from_number("user_id").alias("code"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").alias("price"),
        *order,
    )
    return ticks.groupBy("code", "date").agg(
        *_first_last(ticks, order),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.sum("price").alias("amount"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned vendor rows from line items, with the faults a cleaner has to meet.

    Several rows share a (code, trade_date); some dates are not ``yyyyMMdd``;
    closes and amounts can be missing; some rows break high/low or have a
    negative volume. ``seq`` is a total order standing in for file order.
    """
    price = F.try_divide("l_extendedprice", "l_quantity")
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        supplier_code().alias("code"),
        F.when(
            (line == 7) & (F.col("l_discount") > 0.08), F.date_format("l_shipdate", "yyyy/MM/dd")
        ).otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("trade_date"),
        price.alias("open"),
        (price * (1 + F.col("l_tax")) - F.when(line == 6, price * 0.1).otherwise(0.0)).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"),
        F.when((line == 5) & (F.col("l_tax") == 0.0), None).otherwise(price).alias("close"),
        F.when((F.col("l_returnflag") == "R") & (line == 4), -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .alias("vol"),
        F.when((F.col("l_suppkey") % 5 == 0) & (F.col("l_discount") < 0.03), None)
        .otherwise(F.col("l_extendedprice"))
        .alias("amount"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ).alias("seq"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol dimension from suppliers; nation is the industry, region the market."""
    code = supplier_code("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            code.alias("code"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("market"),
            board_of(code).alias("board"),
            F.col("n_name").alias("industry_l1"),
            F.lit(None).cast("date").alias("list_date"),
            F.lit(0).alias("is_demo"),
            F.lit("suppliers").alias("source"),
        )
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sentiment of a user: mean event weight and number of events."""
    weight = F.lit(0.0)
    for name, value in EVENT_WEIGHTS.items():
        weight = F.when(F.col("event_type") == name, value).otherwise(weight)
    return (
        table(spark, sf_dir, "events")
        .groupBy(code_from_number("user_id").alias("code"), F.col("ts").cast("date").alias("date"))
        .agg(F.avg(weight).alias("sentiment"), F.count(F.lit(1)).alias("comment_count"))
        .withColumn("data_source", F.lit("events"))
    )
