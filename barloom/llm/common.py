"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NULL_ID = 2**63 - 1  # where ids are compared, a null id comes last
ASCII_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that stand for a row: its id and its text.

    Rows that share an id but not the text get different keys, so results worked out per key never mix them. Rows alike
    in both share a key, and their results are alike as well.
    """
    # The id is printed in front of a character that no number holds, so the two parts can't run into each other.
    return F.unhex(F.md5(F.concat(F.coalesce(named(id_col).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(named(text_col), F.lit("")))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: inside higher-order functions a column is evaluated at each use."""
    return F.transform(F.array(value), body)[0]


def schema_with(frame: DataFrame, id_col: str, more: str) -> StructType:
    """The schema of a result: the id column as in ``frame``, whatever its name, and further columns."""
    made = StructType([frame.schema[id_col]])
    made.fields += StructType.fromDDL(more).fields
    return StructType(made.fields)


def batches_of(items: Iterable, size, most: int) -> Iterator[list]:
    """Items in order, in lists whose sizes add up to ``most`` or more at their last item only."""
    group, total = [], 0
    for item in items:
        group.append(item)
        total += size(item)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def named(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")
