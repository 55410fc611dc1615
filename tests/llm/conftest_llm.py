from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_ string, row string, keys string, key string, shingle bigint, fp string, vote_length string"
LINE = "All rights reserved by nobody at all."
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions under an old bridge near the river"

# Ids, texts: nulls, empties, white space, repeats of rows, ids and texts, case, other scripts, one long text.
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\r\n\x0b\x0c "),
    (4, f"{PROSE}\n{LINE}\nunique four"),
    (5, f"{PROSE}\n  {LINE.upper()}\t\nunique five"),
    (5, f"{PROSE}\n  {LINE.upper()}\t\nunique five"),
    (6, f"{LINE}\n{LINE}\nshort\nshort"),
    (None, f"{LINE}\nno id"),
    (None, None),
    (7, "ÄÖÜß éèê Ñandú \U0001f600 漢字 " * 3 + "\n" + LINE),
    (8, "same id, one text\nwith a line of its own"),
    (8, f"same id, other text\n{LINE}"),
    (9, " ".join(f"w{i % 97}x{i}" for i in range(30000)) + "\n" + LINE),
    (10, f"{PROSE}\n{PROSE}\n{PROSE} " + "tail " * 60),
]


def frame(spark: SparkSession, rows=ROWS) -> DataFrame:
    """Documents with further columns whose names the operators use inside, null in part."""
    more = ("en", None, 3, "x", "y", None, "z", 7, None, "v")
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
