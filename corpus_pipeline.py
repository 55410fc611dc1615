"""From raw documents to token ids: five stages over the table ``documents``.

Each stage is written and read again before the next, so a lost executor costs a stage's work at most. Every stage decides
row by row: null and repeated ids, repeated rows and null or empty texts are rows like others, further columns of any name
pass through (but for the last stage, which returns measures), and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, linededup, quality, simhash
from barloom.llm.common import table
from barloom.llm.queries import VOCABULARY
from barloom.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; those with a null or empty text are among them. Equal rows are judged alike."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a document with a smaller id holds; ``n_chars`` follows.

    Rows that share an id are one document, and all rows without an id one more, the last: none of these loses a line to
    another of its own. A null text becomes an empty one.
    """
    cut = linededup.dedup_lines(docs, carry=tuple(c for c in docs.columns if c not in ("text", "n_chars")))
    text = F.col("kept").cast("string")
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, one without an id only if none has one;
    ties are broken by the text's checksum, and of equal rows one stays. All empty texts are one group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; each row by its own text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for each row; a null text counts as an empty one."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # neither the fitted rules nor the fingerprints and ids have an SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
