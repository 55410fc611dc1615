"""Lexicon scoring of text and daily sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import as_number, iso_date

# Default words of the finance lexicon.
POSITIVE = [
    "涨", "大涨", "反弹", "上涨", "利好", "突破", "创新高", "业绩增长",
    "利润增长", "超预期", "增持", "买入", "推荐", "看涨", "牛", "红",
]
NEGATIVE = [
    "跌", "大跌", "下跌", "利空", "破位", "创新低", "业绩下滑",
    "亏损", "减持", "卖出", "看跌", "熊", "绿", "风险", "暴雷",
]


def _hits(text: Column, words: Sequence[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def lexicon_score(text: Column | str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(p - n) / (p + n) over lexicon words the whole text contains; 0 with none or no text."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    p, n = _hits(lowered, positive), _hits(lowered, negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def lexicon_sentiment(
    texts: DataFrame, column: str = "text", positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE
) -> DataFrame:
    return texts.withColumn("sentiment", lexicon_score(column, positive, negative))


def daily_sentiment(items: DataFrame, source: str) -> DataFrame:
    """Mean score and item count per symbol and calendar day."""
    return items.groupBy("code", F.col("ts").cast("date").alias("date")).agg(
        F.avg("sentiment").alias("sentiment"), F.count(F.lit(1)).alias("news_count")
    ).withColumn("data_source", F.lit(source))


def comment_sentiment(comments: DataFrame, order: Sequence[Column | str], source: str) -> DataFrame:
    """First numeric comment score per symbol and date; a missing score is 0.

    Text that is neither missing nor a number is skipped, as is a bad date.
    """
    usable = comments.withColumns({"date": iso_date("date"), "score": as_number("sentiment")}).where(
        F.col("date").isNotNull() & (F.col("score").isNotNull() | F.col("sentiment").isNull())
    )
    kept = usable.groupBy("code", "date").agg(
        F.min_by(F.coalesce("score", F.lit(0.0)), F.struct(*order)).alias("sentiment")
    )
    return kept.withColumns({"comment_count": F.lit(1), "data_source": F.lit(source)})
