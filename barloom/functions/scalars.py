"""Row-level expressions: codes, boards, dates, null handling, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Board labels and listing venues of the symbol dimension.
STAR_BOARD = "科创板"
GROWTH_BOARD = "创业板"
SHENZHEN_MAIN = "深市主板"
SHANGHAI_MAIN = "沪市主板"
OTHER_BOARD = "其他"

CODE_PATTERN = r"^[0-9]{6}$"  # what vendors send
LONG_CODE_PATTERN = r"^[0-9]{6,}$"  # codes made from keys, which may be longer


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_safe(predicate: Column) -> Column:
    """A predicate that is false, not NULL, when an operand is missing."""
    return F.coalesce(predicate, F.lit(False))


def no_nan(value: Column | str) -> Column:
    """NaN and NULL mean the same thing here; keep only NULL."""
    value = col(value)
    return F.when(~F.isnan(value), value)


def normalise_code(value: Column | str) -> Column:
    """Strip a float suffix and zero-pad to six; longer codes are left as they are."""
    return _padded(F.regexp_replace(col(value).cast("string"), r"\.0$", ""))


def _padded(text: Column) -> Column:
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def is_valid_code(value: Column | str, pattern: str = CODE_PATTERN) -> Column:
    return null_safe(col(value).rlike(pattern))


def code_from_number(value: Column | str) -> Column:
    """A code for any integer key, different for different keys: six digits at least, more where the key has more."""
    return _padded(col(value).cast("long").cast("string"))


def board_of(code: Column | str) -> Column:
    """Board by code prefix. 688 has to be tested before 6."""
    code = col(code)
    return (
        F.when(code.startswith("688"), STAR_BOARD)
        .when(code.startswith("3"), GROWTH_BOARD)
        .when(code.startswith("0"), SHENZHEN_MAIN)
        .when(code.startswith("6"), SHANGHAI_MAIN)
        .otherwise(OTHER_BOARD)
    )


def market_of(board: Column | str) -> Column:
    return F.when(col(board).isin(SHANGHAI_MAIN, STAR_BOARD), "SSE").otherwise("SZSE")


def exchange_suffix(code: Column | str) -> Column:
    code = col(code)
    return F.when(code.startswith("6") | code.startswith("9"), "SH").otherwise("SZ")


def trade_date(value: Column | str) -> Column:
    """``yyyyMMdd`` text or number to a date; anything else is NULL."""
    text = F.regexp_replace(col(value).cast("string"), r"\.0$", "")
    return F.when(text.rlike(r"^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def iso_date(value: Column | str) -> Column:
    return F.try_to_timestamp(F.substring(col(value).cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def as_number(value: Column | str) -> Column:
    return no_nan(col(value).try_cast("double"))


def money_label(value: Column | str) -> Column:
    """Amounts in units of 1e8 or 1e4, as shown on pages."""
    value = col(value)
    return (
        F.when(value.isNull(), "--")
        .when(F.abs(value) >= 1e8, F.concat(F.format_string("%.2f", value / 1e8), F.lit("亿")))
        .when(F.abs(value) >= 1e4, F.concat(F.format_string("%.2f", value / 1e4), F.lit("万")))
        .otherwise(F.format_number(value, 0))
    )


def sentiment_class(value: Column | str, threshold: float = 0.1) -> Column:
    value = col(value)
    return F.when(value > threshold, "positive").when(value < -threshold, "negative").otherwise("neutral")


def count_where(predicate: Column) -> Column:
    return F.count_if(null_safe(predicate))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL, not an error, when one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
