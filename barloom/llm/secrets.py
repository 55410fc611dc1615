"""Secret scan (operator 4), in column expressions only.

Three base patterns (assignments, access keys, long hex runs) give spans by the letter. The entropy scan adds spans of kind
``entropy``: candidate strings (runs of token characters, with a digit and a letter) get a window of ``WINDOW`` characters
slid over them. The counts of the window's characters are kept from step to step, one in and one out, and so is the sum of
n log n over them, which gives the Shannon entropy; the highest one is held against the limit of the string's character
class (hex digits, or all token characters). The allow-list drops added spans whose string it matches, and those inside a
base span; base spans always stay.

A null text counts as empty; empty texts have no spans. Repeated rows are scanned each. An empty table gives no rows. Spans
that start together are ordered by kind. Only the id and the text column are read. A text's time grows with its length,
and with the square of its number of matches where that is in the tens of thousands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import spans as S
from barloom.llm.common import let

# The base patterns are fixed by the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12  # characters of the value
ACCESS = r"AKIA[A-Z0-9]{14,}+"  # 18 characters and more
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20


@dataclass(frozen=True)
class CharClass:
    """Strings that ``match`` fits: their alphabet, and the bits a character of a window must carry at least."""

    match: str
    alphabet: str
    bits: float


CLASSES = (
    CharClass(r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    CharClass(r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
)
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i:example|sample|dummy|placeholder|changeme|xxxx)",
    # words in a path or name, letters only, the last one with a short number: name-of-file-v2, report/of/2024
    r"^(?:[A-Za-z]+[-_/=+])+(?:[A-Z]?[a-z]+)?[0-9]{1,4}$",
    r"^[=_+/-]+$",  # rules
    # underlines, if no part between them is long enough for a candidate
    r"^(?!.*(?:(?![=_-]{4}).){20}).*[=_-]{4}",
)


def best_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of the windows of a string (of the string, if it is shorter), in bits a character."""
    # n log2 n for each count that a window can hold
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])

    def moved(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == at, c + by).otherwise(c))

    def slide(chars: Column) -> Column:
        size = F.size(chars)

        def step(acc: Column, i: Column) -> Column:
            gone = F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(-1))
            was = F.coalesce(F.get(acc["counts"], gone), F.lit(0))
            left = F.struct(
                F.when(gone >= 0, moved(acc["counts"], gone, -1)).otherwise(acc["counts"]).alias("counts"),
                (acc["sum"] - F.when(gone >= 0, weight[was] - weight[was - 1]).otherwise(0.0)).alias("sum"),
            )

            def enter(x: Column) -> Column:
                had = F.get(x["counts"], chars[i])
                total = x["sum"] + weight[had + 1] - weight[had]
                full = (i >= window - 1) | (i == size - 1)
                n = F.least(i + 1, F.lit(window)).cast("double")
                entropy = F.log2(n) - total / n
                return F.struct(moved(x["counts"], chars[i], 1).alias("counts"), total.alias("sum"), F.when(full, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"))

            return let(left, enter)

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), size - 1), zero, step, lambda acc: acc["best"]))

    known = F.array_remove(F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.position(c, F.lit(alphabet)) - 1)), -1)
    return let(known, slide)


def _entropy_spans(text: Column, classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> Column:
    found = S.hits(text, CANDIDATE)
    mixed = F.filter(found, lambda h: h["hit"].rlike("[0-9]") & h["hit"].rlike("[A-Za-z]"))
    if allowed:
        mixed = F.filter(mixed, lambda h: ~h["hit"].rlike("|".join(f"(?:{p})" for p in allowed)))

    def random(h: Column) -> Column:
        verdict = F.lit(False)
        for c in reversed(classes):
            verdict = F.when(h["hit"].rlike(c.match), best_entropy(h["hit"], c.alphabet) >= c.bits).otherwise(verdict)
        return verdict

    return F.filter(mixed, random)


def scan(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``base`` and ``added``, arrays of (start, rank, end, kind, hit) by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = S.hits(text, ASSIGN)
    long = F.filter(assign, lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 1)) >= ASSIGN_MIN)
    access = S.hits(text, ACCESS, F.contains(text, F.lit("AKIA")))
    base = S.merged(*[S.named(f, k, i) for i, (f, k) in enumerate(zip((long, access, S.hits(text, HEX)), KINDS, strict=False))])
    added = S.named(_entropy_spans(text, classes, allowed), KINDS[3], 3)
    found = docs.select(F.col(id_col), base.alias("base"), added.alias("found"))
    return found.select(id_col, "base", S.outside(F.col("found"), F.col("base")).alias("added"))


def digest(scanned: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans in print."""
    base = F.col("base")
    return scanned.select(
        id_col, *[S.count(base, k).alias(f"n_{k}") for k in kinds], F.sha2(S.printed(base), 256).alias("base_sha256"), S.printed(S.merged(base, F.col("added"))).alias("spans")
    )
