"""Quality rules by weak supervision (operator 8), in column expressions only.

Rules vote good, bad or abstain on counts taken from the whole text. Expectation-maximisation over the vote patterns (at
most 3 to the number of rules, however many documents there are) estimates how often each rule calls a good and a bad
document bad, and the share of good documents; a document's verdict is its posterior probability of being good. No label
takes part. The two base limits (too few words, too much repetition) reject whatever the posterior says.

A null text has no words and so fails the base. Repeated rows count and are judged each. An empty table gives no rows.
Of further columns only the id is read. Ties: a posterior of exactly the threshold is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let
from barloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # none has a meaning inside brackets
MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words inside repeated windows

GOOD, ABSTAIN, BAD = 1, 0, -1
# Frequent function words of four languages; fixed values.
FUNCTION_WORDS = "a an and are as be by for from in is it of on or that the this to was with au avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une als auch auf das dem den der die ein eine er ist mit nicht sich sie und von zu con del el es las los no por se su y".split()
_ALONE = r"(?<![^\x20\x09-\x0D]){}(?![^\x20\x09-\x0D])"  # a whole word
# Grouped by the first letter, which may be a capital, so that most words are refused at once.
FUNCTION = _ALONE.format(
    "(?:" + "|".join(f"[{c}{c.upper()}](?:" + "|".join(w[1:] for w in sorted(set(FUNCTION_WORDS)) if w[0] == c) + ")" for c in sorted({w[0] for w in FUNCTION_WORDS})) + ")"
)
PLAIN = _ALONE.format(r"\p{L}++[.,;:?!]?")  # letters and at most one mark


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on and good up to ``good``; between them it abstains. ``floor``: smaller values are worse."""

    name: str
    value: str
    good: float
    bad: float
    floor: bool = False

    def vote(self) -> Column:
        v = F.expr(self.value)
        good, bad = (v >= self.good, v <= self.bad) if self.floor else (v <= self.good, v >= self.bad)
        # No value (no words to divide by) is no opinion.
        return F.coalesce(F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)), F.lit(ABSTAIN)).cast("tinyint")


RULES = (
    Rule("length", "n_words", 80, 49, floor=True),
    Rule("word_length_low", "word_chars / nullif(n_words, 0)", 3.0, 2.0, floor=True),
    Rule("word_length_high", "word_chars / nullif(n_words, 0)", 11.0, 14.0),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.05, 0.15),
    Rule("repeated_windows", "n_repeat_words / nullif(n_words, 0)", 0.15, 0.3),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", 0.15, 0.3),
    Rule("capitals", "n_capitals / nullif(n_words, 0)", 0.7, 1.5),
    Rule("plain_words", "n_plain / nullif(n_words, 0)", 0.85, 0.6, floor=True),
    Rule("function_words", "n_function / nullif(n_words, 0)", 0.08, 0.02, floor=True),
    Rule("distinct_words", "n_distinct / nullif(n_words, 0)", 0.2, 0.1, floor=True),
    Rule("exclamations", "n_exclamations / nullif(n_words, 0)", 0.05, 0.2),
)


def _count(text: Column, kind: str) -> Column:
    """Characters of a class, by taking the runs of all others out."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated window are sorted: (hash, position)
    pairs bring equal windows together, and the positions of repeated ones, in order, add at most three words each.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda p, k: F.struct(p["i"].alias("i"), ((p["h"] == F.get(s, k - 1)["h"]) | (p["h"] == F.get(s, k + 1)["h"])).alias("twice"))),
                        lambda q: F.coalesce(q["twice"], F.lit(False)),
                    ),
                    lambda q: q["i"],
                )
            ),
        )
        return let(
            starts,
            lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda acc, n: acc + n),
        )

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the counts that the rules look at, and ``base_failed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    counts = docs.select(
        F.col(id_col),
        of_words.alias("w"),
        lines.alias("l"),
        _count(text, SYMBOLS).alias("n_symbols"),
        F.regexp_count(text, F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.regexp_count(text, F.lit(FUNCTION)).cast("long").alias("n_function"),
        _count(text, "!").alias("n_exclamations"),
        _count(text, "A-Z").alias("n_capitals"),
    )
    flat = counts.select(id_col, "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines", "n_plain", "n_function", "n_exclamations", "n_capitals")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule how often it calls good and bad ones bad when it votes."""

    good: float
    bad_if_good: tuple[float, ...]
    bad_if_bad: tuple[float, ...]

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        import math

        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, g, b in zip(rules, self.bad_if_good, self.bad_if_bad, strict=True):
            vote = F.col(f"vote_{rule.name}")
            odds = odds + F.when(vote == BAD, F.lit(math.log(g / b))).when(vote == GOOD, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-odds))


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 30, tolerance: float = 1e-4) -> Model:
    """EM over distinct vote patterns with their ``count``. Each round is one aggregate that returns one row.

    It starts from rules that rarely call a good document bad, and pseudo-counts (1 in 50 for good documents, an even
    pair for bad ones) keep rates off 0 and 1; so a rule that never votes, and an empty table, leave the start as it is.
    """
    k = len(rules)
    model = Model(0.8, (0.02,) * k, (0.4,) * k)
    for _ in range(rounds):
        p, n = model.posterior(rules), F.col("count")
        sums = [F.sum(n).alias("n"), F.sum(n * F.col("p")).alias("good")]
        for i, rule in enumerate(rules):
            vote = F.col(f"vote_{rule.name}")
            bad, voted = F.when(vote == BAD, n).otherwise(0), F.when(vote != ABSTAIN, n).otherwise(0)
            sums += [F.sum(bad * F.col("p")).alias(f"bg{i}"), F.sum(voted * F.col("p")).alias(f"vg{i}")]
            sums += [F.sum(bad * (1 - F.col("p"))).alias(f"bb{i}"), F.sum(voted * (1 - F.col("p"))).alias(f"vb{i}")]
        s = patterns.withColumn("p", p).agg(*sums).first()
        if not s["n"]:
            return model
        new = Model(
            min(max((s["good"] + 4) / (s["n"] + 5), 0.01), 0.99),
            tuple((s[f"bg{i}"] + 1) / (s[f"vg{i}"] + 50) for i in range(k)),
            tuple((s[f"bb{i}"] + 1) / (s[f"vb{i}"] + 2) for i in range(k)),
        )
        moved = max(abs(a - b) for a, b in zip((model.good, *model.bad_if_good, *model.bad_if_bad), (new.good, *new.bad_if_good, *new.bad_if_bad), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts, ``base_failed``, ``quality`` (posterior probability of being good) and ``kept``.

    The counts are written once to the shared folder (a few numbers a row), since both the fit and the verdicts read them.
    """
    votes = [r.vote().alias(f"vote_{r.name}") for r in rules]
    seen = materialise(signals(docs, id_col, text_col).select("*", *votes), "quality")
    names = [f"vote_{r.name}" for r in rules]
    model = fit(materialise(seen.groupBy(*names).count().coalesce(1), "votes"), rules)
    quality = model.posterior(rules)
    return seen.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. The counts are taken twice, for the fit and for
    the verdicts: cheaper than moving the texts to meet their verdicts."""
    votes = [r.vote().alias(f"vote_{r.name}") for r in rules]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    names = [f"vote_{r.name}" for r in rules]
    model = fit(materialise(signals(rows, "row").select(*votes).groupBy(*names).count().coalesce(1), "votes"), rules)
    judged = signals(rows, "row").select("row", "base_failed", *votes)
    return judged.where(~F.col("base_failed") & (model.posterior(rules) >= threshold)).select("row.*")
