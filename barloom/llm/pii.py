"""Personal data (operator 7), in column expressions only.

Regular expressions propose spans; validators confirm them: Luhn's sum for card numbers, the remainder by 97 for bank
account numbers, ranges for addresses, digit counts for telephone numbers. Every span gets a score: its kind's own, plus a
share where a word that goes with the kind stands within ``NEAR`` characters before or after it, less a share where a
word that speaks against it does. Base spans (email, ip, card, phone) stay whatever their score; the kinds that the
method adds (iban, ssn) need ``LIMIT``.

A null text counts as empty; empty texts have no spans. Repeated rows are scanned each. An empty table gives no rows. Spans
that start together are ordered by kind. Only the id and the text column are read. A text's time grows with its length,
and with the square of its number of matches where that is in the tens of thousands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import spans as S
from barloom.llm.common import let

# The base patterns are fixed by the contract. Possessive quantifiers and the look-behinds don't change what matches; they
# keep long runs from being tried from each of their characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

NEAR = 40
LIMIT = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    score: float
    supports: str  # words nearby that raise the score by 0.2
    speaks_against: str = r"example|test|sample|dummy"  # words nearby that lower it by 0.2


KINDS = (
    Kind("email", 0.7, r"e-?mail|contact|write|address|kontakt|correo|courriel"),
    Kind("ip", 0.5, r"ip|host|server|address|adresse", r"version|release|section|chapter"),
    Kind("card", 0.7, r"card|visa|master|amex|payment|karte|carte|tarjeta|credit"),
    Kind("phone", 0.6, r"tel|phone|call|mobile|fax|telefon|llamar|appel"),
    Kind("iban", 0.8, r"iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", 0.4, r"ssn|social|security|tax"),
)
BASE = ("email", "ip", "card", "phone")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(F.transform(each, value), F.lit(0), lambda acc, d: acc + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 when divided by 97: first four at the end, letters as 10 to 35."""
    plain = F.regexp_replace(account, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    each = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(each, F.lit(0), step) == 1


def _scored(found: Column, text: Column, kind: Kind, rank: int) -> Column:
    word = r"(?i)(?<![a-z])(?:{})(?![a-z])"

    def one(h: Column, context: Column) -> Column:
        more = F.when(context.rlike(word.format(kind.supports)), 0.2).otherwise(0.0)
        score = F.lit(kind.score) + more - F.when(context.rlike(word.format(kind.speaks_against)), 0.2).otherwise(0.0)
        return F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind.name).alias("kind"), h["hit"].alias("hit"), score.alias("score"))

    return let(found, lambda spans: S.around(text, spans, NEAR, one))


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``base`` and ``added``, arrays of (start, rank, end, kind, hit, score) by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    found = {
        "email": S.hits(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(S.hits(text, IP), lambda h: F.forall(F.split(h["hit"], r"\."), part)),
        "card": F.filter(
            S.hits(text, CARD, text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]")), lambda h: let(digits(h["hit"]), lambda d: F.length(d).between(12, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))
        ),
        "phone": F.filter(S.hits(text, PHONE, text.rlike(r"\+[0-9]")), lambda h: F.length(digits(h["hit"])).between(9, 15)),
        "iban": F.filter(S.hits(text, IBAN), lambda h: mod97(h["hit"])),
        "ssn": S.hits(text, SSN),
    }
    scored = {k.name: _scored(found[k.name], text, k, i) for i, k in enumerate(kinds)}
    base = S.merged(*[scored[k] for k in BASE])
    added = S.merged(*[F.filter(scored[k.name], lambda s: s["score"] >= limit) for k in kinds if k.name not in BASE])
    spans = docs.select(F.col(id_col), base.alias("base"), added.alias("found"))
    return spans.select(id_col, "base", S.outside(F.col("found"), F.col("base")).alias("added"))
