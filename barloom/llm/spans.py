"""Spans of a text that a regular expression matches, as column expressions (code points, end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.llm.common import let

HITS = "array<struct<start:int,end:int,hit:string>>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
BLOCK = 256
CHUNK = 512


def nothing(kind: str = HITS) -> Column:
    return F.array().cast(kind)


def running(items: Column, zero: Column, step, out) -> Column:
    """``out(state, item)`` for each item in order; the state starts as ``zero`` and goes on by ``step(state, item)``.

    An array is copied when it grows. So results grow in blocks of ``BLOCK``, kept in a list of blocks: n items cost
    n * BLOCK copies and (n / BLOCK) ** 2, not n ** 2.
    """
    # An empty list of the results' type.
    none = F.transform(F.slice(items, 1, 0), lambda item: out(zero, item))

    def add(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["state"], item).alias("state"), F.concat(acc["out"], F.array(out(acc["state"], item))).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        own = F.aggregate(F.slice(items, first, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return let(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(zero.alias("state"), F.slice(F.array(none), 1, 0).alias("out"))
    whole = F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) == 0, none).otherwise(whole)


def hits(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches in order. ``guard``: a cheap test that each text with a match passes.

    What lies between the matches comes from ``split``, so positions are running sums over pieces and matches.
    """

    def walk(pieces: Column, found: Column) -> Column:
        parts = F.transform(found, lambda m, i: F.struct(F.length(pieces[i]).alias("gap"), F.length(m).alias("size"), m.alias("hit")))

        def out(at: Column, m: Column) -> Column:
            return F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + m["size"]).alias("end"), m["hit"].alias("hit"))

        return let(parts, lambda items: running(items, F.lit(0), lambda at, m: at + m["gap"] + m["size"], out))

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    whole = let(both, lambda b: walk(b["p"], b["m"]))
    return F.when(guard if guard is not None else text.rlike(pattern), whole).otherwise(nothing())


def around(text: Column, spans: Column, near: int, body) -> Column:
    """``body(span, context)`` for each span: the context is the ``near`` characters before it, a blank, and those after.

    A position in a string is found by counting from its start, so the text is cut into chunks first and each context is
    taken from the chunks that it touches.
    """
    size = max(CHUNK, near)

    def taken(chunks: Column, start: Column, length: Column) -> Column:
        k = F.floor(start / size).cast("int")
        two = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
        return F.substring(two, start - k * size + 1, length)

    def one(chunks: Column, s: Column) -> Column:
        first = F.greatest(s["start"] - near, F.lit(0))
        context = F.concat(taken(chunks, first, s["start"] - first), F.lit(" "), taken(chunks, s["end"], F.lit(near)))
        return let(context, lambda c: body(s, c))

    chunks = F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return let(chunks, lambda c: F.transform(spans, lambda s: one(c, s)))


def named(found: Column, kind: str, rank: int) -> Column:
    """Hits as spans of a kind; ``rank`` is its place among the kinds."""
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["hit"].alias("hit")))


def merged(*parts: Column) -> Column:
    """Spans of several kinds by start, then kind."""
    return F.sort_array(F.concat(*parts))


def printed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def outside(added: Column, base: Column) -> Column:
    """Those of ``added`` that aren't inside one of ``base``, by start.

    In one pass by start, base spans before added ones: a span is inside if a base span so far ends with it or after it.
    """

    def tagged(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span")))

    def judged(sweep: Column) -> Column:
        end = lambda reach, x: F.when(x["own"], reach).otherwise(F.greatest(reach, x["span"]["end"]))
        out = lambda reach, x: F.when(x["own"] & (reach < x["span"]["end"]), x["span"])
        return F.filter(running(sweep, F.lit(-1), end, out), lambda s: s.isNotNull())

    sweep = F.sort_array(F.concat(tagged(base, False), tagged(added, True)))
    return F.when((F.size(added) == 0) | (F.size(base) == 0), added).otherwise(let(sweep, judged))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
