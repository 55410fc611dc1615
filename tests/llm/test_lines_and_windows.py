"""Line dedup (1), decontamination (2): against brute force, edge cases, reversal."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import LINE, PROSE, ROWS, frame

from barloom.llm import decontam, linededup

LAST = 2**63 - 1
low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def cut(rows):
    """Brute force: (id, n_lines, n_dropped, kept digest) of each row, counted."""
    key = lambda x: low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(LAST if i is None else i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        own = LAST if i is None else i
        kept = [x for x in lines if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) < own)]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def got_cut(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def test_lines_equal_brute_force(docs):
    assert got_cut(linededup.dedup_lines(docs)) == cut(ROWS)


def test_lines_of_an_empty_table(nothing):
    assert linededup.dedup_lines(nothing).count() == 0


def test_carried_columns_stay(docs):
    rows = linededup.dedup_lines(docs, carry=("lang", "keys", "row")).collect()
    assert len(rows) == len(ROWS) and all(r["row"]["lang"] == "en" and r["row"]["row"] == "y" for r in rows)


def test_insert_then_delete_decides_as_before(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PER_SHARD", 3)  # several shards, and their number changes
    first = [r for r in ROWS if r[0] in (4, 5, 6, None)]
    later = [(20, f"{LINE}\nanother shared line"), (3, f"{LINE}\nanother shared line\nunique four and more"), (21, "another shared line")]
    one = linededup.LineIndex.empty(spark, salts=2).insert(frame(spark, first))
    two = one.insert(frame(spark, later))
    three = two.delete(spark.createDataFrame([(20,), (3,), (21,), (99,)], "doc_id bigint"))
    decided = lambda index: sorted((r["doc"], sorted(bytes(k) for k in r["keys"])) for r in index.dropped().collect())
    assert decided(two) != decided(one) == decided(three)
    both = frame(spark, first + later)
    assert got_cut(two.apply(both, two.dropped())) == cut(first + later)
    counts = {bytes(r["key"]): r["refs"] for r in three.table("counts").collect()}
    assert counts == {bytes(r["key"]): r["refs"] for r in one.table("counts").collect()}


def test_cuckoo_filter_never_forgets_and_deletes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(4000)]
    table = linededup.Cuckoo.build(keys[:2000])
    assert table.holds(keys[:2000]).all()
    assert table.holds(keys[2000:]).mean() < 0.01
    table = linededup.Cuckoo.of(table.raw())
    table.delete(keys[:1000])
    assert table.holds(keys[1000:2000]).all() and table.holds(keys[:1000]).mean() < 0.01
    table.delete(keys[1000:2000])
    assert not table.slots.any()
    with pytest.raises(ValueError):
        table.delete(keys[:1])


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEMS = [
    (1, PROSE),
    (2, "quick brown fox jumps over the lazy dog while seven"),
    (3, "éèê Ñandú"),
    (4, None),
    (5, "!!! ..."),
    (6, "tail"),
    (7, "tail tail"),
    (8, "w5x199 W6X200 w7x201 w8x202 w9x203 w10x204 w11x205 w12x206 w13x207 w14x208 w15x209 w0x0"),
    (9, "nowhere to be found in any of the documents at all really"),
    (None, "unique four"),
    (1, PROSE),
]


def marked(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(WORDS, low(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))
    out = Counter()
    for i, t in rows:
        w, hit, found = re.findall(WORDS, low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[i, len(w), len(hit), tuple(sorted(found)), bool(hit)] += 1
    return out


def got_marks(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect())


@pytest.mark.parametrize("size", [10, 3])
def test_contamination_equals_brute_force(spark, docs, size):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert got_marks(decontam.contamination(docs, items, size)) == marked(ROWS, ITEMS, size)


def test_contamination_by_a_full_bitmap(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BITS", 1 << 15)  # lets far more through, with the same result
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert got_marks(decontam.contamination(docs, items)) == marked(ROWS, ITEMS)


def test_contamination_without_items_or_documents(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got_marks(decontam.contamination(docs, none)) == marked(ROWS, [])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontam.contamination(nothing, items).count() == 0
    kept = decontam.drop_contaminated(docs, spark.createDataFrame(ITEMS[:1], "item_id bigint, text string"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 6, 7, 8, 9, None}


def test_shingles_tell_order_and_width():
    h = decontam.hashes_of([b"a", b"b", b"a", b"b"])
    assert len({*decontam.shingles_of(h, 1)}) == 2 and len({*decontam.shingles_of(h, 2)}) == 2
    assert not np.intersect1d(decontam.shingles_of(h, 1), decontam.shingles_of(h, 2)).size
    assert decontam.shingles_of(h, 5).size == 0


def test_one_id_with_many_rows(spark):
    """A third of all rows share an id, a third have none: each row is given its own keys only."""
    rows = [(1, f"{LINE}\nfirst line of all {i}") for i in range(150)]
    rows += [(i, f"{LINE}\nfirst line of all {i}\nown line number {i}") for i in range(2, 150)]
    rows += [(None, f"first line of all {i}\n{LINE}\nanother line {i}") for i in range(150)]
    df = frame(spark, rows)
    assert got_cut(linededup.dedup_lines(df)) == cut(rows)
    lines = linededup.postings(df)
    index = linededup.LineIndex.empty(spark).insert_postings(lines)
    assert max(len(r["keys"]) for r in index.dropped(lines).collect()) <= 3


def test_salts_follow_the_size_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PER_TASK", 5)
    rows = [(i, f"{LINE}\nown line number {i}") for i in range(60)]
    assert got_cut(linededup.dedup_lines(frame(spark, rows))) == cut(rows)
