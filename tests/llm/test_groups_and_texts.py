"""SimHash (5), sharding (6), byte-level BPE (9), HTML (10) and the pipeline: brute force, round trips, edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from conftest_llm import LINE, PROSE, ROWS, frame
from pyspark.sql import functions as F

from barloom.llm import bpe, sharding, simhash
from barloom.llm.htmltext import extract, visible_text


def plain_fingerprint(t):
    from xxhash import xxh64

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] += [] if doc is None else [doc]
    return Counter((doc, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows))


def near_rows():
    rng = random.Random(4)
    base = [f"{rng.choice('abcdefgh')}{k % 53}" for k in range(400)]
    rows = list(ROWS)
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(words)))
    return rows


def test_near_duplicates_equal_brute_force(spark, nothing):
    rows = near_rows()
    want = plain_components(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows) - 20
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(7)
    chain = [0]
    for _ in range(40):  # a chain whose ends are far apart, each link two bits
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    dense = [0x5555 << 40 | x for x in range(256)]  # one list of the index holds all of these
    alone = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({*chain, *dense, *alone})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    group = {v: v for v in values}

    def find(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                group[find(a)] = find(b)
    mine = {v: root.get(simhash._signed(v), simhash._signed(v)) for v in values}
    assert len(set(mine.values())) == len({find(v) for v in values})
    assert all((mine[a] == mine[b]) == (find(a) == find(b)) for a in chain + dense[:20] for b in alone + dense[-20:] + chain[-3:])


def test_one_of_each_group_stays(spark):
    rows = [r for r in near_rows() if r[0] not in (5, 8)]
    kept = simhash.keep_one(frame(spark, rows))
    want = {c for _, _, c in plain_components(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and ids.count(None) == 1  # the group that only a row without an id is in


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000])
def test_permutation_is_one_and_has_an_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.place(F.col("id"), n, 9).alias("p")).withColumn("back", sharding.number_at(F.col("p"), n, 9)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_shards_are_even_gapless_and_reproducible(spark, docs, nothing):
    out = sharding.shuffled(docs, 4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    facts = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert facts == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    again = sharding.shuffled(docs.repartition(7), 4).collect()
    place = lambda rows: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert place(out) == place(again) != place(sharding.shuffled(docs, 4, seed=1).collect())
    assert sharding.shuffled(nothing, 4).count() == 0


def test_copies_of_one_document_take_their_places_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH", 100)
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("text"))
    out = sharding.shuffled(hot, 7)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i if i % 3 else None for i in range(3000))
    places = sorted(r["slot"] * 7 + r["shard"] for r in rows)
    assert places == list(range(3000))
    assert len({r["task"] for r in rows if r["doc_id"] is None}) > 1


def test_other_columns_are_passed_on_when_rows_are_placed(spark, docs):
    facts = sharding.facts(docs).withColumn("my col", F.lit("a b")).withColumn("id", F.col("size") % 3)
    out = sharding.assign(facts, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["my col"], r["id"]) for r in out) == Counter((i, len((t or "").encode()) + 16, "a b", (len((t or "").encode()) + 16) % 3) for i, t in ROWS)
    assert sorted(r["slot"] * 4 + r["shard"] for r in out) == list(range(len(ROWS)))


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_decode_back(tiktoken_encoding):
    ranks = bpe.load_ranks(PATH)
    codec = bpe.Codec(ranks, bpe.model_bytes(ranks), public_tokenizers.PATTERN)
    rng = random.Random(2)
    pool = [chr(i) for i in range(0x300)] + list("  \n\t\x1c\x85 　\U0001f44d﻿漢字'sLL'll12<|endoftext|>")
    texts = ["", "a" * 30000, " " * 5000 + "x", *["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(3000)]]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_encoding_of_tables(spark, docs, nothing, tiktoken_encoding):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in ROWS:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect())) == want
    ids = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((i, (t or "").encode()) for i, t in ROWS)
    assert bpe.round_trip(nothing, PATH, public_tokenizers.PATTERN).count() == 0


PAGES = [
    ("<title>T</title><h1>Head</h1>intro  text<p>one<p>two <b>bold</b><br>next", "Head\n\nintro text\n\none\n\ntwo bold\nnext"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  1. x\n  2. y\n- c\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apples<td>10<tr><td>Figs &amp; more<br>line<td>2</table>", "Name         Qty\nApples       10\nFigs & more  2\nline"),
    ("<table><tr><td rowspan=2>R<td>1<tr><td>2</table>end", "R  1\n   2\n\nend"),
    ("a<script>b</script><style>c</style><span hidden>d</span><div style='color:red; Display : none'>e</div><p style='visibility:hidden'>f</p>g<!-- h -->", "ag"),
    ("<pre>  keep\n   this</pre>", "  keep\n   this"),
    ("<head><meta charset=x>text in the head", "text in the head"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("open <!-- comment to the end <p>never", "open"),
    ("&copy; &#x41;&#66; &nosuch; 1 < 2", "© AB &nosuch; 1 < 2"),
    ("</p></div>stray<td>cell</tr>", "straycell"),
    ("", ""),
    (" \n ", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_layout(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", "Let x=2."),
        ("<math><semantics><mi>y</mi><annotation>\\y</annotation><annotation-xml><ci>z</ci></annotation-xml></semantics></math>", "y"),
        ("<svg><text>Sun</text><g><text>Earth <tspan>(old)</tspan></text></g></svg>", "Sun\nEarth (old)"),
        ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><style>s</style><script>c</script>stray<text>seen</text></svg>", "seen"),
        ("<svg><defs><text>d</text></defs><defs/><symbol><text>s</text></symbol><text display=none>n</text><text>seen</text></svg>", "seen"),
        ("<svg><foreignObject><p>inside</p></foreignObject></svg><desc>after</desc>", "inside\n\nafter"),
        ("<svg><defs><path/><p>next", "next"),
        ("<svg/>one <svg><path d=''/></svg>two", "one two"),
    ],
)
def test_formulas_and_inline_diagrams(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='visibility:hidden'>a<p>b<p style='visibility:visible'>c<i>d</i></p>e</div>f", "cd\n\nf"),
        ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
        ("<details><summary>s</summary>body<p>more</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
        ("<noframes>a</noframes><noembed>b</noembed><ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
        ("<style>.h{display:none} #i, p.k { visibility : hidden }</style><b class='x h'>a</b><b id=i>b</b><b class=k>c</b><p class=k>d</p>", "c"),
        ("<style>.h{display:none}.h.s{display:inline}</style><b class=h>a</b><b class='h s'>b</b><b class=h style='display:block'>c</b>", "bc"),
        ("<style>b{display:none!important}</style><b style='display:inline'>a</b><i hidden style='display:inline'>b</i>", "b"),
        ("<style>@media print{.p{display:none}}@media screen{.q{display:none}} .r{display:none</style><b class=p>a</b><b class=q>b</b><b class=r>c</b>", "a"),
        ("<style media=print>b{display:none}</style><style>/* b{display:none} */ div b{display:none}</style><b>a</b>", "a"),
        ("<style>b{display:none}</style><b style='color:red'>a</b><style>b{display:inline}</style>", "a"),
        ("<table><tr><td>漢字<td>a<tr><td>abc<td>b</table>", "漢字  a\nabc   b"),
    ],
)
def test_visibility(page, text):
    assert visible_text(page) == text


def test_words_of_generated_trees():
    """A plain walk knows which words of a random tree are seen; the renderer shows these, in order."""
    rng, n = random.Random(12), 0
    sheet = "<style>.gone{display:none}.dim{visibility:hidden}.lit{visibility:visible}</style>"
    forms = [("", None, None), ("class=gone", "none", None), ("class=dim", None, False), ("class=lit", None, True), ("style='display:none'", "none", None)]
    forms += [("style='visibility:collapse'", None, False), ("class=dim style='visibility:visible'", None, True), ("hidden", "none", None)]

    def tree(depth, shown, visible):
        nonlocal n
        out, words = [], []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                form, display, own = rng.choice(forms)
                tag = rng.choice(["div", "span", "b", "section", "dialog", "details"])
                seen = visible if own is None else own
                inner, found = tree(depth - 1, shown and display != "none" and tag not in ("dialog", "details"), seen)
                out.append(f"<{tag} {form}>{inner}</{tag}>")
                words += found
            else:
                n += 1
                out.append(f" w{n} ")
                words += [f"w{n}"] if shown and visible else []
        return "".join(out), words

    for _ in range(400):
        page, words = tree(4, True, True)
        assert visible_text(sheet + page).split() == words, page


def test_any_markup_is_rendered():
    rng = random.Random(1)
    bits = "<p> </p> <li> <ul> </ul> <table> <tr> <td> </td> </table> <td/colspan=99999999> text &amp &#99999999; <![CDATA[x]]> <![foo <! <!-- --> <?php </ < <a/href=' > <script> </script> <head> </body> </br> <select><option>".split()
    for _ in range(3000):
        visible_text("".join(rng.choices([*bits, " ", "\x00", "é"], k=rng.randint(1, 30))))
    assert visible_text("<div>" * 20000 + "deep") == "deep"
    words = [f"w{i}" for i in range(3000)]
    assert visible_text("".join(f"<p><i>{w}" for w in words)).split() == words


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "y"), (None, "<p>a", None), (1, "<p>a", "y")], "page_id bigint, html string, text string")
    assert Counter(map(tuple, extract(df).collect())) == Counter([(1, None), (1, "a"), (None, "a"), (1, "a")])
    assert extract(df.limit(0)).count() == 0


def test_pipeline_stages(spark, nothing, tmp_path):
    good = " ".join(f"the {w} of a word{i} and some{i} more{i}" for i, w in enumerate("river stone cloud meadow garden window kitchen paper letter music".split() * 2))
    copy = good.replace("stone", "stones", 1)
    rows = [(1, f"{good}\n{LINE}"), (2, f"{good} closing words\n{LINE}"), (3, "too short"), (4, f"{PROSE}. " + " ".join(f"the x{i} is not y{i}" for i in range(60))), (5, None), (6, copy)]
    plain = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, PROSE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = plain, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"]: r for r in docs.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == plain.columns
            assert stage(spark, nothing.select(plain.columns), str(tmp_path)).count() == 0
    assert set(seen[0]) == {1, 2, 4, 6}
    assert seen[1][2]["text"] == f"{good} closing words" and seen[1][2]["n_chars"] == len(f"{good} closing words") and seen[1][1]["text"] == rows[0][1]
    assert set(seen[3]) == set(seen[2]) - {4} and set(seen[4]) == set(seen[3])
    fps = {i: plain_fingerprint(r["text"]) for i, r in seen[1].items()}
    assert set(seen[2]) == {c for _, _, c in plain_components([(i, r["text"]) for i, r in seen[1].items()])}, fps
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, seen[4].values()))


def test_stages_take_rows_as_they_come(spark, tmp_path):
    """Null ids, repeated ids and rows, odd and clashing names: each stage decides row by row."""
    prose = lambda k: " ".join(f"the {w} of a word{k}x{i} and some{i} more{k}y{i}" for i, w in enumerate("river stone cloud meadow garden window kitchen paper letter music".split() * 2))
    dirty, other = f"{PROSE}. {prose(1)}", f"{PROSE}! {prose(2)}"
    rows = [
        (None, dirty), (None, prose(3)), (None, prose(3)), (None, prose(4)),  # one contaminated row has no id
        (7, other), (7, prose(5)), (7, prose(5)), (7, prose(3)), (7, f"{prose(6)}\n{LINE}"), (8, f"{prose(8)}\n{LINE}"), (None, f"{prose(9)}\n{LINE}"),
    ]
    kinds = "doc_id bigint, text string, `my col` string, `a.b` int, row int, keys string, place string, n int, fp bigint, `select` string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "k", "p", 3, 4, "s") for r in rows], kinds).repartition(3)
    spark.createDataFrame([(1, PROSE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda out: Counter((r["doc_id"], r["text"]) for r in out.collect())

    lines = stage["line_dedup"](spark, df, str(tmp_path))
    assert lines.columns == df.columns
    # Document 7 is the first to hold the line, and a text that rows without an id hold too.
    want = lambda i, t: t if i == 7 else "" if i is None and t == prose(3) else t.replace(f"\n{LINE}", "")
    assert pairs(lines) == Counter((i, want(i, t)) for i, t in rows)
    near = stage["simhash_near_dedup"](spark, df, str(tmp_path))
    assert near.columns == df.columns
    texts = {t for _, t in rows}
    first = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in texts}
    assert pairs(near) == Counter((first[t], t) for t in texts)
    clean = stage["decontamination"](spark, df, str(tmp_path))
    assert clean.columns == df.columns
    assert pairs(clean) == Counter(r for r in rows if r[1] not in (dirty, other))
    kept = stage["quality_rules"](spark, df, str(tmp_path))
    assert kept.columns == df.columns and not pairs(kept) - Counter(rows)
    assert stage["byte_bpe"](spark, df, str(tmp_path)).count() == len(rows)


def test_links_of_more_bits(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(20)}
    for v in list(values):
        values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    df = spark.createDataFrame([(simhash._signed(v),) for v in sorted(values)], "fp bigint")
    found = simhash.links(df, 4).collect()
    want = {frozenset((simhash._signed(a), simhash._signed(b))) for a in values for b in values if 0 < (a ^ b).bit_count() <= 4}
    assert {frozenset((r["a"], r["b"])) for r in found} == want
    assert all(r["tally"] >= 4 and r["differing"] <= 4 for r in found)
    with pytest.raises(ValueError):
        simhash.links(df, 3)
