"""Periodic runs (11), token alignment (12) and language mixtures (13) against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ROWS, frame
from pyspark.sql import functions as F

from barloom.llm import align, languages, queries, runs

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """All maximal stretches of each period, the smallest period of each stretch."""
    words, found = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int), {}
    for q in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (words[q:] == words[:-q]).astype(int), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    kind, k, size = rng.random(), rng.choice([1, 2, 3, 40]), rng.randint(0, 90)
    if kind < 0.4:
        return [rng.randrange(k) for _ in range(size)]
    if kind < 0.7:
        base = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
        ends = [[rng.randrange(k) for _ in range(rng.randint(0, 20))] for _ in range(2)]
        return [*ends[0], *(base[i % len(base)] for i in range(size)), *ends[1]]
    x, y = rng.choice([([0], [0, 1]), ([0, 0, 1], [0, 0, 0, 1])])  # words whose factors recur at many distances
    for _ in range(rng.randint(1, 6)):
        x, y = y, y * rng.choice([1, 1, 2, 3]) + x
    at = rng.randrange(len(y))
    return (y * 4)[at : at + rng.randint(2 * len(y) - 2, 3 * len(y))][:160]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        words, least = random_words(rng), rng.choice([2, 4, 12])
        assert [tuple(r) for r in runs.runs_in(np.array(words, np.int64), least).tolist()] == plain_runs(words, least), (words, least)


def test_long_periodic_texts_stay_near_linear():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 100_003):
        assert len(runs.runs_in(words)) == 1


def planted(doc, words):
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_op11(doc, text):
    words = planted(doc, WORD.findall(text or ""))
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return {
        "doc_id": doc,
        "n_runs": len(found),
        "start": s,
        "length": n,
        "period": q,
        "exponent_milli": None if n is None else 1000 * n // q,
        "runs_sha256": SHA("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        "collapsed_sha256": SHA(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def counted(rows):
    return Counter(tuple(sorted(r.items())) for r in rows)


def test_op11_on_tables(spark, nothing, tmp_path):
    rng = random.Random(6)
    rows = [r for r in ROWS if len(r[1] or "") < 100_000]
    rows += [(i, " \n".join(f"w{x}" for x in random_words(rng))) for i in range(100, 400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert counted(got) == counted(plain_op11(*r) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) > 10
    assert runs.find_runs(nothing).count() == 0


def test_runs_of_a_table_with_odd_names(spark):
    df = spark.createDataFrame([("k", "a b " * 8, 1), (None, None, 2), ("k", "a b " * 8, 3)], "`my id` string, `a text` string, runs int")
    got = [(r["my id"], r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"])) for r in runs.find_runs(df, "my id", "a text").collect()]
    assert sorted(got, key=str) == sorted([("k", 16, [(0, 16, 2)], b"a b"), ("k", 16, [(0, 16, 2)], b"a b"), (None, 0, [], b"")], key=str)


PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@pytest.fixture(scope="module")
def ours():
    with open(PATHS[0]) as a, open(PATHS[1], "rb") as b:
        return align.Tokenizers(a.read(), b.read())


def plain_groups(text, library, ours):
    """Whole-text alignment: the ids of each group."""
    whole = f" {text}"
    a, b = library[0].encode(whole, add_special_tokens=False).ids, library[1].encode(text)
    sides = []
    for ids, of in ((a, ours.a_bytes), (b, ours.b_bytes)):
        if not text or b"".join(of.get(i, b"") for i in ids) != whole.encode():
            return []
        sides.append((ids, list(accumulate(len(of[i]) for i in ids))))
    cuts = [0, *sorted(set(sides[0][1]) & set(sides[1][1]))]
    part = lambda side, low, high: side[0][bisect(side[1], low) : bisect(side[1], high)]
    return [(part(sides[0], x, y), part(sides[1], x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]


def plain_op12(rows, library, ours):
    made = [(doc, plain_groups(t or "", library, ours)) for doc, t in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in made for a, b in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    for doc, groups in made:
        links = [counts[a[-1], b[-1]] for a, b in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield {
            "doc_id": doc,
            "n_a": sum(len(a) for a, _ in groups),
            "n_b": sum(len(b) for _, b in groups),
            "n_groups": len(groups),
            "n_links": len(groups),
            "n_best": sum(n == best[b[-1]] for n, (_, b) in zip(links, groups, strict=True)),
            "count_sum": sum(links),
            "groups_sha256": SHA(text) if groups else "",
        }


def odd_texts():
    rng = random.Random(3)
    pool = [chr(i) for i in range(0x250)] + list("  \n\t\r\x1c\x85 　▁\U0001f44d漢字'sLL'll12")
    pool += ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", ";\r", "\r\n", "  ", "    ", " the", " and"]
    return ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(1500)]


def test_alignment_equals_the_libraries(spark, nothing, library, ours, tmp_path):
    texts = odd_texts()
    rows = [*ROWS, *enumerate(texts, 1000), *((5000 + i, texts[i % 7]) for i in range(300)), (None, texts[0]), (77, "x" * 3000), (78, "▁ text")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op12_token_alignment(spark, str(tmp_path)).collect()]
    want = list(plain_op12(rows, library, ours))
    assert counted(got) == counted(want)
    assert sum(r["n_a"] == 0 for r in want) > 20 and sum(r["n_a"] > 0 for r in want) > 1200
    assert align.align(nothing, *PATHS).count() == 0


def test_linkable_pairs_are_those_of_suffixes(ours):
    pairs = align.Pairs(ours.a_bytes, ours.b_bytes)
    assert len(pairs) <= sum(map(len, ours.a_bytes.values())) + sum(map(len, ours.b_bytes.values()))
    a, b = pairs.ids()
    for i in random.Random(1).sample(range(len(pairs)), 2000):
        x, y = ours.a_bytes[a[i]], ours.b_bytes[b[i]]
        assert x.endswith(y) or y.endswith(x)
    assert pairs.numbers(a[:50], b[:50]).tolist() == list(range(50))


def plain_shares(model, words, penalty=languages.PENALTY):
    """Every set of languages, each fitted by a long EM; the best by its penalised likelihood."""
    from itertools import combinations

    rows = model.likelihoods(words)
    cost, best = penalty * math.log1p(len(words)), None
    for size in range(1, len(model.names) + 1):
        for chosen in combinations(range(len(model.names)), size):
            share = np.full(size, 1 / size)
            for _ in range(3000):
                r = rows[:, chosen] * share
                share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            value = np.log(rows[:, chosen] @ share).sum() - size * cost
            if best is None or value > best[0] + 1e-9:
                best = value, dict(zip(chosen, share.tolist(), strict=True))
    return best[1]


STEMS = {"aa": "lumi kesä talo vesi", "bb": "strom bruck wald stein", "cc": "fleur rivière chemin"}


def language_rows(seed, n, ids):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(sorted(STEMS))
        yield ids + i, " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "n", "e"]) for _ in range(rng.randint(3, 60))), lang


def words_in(rng, parts):
    made = [rng.choice(STEMS[x].split()) + rng.choice(["", "n", "e"]) for x, n in parts for _ in range(n)]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [*language_rows(1, 400, 0), (9001, "strom wald", None), (None, "lumi lumi lumi", "bb"), (9002, None, "aa"), (9003, "123 !?", "cc")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)


@pytest.fixture(scope="module")
def model(labelled):
    return languages.train(labelled.where(languages.of_training()))


def test_model_counts_every_learned_row(labelled, model):
    want = Counter()
    for r in labelled.collect():
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and r["text"]:
            for w in languages.words_of(r["text"]):
                want.update((r["lang"], b) for b in languages.buckets_of(w))
    got = {(r["lang"], r["bucket"]): r["n"] for r in languages.gram_counts(labelled.where(languages.of_training())).collect()}
    assert got == want
    totals = np.exp(model.log_p).sum(axis=0)
    assert model.names == ["aa", "bb", "cc"] and np.allclose(totals, 1)


def test_shares_equal_a_search_over_all_sets(model):
    rng = random.Random(2)
    texts = [words_in(rng, [(x, rng.randint(1, 150)) for x in rng.sample(sorted(STEMS), rng.randint(1, 3))]) for _ in range(60)]
    found = languages.Guesser(model, languages.PENALTY).shares(texts)
    for words, own in zip(texts, found, strict=True):
        want = plain_shares(model, words)
        assert set(np.flatnonzero(own).tolist()) == set(want)
        assert all(abs(own[i] - s) < 0.02 for i, s in want.items()) and abs(own.sum() - 1) < 1e-6
    one_by_one = np.concatenate([languages.Guesser(model, languages.PENALTY).shares([t]) for t in texts])
    assert np.allclose(found, one_by_one, atol=1e-12)  # what else is in the batch makes no difference


def test_predictions_of_a_table(spark, labelled, model, nothing, docs):
    held = labelled.where(~languages.of_training())
    joined = languages.predict(held, model).join(held, "doc_id").where("lang is not null and doc_id < 9000").collect()
    assert len(joined) > 80 and sum(r["lang_pred"] == r["lang"] for r in joined) >= 0.97 * len(joined)
    out = languages.predict(docs, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] in model.names or r["lang_pred"] == "und" and not r["languages"]) for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} >= {1, 2, 3}
    assert languages.predict(nothing, model).count() == 0
    empty = languages.train(nothing)
    assert empty.names == [] and {(r["lang_pred"], r["score"]) for r in languages.predict(docs, empty).collect()} == {("und", 0.0)}


def test_op13_reads_no_label_of_held_out_rows(spark, labelled, tmp_path):
    labelled.write.parquet(f"{tmp_path}/a/documents.parquet")
    changed = F.when(languages.of_training(), F.col("lang")).otherwise(F.lit("zz"))
    labelled.withColumn("lang", changed).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (Counter(map(tuple, queries.op13_language_mixture(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 3 == 1) for i, h, *_ in a)
