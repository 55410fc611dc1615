from __future__ import annotations

import datetime as dt
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.functions import ranks
from barloom.operators import crosssection as x
from barloom.operators import joins as j
from barloom.operators import metrics as m
from barloom.operators import ranking as r
from barloom.operators import serving as s
from barloom.operators import text as t
from barloom.sources import sinks


@pytest.fixture(scope="module")
def star_root(spark, tmp_path_factory):
    """Three symbols over twelve business days, published."""
    rows, day = [], dt.date(2026, 1, 5)
    for d in range(12):
        for i, code in enumerate(("000001", "600519", "688001")):
            close = 10 + 5 * i + 0.1 * d * (1 if i else -1)
            rows.append((code, day, close, close + 0.2, close - 0.2, close, 100.0 + d, close * 100))
        day += dt.timedelta(days=3 if day.weekday() == 4 else 1)
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")
    catalog = spark.createDataFrame(
        [(c, f"n{c}", "SSE", b, ind, None, 1, "demo") for c, b, ind in (("000001", "A", "bank"), ("600519", "B", "food"), ("688001", "C", "bank"), ("300001", "D", "tech"))],
        "code string, name string, market string, board string, industry_l1 string, list_date date, is_demo int, source string",
    )
    root = str(tmp_path_factory.mktemp("star"))
    facts = s.fact_panel(bars, None, "v1")
    sinks.by_key(facts).write.parquet(f"{root}/staged")
    stored = spark.read.parquet(f"{root}/staged")
    tables = {"fact_stock_daily_demo": stored, **s.aggregates(stored, catalog, "v1", "demo")}
    sinks.publish(spark, tables, root, "v1", {"fact_stock_daily_demo": stored.count()})
    return root, tables


@pytest.fixture(scope="module")
def star(spark, star_root):
    return sinks.open_published(spark, star_root[0])


def test_star_sizes(star):
    # The first two days of a symbol have no volatility yet and are warm-up.
    assert set(star) == set(sinks.STAR_TABLES)
    assert star["fact_stock_daily_demo"].count() == 30
    assert star["fact_market_daily"].count() == 10
    assert s.stock_catalog(star).count() == 4
    assert s.stock_catalog(star, has_detail=True).count() == 3
    assert s.stock_history(star, "600519", limit=5).count() == 5


def test_failed_publication_changes_nothing(spark, star_root):
    root, tables = star_root
    with pytest.raises(RuntimeError):
        sinks.publish(spark, tables, root, "v2", {"fact_stock_daily_demo": 1})
    assert sinks.open_published(spark, root)["pipeline_run"].first()["data_version"] == "v1"
    assert sinks.published(spark, root).count() == 1


def test_second_of_two_builds_on_one_base_is_refused(spark, star_root, tmp_path):
    tables, root = star_root[1], str(tmp_path)
    one, two = (sinks.Publication(spark, root, v) for v in ("a", "b"))
    for build in (one, two):
        for name in sinks.STAR_TABLES:
            build.write(name, tables[name])
    one.commit()
    with pytest.raises(RuntimeError, match="first"):
        two.commit()
    assert [(r_["number"], r_["version"], r_["replaces"]) for r_ in sinks.published(spark, root).collect()] == [(1, "a", None)]
    opened = sinks.open_published(spark, root)
    sinks.publish(spark, tables, root, "c", {})
    assert opened["dim_stock"].count() == 4  # a reader of the version before goes on
    assert {r_["table_name"]: r_["row_count"] for r_ in sinks.manifest(spark, root).collect()} == {n: t.count() for n, t in tables.items()}
    log = {r_["version"]: r_ for r_ in sinks.published(spark, root).collect()}
    assert log["c"]["replaces"] == 1 and all(x["digest"] for x in log["c"]["tables"])
    gone = sinks.vacuum(spark, root, keep=1)
    assert len(gone) == 2 and not any(log["c"]["folder"].endswith(g.rpartition("/")[2]) for g in gone)
    assert sinks.open_published(spark, root)["dim_stock"].count() == 4
    missing = sinks.Publication(spark, root, "d")
    missing.write("dim_stock", tables["dim_stock"])
    with pytest.raises(ValueError, match="missing"):
        missing.commit()


def test_serving_panel_is_switched_after_its_check(spark, tmp_path):
    rows = [("000001", dt.date(2024, 1, i + 1), 1.0 * i + 1, 2.0) for i in range(4)]
    panel = spark.createDataFrame(rows, "code string, date date, close double, volume double")
    need = ["code", "date", "close"]
    sinks.rebuild_serving(spark, panel, str(tmp_path), ["volume"], need)
    before = sinks.open_serving(spark, str(tmp_path))
    with pytest.raises(ValueError):
        sinks.rebuild_serving(spark, panel, str(tmp_path), ["volume"], ["open"])
    assert sinks.open_serving(spark, str(tmp_path)).count() == 4
    sinks.rebuild_serving(spark, panel.limit(2), str(tmp_path), ["volume"], need)
    assert sinks.open_serving(spark, str(tmp_path)).count() == 2 and before.count() == 4


def test_reads_scan_published_tables_only(spark):
    from barloom.plans import serving_queries as sq

    smoke = "/root/testdata/sf0.001"
    sq.star(spark, smoke)
    for build in (sq.q_manifest, sq.q_market_summary, sq.q_industry_trend, sq.q_quality_issues, sq.q_factor_catalog):
        plan = build(spark, smoke)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "Window" not in plan and "/star-" in plan


def test_reads(star):
    manifest = s.manifest(star).first()
    assert manifest["asset_catalog_stock_count"] == 4 and manifest["public_detail_record_count"] == 30
    summary = s.asset_summary(star).first()
    assert (summary["detail_stock_count"], summary["record_count"], summary["trading_day_count"]) == (3, 30, 10)
    assert s.market_snapshot(star, limit=2).count() == 2
    assert s.market_snapshot(star, limit=2, offset=2).count() == 1
    assert {row["code"] for row in s.peer_history(star, "bank").collect()} == {"000001", "688001"}
    assert s.latest_quotes(star, ["1", "600519"]).count() == 2
    assert s.quality_issues(star).where("rule_name = 'duplicate_primary_key'").first()["issue_count"] == 0
    assert s.latest_quotes(star, [str(i) for i in range(600500, 600620)]).count() == 1
    assert s.stock_history(star, "600519").count() == 10
    with pytest.raises(ValueError):
        s.stock_history(star, "x' OR 1=1 --")


def scanned(df):
    """Rows that the scan of the facts hands on: row groups and pages whose statistics rule them out are not in."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    seen, todo = 0, [plan]
    while todo:
        node = todo.pop()
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            seen += node.metrics().get("numOutputRows").get().value()
    return seen


def test_one_date_and_one_symbol_are_small_parts_of_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    days, codes = 256, 400
    panel = spark.range(days * codes).select(
        F.lpad(((F.col("id") % codes) * 37 % 1000).cast("string"), 6, "0").alias("code"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / codes).cast("int")).alias("date"),
        *[F.rand(i).alias(c) for i, c in enumerate(("close", "pct_chg", "change"))],
    )
    path = str(tmp_path / "facts-by-both")
    sinks.by_date_and_code(panel, panel.select("code", "date"), 2000).write.parquet(path)
    facts = spark.read.parquet(path)
    assert facts.count() == panel.count() and facts.columns == panel.columns
    run = spark.createDataFrame([("SUCCESS", 1, dt.date(2024, 1, 1) + dt.timedelta(days=days - 1))], "status string, finished_at int, data_end_date date")
    both = {"fact_stock_daily_demo": facts, "pipeline_run": run}
    last, one = s.latest_quotes(both, ["37"]), s.stock_history(both, "37")
    assert (last.count(), one.count()) == (1, days)
    everything = days * codes
    for read, passes in ((last, 2), (one, 2), (j.join_latest(facts), 1)):  # sorted reads scan twice: range bounds, then rows
        assert 0 < scanned(read) <= passes * everything // 7
    # Files whose statistics take in the date or the code.
    spans = []
    for file in sorted((tmp_path / "facts-by-both").glob("*.parquet")):
        groups = pq.ParquetFile(file).metadata
        at = {groups.schema.column(i).name: i for i in range(len(groups.schema))}
        stats = [[groups.row_group(g).column(at[c]).statistics for g in range(groups.num_row_groups)] for c in ("code", "date")]
        spans.append([(min(x_.min for x_ in each), max(x_.max for x_ in each)) for each in stats])
    assert len(spans) == 64
    assert sum(a <= "000037" <= b for (a, b), _ in spans) == 8
    assert sum(a <= dt.date(2024, 6, 1) <= b for _, (a, b) in spans) == 8


def test_clustered_files_take_rows_as_they_come(spark, tmp_path):
    rows = [(None, None), ("000001", None), (None, dt.date(2024, 1, 1)), ("x" * 40, dt.date(2024, 1, 1)), ("000001", dt.date(1969, 1, 1))] * 3
    panel = spark.createDataFrame(rows, "code string, date date")
    sinks.by_date_and_code(panel).write.parquet(f"{tmp_path}/odd")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/odd").collect())) == sorted(map(str, panel.collect()))
    assert sinks.by_date_and_code(panel.limit(0)).count() == 0


def test_complete_universe_passes_its_check(spark):
    rows = [(c, dt.date(2024, 1, d), float(d)) for c in ("a", "b") for d in (1, 2, 3) if (c, d) != ("b", 2)] + [("c", dt.date(2024, 1, d), d - 2.0) for d in (1, 2, 3)]
    market = spark.createDataFrame(rows, "code string, date date, open double")
    with pytest.raises(ValueError, match="complete"):
        x.equal_weight_curve(market)
    whole = x.quoted_on_all_days(market)
    assert {r_["code"] for r_ in whole.collect()} == {"a"}
    assert [r_["curve"] for r_ in x.equal_weight_curve(whole).orderBy("date").collect()] == pytest.approx([1.0, 2.0, 3.0])


def test_filters_reach_the_scan(star):
    plan = s.stock_history(star, "600519", "2026-01-08")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,600519)" in plan and "GreaterThanOrEqual(date,2026-01-08)" in plan
    narrow = s.bench_latest(star, "600519")._jdf.queryExecution().executedPlan().toString()
    assert "momentum_60d" not in narrow


def test_market_identities(star):
    market = star["fact_market_daily"]
    assert market.where("advancing_count + declining_count + flat_count <> stock_count").count() == 0
    by_industry = star["fact_industry_daily"].groupBy("date").agg(F.sum("stock_count").alias("n"))
    assert by_industry.join(market, "date").where("n <> stock_count").count() == 0


def test_constant_factor_has_no_ic(star):
    ic = star["fact_factor_ic_daily"]
    assert ic.where("factor_name = 'sentiment' AND ic IS NOT NULL").count() == 0
    assert x.factor_availability(ic, ["sentiment", "rsi", "none"]).count() >= 2


def test_ic_of_a_perfect_order(spark):
    rows = [(dt.date(2024, 1, 1), f"{i:06d}", float(i), i / 10, -float(i)) for i in range(6)]
    rows += [(dt.date(2024, 1, 2), f"{i:06d}", float(i), i / 10, 1.0) for i in range(2)]
    panel = spark.createDataFrame(rows, "date date, code string, rsi double, label double, macd double")
    got = {(r_["factor_name"], r_["date"].day): r_ for r_ in x.factor_ic(panel, ["rsi", "macd"]).collect()}
    assert got["rsi", 1]["ic"] == pytest.approx(1.0) and got["macd", 1]["ic"] == pytest.approx(-1.0)
    assert got["rsi", 2]["ic"] is None and got["rsi", 2]["sample_count"] == 2


def test_ic_sends_one_row_per_symbol_over_the_exchange(star):
    plan = x.factor_ic(star["fact_stock_daily_demo"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_symbol_metrics(spark):
    rows = [("000001", dt.date(2024, 1, i + 1), c, ret, a) for i, (c, ret, a) in enumerate([(50.0, 0.0, 4.0), (40.0, -0.2, 8.0), (60.0, 0.5, 6.0)])]
    rows += [("000002", dt.date(2024, 1, i + 1), c, None, 1.0) for i, c in enumerate((10.0, 10.0, 15.0))]
    rows += [("000003", dt.date(2024, 1, 1), 5.0, None, 1.0)]
    panel = spark.createDataFrame(rows, "code string, date date, close double, ret double, amount double")
    one = m.stock_metrics(panel).where("code = '000001'").first()
    assert one["period_return"] == pytest.approx(0.2) and one["max_drawdown"] == pytest.approx(-0.2)
    assert one["average_turnover"] == 6 and one["annualized_volatility"] == pytest.approx(math.sqrt(0.13 * 252))
    dim = spark.createDataFrame([(c, c, "bank") for c in ("000001", "000002", "000003")], "code string, name string, industry_l1 string")
    peers = {p["code"]: p for p in m.peer_percentiles(panel, dim).collect()}
    assert peers["000002"]["return_percentile"] == 1.0 and "000003" not in peers


def test_industry_metrics(spark):
    rows = [("bank", dt.date(2024, 1, i + 1), 64, 0.02, 0.5, 80.0 if i < 5 else 100.0) for i in range(10)]
    df = spark.createDataFrame(rows, "industry_l1 string, date date, stock_count long, average_return double, advancing_ratio double, total_amount double")
    got = m.industry_metrics(df).first()
    assert got["return_5d"] == pytest.approx(1.02**5 - 1) and got["amount_change_5d"] == pytest.approx(0.25)
    assert got["stock_count"] == 64
    assert m.industry_metrics(df.where("date > '2024-01-01'")).first()["amount_change_5d"] is None


def test_stratified_sample_is_exact_and_covers(spark):
    rows = [(f"{i:06d}", f"ind{i % 31}", f"b{(i * 7) % 4}") for i in range(5200)]
    catalog = spark.createDataFrame(rows, "code string, industry_l1 string, board string")
    one, two = (r.stratified_sample(catalog, 300, 7).select("code", "industry_l1", "board").collect() for _ in range(2))
    assert len(one) == 300 == len({p["code"] for p in one}) and sorted(one) == sorted(two)
    assert {(p["industry_l1"], p["board"]) for p in one} == {(b, c) for _, b, c in rows}


@pytest.mark.parametrize("limit", [2, 7, 50, 279, 280, 500])
def test_even_downsample(bars, limit):
    n = bars.count()
    got = sorted(p["row_index"] for p in r.even_downsample(bars, limit).collect())
    step = (n - 1) / (limit - 1)
    want = list(range(n)) if n <= limit else sorted({n - 1 if j == limit - 1 else int(j * step) for j in range(limit)})
    assert got == want


def test_lexicon(spark):
    texts = ["大涨 利好", "下跌 风险", "涨 跌", "nothing", None, "X" * 20000 + "牛"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, text string")
    got = [p["sentiment"] for p in t.lexicon_sentiment(df).orderBy("i").collect()]
    assert got == [1.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([("GOOD bad good",), ("Bad",)], "text string")
    assert [p["sentiment"] for p in t.lexicon_sentiment(df, "text", ["good"], ["bad"]).collect()] == [0.0, -1.0]


def test_comment_sentiment_takes_first_usable(spark):
    rows = [("000001", "2024-01-02", "0.5", 2), ("000001", "2024-01-02", "text", 1), ("000001", "2024-01-03", None, 1), ("000001", "bad", "1", 1)]
    df = spark.createDataFrame(rows, "code string, date string, sentiment string, seq int")
    got = {p["date"].day: p["sentiment"] for p in t.comment_sentiment(df, ["seq"], "src").collect()}
    assert got == {2: 0.5, 3: 0.0}


def test_histogram_covers_all_rows(bars):
    day = bars.where(F.col("date") == bars.agg(F.min("date")).scalar())
    assert x.histogram(bars, "close").agg(F.sum("n")).first()[0] == bars.count()
    assert x.histogram(day, "volume", 30).count() == 1


def test_heatmap_has_one_column_per_date(star):
    wide = x.industry_heatmap(star["fact_industry_daily"], 3)
    assert len(wide.columns) == 4 and wide.count() == 2


# ---- groups of any size -------------------------------------------------------------------------


def _by_hand(rows, value):
    """Average rank, position by code and median per group, from plain lists."""
    out, groups = {}, {}
    for g, code, v in rows:
        groups.setdefault(g, []).append((v, code))
    for g, own in groups.items():
        valued = sorted((v, c) for v, c in own if v is not None)
        values = [v for v, _ in valued]
        for i, (v, c) in enumerate(valued):
            first, n = values.index(v), values.count(v)
            out[g, c] = ((first + (n + 1) / 2) / len(values), (i + 1) / len(values))
        out[g] = statistics.median(values) if values else None
    return out


@pytest.mark.parametrize("group_rows", [4, 100_000])
def test_ranks_and_medians_are_the_same_in_buckets(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ranks, "CUTS", 7)
    rng = random.Random(3)
    rows = [(g, f"{i:06d}", rng.choice([None, 0.5, 0.5, rng.random(), -rng.random()])) for g, n in (("a", 300), ("b", 41), ("c", 2), ("d", 1)) for i in range(n)]
    rows += [("e", f"{i:06d}", None) for i in range(3)]
    want = _by_hand(rows, "v")
    df = spark.createDataFrame(rows, "g string, code string, v double").repartition(5)
    both = ranks.with_pct_position(ranks.with_pct_rank(df, ["g"], "v", "average", group_rows=group_rows), ["g"], "v", "code", "first", group_rows)
    got = {(q["g"], q["code"]): (q["average"], q["first"]) for q in both.collect()}
    assert len(got) == len(rows)
    assert all(got[g, c] == pytest.approx(want[g, c]) if v is not None else got[g, c] == (None, None) for g, c, v in rows)
    down = {(q["g"], q["code"]): q["d"] for q in ranks.with_pct_rank(df, ["g"], "v", "d", True, group_rows).where("v is not null").collect()}
    sizes = {g: sum(v is not None for h, _, v in rows if h == g) for g in "abcd"}
    assert all(d == pytest.approx(1 + 1 / sizes[g] - want[g, c][0]) for (g, c), d in down.items())
    medians = {q["g"]: q["m"] for q in ranks.group_median(df, ["g"], "v", "m", group_rows).collect()}
    assert medians == {g: pytest.approx(want[g]) for g in "abcd"}
    one = ranks.running_totals(df.where("v is not null").withColumn("n", F.lit(1)), [], ["v", "g", "code"], ["n"], group_rows)
    places = sorted((q["v"], q["g"], q["code"], q["below_n"], q["all_n"]) for q in one.collect())
    assert [q[3] for q in places] == list(range(len(places))) and {q[4] for q in places} == {len(places)}


def test_ic_of_a_date_with_very_many_symbols(spark):
    """300,000 symbols on one date, half of them tied: no window or exchange by the date alone."""
    n = 300_000
    label = (F.xxhash64("id") % 1000003) / 1e6
    tied = F.when(F.col("id") % 2 == 0, 0.25).otherwise(label + (F.xxhash64(F.col("id") + 1) % 1000003) / 2e6)
    day = F.when(F.col("id") < n, F.lit("2024-01-02")).otherwise(F.lit("2024-01-03")).cast("date")
    code = F.format_string("%06d", "id")
    panel = spark.range(n + 50).select(day.alias("date"), code.alias("code"), label.alias("label"), tied.alias("rsi"), F.when(F.col("id") % 3 > 0, -label).alias("macd"))
    df = x.factor_ic(panel, ["rsi", "macd"])
    got = {(q["factor_name"], q["date"].day): q for q in df.collect()}
    flat = panel.toPandas()
    for (factor, d), q in got.items():
        own = flat[[v.day == d for v in flat["date"]]].dropna(subset=[factor, "label"])
        assert q["sample_count"] == len(own) and q["ic"] == pytest.approx(own[factor].rank().corr(own["label"].rank()))
    assert len(got) == 4 and got["macd", 2]["ic"] == pytest.approx(-1.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(date#\d+L?, \d+\)", plan)
    assert not re.search(r"Window \[[^\n]*\], \[date#\d+\]", plan)


def test_stale_counts_equal_the_marks_laid_out(spark):
    days = [dt.date(2024, 1, i) for i in (1, 2, 3, 4, 5)]
    opens = [("a", 0, 1.0), ("a", 2, 0.0), ("a", 4, 2.0), ("b", 1, 1.0), ("b", 2, None), ("b", 3, 3.0), ("c", 3, 5.0), ("d", 0, 9.0)]
    market = spark.createDataFrame([(c, days[i], o) for c, i, o in opens], "code string, date date, open double")
    held = spark.createDataFrame([("a", days[0]), ("b", days[2]), ("c", days[3]), ("e", days[1])], "code string, since date")
    marks = j.last_valid_mark(held, market).groupBy("date").agg(F.count("*").alias("held"), F.count_if("stale").alias("stale_price_positions"))
    assert sorted(map(tuple, j.stale_counts(held, market).collect())) == sorted(map(tuple, marks.collect()))


def test_class_of_a_mean_on_the_bound(spark):
    rows = [("a", v) for v in (-0.3, 0.1, -0.1)] + [("b", v) for v in (-0.1, -0.3, 0.1)] + [("c", -0.2)]
    got = {r_["code"]: r_["status"] for r_ in x.sentiment_stats(spark.createDataFrame(rows, "code string, sentiment double")).collect()}
    assert got == {"a": "neutral", "b": "neutral", "c": "negative"}


def test_ic_of_a_date_equals_the_one_by_distinct_value(spark):
    """Ties, missing values, constant and infinite ones, a missing date: rows ranked at their date, not unfolded."""
    rng = random.Random(11)
    some = [None, 0.0, -0.0, 0.5, 0.5, float("inf"), float("nan")]
    days = [None, *(dt.date(2024, 1, d) for d in range(1, 9))]
    rows = [(d, f"{i:06d}", rng.choice([None, rng.random(), 0.25]), rng.choice(some), rng.random(), 1.0) for d in days for i in range(rng.choice([2, 30]))]
    panel = spark.createDataFrame(rows, "date date, code string, label double, rsi double, macd double, ret_5d double").repartition(4)
    near, far = (x.factor_ic(panel, ["rsi", "macd", "ret_5d"], n) for n in (100_000, 1))
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r_["factor_name"], r_["date"]): r_ for r_ in df.collect()} for df in (near, far))
    assert len(got) == 27 and set(got) >= {k for k in want if k[1] is not None}
    for key, row in got.items():
        if key[1] is not None:
            assert row["sample_count"] == want[key]["sample_count"]
            assert row["ic"] == (want[key]["ic"] if want[key]["ic"] is None else pytest.approx(want[key]["ic"], abs=1e-12))


def test_a_star_stores_its_bars_once_and_copies_no_stored_facts(spark, monkeypatch, tmp_path):
    from barloom import session
    from barloom.operators import crosssection, serving
    from barloom.plans import serving_queries as sq

    made = []
    note = lambda df, name: (made.append(name), session.materialise(df, name))[1]
    for module in (crosssection, serving, sq):
        monkeypatch.setattr(module, "materialise", note)
    monkeypatch.setattr(sq, "shared_dir", lambda spark: str(tmp_path))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    root = sq.star_root(spark, "/root/testdata/sf0.001")
    assert made == ["bars", "market", "report"]  # the market and the report feed several tables
    assert spark.conf.get(key) == before and sinks.manifest(spark, root).count() == 8


def test_panel_in_ranges_of_codes_is_written_where_it_lies(spark, tmp_path):
    import gzip

    from barloom.plans.panels import long_panel, ranged_panel

    smoke = "/root/testdata/sf0.001"
    panel = ranged_panel(spark, smoke)
    plan = panel.sortWithinPartitions("code", "date")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(code") == 1 and plan.count("Exchange ") == 2  # the other makes the bars
    path = str(tmp_path / "panel")
    sinks.write_panel(panel, path, ["csv"], laid_out=True)
    spans = []
    for file in (tmp_path / "panel.csv").glob("*.csv.gz"):
        codes = [line.split(",")[0] for line in gzip.open(file, "rt").read().splitlines()[1:]]
        assert codes == sorted(codes)
        spans.append((codes[0], codes[-1])) if codes else None
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    from barloom.sources import readers

    assert readers.scan_panel(spark, path).count() == long_panel(spark, smoke).count()


def test_larger_inputs_get_more_tasks(spark, monkeypatch):
    from barloom.plans import panels

    monkeypatch.setattr(panels, "BYTES_PER_TASK", 1000)
    plan = panels.long_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = panels.panel_tasks(spark, "/root/testdata/sf0.001")
    assert n > 8 and re.search(rf"hashpartitioning\(code#\d+, {n}\), REPARTITION_BY_NUM", plan)


def test_a_star_sends_its_bars_and_no_panel(spark, tmp_path):
    """Facts lie in ranges of codes where they are worked out; the bars that were stored for them go."""
    import pyarrow.parquet as pq

    from barloom.session import discard, materialise

    days, codes = 256, 100
    price = F.lit(50.0) + F.rand(1)
    bars = spark.range(days * codes).select(
        F.lpad((F.col("id") % codes * 37 % 1000).cast("string"), 6, "0").alias("code"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / codes).cast("int")).alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close", "volume", "amount")],
    )
    bars = materialise(bars, "own-bars")
    ranges, cuts = sinks.code_ranges(bars, 3200)
    facts = sinks.in_stretches(s.fact_panel(ranges, None, "v1"), cuts)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(code" in plan
    path = str(tmp_path / "facts")
    facts.write.options(**{**sinks.STRETCH_PAGES, "parquet.page.row.count.limit": 100}).parquet(path)
    stored = spark.read.parquet(path)
    assert sorted(map(tuple, stored.select("code", "date", "rsi").collect())) == sorted(map(tuple, s.fact_panel(bars, None, "v1").select("code", "date", "rsi").collect()))
    spans = []
    for file in (tmp_path / "facts").glob("*.parquet"):
        own = pq.read_table(file, columns=["code"])["code"].to_pylist()
        spans.append((min(own), max(own)))
    assert len(spans) >= 6 and all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    everything = stored.count()
    assert 0 < scanned(j.join_latest(stored)) < everything + everything // 4  # all dates for the last one, then its pages
    assert 0 < scanned(stored.where("code = '000037'")) <= everything // 6
    discard(bars)
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        bars.collect()


def test_a_published_ic_comes_in_parts(star, star_root, spark, tmp_path):
    facts, catalog = star["fact_stock_daily_demo"], star["dim_stock"].drop("has_detail")
    whole, parts = (s.aggregates(facts, catalog, "v1", "demo", ic_at_once=n)["fact_factor_ic_daily"] for n in (None, s.IC_AT_ONCE))
    build = sinks.Publication(spark, str(tmp_path), "v1")
    stored = build.write("fact_factor_ic_daily", parts)
    assert len(parts) == 3 and build.given["fact_factor_ic_daily"] == stored.count() == whole.count()
    assert sorted(map(str, stored.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_a_star_stores_no_column_that_follows_from_its_row(spark, bars, tmp_path):
    """Bands, differences and ratios of stored columns are worked out on reading; they took a third of the facts' disk."""
    catalog = spark.createDataFrame(
        [(c, "n" + c, "SSE", "main", "bank", None, 0, "test") for c in ("000001", "600519")],
        "code string, name string, market string, board string, industry_l1 string, list_date date, is_demo int, source string",
    )
    gaps = bars.withColumns({"close": F.when(F.dayofmonth("date") != 9, F.col("close")), "open": F.when(F.dayofmonth("date") != 17, F.col("open"))})
    opened = s.publish_star(spark, str(tmp_path), "v", gaps, catalog, "v1", "demo")["fact_stock_daily_demo"]
    whole = s.fact_panel(gaps, None, "v1")
    assert opened.columns == whole.columns and sorted(map(str, opened.collect())) == sorted(map(str, whole.collect()))
    stored = spark.read.parquet(*{f.rpartition("/")[0] for f in opened.inputFiles()}).columns
    assert len(stored) == len(whole.columns) - 15 and not {"ret", "bb_upper", "bb_mid", "pct_chg", "macd_hist"} & set(stored)
    log = {r_["table_name"]: r_ for r_ in sinks.manifest(spark, str(tmp_path)).collect()}["fact_stock_daily_demo"]
    assert log["digest"] == str(sinks.table_fingerprint(whole).first()["hash_sum"])
    scan = opened.select("code", "ret")._jdf.queryExecution().executedPlan().toString()
    assert "pre_close" in scan and "ma20" not in scan


def test_a_large_star_is_sent_in_parts(spark, tmp_path):
    """Parts of the codes for the facts, of the dates for the IC, with missing codes; tables are those of one part."""
    from barloom.session import materialise

    days, codes = 64, 100
    code = F.lpad((F.col("id") % codes * 37 % 1000).cast("string"), 6, "0")
    raw = spark.range(days * codes).select(
        F.when(F.col("id") % codes != 5, code).alias("code"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / codes).cast("int")).alias("date"),
        *[(F.lit(50.0) + F.rand(i)).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume", "amount"))],
    )
    stored = materialise(raw, "large-bars")
    parts = sinks.code_parts(stored, days * codes // 4)
    sizes = [p.count() for p in parts]
    assert len(parts) == 4 and sum(sizes) == days * codes and max(sizes) < days * codes // 3
    assert not set.intersection(*[{r_["code"] for r_ in p.select("code").distinct().collect()} for p in parts])
    catalog = stored.select("code").distinct().where("code IS NOT NULL").select(
        "code", F.lit("n").alias("name"), F.lit("SSE").alias("market"), F.lit("main").alias("board"), F.lit("bank").alias("industry_l1"),
        F.lit(None).cast("date").alias("list_date"), F.lit(0).alias("is_demo"), F.lit("test").alias("source"),
    )
    found = []
    for n in (days * codes // 4, days * codes):
        own = materialise(stored, "large-own")
        root = str(tmp_path / f"star-{n}")
        opened = s.publish_star(spark, root, "v", own, catalog, "v1", "demo", spent=True, rows_per_part=n)
        digests = {r_["table_name"]: (r_["row_count"], r_["digest"]) for r_ in sinks.manifest(spark, root).collect()}
        ic = opened["fact_factor_ic_daily"].select("factor_name", F.col("date").cast("string"), "sample_count", F.round("ic", 9)).collect()
        found.append((digests["fact_stock_daily_demo"], digests["fact_factor_ic_daily"][0], sorted(map(str, ic))))
    assert found[0] == found[1] and found[0][1] > 0
