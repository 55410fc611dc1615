from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.functions import guards
from barloom.functions.scalars import board_of, code_from_number, money_label, normalise_code, trade_date
from barloom.operators import cleaning as c
from barloom.operators import quality as q
from barloom.operators.joins import join_sentiment
from barloom.operators.ranking import latest_n
from barloom.sources import readers, sinks
from barloom.streaming import incremental as inc


def test_dirty_rows(spark):
    df = spark.createDataFrame(
        [
            ("300456", "2030-05-06", 20.0, 22.0, 19.0, 21.0, "survey"),
            ("300456", "2030-05-06", 20.0, 18.0, 17.0, 19.5, "survey"),  # same key, high below open
            ("300456", "2030-05-07", 21.0, 23.0, 20.0, None, "survey"),  # one missing cell
            ("000021", "31 May", 5.0, 6.0, 4.0, 5.0, "made"),  # no date: the other one
        ],
        "code string, date string, open double, high double, low double, close double, sentiment_source string",
    )
    r = q.quality_report(df).first()
    assert (r.row_count, r.duplicate_key_count, r.invalid_date_count, r.invalid_ohlc_count) == (4, 1, 1, 1)
    assert (r.missing_cell_count, r.unexpected_missing_cell_count) == (2, 2)
    assert (r.structural_factor_missing_count, r.structural_label_missing_count, r.quality_status) == (0, 0, "FAIL")


def test_structural_gaps_only_warn(spark):
    days = [dt.date(2030, 5, d) for d in (6, 7, 8)]
    gaps = [(None, 0.02), (None, -0.01), (0.3, None)]  # two factors still warming up, the last label not known yet
    df = spark.createDataFrame(
        [("300456", day, 20.0, 22.0, 19.0, 21.0, 3.0, 63.0, *gap) for day, gap in zip(days, gaps, strict=True)],
        "code string, date date, open double, high double, low double, close double, volume double, amount double, momentum_60d double, label double",
    )
    r = q.quality_report(df).first()
    assert (r.raw_missing_cell_count, r.structural_factor_missing_count, r.structural_label_missing_count) == (0, 2, 1)
    assert (r.unexpected_missing_cell_count, r.quality_status) == (0, "WARN")


def test_clean_frame_passes(spark):
    df = spark.createDataFrame([("600519", dt.date(2026, 1, 2), 1.0)], "code string, date date, close double")
    assert q.quality_report(df).first().quality_status == "PASS"


def test_sentiment_defaults_and_join(spark):
    raw = spark.createDataFrame(
        [("21", "2030-05-06", -0.4, 0.6, 0.7), ("21", "in May", 0.9, 0.6, 0.7)],
        "code string, date string, sentiment double, sentiment_ma5 double, sentiment_ma10 double",
    )
    s = readers.normalise_sentiment(raw)
    row = s.first()
    assert s.count() == 1
    assert (row["code"], row["comment_count"], row["data_source"]) == ("000021", 0, "legacy_unknown")
    panel = spark.createDataFrame([("000021", dt.date(2030, 5, 6), 7.5), ("000022", dt.date(2030, 5, 6), 7.5)], "code string, date date, close double")
    got = {r["code"]: r for r in join_sentiment(panel, s).collect()}
    assert (got["000021"]["sentiment"], got["000021"]["sentiment_source"]) == (-0.4, "legacy_unknown")
    assert (got["000022"]["sentiment"], got["000022"]["sentiment_source"]) == (0.0, "not_available")
    assert join_sentiment(panel, None).first()["sentiment_source"] == "not_available"


def test_upsert(spark):
    may, june = dt.date(2030, 5, 6), dt.date(2030, 6, 3)
    stored = spark.createDataFrame([("300456", may, 7.0), ("000021", june, 8.0)], "code string, date date, ret double")
    batch = spark.createDataFrame(
        [("300456.0", "2030-05-06", 0.4, 0.5), ("22", "2030-06-03", 0.6, 0.7), ("22", "2030-06-04", 0.8, 0.9), (None, "2030-06-04", 3.0, 3.0), ("9", "soon", 3.0, 3.0)],
        "code string, date string, ret double, momentum_20d double",
    )
    once = inc.upsert(stored, inc.prepare_batch(batch, ["ret"]))
    again = spark.createDataFrame([("22", "2030-06-04", -0.9)], "code string, date string, momentum_20d double")
    rows = {(r["code"], r["date"]): r for r in inc.upsert(once, inc.prepare_batch(again, ["momentum_20d"])).collect()}
    assert len(rows) == 4
    last = dt.date(2030, 6, 4)
    assert (rows["000022", last]["ret"], rows["000022", last]["momentum_20d"]) == (0.8, -0.9)
    assert (rows["300456", may]["ret"], rows["300456", may]["momentum_20d"]) == (0.4, 0.5)
    assert rows["000021", june]["ret"] == 8.0 and rows["000021", june]["momentum_20d"] is None


def test_upsert_overwrites_with_null(spark):
    day = dt.date(2026, 1, 2)
    stored = spark.createDataFrame([("600519", day, 1.0, 2.0)], "code string, date date, a double, b double")
    batch = spark.createDataFrame([("600519", "2026-01-02", None)], "code string, date string, a double")
    row = inc.upsert(stored, inc.prepare_batch(batch, ["a"])).first()
    assert row["a"] is None and row["b"] == 2.0


@pytest.mark.parametrize("bad", [0, -1, 1.5, "10", True])
def test_latest_n_rejects(spark, bars, bad):
    with pytest.raises(ValueError):
        latest_n(bars, "600519", bad)


def test_hostile_input_is_rejected():
    with pytest.raises(ValueError):
        guards.security_code("600519' OR '1'='1")
    with pytest.raises(ValueError):
        guards.date_range("2026-02-01", "2026-01-01")
    with pytest.raises(ValueError):
        guards.iso_day("01/02/2026")
    with pytest.raises(ValueError):
        guards.safe_columns(["ok", "x; drop table"])
    with pytest.raises(ValueError):
        guards.offset(-1)
    assert guards.security_code("1") == "000001"


def test_limits_are_exact_or_refused(spark):
    df = spark.range(5000)
    assert guards.row_limit(df, None).count() == 5000 and guards.row_limit(df, 4321).count() == 4321
    for bad in (0, -1, 1.5, "10", True):
        with pytest.raises(ValueError):
            guards.row_limit(df, bad)


def test_codes_of_different_keys_differ(spark):
    keys = [1, 7, 999_999, 1_000_000, 1_000_001, 2_000_001, 123_456_789_012]
    codes = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(code_from_number("k")).collect()]
    assert codes == ["000001", "000007", "999999", "1000000", "1000001", "2000001", "123456789012"]


def test_unique_key(spark):
    good = spark.createDataFrame([("a", 1), ("b", 1)], "code string, n int")
    assert guards.assert_unique_key(good, ["code"]) is good
    for rows in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            guards.assert_unique_key(spark.createDataFrame(rows, "code string, n int"), ["code"])


def test_scalars(spark):
    df = spark.createDataFrame([("600519.0",), ("1",), ("1234567",), (None,)], "c string")
    assert [r[0] for r in df.select(normalise_code("c")).collect()] == ["600519", "000001", "1234567", None]
    boards = spark.createDataFrame([("688001",), ("600519",), ("300750",), ("000001",), ("830001",)], "c string")
    assert [r[0] for r in boards.select(board_of("c")).collect()] == ["科创板", "沪市主板", "创业板", "深市主板", "其他"]
    dates = spark.createDataFrame([("20240229",), ("20230229",), ("2024-02-29",), ("20240229.0",)], "c string")
    assert [r[0] for r in dates.select(trade_date("c")).collect()] == [dt.date(2024, 2, 29), None, None, dt.date(2024, 2, 29)]
    money = spark.createDataFrame([(2.5e8,), (12345.0,), (987.0,), (None,)], "v double")
    assert [r[0] for r in money.select(money_label("v")).collect()] == ["2.50亿", "1.23万", "987", "--"]


def test_dedup_keeps_stated_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("b", 1, 7.0)], "k string, seq int, v double")
    first = {r["k"]: r["v"] for r in c.dedup(df, ["k"], ["seq"], "first").collect()}
    last = {r["k"]: r["v"] for r in c.dedup(df, ["k"], ["seq"], "last").collect()}
    assert first == {"a": None, "b": 7.0} and last == {"a": 5.0, "b": 7.0}


def test_sparse_columns_and_rows(spark):
    rows = [("x", i, 1.0, 2.0 if i else None, 3.0 if i > 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "code string, n int, a double, b double, c double")
    out = c.drop_sparse(df, ["a", "b", "c"])
    # c misses 25 % and is blanked; b misses 5 % and stays, its one gap is half of the kept cells.
    assert out.count() == 19
    assert out.where(F.col("c").isNotNull()).count() == 0


def test_valid_filter_is_null_safe(spark):
    df = spark.createDataFrame(
        [("000001", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0), ("000001", dt.date(2024, 1, 2), None, 2.0, 0.5, None, 10.0), ("1", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 10.0)],
        "code string, date date, open double, high double, low double, close double, volume double",
    )
    assert c.valid_bar_filter(df).count() == 1
    row = q.valid_summary(df).first()
    assert (row.input_rows, row.valid_rows, row.invalid_rows) == (3, 1, 2)


def test_quarantine_reasons(spark):
    df = spark.createDataFrame(
        [("a", 0, ["trade_date"], 0), ("b", 3, ["trade_date", "open"], 0), ("c", 3, c.RAW_COLUMNS, 3), ("d", 3, c.RAW_COLUMNS, 1)],
        "code string, row_count long, columns array<string>, bad_dates long",
    )
    got = {r["code"]: r["reason"] for r in c.quarantine(df).collect()}
    assert got == {"a": "empty", "b": "missing columns: high,low,close,vol,amount", "c": "no readable dates", "d": None}


def test_scan_bars_reads_code_from_file_name(spark, tmp_path):
    (tmp_path / "600519_daily.csv").write_text("date,open,high,low,close,volume,amount\n2024-01-02,1,2,0.5,1.5,10,15\n")
    (tmp_path / "000001_daily.csv").write_text("date,open,high,low,close,volume,amount\n2024-01-02,1,2,0.5,1.5,10,15\n2024-01-03,1,2,0.5,,10,15\n")
    rows = readers.scan_bars(spark, str(tmp_path)).orderBy("code", "date").collect()
    assert [(r["code"], r["close"]) for r in rows] == [("000001", 1.5), ("000001", None), ("600519", 1.5)]


def test_scan_bars_rejects_other_header(spark, tmp_path):
    (tmp_path / "600519_daily.csv").write_text("date,open,high,low,price,volume,amount\n2024-01-02,1,2,0.5,1.5,10,15\n")
    with pytest.raises(Exception):
        readers.scan_bars(spark, str(tmp_path)).collect()


def test_missing_inputs_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.scan_predictions(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        readers.scan_benchmark(spark, [str(tmp_path / "none.parquet")])
    (tmp_path / "b.csv").write_text("trade_date,close\n20240102,5\n")
    with pytest.raises(ValueError):
        readers.scan_benchmark(spark, [str(tmp_path / "b.csv")])


def test_fingerprint_ignores_order_but_not_content(spark, bars):
    a = sinks.content_version({"bars": bars}).first()[0]
    assert a == sinks.content_version({"bars": bars.orderBy(F.col("close").desc())}).first()[0]
    assert a != sinks.content_version({"bars": bars.unionByName(bars.limit(1))}).first()[0]


def test_one_symbol_holds_most_rows(spark):
    """Duplicates of one key are combined before the exchange, so a hot key is one row per task after it."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "000007").otherwise(F.lpad((F.col("id") % 500).cast("string"), 6, "0")).alias("code"),
        F.lit(dt.date(2024, 1, 1)).alias("date"),
        F.col("id").alias("seq"),
    )
    kept = c.dedup(df, ["code", "date"], ["seq"], "last")
    hot = kept.where(F.col("code") == "000007").first()
    assert hot["seq"] == max(i for i in range(n) if i % 3 == 0 or i % 500 == 7)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_upsert_leaves_the_files_of_other_years(spark, tmp_path):
    rows = [("000001", dt.date(y, 1, 1 + i), float(i)) for y in (2022, 2023, 2024) for i in range(5)]
    stored = spark.createDataFrame(rows, "code string, date date, close double")
    path = f"{tmp_path}/panel"
    sinks.write_partitioned(stored.withColumn("year", F.year("date")), path)
    files = lambda: {p.relative_to(path) for p in Path(path).rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([("000001", "2023-01-02", 9.0, 0.5), ("000002", "2023-06-01", None, 0.25)], "code string, date string, close double, ret double")
    prepared = inc.prepare_batch(batch, ["ret"])
    got = {(r["code"], r["date"]): (r["close"], r["ret"]) for r in inc.upsert_by_year(spark, path, prepared).collect()}
    kept = {f for f in before if "year=2023" not in str(f)}
    assert kept and kept < files() and not (before - kept) & files()
    want = {(c, d): (v, None) for c, d, v in rows} | {("000001", dt.date(2023, 1, 2)): (9.0, 0.5), ("000002", dt.date(2023, 6, 1)): (None, 0.25)}
    assert got == want
    again = inc.upsert_by_year(spark, path, prepared)
    assert {(r["code"], r["date"]): (r["close"], r["ret"]) for r in again.collect()} == want
    assert inc.upsert_by_year(spark, path, prepared.limit(0)).count() == len(want)


def test_packed_bars_follow_bytes_not_symbols(spark, tmp_path):
    rows = [(f"{i:06d}", dt.date(2024, 1, 1 + d), 1.0, 2.0, 0.5, 1.5, 10.0, 15.0) for i in range(400) for d in range(3)]
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")
    path = sinks.write_packed_csv(bars, f"{tmp_path}/bars")
    assert len(list(Path(path).rglob("*.csv"))) <= 8
    assert sorted(map(tuple, readers.scan_bars(spark, path, packed=True).collect())) == sorted(rows)


def test_years_are_written_where_codes_lie(spark, tmp_path):
    """Rows in ranges of codes are not sent again to be written by year; an overwrite still leaves the other years."""
    rows = [(f"{i:06d}", dt.date(y, 1, 1 + d), y, float(i)) for i in range(40) for y in (2022, 2023, 2024) for d in range(3)]
    laid = spark.createDataFrame(rows, "code string, date date, year int, close double").repartitionByRange(4, "code")
    path = f"{tmp_path}/years"
    sinks.write_partitioned(laid, path, laid_out=True)
    spans = {}
    for file in Path(path).rglob("year=2023/*.parquet"):
        codes = [r["code"] for r in spark.read.parquet(str(file)).collect()]
        assert codes == sorted(codes)
        spans[codes[0]] = codes[-1]
    ends = sorted(spans.items())
    assert len(ends) == 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # each task wrote its own codes
    sinks.write_partitioned(laid.where("year = 2023").withColumn("close", -laid["close"]), path, laid_out=True)
    got = sorted((r["code"], r["date"], r["year"], r["close"]) for r in spark.read.parquet(path).collect())
    assert got == sorted((c, d, y, -v if y == 2023 else v) for c, d, y, v in rows)


def test_partitioned_query_keeps_no_shuffle_and_no_bars(spark):
    from barloom.plans import source_queries as sq
    from barloom.session import folders, shared_dir

    before = set(folders(spark, shared_dir(spark)))
    assert sq.write_partitioned(spark, "/root/testdata/sf0.001").count() > 0
    assert len([f for f in set(folders(spark, shared_dir(spark))) - before if "/years-" in f or "/bars-" in f]) == 1
