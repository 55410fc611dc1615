from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import learning as ln
from barloom.operators.factors import drop_warmup, factor_panel


def test_date_quantile_interpolates(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 5, 9)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    value = ln.date_quantiles(df, [0.7]).first()["cutoffs"][0]
    # 5 January 09:36
    assert value == pytest.approx((dt.date(2024, 1, 5) - dt.date(1970, 1, 1)).days + 9.6 / 24)


def test_split_purges_boundary_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(101)], "date date")
    split = {r["date"]: r["split"] for r in ln.time_split_purged(df).collect()}
    start = dt.date(2024, 1, 1)
    assert len(split) == 99
    assert start + dt.timedelta(70) not in split and start + dt.timedelta(85) not in split
    assert split[start + dt.timedelta(69)] == "train" and split[start + dt.timedelta(71)] == "validation"
    assert split[start + dt.timedelta(86)] == "test"


def test_unverified_sentiment_is_left_out(bars):
    panel = bars.withColumns({"rsi": F.lit(1.0), "sentiment": F.lit(0.1)})
    names = ["rsi", "sentiment", "absent"]
    assert ln.verified_features(panel, names) == ["rsi"]
    assert ln.verified_features(panel.withColumn("sentiment_source", F.lit("synthetic_demo")), names) == ["rsi"]
    assert ln.verified_features(panel.withColumn("sentiment_source", F.lit("verified_real")), names) == ["rsi", "sentiment"]


def brute_auc(pairs):
    pos = [s for s, y in pairs if y > 0]
    neg = [s for s, y in pairs if y <= 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(5)
    pairs = [(round(rng.random(), 2), rng.choice([-1.0, 1.0])) for _ in range(400)]
    # a third of all rows share one score
    pairs += [(0.5, rng.choice([-1.0, 1.0])) for _ in range(200)]
    df = spark.createDataFrame(pairs, "predicted double, actual double")
    assert ln.auc(df).first()[0] == pytest.approx(brute_auc(pairs))
    assert ln.auc(df.where("actual > 0")).first()[0] == 0.5


def test_classification_on_empty_denominators(spark):
    df = spark.createDataFrame([(0.1, -1.0), (0.2, -1.0)], "predicted double, actual double")
    r = ln.eval_classification(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["auc"]) == (1.0, 0.0, 0.0, 0.0, 0.5)


def test_measures_of_many_scores_equal_plain_ones(spark):
    import random

    draw = random.Random(5)
    rows = [(draw.choice([None, round(draw.random(), 2), draw.random()]), draw.choice([None, -0.1, 0.0, 0.2, 0.3])) for _ in range(2000)]
    got = ln.eval_classification(spark.createDataFrame(rows, "predicted double, actual double")).first()
    known = [(p, a > 0) for p, a in rows if p is not None and a is not None]
    tp, fp, fn = (sum(1 for p, u in known if (u, p > 0.5) == x) for x in ((True, True), (False, True), (True, False)))
    assert got["n"] == 2000 and got["accuracy"] == pytest.approx(sum(u == (p > 0.5) for p, u in known) / 2000)
    assert got["mse"] == pytest.approx(sum((p - u) ** 2 for p, u in known) / len(known))
    assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)))


def test_sequences_take_their_split_from_one_layout(spark):
    rows = [("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), (-1.0) ** i) for i in range(60)]
    df = spark.createDataFrame(rows, "code string, date date, x double, label double")
    got = ln.split_sequences(df, ["x"], 20)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    split = {r_["date"]: r_["split"] for r_ in ln.time_split_purged(df, 0.70, 0.85).collect()}
    assert {r_["date"]: r_["split"] for r_ in got.collect()} == {d: k for d, k in split.items() if d >= rows[20][1]}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, -2.0), (2.0, 3.0), (0.5, -1.0)], "predicted double, actual double")
    r = ln.eval_regression(df).first()
    sse = 0 + 1 + 1 + 2.25
    mean = 0.25
    sst = sum((y - mean) ** 2 for y in (1.0, -2.0, 3.0, -1.0))
    assert r["mse"] == pytest.approx(sse / 4) and r["r2"] == pytest.approx(1 - sse / sst)
    assert r["accuracy"] == 0.75 and r["win_rate"] == 0.5


def test_sequences_see_only_the_past(spark):
    rows = [("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), (-1.0) ** i) for i in range(40)]
    df = spark.createDataFrame(rows, "code string, date date, x double, label double")
    got = ln.sequence_windows(df, ["x"], 20).orderBy("date").collect()
    assert len(got) == 20
    assert [v[0] for v in got[0]["sequence"]] == [float(i) for i in range(20)]
    assert got[0]["date"] == rows[20][1] and got[0]["target"] == 1


def test_scaling_uses_training_rows_only(spark):
    rows = [(0, "train", 1.0), (0, "train", 3.0), (0, "train", None), (0, "test", 100.0), (1, "train", 5.0), (1, "test", 5.0)]
    df = spark.createDataFrame(rows, "split_id int, role string, x double")
    got = ln.standardise_on_train(df, ["x"]).where("role = 'test'").orderBy("split_id").collect()
    mean = 4 / 3
    std = ((1 - mean) ** 2 + (3 - mean) ** 2 + mean**2) ** 0.5 / 3**0.5
    assert got[0]["x"] == pytest.approx((100 - mean) / std) and got[1]["x"] == 0.0


def test_direction_model_end_to_end(spark, bars):
    features = ["rsi", "macd", "momentum_20d"]
    frame = ln.model_frame(drop_warmup(factor_panel(bars)), features)
    splits = ln.time_split_purged(frame)
    model = ln.train_direction(splits.where("split = 'train'"), features, iterations=3)
    scored = ln.predict_direction(model, splits.where("split = 'test'"), features)
    metrics = ln.eval_classification(scored)
    assert 0 <= metrics.first()["auc"] <= 1
    assert ln.feature_importance(model, features, spark).count() == 3
    log = ln.training_log(metrics, splits, "trees", features, {"iterations": 3})
    stored = spark.createDataFrame([("trees", 0.1, 0.1, 0.1, 0.1, 0.1), ("other", 0.2, 0.2, 0.2, 0.2, 0.2)],
                                   "model string, auc double, accuracy double, precision double, recall double, f1 double")
    rows = {r["model"]: r for r in ln.model_comparison(log, stored).collect()}
    assert set(rows) == {"trees", "other"} and rows["trees"]["auc"] == pytest.approx(metrics.first()["auc"], abs=1e-4)
    own = ln.score_holdout(model, frame, features, "600519")
    assert {r["code"] for r in own.select("code").distinct().collect()} == {"600519"}
    assert ln.score_holdout(model, frame, features, "999999").select("code").distinct().count() == 2


def test_return_model_selects_its_features(spark):
    rng = random.Random(3)
    rows = [(dt.date(2024, 1, 1), str(i), y + 0.01 * rng.random(), -y + 0.02 * rng.random(), rng.random(), y) for i in range(60) for y in (rng.random(),)]
    df = spark.createDataFrame(rows, "date date, code string, b double, a double, noise double, label double")
    models = ln.train_return(df, ["noise", "b", "a"], iterations=1, k=2)
    assert models[2] == ["b", "a"] and models[0].numFeatures == 2
    assert ln.predict_return(models, df).count() == 60


@pytest.fixture
def own_folder(monkeypatch, tmp_path):
    """A folder for one test: models kept under their content are not those of other tests."""
    from barloom.plans import learning_queries as lq

    for module in (ln, lq):
        monkeypatch.setattr(module, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def test_windows_that_are_done_are_not_fitted_again(spark, own_folder, monkeypatch):
    rng = random.Random(8)
    days = [dt.date(y, 1 + m, 3) for y in range(2018, 2023) for m in range(12)]
    rows = [(f"{i:06d}", d, x, rng.random(), 2 * x + 0.1 * rng.random()) for i in range(4) for d in days for x in (rng.random(),)]
    splits = ln.rolling_year_splits(spark.createDataFrame(rows, "code string, date date, a double, b double, label double"))
    first = sorted(map(tuple, ln.return_by_window(splits, ["a", "b"], iterations=2).collect()))
    assert [(r[0], r[1], r[2]) for r in first] == [(0, "2018-2020 -> 2021-2021", 48), (1, "2019-2021 -> 2022-2022", 48)]
    fitted, train = [], ln.train_return
    monkeypatch.setattr(ln, "train_return", lambda *a, **kw: (fitted.append(1), train(*a, **kw))[1])
    assert sorted(map(tuple, ln.return_by_window(splits, ["a", "b"], iterations=2).collect())) == first and not fitted
    # A window without its mark of success is done anew, the other is kept.
    next(own_folder.glob("return-*/window-1/metrics/_SUCCESS")).unlink()
    assert sorted(map(tuple, ln.return_by_window(splits, ["a", "b"], iterations=2).collect())) == first and fitted == [1]
    ln.return_by_window(splits, ["a", "b"], iterations=1)
    assert len(fitted) == 3  # other parameters, other models


def test_registered_training_takes_all_inputs_and_rounds(spark, own_folder, monkeypatch):
    """Fits are replaced by short ones that keep what they were asked for."""
    from barloom.plans import learning_queries as lq

    asked = []
    direction, regression = ln.train_direction, ln.train_return
    monkeypatch.setattr(ln, "train_direction", lambda t, f, **kw: (asked.append((len(f), kw)), direction(t, f, iterations=1))[1])
    monkeypatch.setattr(ln, "train_return", lambda t, f, **kw: (asked.append((len(f), kw)), regression(t, f, iterations=1))[1])
    smoke = "/root/testdata/sf0.001"
    assert lq.feature_importance_topk(spark, smoke).count() == 15
    lq.training_log(spark, smoke)
    assert asked == [(21, {})]  # the second query takes the model of the first
    lq.train_return(spark, smoke)
    assert len(asked) > 1 and all(x == (21, {}) for x in asked)


def _lineitem_files(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey#")


def test_split_reads_its_rows_once(spark):
    """Rows and bounds come from one written frame: the panel was worked out for each of them."""
    from barloom.plans import learning_queries as lq

    smoke = "/root/testdata/sf0.001"
    for build in (lq.time_split_purged, lq.class_weight, lq.sequence_windows, lq.model_comparison, lq.model_overview, lq.standardise_on_train):
        assert _lineitem_files(build(spark, smoke)) == 0, build.__name__


def test_windows_of_years_are_broadcast(spark):
    """No exchange by year or by window: there are few of either, so it left few tasks with all rows."""
    rows = [(f"{i:06d}", dt.date(2018 + i % 5, 1, 1), float(i), 0.1 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "code string, date date, x double, label double").repartition(3)
    splits = ln.rolling_year_splits(df, broadcast=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scaled = ln.standardise_on_train(splits, ["x"], broadcast=True)
        plan = scaled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and scaled.count() == 80


def _noisy(spark, n, parts):
    from pyspark.sql import functions as F

    inputs = [f"x{i}" for i in range(6)]
    df = spark.range(n, numPartitions=parts).select(*[F.randn(i).alias(c) for i, c in enumerate(inputs)])
    # A mirrored input ties with its original, a rounded one has few cut points, a constant one has none.
    df = df.withColumns({"x3": -F.col("x2"), "x4": F.round("x4"), "x5": F.lit(0.0)})
    label = F.col("x0") * F.col("x1") + F.col("x2") + F.randn(9)
    return df.withColumn("label", label), inputs


def _body(model):
    return [t.toDebugString.partition("\n")[2] for t in model.trees]


@pytest.mark.parametrize("parts", [1, 3])
def test_boosting_gives_the_trees_of_mllib(spark, monkeypatch, parts):
    """Trees, weights and importances are those of MLlib's own fit on the same partitions."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    from barloom.operators import boosting

    monkeypatch.setattr(boosting, "FOLD", 4)
    df, inputs = _noisy(spark, 12_000, parts)
    rows = ln._features(df, inputs).select("features", "label", (F.col("label") > 0).cast("double").alias("up"), F.when(F.col("label") > 0, 1.7).otherwise(1.0).alias("w"))
    shared = {"maxIter": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
    for learner in (
        GBTRegressor(labelCol="label", maxDepth=5, stepSize=0.015, **shared),
        GBTClassifier(labelCol="up", weightCol="w", maxDepth=4, stepSize=0.05, **shared),
        GBTRegressor(labelCol="label", maxDepth=3, maxIter=3, seed=7),
    ):
        own, theirs = boosting.boosted(learner, rows), learner.fit(rows)
        assert _body(own) == _body(theirs) and own.treeWeights == theirs.treeWeights
        assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-12)
        assert own.getMaxDepth() == theirs.getMaxDepth() and own.numFeatures == 6


def test_rounds_of_a_small_fit_are_no_jobs(spark):
    """Rows that one task holds are boosted in it; a job for each level of each tree took most of the time."""
    df, inputs = _noisy(spark, 2_000, 1)
    context = spark.sparkContext
    context.setJobGroup("boosting-jobs", "count")
    try:
        models = ln.train_return(df, inputs, iterations=20)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert models[0].getNumTrees == 20
    assert len(context.statusTracker().getJobIdsForGroup("boosting-jobs")) < 40


def test_a_task_of_a_fit_has_bounded_rows(spark, monkeypatch):
    """Tasks follow the rows, up to the fit's share of the cluster, and beyond it where a task's rows would be too many."""
    df, inputs = _noisy(spark, 1_000, 20)
    rows, context = ln._features(df, inputs).select("features", "label"), spark.sparkContext
    count = lambda: ln._training_table(rows, "bounded").rdd.getNumPartitions()
    assert count() == 1
    monkeypatch.setattr(ln, "ROWS_PER_TASK", 50)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # so that each of the 20 files is a partition
    try:
        whole = count()
        context.setLocalProperty(ln.SIDE_BY_SIDE, "4")
        shared = count()
        monkeypatch.setattr(ln, "MOST_ROWS_PER_TASK", 100)
        assert (whole, shared, count()) == (8, 2, 10)
    finally:
        context.setLocalProperty(ln.SIDE_BY_SIDE, None)
        spark.conf.unset("spark.sql.files.openCostInBytes")
