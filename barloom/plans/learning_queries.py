"""Model preparation, training and evaluation."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from barloom.operators import learning as ln
from barloom.operators.factors import drop_warmup, factor_panel
from barloom.operators.joins import join_sentiment
from barloom.plans.oracle import HIST
from barloom.plans.panels import long_panel
from barloom.plans.registry import query
from barloom.session import exists, materialise, rename, scratch_path, shared_dir
from barloom.sources.adapter import bars_long

UNVERIFIED = [c for c in ln.CLASSIC_FEATURES if c not in ln.SENTIMENT_FEATURES]
FEATURES = UNVERIFIED  # all inputs of the models
READY = "(SELECT * FROM bars_ready WHERE label IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ") AS ready"
DAY = "(date - DATE '1970-01-01')"


def frame(spark, sf):
    return ln.model_frame(long_panel(spark, sf), FEATURES)


def stored_frame(spark, sf, *columns):
    """The model frame's columns that a query needs, written once: bounds come from the dates of all rows, so it is read twice."""
    return materialise(frame(spark, sf).select(*columns), "frame")


@query(
    "verified_features",
    "feature filled",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS filled FROM bars_ready" for c in UNVERIFIED),
)
def verified_features(spark, sf):
    """The features a model may use on a panel with unverified sentiment, and how often each is filled."""
    panel = join_sentiment(long_panel(spark, sf), None)
    features = ln.verified_features(panel)
    counts = panel.agg(*[F.count(c).alias(c) for c in features])
    return counts.unpivot([], features, "feature", "filled")


SPLIT_SQL = f"""
    SELECT *, CASE WHEN {DAY} < c1 THEN 'train' WHEN {DAY} > c1 AND {DAY} < c2 THEN 'validation' WHEN {DAY} > c2 THEN 'test' END AS split
    FROM {READY}, (SELECT quantile_cont(CAST({DAY} AS DOUBLE), 0.70) AS c1, quantile_cont(CAST({DAY} AS DOUBLE), 0.85) AS c2
        FROM {READY}) AS c WHERE {DAY} <> c1 AND {DAY} <> c2"""


@query("time_split_purged", "code date split", f"SELECT code, date, split FROM ({SPLIT_SQL}) AS s")
def time_split_purged(spark, sf):
    return ln.time_split_purged(stored_frame(spark, sf, "code", "date"))


ROLLING_SQL = """
    SELECT p.*, w.split_id, w.period, CASE WHEN year(p.date) <= w.e THEN 'train' ELSE 'test' END AS role
    FROM bars_ready AS p JOIN (SELECT i AS split_id, y AS s, y3 AS e, y4 AS t, y || '-' || y3 || ' -> ' || (y3 + 1) || '-' || y4 AS period
        FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, lead(y, 2) OVER (ORDER BY y) AS y3, lead(y, 3) OVER (ORDER BY y) AS y4
            FROM (SELECT DISTINCT year(date) AS y FROM bars_ready) AS a) AS b WHERE y4 IS NOT NULL) AS w
    ON year(p.date) BETWEEN w.s AND w.t"""


@query(
    "rolling_year_splits",
    "split_id period role n first_date last_date",
    f"SELECT split_id, period, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM ({ROLLING_SQL}) AS r "
    "GROUP BY split_id, period, role",
)
def rolling_year_splits(spark, sf):
    return ln.rolling_year_splits(long_panel(spark, sf)).groupBy("split_id", "period", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


SCALED = ["rsi", "ret_5d", "volume_ratio"]


def _scaled(c: str) -> str:
    return (
        f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) FILTER (role = 'train') OVER (PARTITION BY split_id)) "
        f"/ stddev_pop(coalesce({c}, 0)) FILTER (role = 'train') OVER (PARTITION BY split_id) AS {c}"
    )


@query(
    "standardise_on_train",
    "split_id role code date rsi:6 ret_5d:6 volume_ratio:6",
    f"SELECT split_id, role, code, date, {', '.join(_scaled(c) for c in SCALED)} FROM ({ROLLING_SQL}) AS r",
)
def standardise_on_train(spark, sf):
    splits = ln.rolling_year_splits(materialise(long_panel(spark, sf).select("code", "date", *SCALED), "scaled"), broadcast=True)
    return ln.standardise_on_train(splits, SCALED, broadcast=True)


F_SQL = " UNION ALL ".join(
    f"SELECT split_id, '{c}' AS feature, corr(coalesce({c}, 0), coalesce(label, 0)) AS r, count(*) AS n FROM ({ROLLING_SQL}) AS r "
    "WHERE role = 'train' GROUP BY split_id"
    for c in FEATURES
)


@query(
    "f_score_select",
    "split_id feature f_score:4 position",
    f"SELECT * FROM (SELECT split_id, feature, r * r / (1 - r * r) * (n - 2) AS f_score, row_number() OVER (PARTITION BY split_id "
    f"ORDER BY round(r * r / (1 - r * r) * (n - 2), 6) DESC, feature) AS position FROM ({F_SQL}) AS f) AS g WHERE position <= 25",
)
def f_score_select(spark, sf):
    panel = drop_warmup(factor_panel(materialise(bars_long(spark, sf), "bars")))  # for the years and for the scores
    train = ln.rolling_year_splits(panel, broadcast=True).where(F.col("role") == "train")
    return ln.f_score_select(train, FEATURES, by=["split_id"])


@query(
    "class_weight",
    "positives negatives weight:6",
    f"SELECT count(*) FILTER (label > 0) AS positives, count(*) FILTER (label <= 0) AS negatives, "
    f"count(*) FILTER (label <= 0) / greatest(count(*) FILTER (label > 0), 1) AS weight FROM ({SPLIT_SQL}) AS s WHERE split = 'train'",
)
def class_weight(spark, sf):
    return ln.class_weight(ln.time_split_purged(stored_frame(spark, sf, "date", "label")).where(F.col("split") == "train"))


@query(
    "sequence_windows",
    "code date split target n_steps oldest_rsi:6 newest_ret:5",
    f"""SELECT code, date, split, target, 20 AS n_steps, oldest_rsi, newest_ret FROM ({SPLIT_SQL}) AS s JOIN (
        SELECT code, date, CASE WHEN label > 0 THEN 1 ELSE 0 END AS target, lag(rsi, 20) OVER {HIST} AS oldest_rsi,
            lag(ret_5d) OVER {HIST} AS newest_ret, row_number() OVER {HIST} AS i FROM {READY}) AS w USING (code, date) WHERE i > 20""",
)
def sequence_windows(spark, sf):
    built = ln.split_sequences(stored_frame(spark, sf, "code", "date", "label", "rsi", "ret_5d"), ["rsi", "ret_5d"])
    sequence = F.col("sequence")
    return built.select(
        "code", "date", "split", "target", F.size("sequence").alias("n_steps"),
        sequence[0][0].alias("oldest_rsi"), sequence[19][1].alias("newest_ret"),
    )


# ---- training: rows only, MLlib's trees have no SQL counterpart ---------------------------------

def _trained(spark, sf):
    """The model of the direction, kept under the content of its training rows and shared by the queries below."""
    rows = materialise(ln.model_frame(long_panel(spark, sf), FEATURES).select("code", "date", "close", "label", *FEATURES), "frame")
    splits = ln.time_split_purged(rows)
    train = splits.where(F.col("split") == "train")
    path = f"{shared_dir(spark)}/direction-{ln.content_key(train)}"
    if not exists(spark, f"{path}/metadata/_SUCCESS"):
        # Written under a name of its own and then renamed in one step: a model is there whole or not at all.
        made = scratch_path(spark, "direction-model")
        ln.train_direction(train, FEATURES).write().save(made)
        rename(spark, made, path)
    return GBTClassificationModel.load(path), splits, rows


@query("train_direction", "date code predicted:6 actual:6")
def train_direction(spark, sf):
    model, splits, _ = _trained(spark, sf)
    return ln.predict_direction(model, splits.where(F.col("split") == "test"), FEATURES)


@query("feature_importance_topk", "feature importance:6")
def feature_importance_topk(spark, sf):
    model, *_ = _trained(spark, sf)
    return ln.feature_importance(model, FEATURES, spark)


@query("score_holdout", "date code close:4 predicted:6 actual:6 implied_close:4")
def score_holdout(spark, sf):
    # The holdout is the last stretch of all rows; the days purged around the training split belong to it.
    model, _, rows = _trained(spark, sf)
    return ln.score_holdout(model, rows, FEATURES)


@query("train_return", "split_id period n mse:6 r2:6 accuracy:6 ic:6 win_rate:6 baseline_mse:6 baseline_r2:6")
def train_return(spark, sf):
    panel = materialise(long_panel(spark, sf).select("code", "date", "label", *FEATURES), "panel")
    return ln.return_by_window(ln.rolling_year_splits(panel), FEATURES)


@query("training_log", "model record")
def training_log(spark, sf):
    model, splits, _ = _trained(spark, sf)
    scored = ln.predict_direction(model, splits.where(F.col("split") == "test"), FEATURES)
    return ln.training_log(ln.eval_classification(scored), splits, "boosted_trees", FEATURES, {"iterations": model.getMaxIter(), "depth": model.getMaxDepth()})


# What of the training SQL can follow: which rows are scored, ranges, totals, dates.


@query(
    "train_direction_rows",
    "date code actual:6 probable",
    f"SELECT date, code, label AS actual, true AS probable FROM ({SPLIT_SQL}) AS s WHERE split = 'test'",
)
def train_direction_rows(spark, sf):
    return train_direction(spark, sf).select("date", "code", "actual", F.col("predicted").between(0, 1).alias("probable"))


@query("feature_importance_total", "features total:6 smallest_ok", f"SELECT {len(FEATURES)} AS features, 1.0 AS total, true AS smallest_ok")
def feature_importance_total(spark, sf):
    model, *_ = _trained(spark, sf)
    whole = ln.feature_importance(model, FEATURES, spark, len(FEATURES))
    return whole.agg(F.count("feature").alias("features"), F.sum("importance").alias("total"), (F.min("importance") >= 0).alias("smallest_ok"))


@query(
    "score_holdout_rows",
    "date code close:4 actual:6 probable implied",
    f"""SELECT date, code, close, label AS actual, true AS probable, true AS implied FROM {READY}
        WHERE {DAY} > (SELECT quantile_cont(CAST({DAY} AS DOUBLE), 0.80) FROM {READY})""",
)
def score_holdout_rows(spark, sf):
    implied = F.abs(F.col("implied_close") - F.col("close") * (0.99 + F.col("predicted") / 50)) < 1e-6
    return score_holdout(spark, sf).select(
        "date", "code", "close", "actual", F.col("predicted").between(0, 1).alias("probable"), implied.alias("implied")
    )


@query(
    "training_log_dates",
    "model feature_count iterations train_end validation_start validation_end test_start test_end",
    "SELECT 'boosted_trees' AS model, " + f"{len(FEATURES)} AS feature_count, 200 AS iterations, "
    + ", ".join(
        f"CAST({f}(date) FILTER (split = '{s}') AS VARCHAR) AS {s}_{n}"
        for s, f, n in (("train", "max", "end"), ("validation", "min", "start"), ("validation", "max", "end"), ("test", "min", "start"), ("test", "max", "end"))
    )
    + f" FROM ({SPLIT_SQL}) AS s",
)
def training_log_dates(spark, sf):
    dates = "train_end string, validation_start string, validation_end string, test_start string, test_end string"
    kind = f"feature_count int, params struct<iterations: int>, split_info struct<{dates.replace(' string', ': string')}>"
    record = F.from_json("record", kind)
    return training_log(spark, sf).withColumn("r", record).select("model", "r.feature_count", "r.params.iterations", "r.split_info.*")


@query(
    "train_return_windows",
    "split_id period n",
    f"SELECT split_id, period, count(*) AS n FROM ({ROLLING_SQL}) AS r WHERE role = 'test' AND label IS NOT NULL GROUP BY split_id, period",
)
def train_return_windows(spark, sf):
    return train_return(spark, sf).select("split_id", "period", "n")


# ---- evaluation of a fixed score, so that SQL can follow ----------------------------------------

# Score in [0, 1] with ties at 1: today's volume ratio, against tomorrow's return. Nine digits, so that both engines tie alike.
SCORE_SQL = "(SELECT code, date, year(date) AS y, round(least(volume_ratio, 1.0), 9) AS predicted, label AS actual, " \
    "amount_ratio / 10 AS baseline FROM bars_ready WHERE label IS NOT NULL) AS scored"


def scored(spark, sf):
    return scores_of(long_panel(spark, sf))


def scores_of(panel):
    return panel.where(F.col("label").isNotNull()).select(
        "code", "date", F.year("date").alias("y"),
        F.round(F.least("volume_ratio", F.lit(1.0)), 9).alias("predicted"),
        F.col("label").alias("actual"), (F.col("amount_ratio") / 10).alias("baseline"),
    )


AUC_SQL = f"""
    SELECT (sum(r) FILTER (actual > 0) - p * (p + 1) / 2) / (p * (n - p)) AS auc FROM (SELECT actual,
        rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS r,
        CAST(count(*) FILTER (actual > 0) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM {SCORE_SQL}) AS x
    GROUP BY p, n"""


@query("auc", "auc:6", AUC_SQL)
def auc(spark, sf):
    return ln.auc(scored(spark, sf))


@query(
    "eval_classification",
    "n accuracy:6 mse:6 precision:6 recall:6 f1:6 auc:6",
    f"""SELECT count(*) AS n, avg(CASE WHEN (actual > 0) = (predicted > 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy,
        avg(pow(predicted - CASE WHEN actual > 0 THEN 1 ELSE 0 END, 2)) AS mse,
        count(*) FILTER (actual > 0 AND predicted > 0.5) / count(*) FILTER (predicted > 0.5) AS precision,
        count(*) FILTER (actual > 0 AND predicted > 0.5) / count(*) FILTER (actual > 0) AS recall,
        2.0 * count(*) FILTER (actual > 0 AND predicted > 0.5) / (count(*) FILTER (predicted > 0.5) + count(*) FILTER (actual > 0)) AS f1,
        ({AUC_SQL}) AS auc FROM {SCORE_SQL}""",
)
def eval_classification(spark, sf):
    return ln.eval_classification(scored(spark, sf))


REGRESSION_SQL = f"""
    SELECT y, count(*) AS n, avg(pow(actual - predicted, 2)) AS mse, 1 - avg(pow(actual - predicted, 2)) / var_pop(actual) AS r2,
        avg(CASE WHEN sign(actual) = sign(predicted) THEN 1.0 ELSE 0.0 END) AS accuracy, corr(actual, predicted) AS ic,
        avg(CASE WHEN predicted > 0 AND actual > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        avg(pow(actual - baseline, 2)) AS baseline_mse, 1 - avg(pow(actual - baseline, 2)) / var_pop(actual) AS baseline_r2
    FROM {SCORE_SQL} GROUP BY y"""


@query(
    "eval_regression",
    "y n mse:3 r2:6 accuracy:6 ic:6 win_rate:6 baseline_mse:3 baseline_r2:6",
    REGRESSION_SQL,
)
def eval_regression(spark, sf):
    return ln.eval_regression(scored(spark, sf), by=["y"])


@query(
    "split_metrics_mean",
    "r2:6 accuracy:6 ic:6 win_rate:6",
    f"SELECT avg(r2) AS r2, avg(accuracy) AS accuracy, avg(ic) AS ic, avg(win_rate) AS win_rate FROM ({REGRESSION_SQL}) AS r",
)
def split_metrics_mean(spark, sf):
    return ln.split_metrics_mean(ln.eval_regression(scored(spark, sf), by=["y"]))


@query(
    "model_comparison",
    "model accuracy:4 auc:4",
    f"""SELECT 'logged' AS model, avg(CASE WHEN (actual > 0) = (predicted > 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy, ({AUC_SQL}) AS auc
        FROM {SCORE_SQL} UNION ALL SELECT 'stored', 0.5, 0.5""",
)
def model_comparison(spark, sf):
    # One panel for the scores and the split, written once; of an input that only has to be there it keeps whether it is.
    used = ["code", "date", "label", "volume_ratio", "amount_ratio"]
    filled = [F.when(F.col(c).isNotNull(), True).alias(c) for c in FEATURES if c not in used]
    panel = materialise(long_panel(spark, sf).select(*used, *filled), "panel")
    metrics = ln.eval_classification(scores_of(panel))
    splits = ln.time_split_purged(ln.model_frame(panel, FEATURES))
    logs = ln.training_log(metrics, splits, "logged", FEATURES, {"iterations": 0})
    stored = metrics.select(
        F.explode(F.array(F.lit("stored"), F.lit("logged"))).alias("model"),
        *[F.lit(0.5).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")],
    )
    return ln.model_comparison(logs, stored)


@query(
    "model_overview",
    "average_accuracy:4 average_auc:4",
    f"""SELECT (avg(CASE WHEN (actual > 0) = (predicted > 0.5) THEN 1.0 ELSE 0.0 END) + 0.5) / 2 AS average_accuracy,
        (({AUC_SQL}) + 0.5) / 2 AS average_auc FROM {SCORE_SQL}""",
)
def model_overview(spark, sf):
    return ln.model_overview(model_comparison(spark, sf))
