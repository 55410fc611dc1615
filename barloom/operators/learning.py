"""Preparation of model data, training on MLlib, and evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import GROUP_ROWS, running_totals
from barloom.functions.scalars import safe_corr
from barloom.functions.windows import history
from barloom.operators.boosting import boosted
from barloom.session import exists, materialise, shared_dir

# Candidate features, sentiment features, and sources counted as verified.
CLASSIC_FEATURES = [
    "ret_5d", "ma5", "ma10", "ma20", "ma5_ma10_diff", "ma5_ma20_diff", "rsi", "macd", "macd_signal",
    "momentum_20d", "reversal_5d", "volatility_20d", "volatility_60d", "bb_mid", "bb_position",
    "volume_ma5", "volume_ratio", "amount_ma20", "amount_ratio", "high_low_ratio", "close_open_ratio",
    "sentiment", "sentiment_ma5", "sentiment_ma10",
]
SENTIMENT_FEATURES = ["sentiment", "sentiment_ma5", "sentiment_ma10", "comment_count"]
VERIFIED_SOURCES = ["akshare_news", "eastmoney_news", "tushare_news", "verified_real"]

STEPS = 20


def verified_features(panel: DataFrame, candidates: Sequence[str] = CLASSIC_FEATURES) -> list[str]:
    """The candidates that the panel has; sentiment only counts once a source of it is known to be good."""
    wanted = set(panel.columns).intersection(candidates)
    if wanted.intersection(SENTIMENT_FEATURES):
        trusted = panel.where(F.col("sentiment_source").isin(VERIFIED_SOURCES)) if "sentiment_source" in panel.columns else None
        if trusted is None or trusted.isEmpty():
            wanted.difference_update(SENTIMENT_FEATURES)
    return [c for c in candidates if c in wanted]


def model_frame(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with label and all features."""
    return panel.dropna(subset=["label", *features])


def day_number(column: Column | str = "date") -> Column:
    return F.unix_date(column)


def date_quantiles(frame: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Row-weighted quantiles of the date in days, interpolated; one array per frame.

    Rows are counted per day first, so the exact percentile sees one weighted
    value per calendar day.
    """
    per_day = frame.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.percentile(day_number(), F.array(*[F.lit(float(x)) for x in levels]), F.col("n")).alias("cutoffs")
    )


def time_split_purged(frame: DataFrame, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """Train, validation and test by date; the two boundary days belong to none and drop out."""
    return _split(frame, frame, train, validation)


def _split(rows: DataFrame, dated: DataFrame, train: float, validation: float) -> DataFrame:
    """``rows`` with their split by the quantiles of the dates of ``dated``."""
    cutoffs = date_quantiles(dated, [train, validation]).scalar()
    day, first, second = day_number(), cutoffs[0], cutoffs[1]
    split = (
        F.when(day < first, "train")
        .when((day > first) & (day < second), "validation")
        .when(day > second, "test")
    )
    return rows.withColumn("split", split).where(F.col("split").isNotNull())


def year_windows(frame: DataFrame, train_years: int = 3, test_years: int = 1) -> DataFrame:
    """One row per window and year with its role; windows move by one year that has data."""
    w = Window.orderBy("year")
    years = frame.select(F.year("date").alias("year")).distinct()
    spans = years.select(
        (F.row_number().over(w) - 1).alias("split_id"),
        F.col("year").alias("train_start"),
        F.lead("year", train_years - 1).over(w).alias("train_end"),
        F.lead("year", train_years + test_years - 1).over(w).alias("test_end"),
    ).where(F.col("test_end").isNotNull())
    period = F.format_string("%d-%d -> %d-%d", "train_start", "train_end", F.col("train_end") + 1, "test_end")
    return spans.select(
        "split_id", period.alias("period"), "train_end", F.explode(F.sequence("train_start", "test_end")).alias("year")
    ).select("split_id", "period", "year", F.when(F.col("year") <= F.col("train_end"), "train").otherwise("test").alias("role"))


def rolling_year_splits(frame: DataFrame, train_years: int = 3, test_years: int = 1, broadcast: bool = False) -> DataFrame:
    """Every row once per window it belongs to, by an equi-join on the year. Of windows there are a few rows a year: with
    ``broadcast`` they go to the rows, as an exchange by year leaves no more tasks than there are years."""
    windows = year_windows(frame, train_years, test_years)
    return frame.withColumn("year", F.year("date")).join(F.broadcast(windows) if broadcast else windows, "year")


def standardise_on_train(splits: DataFrame, features: Sequence[str], by: Sequence[str] = ("split_id",), broadcast: bool = False) -> DataFrame:
    """Scale by mean and population deviation of the training rows; missing counts as 0 first.

    The groups are windows; with ``broadcast`` their figures, a row each, go to the rows.
    """
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in features}
    train = splits.where(F.col("role") == "train")
    stats = train.groupBy(*by).agg(
        *[F.avg(filled[c]).alias(f"_mean_{c}") for c in features],
        *[F.stddev_pop(filled[c]).alias(f"_std_{c}") for c in features],
    )
    spread = lambda c: F.when(F.col(f"_std_{c}") == 0, 1.0).otherwise(F.col(f"_std_{c}"))
    scaled = splits.join(F.broadcast(stats) if broadcast else stats, list(by)).withColumns({c: (filled[c] - F.col(f"_mean_{c}")) / spread(c) for c in features})
    return scaled.drop(*[f"_mean_{c}" for c in features], *[f"_std_{c}" for c in features])


def f_scores(train: DataFrame, features: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Univariate F of each feature against the label, all in one aggregate."""
    y = F.coalesce(F.col(label), F.lit(0.0))
    wide = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[safe_corr(F.coalesce(F.col(c), F.lit(0.0)), y).alias(c) for c in features]
    )
    long = wide.unpivot([*by, "n"], list(features), "feature", "r")
    r2 = F.col("r") * F.col("r")
    return long.withColumn("f_score", F.try_divide(r2, 1 - r2) * (F.col("n") - 2))


def f_score_select(train: DataFrame, features: Sequence[str], label: str = "label", k: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """The k best features per group; one row per feature is ranked. Scores equal to six digits go by name."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = w.orderBy(F.round("f_score", 6).desc_nulls_last(), "feature")
    scored = f_scores(train, features, label, by)
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def selected(train: DataFrame, features: Sequence[str], label: str = "label", k: int = 25) -> list[str]:
    """The names of the k best features, in the order given."""
    best = {r["feature"] for r in f_score_select(train, features, label, k).select("feature").collect()}
    return [c for c in features if c in best]


def class_weight(train: DataFrame) -> DataFrame:
    """Positives, negatives, and the weight of a positive row."""
    up = F.count_if(F.col("label") > 0)
    return train.agg(up.alias("positives"), (F.count(F.lit(1)) - up).alias("negatives")).withColumn(
        "weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))
    )


def sequence_windows(frame: DataFrame, features: Sequence[str], steps: int = STEPS) -> DataFrame:
    """The feature rows of the ``steps`` days before each row, with the row's own direction.

    Run on the whole frame and filtered by split afterwards, it gives a
    validation or test target exactly the history that lies before it, and no
    label from its future.
    """
    before = history().rowsBetween(-steps, -1)
    sequence = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(before)
    return (
        frame.withColumn("sequence", sequence)
        .where(F.size("sequence") == steps)
        .select("code", "date", "sequence", (F.col("label") > 0).cast("int").alias("target"))
    )


def split_sequences(frame: DataFrame, features: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Sequences with the split of their target day; boundary days are history only.

    The bounds are two numbers from the dates of the whole frame; the sequences carry their own rows on, so the frame is
    laid out once.
    """
    return _split(sequence_windows(frame, features, steps), frame, 0.70, 0.85).select("code", "date", "split", "sequence", "target")


# ---- training ----------------------------------------------------------------------------------


def _features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x_{c}") for c in features])
    assembled = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="features").transform(filled)
    return assembled.drop(*[f"_x_{c}" for c in features])


ROWS_PER_TASK = 200_000  # of a training table; a round over a small table costs the scheduling of its tasks
MOST_ROWS_PER_TASK = 2_000_000
SIDE_BY_SIDE = "barloom.fits.side_by_side"  # local property of a thread: how many fits share the cluster


def _training_table(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once, as boosting reads them more than once, and read in as few tasks as their number needs: no more than
    this fit's share of the cluster runs at a time, while a task's rows stay bounded."""
    table = materialise(rows, name)
    context, count = table.sparkSession.sparkContext, table.count()
    share = context.defaultParallelism // int(context.getLocalProperty(SIDE_BY_SIDE) or 1)
    return table.coalesce(max(1, min(-(-count // ROWS_PER_TASK), max(share, -(-count // MOST_ROWS_PER_TASK)))))


def train_direction(
    train: DataFrame, features: Sequence[str], iterations: int = 200, depth: int = 4, step: float = 0.05, seed: int = 42
) -> Model:
    """Boosted trees for the direction of the next day, positives weighted by class balance.

    Rows are filled, assembled and written before the first round.
    """
    weight = class_weight(train).select("weight").scalar()
    rows = _features(train, features).withColumns(
        {
            "direction": (F.col("label") > 0).cast("double"),
            "weight": F.when(F.col("label") > 0, weight).otherwise(1.0),
        }
    )
    learner = GBTClassifier(
        featuresCol="features", labelCol="direction", weightCol="weight", maxIter=iterations, maxDepth=depth,
        stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    return boosted(learner, _training_table(rows.select("features", "direction", "weight"), "direction"))


def predict_direction(model: Model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Out-of-sample probability of a rise with the realised return."""
    scored = model.transform(_features(rows, features))
    return scored.select(
        "date", "code", vector_to_array("probability")[1].alias("predicted"), F.col("label").alias("actual")
    )


def train_return(
    train: DataFrame, features: Sequence[str], iterations: int = 500, depth: int = 5, step: float = 0.015, seed: int = 42, k: int = 25
) -> tuple[Model, Model, list[str]]:
    """Boosted regression of the next return and a linear baseline, on the k features of the highest F, and their names."""
    chosen = selected(train, features, "label", k)
    rows = _training_table(_features(train.where(F.col("label").isNotNull()), chosen).select("features", "label"), "return")
    trees = GBTRegressor(
        featuresCol="features", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=step,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    linear = LinearRegression(featuresCol="features", labelCol="label", maxIter=50)
    return boosted(trees, rows), linear.fit(rows), chosen


def predict_return(models: tuple[Model, Model, list[str]], rows: DataFrame) -> DataFrame:
    trees, linear, chosen = models
    first = trees.transform(_features(rows, chosen)).withColumnRenamed("prediction", "predicted")
    both = linear.transform(first).withColumnRenamed("prediction", "baseline")
    return both.select("date", "code", "predicted", "baseline", F.col("label").alias("actual"))


def content_key(rows: DataFrame, *more) -> str:
    """A name for what a table holds, whatever the order of its rows, together with further values."""
    content = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    facts = rows.agg(F.count(F.lit(1)), F.bit_xor(content), F.sum(content.cast("decimal(38, 0)"))).first()
    return hashlib.sha256(repr((sorted(rows.dtypes), tuple(map(str, facts)), more)).encode()).hexdigest()[:24]


def return_by_window(splits: DataFrame, features: Sequence[str], parallel: int = 8, **params) -> DataFrame:
    """Each window of years trained and tested on its own: one row of metrics per window.

    ``splits`` comes from ``rolling_year_splits``. A boosting round over one window's rows leaves most of a cluster idle, so
    windows run side by side, each in a scheduler pool of its own. A window's models and metrics are written when it is done,
    in a folder named by the content of the rows and the parameters: a restart goes on with the windows that are missing.
    """
    spark = splits.sparkSession
    # Laid out here, as boosting draws by the order of its rows: which join brings them, and so their order, hangs on timing.
    placed = splits.select("split_id", "period", "role", "code", "date", "label", *features).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "split_id", "code"
    )
    rows = materialise(placed.sortWithinPartitions("split_id", "date", "code"), "windows")
    root = f"{shared_dir(spark)}/return-{content_key(rows, list(features), sorted(params.items()))}"
    windows = rows.select("split_id", "period").distinct().orderBy("split_id").collect()  # as many as there are years

    def fit(window) -> str:
        folder = f"{root}/window-{window['split_id']}"
        if not exists(spark, f"{folder}/metrics/_SUCCESS"):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"window-{window['split_id']}")
            spark.sparkContext.setLocalProperty(SIDE_BY_SIDE, str(min(parallel, len(windows))))
            # Broadcast, as an exchange by window leaves one task.
            own = standardise_on_train(rows.where(F.col("split_id") == window["split_id"]), features, broadcast=True)
            models = train_return(own.where(F.col("role") == "train"), features, **params)
            for name, model in zip(("boosted", "linear"), models):
                model.write().overwrite().save(f"{folder}/{name}")
            found = eval_regression(predict_return(models, own.where(F.col("role") == "test")))
            named = found.select(F.lit(window["split_id"]).alias("split_id"), F.lit(window["period"]).alias("period"), "*")
            named.write.mode("overwrite").parquet(f"{folder}/metrics")
        return f"{folder}/metrics"

    if not windows:
        raise ValueError("no window of years to train on")
    with ThreadPoolExecutor(min(parallel, len(windows))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(fit), w) for w in windows]
        return spark.read.parquet(*[j.result() for j in jobs])


def feature_importance(model: Model, features: Sequence[str], spark, k: int = 15) -> DataFrame:
    """The k most important features; as many rows as features, no more."""
    pairs = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    ).limit(k)


# ---- evaluation --------------------------------------------------------------------------------


def score_counts(scored: DataFrame) -> DataFrame:
    """Rows, positives and others per distinct score: all that the measures of a classification need."""
    up = F.col("actual") > 0
    return scored.groupBy(F.col("predicted").alias("score")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(up).alias("pos"), F.count_if(~up).alias("neg")
    )


def auc(scored: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Area under the curve from tie-averaged ranks; 0.5 when one class is missing.

    Rows are combined per distinct score and summed through buckets that the
    scores themselves give, so there is no global sort.
    """
    return _auc(score_counts(scored), group_rows)


def _auc(counts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    counts = running_totals(counts.select("score", "pos", "neg"), [], ["score"], ["pos", "neg"], group_rows)
    total = counts.agg(
        F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)).alias("won"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    return total.select(F.coalesce(F.try_divide(F.col("won"), (F.col("p") * F.col("n")).cast("double")), F.lit(0.5)).alias("auc"))


def eval_classification(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, AUC, squared error of the probability, precision, recall and F1.

    The scores are worked out once: their counts per distinct value are written, and both the matrix and the AUC come
    from those.
    """
    counts = materialise(score_counts(scored), "scores")
    called = F.col("score") > threshold
    total = lambda c, where=None: F.coalesce(F.sum(c if where is None else F.when(where, c)), F.lit(0))
    valued = F.when(F.col("score").isNotNull(), F.col("pos") + F.col("neg"))
    squares = F.col("pos") * (F.col("score") - 1) ** 2 + F.col("neg") * F.col("score") ** 2
    matrix = counts.agg(
        total(F.col("rows")).alias("n"),
        total(F.col("pos"), called).alias("tp"),
        total(F.col("neg"), called).alias("fp"),
        total(F.col("pos"), ~called).alias("fn"),
        (total(F.col("pos"), called) + total(F.col("neg"), ~called)).alias("hits"),
        F.try_divide(F.sum(squares), F.sum(valued)).alias("mse"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return matrix.select(
        "n",
        ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        "mse",
        ratio(tp, tp + F.col("fp")).alias("precision"),
        ratio(tp, tp + F.col("fn")).alias("recall"),
        ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    ).withColumn("auc", _auc(counts).scalar())


def eval_regression(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors, direction accuracy, correlation and win rate of a long-only signal, against a baseline."""
    y, p = F.col("actual"), F.col("predicted")
    pairs = scored.where(y.isNotNull() & p.isNotNull())
    kept = F.when(p > 0, y).otherwise(0.0)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop("actual").alias("_variance"),
        F.avg((F.signum(y) == F.signum(p)).cast("int")).alias("accuracy"),
        safe_corr(y, p).alias("ic"),
        F.avg((kept > 0).cast("int")).alias("win_rate"),
    ]
    if "baseline" in scored.columns:
        b = F.col("baseline")
        measures.append(F.avg((y - b) * (y - b)).alias("baseline_mse"))
    out = pairs.groupBy(*by).agg(*measures).withColumn("r2", 1 - F.try_divide("mse", "_variance"))
    if "baseline" in scored.columns:
        out = out.withColumn("baseline_r2", 1 - F.try_divide("baseline_mse", "_variance"))
    return out.drop("_variance")


def split_metrics_mean(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in ("r2", "accuracy", "ic", "win_rate")])


def holdout(frame: DataFrame, level: float = 0.8, code: str | None = None, least: int = 10) -> DataFrame:
    """Rows after the date quantile; one symbol only if it has enough of them."""
    cutoff = date_quantiles(frame, [level]).scalar()
    rows = frame.where(day_number() > cutoff[0])
    if code is None:
        return rows
    own = rows.where(F.col("code") == code)
    enough = own.agg(F.count(F.lit(1)) >= least).scalar()
    return rows.where((F.col("code") == code) | ~enough)


def score_holdout(model: Model, frame: DataFrame, features: Sequence[str], code: str | None = None) -> DataFrame:
    """Holdout scored, with the price the probability implies."""
    rows = holdout(frame, 0.8, code)
    scored = model.transform(_features(rows, features))
    probability = vector_to_array("probability")[1]
    return scored.select("date", "code", "close", probability.alias("predicted"), F.col("label").alias("actual")).withColumn(
        "implied_close", implied_close()
    )


def implied_close() -> Column:
    return F.col("close") * (1 + (F.col("predicted") - 0.5) * 0.02)


def training_log(metrics: DataFrame, splits: DataFrame, model_name: str, features: Sequence[str], params: dict) -> DataFrame:
    """Metrics, features, split dates and provenance as one JSON record."""
    date_of = lambda f, s: f(F.when(F.col("split") == s, F.col("date"))).cast("string")
    info = splits.agg(
        date_of(F.max, "train").alias("train_end"),
        date_of(F.min, "validation").alias("validation_start"),
        date_of(F.max, "validation").alias("validation_end"),
        date_of(F.min, "test").alias("test_start"),
        date_of(F.max, "test").alias("test_end"),
    )
    record = F.struct(
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(len(features)).alias("feature_count"),
        *[F.round(c, 4).alias(c) for c in ("accuracy", "auc", "precision", "recall", "f1")],
        F.round("mse", 6).alias("mse"),
        F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"),
        F.lit("chronological split, no shuffle").alias("split_policy"),
        info.select(F.struct("*")).scalar().alias("split_info"),
    )
    return metrics.select(F.lit(model_name).alias("model"), F.to_json(record).alias("record"))


LOG_SCHEMA = "auc double, accuracy double, precision double, recall double, f1 double"


def model_comparison(logs: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """One row per model from its log record, else from the fallback table."""
    parsed = logs.select("model", F.from_json("record", LOG_SCHEMA).alias("m")).select("model", "m.*")
    complete = parsed.dropna(subset=["auc", "accuracy"])
    if fallback is None:
        return complete
    rest = fallback.select(*complete.columns).join(complete.select("model"), "model", "left_anti")
    return complete.unionByName(rest)


def model_overview(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.avg("accuracy").alias("average_accuracy"), F.avg("auc").alias("average_auc"))
