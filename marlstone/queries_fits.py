"""Registered queries of fitted models, selection, calibration and the symbolic surrogate: results that no SQL expresses, but for
the tables that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.store import stored
from marlstone.operators import cv, diagnose, evaluate, features, kernels, models
from marlstone.plans import flows
from marlstone.queries import FEATS, PREDS, _aligned, _feats, _preds, query
from marlstone.sources import bars as source

COLUMNS = [*features.TA, "shannon_entropy", "gaussian_entropy", "negentropy", "variance_ratio", "jarque_bera", *(f"log_returns_lag{k}" for k in features.LAGS)]


def _roles(spark, d):
    """The aligned set and the roles of its events in all 28 splits."""
    df = stored(_aligned(spark, d))
    ev = cv.events(df.select("symbol", F.col("ts").alias("t0"), "t1"))
    numbered = df.drop("event_pos").join(ev.select("event_pos", "symbol", F.col("t0").alias("ts")), ["symbol", "ts"])
    return stored(numbered), stored(cv.roles(ev))


def _run(spark, d, name, **params):
    df, found = _roles(spark, d)
    return flows.run(spark, flows.folds(df, found, COLUMNS), COLUMNS, name, **params)


@query()
def model_logistic(spark, d):
    return _run(spark, d, "logistic")


@query()
def model_ar_logistic(spark, d):
    return _run(spark, d, "ar_logistic")


@query()
def model_spline(spark, d):
    return _run(spark, d, "spline")


@query()
def model_spline_network(spark, d):
    """Networks of 28 splits and five seeds, trained together, a job an epoch, until their losses rise."""
    return _run(spark, d, "spline_network", seeds=SEEDS)


#: Trees of the registered queries: MLlib grows a forest in a job a level for each of 28 splits; boosted trees of all splits and
#: SEEDS seeds take a job a level together.
FOREST_TREES, BOOSTED_TREES, SEEDS = 100, 50, 5


@query()
def model_forest(spark, d):
    return _run(spark, d, "random_forest", trees=FOREST_TREES)


@query()
def model_boosted(spark, d):
    """Trees for each of 28 splits and five seeds, all grown together until their losses rise."""
    return _run(spark, d, "boosted", trees=BOOSTED_TREES, seeds=SEEDS)


def _inner(spark, d):
    df, found = _roles(spark, d)
    inner = cv.purged_folds(found, 3, share=0.01).select("split_id", "event_pos", "fold", "role")
    return df.dropna(subset=COLUMNS).withColumn("y", (F.col("bin") > 0).cast("int")).join(inner, "event_pos")


@query()
def mda_importance(spark, d):
    return models.importance(_inner(spark, d), COLUMNS)


@query()
def mda_selection(spark, d):
    return models.chosen_features(stored(models.importance(_inner(spark, d), COLUMNS)))


@query()
def cpcv_selected(spark, d):
    """Predictions of the logistic model on the features that each split selects."""
    df, found = _roles(spark, d)
    inner = cv.purged_folds(found, 3, share=0.01).select("split_id", "event_pos", "fold", "role")
    rows = df.dropna(subset=COLUMNS).withColumn("y", (F.col("bin") > 0).cast("int")).join(inner, "event_pos")
    selected = stored(models.chosen_features(models.importance(rows, COLUMNS)))
    return flows.run(spark, flows.folds(df, found, COLUMNS), COLUMNS, "logistic", selected=selected)


@query()
def cpcv_summary(spark, d):
    """The ranking of the three logistic kinds and of spline networks over all splits and paths."""
    df, found = _roles(spark, d)
    ready = stored(flows.folds(df, found, COLUMNS))
    first, *others = (flows.run(spark, ready, COLUMNS, n) for n in ("logistic", "ar_logistic", "spline", "spline_network"))
    for more in others:
        first = first.unionByName(more)
    all_ = stored(first)
    return flows.analyse(all_, cv.path_map(spark))["summary"]


def _orders(spark, d):
    df, found = _roles(spark, d)
    own = df.join(found.where("role = 'train'").select("split_id", "event_pos"), "event_pos").select(F.col("split_id").cast("string").alias("symbol"), "ts", F.col("atr").alias("x"))
    return kernels.optimal_d(own.where("x IS NOT NULL")).select(F.col("symbol").cast("int").alias("split_id"), "d")


@query()
def ffd_by_split(spark, d):
    """The order of differencing of each split's train events."""
    return _orders(spark, d)


def _calibrated(spark, d, method):
    df = stored(_preds(spark, d)).withColumn("raw", F.log(F.col("p_up") / (1 - F.col("p_up")))).withColumnRenamed("y_true", "y")
    df = df.withColumn("key", F.concat_ws("/", "model", "split_id"))
    return models.calibrated(df, "key", models.calibrate(df, "key", method)).select("model", "split_id", "seed", "ts", "p_up", "p_cal")


@query()
def platt_calibration(spark, d):
    return _calibrated(spark, d, "platt")


@query()
def temperature_calibration(spark, d):
    return _calibrated(spark, d, "temperature")


@query()
def vector_calibration(spark, d):
    return _calibrated(spark, d, "vector")


@query()
def tuned_penalty(spark, d):
    """The mean log loss of each penalty over the purged inner folds of all splits, all fitted together."""
    df, found = _roles(spark, d)
    inner = cv.purged_folds(found, 5).select("split_id", "event_pos", "fold", "role")
    return flows.tuned(df.dropna(subset=COLUMNS).withColumn("y", (F.col("bin") > 0).cast("int")).join(inner, "event_pos"), COLUMNS)


def _symbolic(spark, d):
    """All series: inputs of a day and the return of the next."""
    df = _feats(spark, d).dropna().withColumn("y", F.lead("log_returns").over(features.Window.partitionBy("symbol").orderBy("ts"))).dropna()
    return stored(models.prepared(df, FEATS, "ts"))


@query()
def symbolic_edges(spark, d):
    df = stored(models.robust_scale(_feats(spark, d).dropna(), FEATS))
    return models.symbolic_edges(df.withColumn("y", F.col("realized_vol")), [x for x in FEATS if x != "realized_vol"], "y")


@query()
def symbolic_sensitivity(spark, d):
    df = _symbolic(spark, d)
    expression = models.formula(models.symbolic_edges(df.where("part = 'train'"), FEATS, "y"), 0.0)
    return models.sensitivity(df, expression, FEATS)


@query()
def marginal_effects(spark, d):
    df = _symbolic(spark, d)
    expression = models.formula(models.symbolic_edges(df.where("part = 'train'"), FEATS, "y"), 0.0)
    return models.marginal_effects(df, expression, FEATS)


@query()
def symbolic_accuracy(spark, d):
    """Share of rows, by part, whose sign the pruned formula gets right."""
    df = _symbolic(spark, d)
    expression = models.formula(models.symbolic_edges(df.where("part = 'train'"), FEATS, "y"), 0.0)
    return df.groupBy("part").agg(F.count("*").alias("n"), F.avg(((F.expr(expression) > 0) == (F.col("y") > 0)).cast("double")).alias("accuracy"))


def _selected(spark, d):
    """What each split selects, by the fitted importance."""
    return stored(models.chosen_features(stored(models.importance(_inner(spark, d), COLUMNS))))


@query()
def feature_stability(spark, d):
    return evaluate.feature_stability(_selected(spark, d))


@query()
def stability_table(spark, d):
    names = spark.createDataFrame([(x,) for x in COLUMNS], "feature string")  # the names of all inputs, selected or never
    return diagnose.stability_table(evaluate.feature_stability(_selected(spark, d)).drop("stable"), names)


@query()
def ffd_stability(spark, d):
    """Spread over the splits of the orders that ffd_by_split finds."""
    return evaluate.ffd_stability(_orders(spark, d).select("split_id", F.create_map(F.lit("atr"), "d").alias("ffd")))


SPLIT_F1 = """sf AS (SELECT split_id, avg(f1) AS f1 FROM (SELECT model, split_id, (coalesce(2 * a / nullif(2 * a + b + c, 0), 0) + coalesce(2 * d / nullif(2 * d + b + c, 0), 0)) / 2 AS f1 FROM (SELECT model, split_id,
    count(*) FILTER (y_true = 0 AND p_up < 0.5)::DOUBLE AS a, count(*) FILTER (y_true = 0 AND p_up >= 0.5)::DOUBLE AS b, count(*) FILTER (y_true = 1 AND p_up < 0.5)::DOUBLE AS c, count(*) FILTER (y_true = 1 AND p_up >= 0.5)::DOUBLE AS d FROM av GROUP BY 1, 2)) GROUP BY 1)"""


@query(f"{PREDS}, {SPLIT_F1} SELECT split_id, round(f1, 6) AS f1 FROM sf ORDER BY round(f1, 12) DESC, split_id LIMIT 1")
def extraction_split(spark, d):
    return models.extraction_split(evaluate.split_metrics(_preds(spark, d)))


@query()
def extraction_features(spark, d):
    """The five features of the chosen split that most splits select, by the fitted importance."""
    split = models.extraction_split(evaluate.split_metrics(_preds(spark, d)))
    return models.extraction_features(_selected(spark, d), split, 5)
