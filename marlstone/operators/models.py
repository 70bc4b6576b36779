"""Preprocessing of folds, models, calibration, tuning and the symbolic surrogate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.store import stored
from marlstone.operators import boosting, glm, spline_net


def robust_scale(df: DataFrame, columns: list[str], fit_on: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(x - median) / IQR with exact, linearly interpolated quantiles of the rows `fit_on`; an IQR of zero counts as one."""
    by = by or []
    own = df if fit_on is None else df.where(fit_on)
    stats = own.groupBy(*by).agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}") for c in columns))
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"_{c}")[1]) / F.coalesce(F.nullif(F.col(f"_{c}")[2] - F.col(f"_{c}")[0], F.lit(0.0)), F.lit(1.0)) for c in columns}
    return joined.withColumns(scaled).drop(*(f"_{c}" for c in columns))


def balanced(df: DataFrame, label: str = "y", weight: str | None = "w") -> DataFrame:
    """Rows with _weight, the sample weight times the balance of its class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*").alias("_t"), F.count_distinct(label).alias("_k"))
    own = F.col(weight) if weight else F.lit(1.0)
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("_weight", own * F.col("_t") / (F.col("_k") * F.col("_c"))).drop("_c", "_t", "_k")


@dataclass(frozen=True)
class Spec:
    """A model's name, how to make its estimator from parameters, and the parameters' grid."""

    name: str
    make: Callable[..., object]
    defaults: dict = field(default_factory=dict)
    grid: tuple[dict, ...] = ()
    columns: Callable[[list[str]], list[str]] = lambda names: names


def _logistic(l1: float = 0.0, c: float = 1.0, total: float = 1000.0):
    """total: the sum of the weights of the rows it is fitted on, which the penalty is set against."""
    return LogisticRegression(regParam=1 / (c * total), elasticNetParam=l1, standardization=False, maxIter=100)


def _forest(trees: int = 500, depth: int = 10, leaf: int = 5, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)


#: The additive spline is a logistic model; networks of splines are trained by steps of their own.
REGISTRY = {
    "ar_logistic": Spec("ar_logistic", _logistic, columns=lambda names: [n for n in names if "lag" in n]),
    "logistic": Spec("logistic", _logistic, grid=({"c": 0.1}, {"c": 1.0}, {"c": 1.0, "l1": 1.0})),
    "random_forest": Spec("random_forest", _forest, grid=({"depth": 5}, {"depth": 10})),
    "boosted": Spec("boosted", boosting.Boost, grid=({"depth": 2}, {"depth": 3})),
    "spline": Spec("spline", _logistic, defaults={"c": 0.5}),
    "spline_network": Spec("spline_network", spline_net.Net, grid=({"hidden": 3}, {"hidden": 5})),
}


def list_models() -> list[str]:
    return sorted(REGISTRY)


def create_model(name: str, **params):
    if name not in REGISTRY:
        raise KeyError(f"no model {name!r}; there are {', '.join(list_models())}")
    return REGISTRY[name].make(**REGISTRY[name].defaults | params)


def splines(df: DataFrame, columns: list[str], knots: tuple[float, ...] = (-1.0, -0.5, 0.0, 0.5, 1.0)) -> tuple[DataFrame, list[str]]:
    """Columns squashed by tanh and spread over hat functions: the inputs of an additive spline model."""
    out = {}
    for c in columns:
        for i, k in enumerate(knots):
            out[f"{c}__{i}"] = F.greatest(1 - F.abs(F.tanh(F.col(c)) - k) / 0.5, F.lit(0.0))
    return df.withColumns(out), list(out)


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], name: str = "logistic", label: str = "y", weight: str | None = "w", **params) -> DataFrame:
    """`test` with raw (the margin) and p_up by one of MLlib's models of `train`; rows with missing inputs do not train."""
    own = REGISTRY[name].columns(columns)
    if name == "spline":
        (train, own), (test, _) = splines(train, columns), splines(test, columns)
    assembler = VectorAssembler(inputCols=own, outputCol="_x", handleInvalid="skip")
    ready = assembler.transform(balanced(train, label, weight))
    if REGISTRY[name].make is _logistic and "total" not in params:
        params = params | {"total": ready.agg(F.sum("_weight")).first()[0] or 1.0}
    fitted = create_model(name, **params).setFeaturesCol("_x").setLabelCol(label).setWeightCol("_weight").fit(ready)
    scored = fitted.transform(assembler.transform(test))
    p, raw = vector_to_array("probability")[1], vector_to_array("rawPrediction")[1]
    return scored.withColumn("p_up", p).withColumn("raw", raw).select(*test.columns, "raw", "p_up")


def macro_f1(scored: DataFrame, by: list[str], hit, label: str = "y", weight: str = "w") -> DataFrame:
    """Weighted macro F1 of a predicted class by group."""
    y, w = F.col(label), F.col(weight)
    sums = {f"_{a}{b}": F.sum(F.when((y == a) & (hit == b), w).otherwise(0.0)).alias(f"_{a}{b}") for a in (0, 1) for b in (0, 1)}
    df = scored.groupBy(*by).agg(*sums.values())
    n00, n01, n10, n11 = (F.col(f"_{k}") for k in ("00", "01", "10", "11"))
    zero = F.lit(0.0)
    parts = [F.coalesce(2 * tp / F.nullif(2 * tp + n01 + n10, zero), zero) for tp in (n00, n11)]
    return df.select(*by, ((parts[0] + parts[1]) / 2).alias("f1"))


def importance(rows: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """(split_id, feature, mda): mean fall of the weighted macro F1 of a logistic model when a feature's values are dealt anew,
    over the inner folds of each split, z-scored over the features of the split.

    `rows` are events of (split_id, fold, role, event_pos, y, w, columns): those that validate a fold and those that train for
    it. All folds of all splits are scaled, fitted and scored together; folds that train on fewer than 20 rows or validate fewer
    than 10 are left out.
    """
    sizes = rows.groupBy("split_id", "fold").agg(F.count_if(F.col("role") == "train").alias("_a"), F.count_if(F.col("role") == "validate").alias("_b")).where("_a >= 20 AND _b >= 10")
    used = rows.where("role IN ('train', 'validate')").join(F.broadcast(sizes.select("split_id", "fold")), ["split_id", "fold"])  # a row a fold
    scaled = robust_scale(used, columns, F.col("role") == "train", by=["split_id", "fold"])
    scaled = scaled.withColumn("key", F.concat_ws("/", "split_id", "fold")).withColumn("x", F.array(*columns))
    classes = scaled.where("role = 'train'").groupBy("key").agg(F.count("*").alias("_t"), F.count_if(F.col("y") == 1).alias("_o"))
    balance = F.col("_t") / (2 * F.when(F.col("y") == 1, F.col("_o")).otherwise(F.col("_t") - F.col("_o")))
    ready = stored(scaled.join(F.broadcast(classes), "key").select("key", "split_id", "fold", "role", "event_pos", "y", "w", "x", (F.col("w") * balance).alias("weight")))
    beta = glm.fit(ready.where("role = 'train'"), "key", "x", "y", "weight")
    tests = stored(glm.margin(ready.where("role = 'validate'"), "key", "x", beta))
    base = macro_f1(tests, ["split_id", "fold"], (F.col("raw") > 0).cast("int")).withColumnRenamed("f1", "base")
    spark = rows.sparkSession
    slopes = spark.createDataFrame([(k, i, float(v)) for k, b in beta.items() for i, v in enumerate(b[:-1])], "key string, number int, slope double")  # splits x folds x features
    long_ = tests.select("key", "split_id", "fold", "event_pos", "y", "w", "raw", F.posexplode("x").alias("number", "v"))
    folds = Window.partitionBy("key", "number")
    order = F.xxhash64("event_pos", "number", F.lit(seed))
    a = long_.withColumn("_k", F.row_number().over(folds.orderBy("event_pos")))
    b = long_.select("key", "number", F.col("v").alias("other"), F.row_number().over(folds.orderBy(order, "event_pos")).alias("_k"))
    dealt = a.join(b, ["key", "number", "_k"]).join(F.broadcast(slopes), ["key", "number"])
    worse = macro_f1(dealt, ["split_id", "fold", "number"], (F.col("raw") + F.col("slope") * (F.col("other") - F.col("v")) > 0).cast("int"))
    falls = worse.join(base, ["split_id", "fold"]).groupBy("split_id", "number").agg(F.avg(F.col("base") - F.col("f1")).alias("fall"))
    every = Window.partitionBy("split_id")
    spread = F.stddev_pop("fall").over(every)
    value = F.when(spread > 0, (F.col("fall") - F.avg("fall").over(every)) / spread).otherwise(0.0)
    return falls.select("split_id", F.element_at(F.array(*map(F.lit, columns)), F.col("number") + 1).alias("feature"), value.alias("mda"))


def chosen_features(scores: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """(split_id, selected): features with a positive score, at most a share of all but `least` at least; the best `least` where
    fewer are positive. Names are in alphabetical order."""
    every = Window.partitionBy("split_id")
    df = scores.withColumn("_n", F.count("*").over(every)).withColumn("_good", F.count_if(F.col("mda") > 0).over(every)).withColumn("_k", F.row_number().over(every.orderBy(F.desc("mda"), "feature")))
    most = F.greatest(F.floor(F.col("_n") * share), F.lit(least))
    kept = F.when(F.col("_good") < least, F.col("_k") <= least).otherwise((F.col("mda") > 0) & (F.col("_k") <= most))
    return df.where(kept).groupBy("split_id").agg(F.array_sort(F.collect_list("feature")).alias("selected"))


def calibrate(scored: DataFrame, by: str, method: str = "platt", label: str = "y", value: str = "raw", steps: int = 60) -> dict[str, tuple[float, float]]:
    """(slope, intercept) of the calibration curve of each group of margins: `platt`, free; `temperature`, a positive divisor
    within 0.05 and 20 and no shift; `vector`, a divisor in those bounds and a shift within -5 and 5 before it."""
    rows = stored(scored.select(F.col(by).cast("string").alias("g"), F.array(value).alias("x"), F.col(label).alias("y")))
    if method == "platt":
        return {g: (float(b[0]), float(b[1])) for g, b in glm.fit(rows, "g", "x", "y", c=None).items()}
    groups = [r[0] for r in rows.select("g").distinct().collect()]  # a row a group
    spark = scored.sparkSession
    low, high = np.log(0.05), np.log(20.0)

    def losses(tried: dict[str, list[tuple[float, float]]]) -> dict[str, list[float]]:
        table = spark.createDataFrame([(g, i, float(t), float(s)) for g, own in tried.items() for i, (t, s) in enumerate(own)], "g string, i int, t double, s double")
        z = (F.col("x")[0] + F.col("s")) / F.exp("t")
        loss = F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("y") * z)
        out: dict[str, list[float]] = {g: [np.inf] * len(own) for g, own in tried.items()}
        for r in rows.join(F.broadcast(table), "g").groupBy("g", "i").agg(loss.alias("v")).collect():  # a row a group and trial
            out[r.g][r.i] = r.v
        return out

    if method == "vector":  # the free curve, where its divisor is in bounds
        free = glm.fit(rows, "g", "x", "y", c=None)
        inside = {g: (float(b[0]), float(b[1])) for g, b in free.items() if 0.05 <= b[0] <= 20 and abs(b[1] / b[0]) <= 5}
    else:
        inside = {}
    best = {g: (0.0, 0.0) for g in groups if g not in inside}
    width, shift = (high - low) / 2, 5.0 if method == "vector" else 0.0
    for _ in range(steps if best else 0):  # a grid that closes in on the least loss
        tried = {g: [(min(max(t + i * width, low), high), min(max(s + j * shift, -5.0), 5.0)) for i in (-1, -0.5, 0, 0.5, 1) for j in ((-1, 0, 1) if shift else (0,))] for g, (t, s) in best.items()}
        found = losses(tried)
        best = {g: tried[g][int(np.argmin(found[g]))] for g in best}
        width, shift = width * 0.6, shift * 0.6
        if width < 1e-6:
            break
    return inside | {g: (float(np.exp(-t)), float(s * np.exp(-t))) for g, (t, s) in best.items()}


def calibrated(df: DataFrame, by: str, curves: dict[str, tuple[float, float]], value: str = "raw", name: str = "p_cal") -> DataFrame:
    """`df` with the calibrated probability of each row by its group's curve."""
    return glm.margin(df.withColumn("_x", F.array(value)), by, "_x", {g: np.array(c) for g, c in curves.items()}, "_z").withColumn(name, glm.sigmoid(F.col("_z"))).drop("_x", "_z")


#: Which curve calibrates a model's margins.
CURVES = {"spline": "vector"}


#: Primitives of the symbolic surrogate as SQL of an argument (fixed values).
PRIMITIVES = {
    "x": "{0}", "x^2": "({0})*({0})", "x^3": "({0})*({0})*({0})", "exp": "exp({0})", "sin": "sin({0})", "cos": "cos({0})", "tanh": "tanh({0})", "abs": "abs({0})",
    "log": "ln(abs({0}) + 0.01)", "sqrt": "sqrt(abs({0}))", "atan": "atan({0})", "gaussian": "exp(-({0})*({0}))", "sigmoid": "1/(1+exp(-({0})))", "1/x": "1/({0} + sign({0})*0.01 + 0.001)",
}


def symbolic_edges(df: DataFrame, columns: list[str], target: str, scales: tuple[float, ...] = (0.5, 1.0, 2.0), shifts: tuple[float, ...] = (-0.5, 0.0, 0.5)) -> DataFrame:
    """(feature, primitive, scale, shift, slope, intercept, r2): each feature's best primitive of tanh of it, over the whole grid of
    scales and shifts, in one pass: a row of the grid for each row and feature, summed by its place in the grid."""
    grid = F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(b).alias("shift")) for s in scales for b in shifts))
    inputs = F.array(*(F.struct(F.lit(c).alias("feature"), F.tanh(F.col(c)).alias("t")) for c in columns))
    rows = df.select(F.col(target).alias("y"), F.explode(inputs).alias("f")).select("y", "f.*", F.explode(grid).alias("g")).select("y", "feature", "g.*", (F.col("g.scale") * F.col("t") + F.col("g.shift")).alias("z"))
    values = F.array(*(F.struct(F.lit(n).alias("primitive"), F.expr(sql.format("z")).alias("v")) for n, sql in PRIMITIVES.items()))
    long_ = rows.select("y", "feature", "scale", "shift", F.explode(values).alias("p")).select("y", "feature", "scale", "shift", "p.*")
    fits = long_.groupBy("feature", "primitive", "scale", "shift").agg(F.regr_slope("y", "v").alias("slope"), F.regr_intercept("y", "v").alias("intercept"), F.regr_r2("y", "v").alias("r2")).where("r2 IS NOT NULL")
    order = Window.partitionBy("feature").orderBy(F.desc("r2"), "primitive", "scale", "shift")
    return fits.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").select("feature", "primitive", "scale", "shift", "slope", "intercept", "r2")


def formula(edges: DataFrame, prune: float = 0.01) -> str:
    """The sum of the edges as one SQL expression; edges of little use are left out."""
    terms = []
    for r in edges.where(F.col("r2") >= prune).orderBy("feature").collect():  # a row a feature
        terms.append(f"({r.slope} * {PRIMITIVES[r.primitive].format(f'({r.scale}*tanh(`{r.feature}`)+{r['shift']})')} + {r.intercept})")
    return " + ".join(terms) or "0.0"


def prepared(df: DataFrame, columns: list[str], order: str = "ts", share: float = 0.8, by: str = "symbol") -> DataFrame:
    """`df` with inputs (x - median) / IQR squashed by tanh, medians of the first `share` of each series' rows in order, and part:
    train or test."""
    place = F.percent_rank().over(Window.partitionBy(by).orderBy(order))
    parted = df.withColumn("part", F.when(place < share, "train").otherwise("test"))
    scaled = robust_scale(parted, columns, F.col("part") == "train")
    return scaled.withColumns({c: F.tanh(c) for c in columns})


def extraction_split(metrics: DataFrame, choice: str | int = "best") -> DataFrame:
    """(split_id, f1): the split to explain, with the best mean F1 (the first of equals), the last one, or one by number."""
    means = metrics.groupBy("split_id").agg(F.avg("macro_f1").alias("f1")).where("f1 IS NOT NULL")
    order = {"best": [F.desc("f1"), F.asc("split_id")], "last": [F.desc("split_id")]}.get(choice, [F.desc(F.col("split_id") == choice), F.desc("f1"), F.asc("split_id")])
    return means.orderBy(*order).limit(1)


def extraction_features(selected: DataFrame, split: DataFrame, most: int | None = None) -> DataFrame:
    """(feature, frequency): the features that the split selected; of more than `most`, those selected by most splits, ties in
    alphabetical order."""
    total = selected.agg(F.count("*").alias("_t"))  # one row
    all_ = selected.select("split_id", F.explode("selected").alias("feature"))
    frequency = all_.groupBy("feature").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).select("feature", (F.col("_n") / F.col("_t")).alias("frequency"))
    own = all_.join(F.broadcast(split.select("split_id")), "split_id").select("feature").join(frequency, "feature")
    return own.orderBy(F.desc("frequency"), "feature").limit(most) if most else own


def sensitivity(df: DataFrame, expression: str, columns: list[str], step: float = 0.01) -> DataFrame:
    """(feature, slope, effect, change): central differences of a formula at the means, for one standard deviation, and of the
    probability then."""
    stats = df.agg(*(F.avg(c).alias(c) for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    points = []
    for c in columns:
        for s in (1, -1, 0):
            moved = [(F.col(k) + s * step * F.col(f"_s_{k}") if k == c else F.col(k)).alias(k) for k in columns]
            points.append(F.struct(F.lit(c).alias("feature"), F.lit(s).alias("side"), F.col(f"_s_{c}").alias("_s"), *moved))
    values = stats.select(F.explode(F.array(*points)).alias("p")).select("p.*").select("feature", "side", "_s", F.expr(expression).alias("v"))
    row = values.groupBy("feature").agg(*(F.max(F.when(F.col("side") == s, F.col("v"))).alias(n) for s, n in ((1, "_up"), (-1, "_down"), (0, "_at"))), F.max("_s").alias("_s"))
    slope = (F.col("_up") - F.col("_down")) / F.nullif(2 * step * F.col("_s"), F.lit(0.0))
    p = glm.sigmoid(F.col("_at"))
    return row.select("feature", slope.alias("slope"), (slope * F.col("_s")).alias("effect"), (slope * F.col("_s") * p * (1 - p)).alias("change"))


def marginal_effects(df: DataFrame, expression: str, columns: list[str], points: int = 100) -> DataFrame:
    """(feature, x, decision): the formula along each feature from its 5 % to its 95 % quantile, the others at their medians."""
    stats = df.agg(*(F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(c) for c in columns))

    def sweep(own: str) -> Column:
        def at(i: Column) -> Column:
            return F.struct(F.lit(own).alias("feature"), *((F.col(k)[0] + (F.col(k)[2] - F.col(k)[0]) * i / (points - 1) if k == own else F.col(k)[1]).alias(k) for k in columns))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    sweeps = list(map(sweep, columns))
    rows = stats.select(F.explode(F.concat(*sweeps)).alias("p")).select("p.*")
    x = F.element_at(F.array(*columns), F.array_position(F.array(*map(F.lit, columns)), F.col("feature")).cast("int"))
    return rows.select("feature", x.alias("x"), F.expr(expression).alias("decision"))


def sequences(rows: DataFrame, columns: list[str], length: int = 14, by: str = "split_id", order: str = "event_pos") -> DataFrame:
    """`rows` with `sequence`, the vectors of the last `length` rows, oldest first; rows without as many before them are left out."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(-(length - 1), 0)
    return rows.withColumn("sequence", F.collect_list(F.array(*columns)).over(window)).where(F.size("sequence") == length)
