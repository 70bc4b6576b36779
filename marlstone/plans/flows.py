"""Whole flows: bars to aligned sets, predictions to ranked models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.store import stored
from marlstone.operators import boosting, cv, evaluate, features, glm, kernels, labeling, models, spline_net
from marlstone.sources import bars as source


@dataclass(frozen=True)
class Labels:
    """Parameters of events, barriers and weights."""

    multiplier: float = 1.0
    pt: float = 1.5
    sl: float = 1.5
    num_days: int = 10
    min_return: float = 0.02
    oldest: float = 0.4
    drop_zero: bool = True


def dataset(daily: DataFrame, p: Labels = Labels()) -> DataFrame:
    """Bars to an aligned set (symbol, ts, event_pos, t1, bin, ret, w, features), as one lazy plan."""
    vol = labeling.daily_volatility(daily)
    bins = labeling.triple_barrier(vol, labeling.cusum_events(vol, p.multiplier), p.pt, p.sl, p.num_days, p.min_return)
    bins = labeling.drop_rare(bins, drop_zero=p.drop_zero).cache()  # one row an event
    weights = labeling.sample_weights(daily, bins, p.oldest).select("symbol", F.col("t0").alias("ts"), "w")
    matrix = features.technical(daily).join(features.statistical(daily), ["symbol", "ts"]).join(features.lags(daily), ["symbol", "ts"])
    return features.align(matrix, bins.withColumnRenamed("t0", "ts"), weights)


def matrix(daily: DataFrame, which: tuple[str, ...] = features.MATH, sources: dict[str, DataFrame] | None = None, categories: dict[str, bool] | None = None) -> DataFrame:
    """The whole feature matrix in its order: technical, the mathematical ones of `which`, external of the sources at hand and
    lagged features."""
    df = features.technical(daily)
    statistics = [x for x in which if x in ("shannon_entropy", "negentropy", "variance_ratio", "jarque_bera")]
    if statistics:
        df = df.join(features.statistical(daily).select("symbol", "ts", *statistics), ["symbol", "ts"])
    for names, make in ((("lz_complexity",), kernels.lz_complexity), (("hurst",), kernels.hurst), (("sadf",), kernels.sadf), (("smt_poly1", "smt_exp"), kernels.smt)):
        wanted = [x for x in names if x in which]
        if wanted:
            df = df.join(make(daily).select("symbol", "ts", *wanted), ["symbol", "ts"])
    external = []
    if sources is not None:
        wanted = features.chosen(**(categories or {}))
        external = [x[0] for x in wanted]
        df = df.join(features.external(daily, sources, wanted), ["symbol", "ts"])
    df = df.join(features.lags(daily), ["symbol", "ts"])
    return df.select("symbol", "ts", *features.TA, *[x for x in features.MATH if x in which], *external, *(f"log_returns_lag{k}" for k in features.LAGS))


def synthetic_predictions(spark: SparkSession, sf_dir: str, bins: DataFrame, models_: int = 3, seeds: int = 2) -> DataFrame:
    """Predictions that follow from ids alone, for every model, seed and test event: a stand-in for fitted models."""
    own = cv.roles(cv.events(bins)).where("role = 'test'").select("split_id", "event_pos", "group_id")
    rows = cv.events(bins).select("event_pos", "t0", "ret", "bin")
    df = own.join(rows, "event_pos").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(models_ - 1)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    noise = F.pmod(F.col("event_pos") * 7919 + F.col("split_id") * 104729 + F.col("m") * 1299709 + F.col("seed") * 15485863, F.lit(1000))
    p = (noise + 0.5) / 1000 * 0.9 + 0.05
    return df.select(F.concat(F.lit("m"), F.col("m")).alias("model"), "split_id", "seed", "group_id", F.col("t0").alias("ts"), (F.col("bin") > 0).cast("int").alias("y_true"), p.alias("p_up"), "ret")


def folds(aligned: DataFrame, found: DataFrame, columns: list[str], fit_share: float = 0.7, hold_share: float = 0.85) -> DataFrame:
    """Events of every split (split_id, part, y, w, ...): test, and the train events in order of time as fit, stop and
    calibrate. Columns are scaled on the train events; y is 1 for an upward label; events with missing inputs are left out."""
    df = aligned.dropna(subset=columns).join(found.select("split_id", "event_pos", "role", "group_id"), "event_pos").where("role IN ('train', 'test')")
    df = df.withColumn("y", (F.col("bin") > 0).cast("int"))
    every = Window.partitionBy("split_id", "role")
    place = F.row_number().over(every.orderBy("event_pos")) - 1
    total = F.count("*").over(every)
    part = F.when(F.col("role") == "test", "test").when(place < F.floor(total * fit_share), "fit").when(place < F.floor(total * hold_share), "stop").otherwise("calibrate")
    return models.robust_scale(df.withColumn("part", part), columns, F.col("role") == "train", by=["split_id"])


def run(spark: SparkSession, ready: DataFrame, columns: list[str], name: str = "logistic", seeds: int = 1, selected: DataFrame | None = None, threads: int = 8, **params) -> DataFrame:
    """Calibrated test predictions (model, split_id, seed, group_id, ts, y_true, p_up, ret) of one model over all splits of
    folds(). Logistic kinds, boosting and spline networks fit all splits together; forests, fitted by MLlib, several splits at a time. `selected` (split_id,
    selected) says which columns each split's model gets; logistic kinds and networks see zeros for the others. Boosting and networks
    stop by the events of `stop`; other models train on them too."""
    names = models.REGISTRY[name].columns(columns)
    if name == "spline":
        ready, names = models.splines(ready, columns)
    if models.REGISTRY[name].make is models._logistic:
        x = F.array(*names)
        if selected is not None and name != "ar_logistic":
            ready = ready.join(F.broadcast(selected), "split_id")  # a row a split
            x = F.array(*(F.when(F.array_contains("selected", n.split("__")[0]), F.col(n)).otherwise(0.0) for n in names))
        counts = ready.where("part IN ('fit', 'stop')").groupBy("split_id").agg(F.count("*").alias("_t"), F.count_if(F.col("y") == 1).alias("_o"))
        balance = F.col("_t") / (2 * F.when(F.col("y") == 1, F.col("_o")).otherwise(F.col("_t") - F.col("_o")))
        rows = stored(ready.withColumn("x", x).join(F.broadcast(counts), "split_id").select("split_id", "part", "group_id", "ts", "y", "x", "ret", (F.col("w") * balance).alias("weight")))
        beta = glm.fit(rows.where("part IN ('fit', 'stop')"), "split_id", "x", "y", "weight", params.get("c", models.REGISTRY[name].defaults.get("c", 1.0)))
        scored = [glm.margin(rows.where("part IN ('calibrate', 'test')"), "split_id", "x", beta).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))]  # no chance is in the fit
    elif name == "boosted":
        p = boosting.Boost(**models.REGISTRY[name].defaults | params)
        rows = stored(ready)
        rows = boosting.binned(rows, names, boosting.quantiles(rows, names, p.bins), seeds)
        allowed = {r.split_id: [names.index(x) for x in r.selected if x in names] for r in selected.collect()} if selected is not None else None  # a row a split
        scored = [boosting.predict(rows, boosting.fit(rows, seeds, p, allowed), p.depth)]
    elif name == "spline_network":
        p = spline_net.Net(**models.REGISTRY[name].defaults | params)
        if selected is not None:
            ready = ready.join(F.broadcast(selected), "split_id").withColumns({n: F.when(F.array_contains("selected", n), F.col(n)).otherwise(0.0) for n in names})  # a row a split
        rows = spline_net.ready(ready, names)
        scored = [spline_net.predict(rows, spline_net.fit(rows, seeds, p), p.order)]
    else:
        rows = stored(ready)
        own = {r.split_id: r.selected for r in selected.collect()} if selected is not None else {}  # a row a split
        tasks = [(r[0], seed) for r in rows.select("split_id").distinct().orderBy("split_id").collect() for seed in range(seeds)]

        def one(task: tuple[int, int]) -> DataFrame:
            split, seed = task
            part = rows.where(F.col("split_id") == split)
            return models.fit_predict(part.where("part IN ('fit', 'stop')"), part.where("part IN ('calibrate', 'test')"), own.get(split, columns), name, seed=42 + seed, **params).withColumn("seed", F.lit(seed)).select("split_id", "seed", "part", "group_id", "ts", "y", "ret", "raw")

        with ThreadPoolExecutor(threads) as pool:
            scored = list(pool.map(one, tasks))
    all_ = scored[0]
    for more in scored[1:]:
        all_ = all_.unionByName(more)
    all_ = stored(all_.withColumn("key", F.concat_ws("/", "split_id", "seed")))
    curves = models.calibrate(all_.where("part = 'calibrate'"), "key", models.CURVES.get(name, "platt"))
    out = models.calibrated(all_.where("part = 'test'"), "key", curves)
    return out.select(F.lit(name).alias("model"), "split_id", "seed", "group_id", "ts", F.col("y").alias("y_true"), F.col("p_cal").alias("p_up"), "ret")


def tuned(rows: DataFrame, columns: list[str], grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(split_id, c, log_loss, accuracy, rank): weighted scores of each penalty over the inner folds of each split, best first.
    `rows` are events of (split_id, fold, role, event_pos, y, w, columns); all folds and penalties are fitted together, a job a step."""
    used = models.robust_scale(rows.where("role IN ('train', 'validate')"), columns, F.col("role") == "train", by=["split_id", "fold"])
    ready = stored(used.withColumn("key", F.concat_ws("/", "split_id", "fold")).select("key", "split_id", "role", "y", "w", F.array(*columns).alias("x")))
    every = ready.select("*", F.posexplode(F.array(*map(F.lit, grid))).alias("_i", "c")).withColumn("_fit", F.concat_ws("/", "key", "_i"))
    beta = glm.fit(every.where("role = 'train'"), "_fit", "x", "y", "w", lambda g: grid[int(g.rsplit("/", 1)[1])])
    found = glm.margin(every.where("role = 'validate'"), "_fit", "x", beta)
    z, y, w = F.col("raw"), F.col("y"), F.col("w")
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z
    hit = ((z > 0).cast("int") == y).cast("double")
    by_fold = found.groupBy("split_id", "key", "c").agg((F.sum(w * loss) / F.sum(w)).alias("l"), (F.sum(w * hit) / F.sum(w)).alias("a"))
    means = by_fold.groupBy("split_id", "c").agg(F.avg("l").alias("log_loss"), F.avg("a").alias("accuracy"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("split_id").orderBy("log_loss", "c")))


def analyse(preds: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """Everything that follows from predictions, from one stitched table."""
    stitched = evaluate.stitch(preds, paths)
    curve = evaluate.equity(evaluate.strategy(stitched))
    perf = evaluate.performance(curve)
    return {
        "curve": curve, "performance": perf, "summary": evaluate.model_summary(perf), "splits": evaluate.split_metrics(preds), "hold": evaluate.buy_and_hold(stitched),
        "significance": evaluate.significance(evaluate.averaged(preds), ["split_id", "ts"]),
    }


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar-complete daily bars of the tables at hand."""
    return source.fill_gaps(source.validated(source.bars_daily(spark, sf_dir)))
