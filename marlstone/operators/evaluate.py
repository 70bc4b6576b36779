"""Evaluation of predictions: bets, path stitching, path metrics, multiple-testing corrections.

Predictions are long tables (model, split_id, seed, ts, group_id, y_true, p_up, ret); paths keep the group of the split
generation, so stitching needs no second partitioning of events.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import e, pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marlstone.functions.ts import ratio

YEAR, COST, MAX_BET = 365, 0.001, 0.75
#: Where the snapped bet steps up: the quantiles at which 2 * Phi(z) - 1 is midway between neighbouring sizes.
CUTS = tuple(NormalDist().inv_cdf(0.5 + x / 2) for x in (0.125, 0.375, 0.625))
EULER = 0.5772156649015329


def bet_size(p: Column) -> Column:
    """0, .25, .5 or .75 by the distance of a probability from one half, signed."""
    z = (p - 0.5) / F.sqrt(p * (1 - p) + 1e-10)
    size = F.when(F.abs(z) > CUTS[2], 0.75).when(F.abs(z) > CUTS[1], 0.5).when(F.abs(z) > CUTS[0], 0.25).otherwise(0.0)
    return F.when(p.isNotNull(), F.when(size == 0, 0.0).otherwise(size * F.signum(z)))


def averaged(preds: DataFrame) -> DataFrame:
    """Predictions averaged over seeds, by event."""
    return preds.groupBy("model", "split_id", "group_id", "ts").agg(F.avg("p_up").alias("p_up"), F.first("y_true").alias("y_true"), F.first("ret").alias("ret"))


def stitch(preds: DataFrame, paths: DataFrame) -> DataFrame:
    """(model, path_id, ts, p_up, y_true, ret): each path's groups from the split that tests them for it."""
    return averaged(preds).join(F.broadcast(paths), ["split_id", "group_id"]).select("model", "path_id", "ts", "p_up", "y_true", "ret")


def strategy(stitched: DataFrame, cost: float = COST) -> DataFrame:
    """Bets and their gross and net returns; a change of the bet costs."""
    return charged(stitched.withColumn("bet", bet_size(F.col("p_up"))), cost)


def charged(bets: DataFrame, cost: float = COST) -> DataFrame:
    """Gross and net returns of bets; a change of the bet costs, the first one included."""
    order = Window.partitionBy("model", "path_id").orderBy("ts")
    df = bets.withColumn("gross", F.col("bet") * F.col("ret")).withColumn("cost", cost * F.abs(F.col("bet") - F.lag("bet", 1, 0.0).over(order)))
    return df.withColumn("net", F.col("gross") - F.col("cost"))


def equity(returns: DataFrame) -> DataFrame:
    """Compounded value and drawdown, from the highest value so far, at each event of a path; null from a value of zero."""
    order = Window.partitionBy("model", "path_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("equity", F.product(1 + F.col("net")).over(order))
    return df.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(order)) - 1)


def under_water(curve: DataFrame) -> DataFrame:
    """The longest run of events below the peak, by path; the peak may be below zero, where a drawdown is positive."""
    order = Window.partitionBy("model", "path_id").orderBy("ts")
    df = curve.withColumn("_below", F.when(F.col("equity") < F.max("equity").over(order), 1).otherwise(0))
    df = df.withColumn("_run", F.row_number().over(order) - F.sum("_below").over(order))  # an event at its peak and those below it
    runs = df.groupBy("model", "path_id", "_run").agg(F.sum("_below").alias("n"))
    return runs.groupBy("model", "path_id").agg(F.max("n").alias("time_under_water"))


#: Spreads, downside and drawdowns below this count as none.
NOTHING = 1e-10


def performance(curve: DataFrame) -> DataFrame:
    """Path metrics; Sharpe and Sortino ratios are annualised by the square root of YEAR.

    Win rate, profit factor and mean bet are those of events with a bet. Without a spread the Sharpe ratio is 0; without a downside
    the Sortino ratio, and without a drawdown the Calmar ratio, is infinite if there is a gain, else 0; without losses the
    profit factor is infinite, without bets null, and the win rate and mean bet 0. Skewness needs three events, kurtosis four, else
    they are 0, as they are without a spread. A path lasts whole days, one at least; one event has no annual return.
    """
    net, traded = F.col("net"), F.col("bet") != 0
    up, down = F.sum(F.when(traded & (net > 0), net)), F.sum(F.when(traded & (net < 0), net))
    seconds = F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))
    df = curve.groupBy("model", "path_id").agg(
        F.count("*").alias("n_events"),
        F.avg("net").alias("_mean"),
        F.coalesce(F.stddev_samp("net"), F.lit(NOTHING)).alias("_spread"),
        F.sqrt(F.avg(F.when(net < 0, net * net))).alias("_down"),
        (F.product(1 + net) - 1).alias("cum_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(traded, (net > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(up, F.lit(0.0)).alias("_gain"),
        F.coalesce(-down, F.lit(0.0)).alias("_loss"),
        F.count_if(traded).alias("n_trades"),
        F.coalesce(F.avg(F.when(traded, F.abs("bet"))), F.lit(0.0)).alias("avg_bet"),
        F.skewness("net").alias("_skew"),
        F.kurtosis("net").alias("_kurtosis"),
        F.floor(seconds / 86400).alias("_days"),
    )
    endless, zero = F.lit(float("inf")), F.lit(0.0)
    shape = lambda c, least: F.when(F.col("n_events") > least, F.nanvl(F.coalesce(c, zero), zero)).otherwise(zero)
    years = F.greatest(F.col("_days") / 365.25, F.lit(1 / 365.25))
    df = df.withColumn("ann_return", F.when(F.col("n_events") > 1, F.pow(1 + F.col("cum_return"), 1 / years) - 1).otherwise(zero))
    return df.withColumns({
        "sharpe": F.when(F.col("_spread") < NOTHING, zero).otherwise(F.col("_mean") / F.col("_spread") * sqrt(YEAR)),
        "sortino": F.when(F.coalesce("_down", zero) < NOTHING, F.when(F.col("_mean") > 0, endless).otherwise(zero)).otherwise(F.col("_mean") / F.col("_down") * sqrt(YEAR)),
        "calmar": F.when(F.abs("max_drawdown") < NOTHING, F.when(F.col("ann_return") > 0, endless).otherwise(zero)).otherwise(F.col("ann_return") / F.abs("max_drawdown")),
        "profit_factor": F.when(F.col("n_trades") > 0, F.when(F.col("_loss") == 0, endless).otherwise(F.col("_gain") / F.col("_loss"))),
        "skew": shape(F.col("_skew"), 2),
        "excess_kurtosis": shape(F.col("_kurtosis"), 3),
        "years": F.when(F.col("n_events") > 1, years).otherwise(zero),
    }).drop("_mean", "_spread", "_down", "_gain", "_loss", "_skew", "_kurtosis", "_days")


def buy_and_hold(stitched: DataFrame, cost: float = COST) -> DataFrame:
    """The same paths with a full bet throughout; only the first buy costs."""
    held = stitched.select(F.lit("buy_and_hold").alias("model"), "path_id", "ts", "y_true", "ret").distinct().withColumn("bet", F.lit(1.0))
    return performance(equity(charged(held, cost)))


def split_metrics(preds: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Accuracy, macro F1, precision and recall, log loss, Brier score and AUC of each model and split, seeds averaged."""
    y, p = F.col("y_true"), F.col("p_up")
    hit = (p >= 0.5).cast("int")
    clipped = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    own = averaged(preds)
    counts = {f"{a}{b}": F.sum(F.when((y == a) & (hit == b), 1.0).otherwise(0.0)).alias(f"_{a}{b}") for a in (0, 1) for b in (0, 1)}
    df = own.groupBy("model", "split_id").agg(
        F.count("*").alias("n"),
        F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        *counts.values(),
    )
    n00, n01, n10, n11 = (F.col(f"_{k}") for k in ("00", "01", "10", "11"))
    zero = F.lit(0.0)
    parts = {}
    for c, tp, fp, fn in ((0, n00, n10, n01), (1, n11, n01, n10)):
        parts[f"precision_{c}"] = F.coalesce(ratio(tp, tp + fp), zero)
        parts[f"recall_{c}"] = F.coalesce(ratio(tp, tp + fn), zero)
        parts[f"f1_{c}"] = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero)
    df = df.withColumn("accuracy", (n00 + n11) / F.col("n")).withColumns(parts)
    for m in ("precision", "recall", "f1"):
        df = df.withColumn(f"macro_{m}", (F.col(f"{m}_0") + F.col(f"{m}_1")) / 2)
    return df.drop(*(f"_{k}" for k in counts)).join(auc(own, ["model", "split_id"]), ["model", "split_id"])


def midranks(df: DataFrame, by: list[str], value: str = "p_up") -> Column:
    """Ranks by value within `by`, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def auc(df: DataFrame, by: list[str]) -> DataFrame:
    """AUC by midranks; null if a class is missing."""
    ranked = df.withColumn("_r", midranks(df, by))
    m = F.sum(F.when(F.col("y_true") == 1, 1.0).otherwise(0.0))
    n = F.sum(F.when(F.col("y_true") == 0, 1.0).otherwise(0.0))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("y_true") == 1, F.col("_r"))).alias("_s"), m.alias("_m"), n.alias("_n"))
    return sums.select(*by, ratio(F.col("_s") - F.col("_m") * (F.col("_m") + 1) / 2, F.col("_m") * F.col("_n")).alias("auc"))


def placements(df: DataFrame) -> DataFrame:
    """Each event's placement value among the other class, by model: DeLong's structural components, in n log n."""
    all_, own = midranks(df, ["model"]), midranks(df, ["model", "y_true"])
    counted = df.withColumn("_all", all_).withColumn("_own", own)
    total = F.count("*").over(Window.partitionBy("model"))
    mine = F.count("*").over(Window.partitionBy("model", "y_true"))
    v = (F.col("_all") - F.col("_own")) / (total - mine)
    return counted.withColumn("placement", F.when(F.col("y_true") == 1, v).otherwise(1 - v)).drop("_all", "_own")


def delong(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of models: AUCs, the variance of their difference and z, over the events both have."""
    own = placements(df).select(*keys, "model", "y_true", "placement")
    a, b = (own.select(*keys, F.col("model").alias(f"model_{s}"), F.col("y_true").alias(f"y_{s}"), F.col("placement").alias(f"v_{s}")) for s in "ab")
    pairs = a.join(b, keys).where("model_a < model_b")
    by = pairs.groupBy("model_a", "model_b", F.col("y_a").alias("y")).agg(
        F.count("*").alias("n"), F.avg("v_a").alias("auc_a"), F.avg("v_b").alias("auc_b"), F.var_samp(F.col("v_a") - F.col("v_b")).alias("s")
    )
    df = by.groupBy("model_a", "model_b").agg(
        F.max(F.when(F.col("y") == 1, F.col("auc_a"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("auc_b"))).alias("auc_b"), F.sum(F.col("s") / F.col("n")).alias("variance")
    )
    return df.withColumn("z", ratio(F.col("auc_a") - F.col("auc_b"), F.sqrt("variance")))


def significance(df: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Pairs of models with AUCs, z, the two-sided p value and whether it is below alpha."""
    found = delong(df, keys).withColumn("p_value", 2 * (1 - phi(F.abs("z"))))
    return found.withColumn("delta_auc", F.col("auc_a") - F.col("auc_b")).withColumn("significant", F.col("p_value") < alpha)


#: Hart's quotient for the upper tail of the normal distribution, below TAIL; beyond it a continued fraction. Highest powers first.
ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL = 7.07106781186547


@F.pandas_udf(DoubleType())
def _phi(x: pd.Series) -> pd.Series:
    a = np.abs(x.to_numpy(float))
    short = np.minimum(a, TAIL)
    far = np.maximum(a, TAIL)
    quotient = np.polyval(ABOVE, short) / np.polyval(BELOW, short)
    fraction = reduce(lambda s, k: far + k / s, (4, 3, 2, 1), far + 0.65)
    tail = np.exp(-a * a / 2) * np.where(a < TAIL, quotient, 1 / fraction / sqrt(2 * pi))
    return pd.Series(np.where(x > 0, 1 - tail, tail))


def phi(x: Column) -> Column:
    """The normal distribution function, in Arrow batches, to double precision for |x| < 8, beyond which it is 0 or 1 to that precision."""
    return F.when(x.isNotNull(), _phi(F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))))


def model_summary(perf: DataFrame, trials: int | None = None) -> DataFrame:
    """Medians, means, spread and shape over paths with the deflated Sharpe ratio, ranked by median Sharpe ratio, then by its
    spread. `trials` is the number of models that were tried, by default those of `perf`."""
    df = perf.groupBy("model").agg(
        F.percentile("sharpe", 0.5).alias("median_sharpe"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std_sharpe"),
        F.percentile("sortino", 0.5).alias("median_sortino"),
        F.percentile("calmar", 0.5).alias("median_calmar"),
        F.percentile("max_drawdown", 0.5).alias("median_max_drawdown"),
        F.percentile("cum_return", 0.5).alias("median_cum_return"),
        F.percentile("win_rate", 0.5).alias("median_win_rate"),
        F.percentile("profit_factor", 0.5).alias("median_profit_factor"),
        F.avg("skew").alias("pooled_skew"),
        F.avg("excess_kurtosis").alias("pooled_kurtosis"),
        F.floor(F.avg("n_events")).alias("n_obs"),
        F.count("*").alias("n_paths"),
    )
    every = Window.partitionBy(F.lit(1))  # a row a model
    df = df.withColumn("_trials", F.count("*").over(every) if trials is None else F.lit(trials))
    df = df.withColumn("dsr", deflated_sharpe(*map(F.col, ("median_sharpe", "n_obs", "pooled_skew", "pooled_kurtosis", "_trials"))))
    return df.withColumn("rank", F.row_number().over(every.orderBy(F.desc_nulls_last("median_sharpe"), F.asc("std_sharpe"), "model"))).drop("_trials")


def deflated_sharpe(annual: Column, n: Column, skew: Column, excess: Column, trials: Column, most_trials: int = 1000) -> Column:
    """Probability that a Sharpe ratio beats the expected best of `trials` ones that are nothing but chance, with the standard
    error of ratios of returns of that shape (Mertens). The expected best is tabulated up to most_trials."""
    unit = NormalDist()
    best = [0.0] + [(1 - EULER) * unit.inv_cdf(1 - 1 / t) + EULER * unit.inv_cdf(1 - 1 / (t * e)) for t in range(2, most_trials + 1)]
    sr = annual / sqrt(YEAR)
    error = F.sqrt(F.greatest(1 - skew * sr + (excess + 2) / 4 * sr * sr, F.lit(1e-10)) / F.greatest(F.greatest(n, F.lit(2)) - 1, F.lit(1)))
    chosen = F.element_at(F.array(*map(F.lit, best)), F.least(trials, F.lit(most_trials)).cast("int"))
    return F.when(trials <= 1, 1.0).when(error < 1e-10, 0.0).otherwise(phi((sr - chosen * error) / error))


def pbo(spark: SparkSession, sharpes: DataFrame, n_paths: int, leave_one_out: bool = False) -> DataFrame:
    """Probability of backtest overfitting: the share of half-and-half divisions of the paths whose best model in the one
    half is below the models' median in the other. With leave_one_out, once without each model in turn."""
    halves = list(combinations(range(n_paths), n_paths // 2))
    sides = spark.createDataFrame([(i, p, p in own) for i, own in enumerate(halves) for p in range(n_paths)], "division int, path_id int, inside boolean")
    df = sharpes.select("model", F.col("path_id").cast("int").alias("path_id"), "sharpe")
    base = []
    if leave_one_out:
        names = df.select(F.col("model").alias("excluded")).distinct()
        df = df.crossJoin(F.broadcast(names)).where("model <> excluded")  # rows: models squared times paths
        base = ["excluded"]
    by = df.join(F.broadcast(sides), "path_id").groupBy(*base, "division", "model").agg(F.avg(F.when(F.col("inside"), F.col("sharpe"))).alias("i"), F.avg(F.when(~F.col("inside"), F.col("sharpe"))).alias("o"))
    order = Window.partitionBy(*base, "division").orderBy(F.desc("i"), "model")
    chosen = by.withColumn("_k", F.row_number().over(order))
    worse = chosen.groupBy(*base, "division").agg(F.max(F.when(F.col("_k") == 1, F.col("o"))).alias("best"), F.percentile("o", 0.5).alias("middle"), F.count("*").alias("n"))
    out = worse.where("n >= 2").withColumn("_below", F.when(F.col("best") < F.col("middle"), 1.0).otherwise(0.0))
    return out.groupBy(*base).agg(F.avg("_below").alias("pbo"), F.count("*").alias("n_divisions")) if base else out.agg(F.avg("_below").alias("pbo"), F.count("*").alias("n_divisions"))


def bootstrap_median(values: DataFrame, column: str, by: str = "model", draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, low, high): percentile interval of the median over resamples of each group's values, null for fewer than two; draws
    follow from their numbers by modular arithmetic, so partitioning does not change them."""
    kept = values.where(F.col(column).isNotNull() & ~F.isnan(column)).select(by, F.col(column).alias("x"))
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("x")) - 1)  # a value a path
    sizes = kept.groupBy(by).agg(F.count("*").alias("n"))
    drawn = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    drawn = drawn.withColumn("k", shuffled(F.col("draw") * 1009 + F.col("j"), seed) % F.col("n"))
    medians = drawn.join(kept, [by, "k"]).groupBy(by, "n", "draw").agg(F.percentile("x", 0.5).alias("m"))
    tail = (1 - level) / 2
    ends = medians.groupBy(by, "n").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return ends.select(by, *(F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("low", "high")))


def shuffled(number: Column, seed: int = 42) -> Column:
    """A pseudo-random number below 2**31 - 1 of a whole one below it, by two multiplications modulo that prime."""
    prime = 2**31 - 1
    first = (number.cast("long") + seed) * 48271 % prime
    return (first * first % prime + number) * 69621 % prime


def empty_performance(perf: DataFrame, wanted: DataFrame) -> DataFrame:
    """`perf` with a row for every (model, path_id) that is wanted: paths without events count zero, their profit factor is null."""
    zero = [c for c in perf.columns if c not in ("model", "path_id", "profit_factor")]
    found = perf.withColumn("_met", F.lit(True))
    df = wanted.select("model", "path_id").join(found, ["model", "path_id"], "left")
    return df.withColumns({c: F.when(F.col("_met"), F.col(c)).otherwise(F.lit(0).cast(perf.schema[c].dataType)) for c in zero}).drop("_met")


def feature_stability(selected: DataFrame, stable: float = 0.8) -> DataFrame:
    """(feature, n, frequency, stable) of features selected by split."""
    total = selected.agg(F.count("*").alias("_t"))  # a row a split and seed
    df = selected.select(F.explode("selected").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    df = df.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("n") / F.col("_t"))  # one row
    return df.withColumn("stable", F.col("frequency") > stable).drop("_t")


def ffd_stability(found: DataFrame, warn: float = 0.1) -> DataFrame:
    """Mean and population spread of the fractional orders of each feature over splits."""
    df = found.select("split_id", F.explode("ffd").alias("feature", "d")).groupBy("feature")
    df = df.agg(F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("std_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"))
    return df.withColumn("unstable", F.col("std_d") > warn)
