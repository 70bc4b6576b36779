"""Reports on predictions, bets, paths, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.ts import ratio
from marlstone.operators.features import MATH, TA


def reliability(preds: DataFrame, bins: int = 10, least: int = 10) -> DataFrame:
    """(model, bin, n, mean_p, observed) of equal bins of probability with at least `least` rows."""
    b = F.least(F.floor(F.col("p_up") * bins), F.lit(bins - 1)).cast("int")
    df = preds.withColumn("bin", b).groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("p_up").alias("mean_p"), F.avg("y_true").alias("observed"))
    return df.where(F.col("n") >= least)


def calibration_mean(preds: DataFrame, tolerance: float = 0.03) -> DataFrame:
    df = preds.groupBy("model").agg(F.avg("p_up").alias("mean_p"), F.avg("y_true").alias("base_rate"))
    return df.withColumn("gap", F.col("mean_p") - F.col("base_rate")).withColumn("flag", F.abs("gap") >= tolerance)


def concentration(returns: DataFrame, k: int = 5) -> DataFrame:
    """Share of a path's growth that its k largest moves make; null where it gained nothing or has no other moves."""
    order = Window.partitionBy("model", "path_id").orderBy(F.desc(F.abs("net")), "ts")
    df = returns.withColumn("_k", F.row_number().over(order)).groupBy("model", "path_id")
    df = df.agg(F.count("*").alias("n"), (F.product(1 + F.col("net")) - 1).alias("total"), F.product(F.when(F.col("_k") > k, 1 + F.col("net")).otherwise(1.0)).alias("_rest"))
    share = ratio(F.col("total") - (F.col("_rest") - 1), F.nullif(1 + F.col("total"), F.lit(0.0)))
    return df.withColumn("concentration", F.when((F.col("n") > k) & (F.col("total") != 0), share)).drop("_rest")


def dispersion(perf: DataFrame) -> DataFrame:
    return perf.groupBy("model").agg(
        F.min("sharpe").alias("min_sharpe"), F.percentile("sharpe", 0.5).alias("median_sharpe"), F.max("sharpe").alias("max_sharpe"), F.avg("sharpe").alias("mean_sharpe"),
        F.percentile("sharpe", 0.25).alias("q1_sharpe"), F.percentile("sharpe", 0.75).alias("q3_sharpe"),
    )


def bet_summary(returns: DataFrame, most: float = 0.75) -> DataFrame:
    bet = F.col("bet")
    return returns.groupBy("model").agg(
        F.count("*").alias("n"),
        F.avg((bet == 0).cast("double")).alias("abstained"),
        F.percentile(F.when(bet != 0, F.abs(bet)), 0.5).alias("median_bet"),
        F.avg((F.abs(bet) >= most).cast("double")).alias("at_most"),
        F.count_if(bet > 0).alias("n_long"),
        F.count_if(bet < 0).alias("n_short"),
    )


def bet_histogram(returns: DataFrame) -> DataFrame:
    return returns.groupBy("model", "bet").agg(F.count("*").alias("n"))


def confusion(preds: DataFrame) -> DataFrame:
    """Counts by model and class, predicted classes as columns."""
    df = preds.withColumn("_hit", (F.col("p_up") >= 0.5).cast("int"))
    return df.groupBy("model", "y_true").agg(F.count_if(F.col("_hit") == 0).alias("pred_0"), F.count_if(F.col("_hit") == 1).alias("pred_1"))


def equity_pivot(curve: DataFrame, paths: list[int]) -> DataFrame:
    """Equity by model and day, a column for each path, gaps carried forward."""
    wide = curve.groupBy("model", "ts").pivot("path_id", paths).agg(F.last("equity"))
    order = Window.partitionBy("model").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("model", "ts", *(F.last(str(p), ignorenulls=True).over(order).alias(f"path_{p}") for p in paths))


def since(curve: DataFrame, day: str) -> DataFrame:
    """Equity from a day on, starting at one, with the median over paths."""
    order = Window.partitionBy("model", "path_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = curve.where(F.col("ts") >= F.lit(day)).withColumn("value", F.col("equity") / F.first("equity").over(order))
    return df.groupBy("model", "ts").agg(F.percentile("value", 0.5).alias("median_value"), F.count("*").alias("n_paths"))


def category(name):
    """Technical, mathematical, lag or external, by a feature's name."""
    return F.when(name.isin(*TA), "technical").when(name.isin(*MATH), "mathematical").when(F.startswith(name, F.lit("log_returns_lag")), "lag").otherwise("external")


def stability_table(stability: DataFrame, names: DataFrame, stable: float = 0.8, moderate: float = 0.5) -> DataFrame:
    """All features with how often they were selected and a tier, never-selected ones included."""
    df = names.join(stability, "feature", "left").fillna(0, ["n"]).fillna(0.0, ["frequency"])
    tier = F.when(F.col("frequency") > stable, "stable").when(F.col("frequency") > moderate, "moderate").when(F.col("n") > 0, "low").otherwise("never")
    return df.select("feature", category(F.col("feature")).alias("category"), "n", "frequency", tier.alias("tier"))


def correlated(features: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of features with |correlation| above `least`, over rows that have all of them."""
    kept = features.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = kept.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("correlation")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(table).alias("p")).select("p.*").where(F.abs("correlation") > least)


def distributions(features: DataFrame, columns: list[str], heavy: float = 10.0) -> DataFrame:
    """Moments of each feature; heavy-tailed ones are flagged."""
    stacked = features.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).alias("x")) for x in columns))).alias("p")).select("p.*")
    n = F.count("x")
    kurt = ((n + 1) * F.kurtosis("x") + 6) * (n - 1) / ((n - 2) * (n - 3))
    df = stacked.groupBy("feature").agg(n.alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), kurt.alias("kurtosis"))
    return df.withColumn("heavy", F.col("kurtosis") > heavy)


def mutual_information(features: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Information in bits that deciles of each feature hold about a label."""
    entries = F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).alias("x")) for x in columns))
    df = features.select(label, F.explode(entries).alias("p")).select(label, "p.*").where("x IS NOT NULL")
    df = df.withColumn("bin", F.ntile(bins).over(Window.partitionBy("feature").orderBy("x", label)))
    n = df.groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    share = F.col("n") / by()
    return n.withColumn("_i", share * F.log2(F.col("n") * by() / (by("bin") * by(label)))).groupBy("feature").agg(F.sum("_i").alias("bits"))


def next_direction(bars: DataFrame) -> DataFrame:
    """Whether the next close is higher, by raw and by log return, and whether both agree."""
    order = Window.partitionBy("symbol").orderBy("ts")
    after = F.lead("close").over(order)
    df = bars.select("symbol", "ts", (after > F.col("close")).cast("int").alias("raw"), (F.log(after / F.col("close")) > 0).cast("int").alias("logged"))
    return df.where("raw IS NOT NULL").withColumn("same", F.col("raw") == F.col("logged"))


def barrier_examples(bins: DataFrame, vol: DataFrame, pt: float = 1.5, sl: float = 1.5) -> DataFrame:
    """(symbol, t0, t1, ret, touch): which barrier a label reached; here a return equal to a barrier touches it."""
    df = bins.join(vol.select("symbol", F.col("ts").alias("t0"), "vol"), ["symbol", "t0"])
    touch = F.when(F.col("ret") >= pt * F.col("vol"), "profit").when(F.col("ret") <= -sl * F.col("vol"), "stop").otherwise("vertical")
    return df.select("symbol", "t0", "t1", "ret", touch.alias("touch"))


def volatility_comparison(features: DataFrame) -> DataFrame:
    """By symbol: correlation of realised and annualised Yang-Zhang volatility, means and outer quantiles of their difference."""
    rv, yz = F.col("realized_vol"), F.col("yz_vol") * F.sqrt(F.lit(365.0))
    df = features.where(F.col("realized_vol").isNotNull() & F.col("yz_vol").isNotNull()).withColumn("_d", rv - yz).withColumn("_y", yz)
    return df.groupBy("symbol").agg(
        F.count("*").alias("n"), F.corr("realized_vol", "_y").alias("correlation"), F.avg(F.abs("_d")).alias("mean_absolute"), F.avg(F.abs("_d") / F.nullif("_y", F.lit(0.0))).alias("mean_relative"),
        F.percentile("_d", 0.025).alias("low"), F.percentile("_d", 0.975).alias("high"),
    )


def options_of(instruments: DataFrame) -> DataFrame:
    """(name, asset, expiry, strike, call): the parts of instrument names such as BTC-27JUN25-60000-C; malformed names are left out."""
    p = F.split("name", "-")
    df = instruments.where(F.size(p) == 4).select("*", F.get(p, 0).alias("asset"), F.expr("try_to_timestamp(initcap(get(split(name, '-'), 1)), 'dMMMyy')").cast("date").alias("expiry"), F.expr("try_cast(get(split(name, '-'), 2) AS double)").alias("strike"), F.get(p, 3).alias("_side"))  # filters may change places
    return df.where("expiry IS NOT NULL AND strike IS NOT NULL AND _side IN ('C', 'P')").withColumn("call", F.col("_side") == "C").drop("_side")


def tradable(options: DataFrame, day: str, least: int = 7, most: int = 90, floor: float = 0.0) -> DataFrame:
    """Options of the most frequent expiry (the earliest of equals) among those `least` to `most` days ahead and above the price floor."""
    days = F.datediff("expiry", F.lit(day).cast("date"))
    near = options.where(days.between(least, most) & (F.col("price") > floor)).withColumn("days", days)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_n"), "expiry")  # a row an expiry
    best = near.groupBy("expiry").agg(F.count("*").alias("_n")).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return near.join(F.broadcast(best.select("expiry")), "expiry", "left_semi")
