"""Events, barriers, labels and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.ts import lag, placed, ratio, series, span

NUM_DAYS, PT, SL, MIN_RETURN, RARE, CAP = 10, 1.5, 1.5, 0.02, 0.05, 0.99


def daily_volatility(bars: DataFrame, n: int = 50) -> DataFrame:
    """(symbol, ts, close, ret, vol): the exponential standard deviation of simple returns."""
    df = placed(bars).withColumn("ret", F.col("close") / lag("close") - 1)
    return df.withColumn("vol", span(n).std(F.col("ret"))).select("symbol", "ts", "close", "ret", "vol")


def cusum_events(vol: DataFrame, multiplier: float = 1.0, states: bool = False) -> DataFrame:
    """(symbol, ts, side) where one of two sums of returns passes the threshold, multiplier * mean volatility; the sum that
    fires starts again. `states` gives every row with both sums instead.

    The sums restart on what they have summed, so a symbol's series is folded in order; symbols fold in parallel.
    """
    threshold = vol.groupBy("symbol").agg((F.avg("vol") * multiplier).alias("h"))
    rows = vol.where("ret IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "ret"))).alias("rows")).join(threshold, "symbol")
    zero = F.lit(0.0)
    start = F.struct(zero.alias("up"), zero.alias("down"), F.array().cast("array<struct<ts:date,up:double,down:double,side:int>>").alias("out"))

    def fold(state: Column, row: Column) -> Column:
        up, down = F.greatest(zero, state["up"] + row["ret"]), F.least(zero, state["down"] + row["ret"])
        side = F.when(up >= F.col("h"), 1).when(down <= -F.col("h"), -1).otherwise(0)
        told = F.struct(row["ts"].cast("date").alias("ts"), up.alias("up"), down.alias("down"), side.alias("side"))
        out = F.array_append(state["out"], told) if states else F.when(side != 0, F.array_append(state["out"], told)).otherwise(state["out"])
        return F.struct(F.when(side == 1, zero).otherwise(up).alias("up"), F.when(side == -1, zero).otherwise(down).alias("down"), out.alias("out"))

    found = rows.select("symbol", F.explode(F.aggregate("rows", start, fold, lambda s: s["out"])).alias("e"))
    return found.select("symbol", "e.ts", "e.side", *(["e.up", "e.down"] if states else []))


def triple_barrier(vol: DataFrame, events: DataFrame, pt: float = PT, sl: float = SL, num_days: int = NUM_DAYS, min_return: float = MIN_RETURN) -> DataFrame:
    """(symbol, t0, t1, ret, bin): the first touch of the upper, lower or vertical barrier.

    Paths are at most num_days long, so bars meet events in a range join whose keys are symbol and a bucket of that length.
    """
    e = events.select("symbol", F.col("ts").alias("t0")).join(vol.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("c0"), "vol"), ["symbol", "t0"])
    e = e.where("vol IS NOT NULL").withColumn("_until", F.date_add("t0", num_days))
    bucket = lambda x: F.floor(F.datediff(x, F.lit("1970-01-01")) / (num_days + 1))
    e = e.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("t0")), bucket(F.col("_until"))))))
    b = vol.select("symbol", "ts", "close").withColumn("_bucket", bucket(F.col("ts")))
    path = e.join(b, ["symbol", "_bucket"]).where("ts BETWEEN t0 AND _until").withColumn("r", F.col("close") / F.col("c0") - 1)
    touched = path.groupBy("symbol", "t0").agg(
        F.min(F.when((F.col("r") > pt * F.col("vol")) & F.lit(pt > 0), F.col("ts"))).alias("up"),
        F.min(F.when((F.col("r") < -sl * F.col("vol")) & F.lit(sl > 0), F.col("ts"))).alias("down"),
        F.max("ts").alias("last"),
        F.count("*").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("ts", "r"))).alias("path"),
    )
    t1 = F.least("up", "down", "last")
    df = touched.where("n >= 2").withColumn("t1", t1).withColumn("ret", F.element_at("path", F.col("t1")))
    vertical = (F.coalesce(F.col("up"), F.date_add("last", 1)) > F.col("last")) & (F.coalesce(F.col("down"), F.date_add("last", 1)) > F.col("last"))
    label = F.when(vertical & (F.abs("ret") < min_return), 0).otherwise(F.signum("ret").cast("int"))
    return df.select("symbol", "t0", "t1", "ret", label.cast("int").alias("bin"))


def drop_rare(bins: DataFrame, least: float = RARE, drop_zero: bool = False) -> DataFrame:
    """Labels without the classes that are rarer than `least`; drop_zero also drops the undecided."""
    shares = bins.groupBy("bin").count()
    shares = shares.withColumn("_share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))).where(F.col("_share") >= least)
    kept = bins.join(F.broadcast(shares.select("bin")), "bin", "left_semi")  # as many rows as classes
    return kept.where("bin <> 0") if drop_zero else kept


def label(bars: DataFrame, multiplier: float = 1.0, cusum: bool = True, **barriers) -> DataFrame:
    vol = daily_volatility(bars)
    events = cusum_events(vol, multiplier) if cusum else vol.select("symbol", "ts")
    return drop_rare(triple_barrier(vol, events, **barriers))


def concurrency(bars: DataFrame, bins: DataFrame) -> DataFrame:
    """(symbol, ts, n): live labels on each bar, by a sweep over starts and ends."""
    steps = bins.select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("_step")).union(bins.select("symbol", F.date_add("t1", 1), F.lit(-1)))
    steps = steps.groupBy("symbol", "ts").agg(F.sum("_step").alias("_step"))
    both = bars.select("symbol", "ts", F.lit(1).alias("_bar")).join(steps, ["symbol", "ts"], "full")
    live = F.sum(F.coalesce("_step", F.lit(0))).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("n", live.cast("long")).where("_bar = 1").select("symbol", "ts", "n")


def uniqueness(bars: DataFrame, bins: DataFrame) -> DataFrame:
    """(symbol, t0, t1, ret, bin, uniqueness): the mean of 1/n over each label's bars, by differences of a running sum."""
    live = concurrency(bars, bins)
    sums = live.select(
        "symbol",
        "ts",
        F.sum(F.when(F.col("n") > 0, 1 / F.col("n")).otherwise(0.0)).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(series()).alias("k"),
        F.when(F.col("n") > 0, 1 / F.col("n")).otherwise(0.0).alias("own"),
    )
    a = sums.select("symbol", F.col("ts").alias("t0"), (F.col("s") - F.col("own")).alias("s0"), F.col("k").alias("k0"))
    b = sums.select("symbol", F.col("ts").alias("t1"), F.col("s").alias("s1"), F.col("k").alias("k1"))
    joined = bins.join(a, ["symbol", "t0"]).join(b, ["symbol", "t1"])
    return joined.select("symbol", "t0", "t1", "ret", "bin", ((F.col("s1") - F.col("s0")) / (F.col("k1") - F.col("k0") + 1)).alias("uniqueness"))


def sample_weights(bars: DataFrame, bins: DataFrame, oldest: float = 0.4, cap: float | None = CAP) -> DataFrame:
    """(symbol, t0, w): |return| times uniqueness, decayed from `oldest` for the first event to 1, capped, with mean 1."""
    every = Window.partitionBy("symbol")
    norm = lambda x: F.coalesce(ratio(x * F.count("*").over(every), F.sum(x).over(every)), F.lit(1.0))
    df = uniqueness(bars, bins).withColumn("w", F.abs("ret") * F.col("uniqueness")).withColumn("w", norm(F.col("w")))
    order = Window.partitionBy("symbol").orderBy("t0")
    df = df.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(every))
    decay = F.when(F.col("_n") > 1, F.lit(oldest) + (1 - oldest) * F.col("_k") / (F.col("_n") - 1)).otherwise(1.0)
    df = df.withColumn("w", F.col("w") * decay).withColumn("w", norm(F.col("w")))
    if cap is not None:
        limits = df.groupBy("symbol").agg(F.percentile("w", cap).alias("_cap"))
        df = df.join(limits, "symbol").withColumn("w", F.least("w", "_cap")).withColumn("w", norm(F.col("w")))
    return df.select("symbol", "t0", "w")


def label_distribution(bins: DataFrame) -> DataFrame:
    df = bins.groupBy("symbol", "bin").agg(F.count("*").alias("n"))
    return df.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))
