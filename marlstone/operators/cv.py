"""Combinatorial purged cross-validation: groups, splits, purge, embargo, paths, audit."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUPS, TESTS, EMBARGO = 8, 2, 0.01


def events(bins: DataFrame) -> DataFrame:
    """(event_pos, t0, t1, ...): events numbered in order of time, then of symbol. Events of a day are ranked among themselves;
    only the counts of days, one row a day, meet in one task."""
    days = bins.groupBy("t0").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    rank = F.row_number().over(Window.partitionBy("t0").orderBy("symbol")) - 1
    return bins.join(days.select("t0", before.alias("_before")), "t0").withColumn("event_pos", (F.col("_before") + rank).cast("long")).drop("_before")


def grouped(ev: DataFrame, n: int = GROUPS) -> DataFrame:
    """group_id: runs of floor(T / n) events, the last takes the remainder."""
    total = ev.agg(F.count("*").alias("_t"))
    base = F.floor(F.col("_t") / n)
    return ev.crossJoin(F.broadcast(total)).withColumn("group_id", F.least(F.floor(F.col("event_pos") / base), F.lit(n - 1)).cast("int"))


def splits(spark: SparkSession, n: int = GROUPS, k: int = TESTS) -> DataFrame:
    """(split_id, group_id) of the test groups of every split."""
    rows = [(i, g) for i, own in enumerate(combinations(range(n), k)) for g in own]
    return spark.createDataFrame(rows, "split_id int, group_id int")


def path_map(spark: SparkSession, n: int = GROUPS, k: int = TESTS) -> DataFrame:
    """(path_id, group_id, split_id): the p-th split that tests a group belongs to path p."""
    order = Window.partitionBy("group_id").orderBy("split_id")
    return splits(spark, n, k).select((F.row_number().over(order) - 1).alias("path_id"), "group_id", "split_id")


def n_paths(n: int = GROUPS, k: int = TESTS) -> int:
    return comb(n - 1, k - 1)


def roles(ev: DataFrame, n: int = GROUPS, k: int = TESTS, embargo: float = EMBARGO, through_labels: bool = False) -> DataFrame:
    """(split_id, event_pos, group_id, role): test, purged (its label overlaps a test group), embargoed, or train.

    A test group lasts from its first event to the start of its last; with through_labels, to the end of its last label."""
    spark = ev.sparkSession
    own = grouped(ev, n).withColumn("_e", F.floor(F.col("_t") * embargo))
    spans = own.groupBy("group_id").agg(F.min("t0").alias("g0"), F.max("t1" if through_labels else "t0").alias("g1"), F.max("event_pos").alias("_end"))
    tests = splits(spark, n, k).join(F.broadcast(spans), "group_id")
    # a split's test groups become one row: C(n, k) rows in all
    per = tests.groupBy("split_id").agg(F.collect_list(F.struct("group_id", "g0", "g1", "_end")).alias("_tests"))
    df = own.crossJoin(F.broadcast(per))
    test = F.exists("_tests", lambda t: t["group_id"] == F.col("group_id"))
    starts = lambda t: (F.col("t0") >= t["g0"]) & (F.col("t0") <= t["g1"])
    ends = lambda t: (F.col("t1") >= t["g0"]) & (F.col("t1") <= t["g1"])
    around = lambda t: (F.col("t0") <= t["g0"]) & (F.col("t1") >= t["g1"])
    purged = F.col("t1").isNotNull() & F.exists("_tests", lambda t: starts(t) | ends(t) | around(t))
    after = F.exists("_tests", lambda t: (F.col("event_pos") > t["_end"]) & (F.col("event_pos") <= t["_end"] + F.col("_e")))
    role = F.when(test, "test").when(purged, "purged").when(after, "embargoed").otherwise("train")
    return df.select("split_id", "event_pos", "group_id", "t0", "t1", role.alias("role"))


def split_info(found: DataFrame) -> DataFrame:
    names = ("train", "test", "purged", "embargoed")
    return found.groupBy("split_id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in names))


def audit(found: DataFrame) -> DataFrame:
    """Train events of each split whose label ends in a test group or lasts through it: none if the split is sound."""
    tests = found.where("role = 'test'").groupBy("split_id", "group_id").agg(F.min("t0").alias("g0"), F.max("t0").alias("g1"))
    leak = F.col("a.t1").between(F.col("b.g0"), F.col("b.g1")) | (F.col("a.t0") <= F.col("b.g0")) & (F.col("a.t1") >= F.col("b.g1"))
    joined = found.where("role = 'train'").alias("a").join(F.broadcast(tests).alias("b"), (F.col("a.split_id") == F.col("b.split_id")) & leak, "left")
    df = joined.groupBy(F.col("a.split_id").alias("split_id")).agg(F.count("b.g0").alias("n_leaks"))
    return df.withColumn("status", F.when(F.col("n_leaks") == 0, "OK").otherwise("FAIL"))


def demo_splits(spark: SparkSession, n: int = GROUPS, k: int = TESTS) -> DataFrame:
    """(kind, split_id): the split that tests the first groups, the first one with a gap between its groups (else that of the
    first groups), and the one that tests the last groups."""
    own = splits(spark, n, k).groupBy("split_id").agg(F.min("group_id").alias("a"), F.max("group_id").alias("b"))
    row = own.agg(
        F.min(F.when(F.col("b") == k - 1, F.col("split_id"))).alias("early"),
        F.min(F.when(F.col("b") - F.col("a") >= k, F.col("split_id"))).alias("gap"),
        F.max(F.when(F.col("a") == n - k, F.col("split_id"))).alias("tail"),
    )
    kinds = F.array(*(F.struct(F.lit(x).alias("kind"), F.coalesce(x, "early").alias("split_id")) for x in ("early", "gap", "tail")))
    return row.select(F.explode(kinds).alias("k")).select("k.*")


def boundaries(found: DataFrame, rows: int = 3) -> DataFrame:
    """The removed events nearest to each test group, on either side."""
    tests = found.where("role = 'test'").groupBy("split_id", "group_id").agg(F.min("event_pos").alias("_a"), F.max("event_pos").alias("_b"))
    near = found.where("role IN ('purged', 'embargoed')").drop("group_id").join(F.broadcast(tests), "split_id")
    away = F.when(F.col("event_pos") < F.col("_a"), F.col("event_pos") - F.col("_a")).otherwise(F.col("event_pos") - F.col("_b"))
    return near.withColumn("distance", away).where(F.abs("distance") <= rows).select("split_id", "group_id", "event_pos", "role", "distance")


def purged_folds(found: DataFrame, k: int = 5, embargo: int = 10, share: float | None = None) -> DataFrame:
    """(split_id, event_pos, t0, t1, fold, role): inner folds of each split's train events. A fold validates a contiguous run
    (floor(T / k) events, the last takes the rest) and trains on the others but those whose label overlaps the run and the
    `embargo` events behind it, or, with `share`, that share of all."""
    every = Window.partitionBy("split_id")
    df = found.where("role = 'train'").select("split_id", "event_pos", "t0", "t1")
    df = df.withColumn("_p", F.row_number().over(every.orderBy("event_pos")) - 1).withColumn("_n", F.count("*").over(every))
    own = F.least(F.floor(F.col("_p") / F.floor(F.col("_n") / k)), F.lit(k - 1)).cast("int")
    df = df.withColumn("_own", own)
    runs = df.groupBy("split_id", F.col("_own").alias("fold")).agg(F.min("t0").alias("_g0"), F.max("t0").alias("_g1"), F.max("_p").alias("_last"))  # k rows a split
    df = df.join(F.broadcast(runs), "split_id")
    overlaps = F.col("t0").between(F.col("_g0"), F.col("_g1")) | F.col("t1").between(F.col("_g0"), F.col("_g1")) | (F.col("t0") <= F.col("_g0")) & (F.col("t1") >= F.col("_g1"))
    length = F.lit(embargo) if share is None else F.floor(F.col("_n") * share)
    after = (F.col("_p") > F.col("_last")) & (F.col("_p") <= F.col("_last") + length)
    role = F.when(F.col("_own") == F.col("fold"), "validate").when(F.coalesce(overlaps, F.lit(False)), "purged").when(after, "embargoed").otherwise("train")
    return df.select("split_id", "event_pos", "t0", "t1", "fold", role.alias("role"))
