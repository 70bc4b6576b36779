"""Sources: OHLCV bars and external series from the tables at hand, with gap filling and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")


class InputError(ValueError):
    """The input breaks the contract of a source."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, symbol, ts, price: str, order, volume) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of ticks, opened and closed by the order within a bar."""
    keyed = ticks.select(F.expr(symbol).alias("symbol"), F.expr(ts).alias("ts"), F.col(price).alias("_price"), F.expr(order).alias("_order"), F.expr(volume).alias("_volume"))
    return keyed.groupBy("symbol", "ts").agg(
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        F.round(F.sum("_volume"), 2).cast("double").alias("volume"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "orders"), "'ALL'", "cast(o_orderdate as date)", "o_totalprice", "o_orderkey", "o_totalprice")


def bars_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "orders"), "o_orderpriority", "cast(o_orderdate as date)", "o_totalprice", "o_orderkey", "o_totalprice")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "events"), "'ALL'", "date_trunc('HOUR', ts)", "value", "struct(ts, event_id)", "1")


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series beside the bars: the turnover of each day that has any."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return days.select(F.lit("ALL").alias("symbol"), "ts", "value")


def gaps(daily: DataFrame) -> DataFrame:
    """Runs of missing days: symbol, first missing day, length."""
    after = F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    found = daily.select("symbol", "ts", after.alias("_next")).where(F.datediff("_next", "ts") > 1)
    return found.select("symbol", F.date_add("ts", 1).alias("gap_start"), (F.datediff("_next", "ts") - 1).alias("days"))


def fill_gaps(daily: DataFrame, most: int = 3, check: bool = True) -> DataFrame:
    """Calendar-complete bars: prices of up to `most` missing days carried forward, their volume 0; longer gaps are an error."""
    if check:
        longest = gaps(daily).agg(F.max("days")).first()[0]
        if longest is not None and longest > most:
            raise InputError(f"a gap of {longest} days is longer than {most}")
    limits = daily.groupBy("symbol").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    spine = limits.select("symbol", F.explode(F.sequence("_from", "_to")).alias("ts"))
    window = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-most, 0)
    joined = spine.join(daily, ["symbol", "ts"], "left")
    carried = [F.last(c, ignorenulls=True).over(window).alias(c) for c in OHLCV[:4]]
    return joined.select("symbol", "ts", *carried, F.coalesce("volume", F.lit(0.0)).alias("volume"))


def audit(daily: DataFrame) -> DataFrame:
    """Counts of bars that break an invariant, by symbol."""
    return daily.groupBy("symbol").agg(
        F.count("*").alias("n_bars"),
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_below"),
        F.count_if(F.col("low") > F.least("open", "close")).alias("low_above"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.col("close").isNull()).alias("no_close"),
        (F.count("ts") - F.count_distinct("ts")).alias("duplicates"),
    )


def validated(daily: DataFrame) -> DataFrame:
    """Bars without rows that lack a close; empty input and repeated dates are errors."""
    kept = daily.dropna(subset=["close"])
    worst = kept.groupBy("symbol", "ts").count().agg(F.max("count")).first()[0]
    if worst is None:
        raise InputError("no bars")
    if worst > 1:
        raise InputError("a date appears twice")
    return kept


def numeric(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers, null where they are none, one row late so that a row knows only the past."""
    late = Window.partitionBy("symbol").orderBy("ts")
    return raw.select("symbol", "ts", *(F.lag(F.expr(f"try_cast(`{c}` as double)")).over(late).alias(c) for c in columns))


def first_passing(candidates: list[DataFrame], least: int) -> DataFrame:
    """The first source with more than `least` rows."""
    for df in candidates:
        if df.limit(least + 1).count() > least:
            return df
    raise InputError("no source has enough rows")


def cached(build, path: str, spark: SparkSession, columns: list[str], first, last, slack: int = 0) -> DataFrame:
    """A stored matrix if it covers the dates, give or take `slack` days, and has the columns asked for; else `build(columns)`
    gives those that it lacks and they are stored together, or all if the dates differ."""
    try:
        held = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  no such store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    if held is not None:
        limits = held.agg(F.datediff(F.min("ts"), F.lit(first)).alias("a"), F.datediff(F.lit(last), F.max("ts")).alias("b")).first()
        fits = None not in limits and (limits == (0, 0) if slack == 0 else max(limits) <= slack)
        lacking = [c for c in columns if c not in held.columns]
        if fits and not lacking:
            return held.select("symbol", "ts", *columns)
        if fits:
            more = build(lacking).select("symbol", "ts", *lacking)
            both = held.join(more, ["symbol", "ts"], "full")
            both.write.mode("overwrite").parquet(f"{path}-next")  # a matrix cannot be overwritten while it is read
            spark.read.parquet(f"{path}-next").write.mode("overwrite").parquet(path)
            return spark.read.parquet(path).select("symbol", "ts", *columns)
    build(columns).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("symbol", "ts", *columns)


def without_lost_closes(daily: DataFrame, filled: DataFrame) -> DataFrame:
    """`filled` without the days that `daily` has without a close: filling must not bring them back."""
    return filled.join(daily.where("close IS NULL").select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def with_fallback(yields: DataFrame, long_: DataFrame, spread: DataFrame, least: int = 2000) -> DataFrame:
    """A short yield's series (symbol, ts, value): itself if it has more than `least` rows, else the long yield less the spread."""
    try:
        return first_passing([yields], least)
    except InputError:
        a, b = long_.withColumnRenamed("value", "a"), spread.withColumnRenamed("value", "b")
        return a.join(b, ["symbol", "ts"]).select("symbol", "ts", (F.col("a") - F.col("b")).alias("value"))


def merged(series: dict[str, DataFrame]) -> DataFrame:
    """Series (symbol, ts, value) side by side on the union of their days, carried forward, from the first day that all have."""
    out = None
    for name, df in series.items():
        own = df.withColumnRenamed("value", name)
        out = own if out is None else out.join(own, ["symbol", "ts"], "full")
    until = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("symbol", "ts", *(F.last(n, ignorenulls=True).over(until).alias(n) for n in series)).dropna()


def filled_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with missing values taken from the next row that has one."""
    onward = Window.partitionBy("symbol").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(onward) for c in columns})


def fingerprint(df: DataFrame) -> DataFrame:
    """(columns, first_day, last_day) of a matrix: what a stored one must agree in."""
    names = F.lit(",".join(sorted(c for c in df.columns if c not in ("symbol", "ts"))))
    return df.agg(F.min("ts").alias("first_day"), F.max("ts").alias("last_day")).withColumn("columns", names)


def unexpected(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns that a matrix lacks and those that it has beyond the expected ones."""
    have = [c for c in df.columns if c not in ("symbol", "ts")]
    return {"missing": [c for c in expected if c not in have], "extra": [c for c in have if c not in expected]}
