"""Column builders for ordered series: every one is a window expression partitioned by symbol, so a plan that uses many of
them shuffles once."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTIL_NOW = (Window.unboundedPreceding, Window.currentRow)


def series() -> "Window":
    return Window.partitionBy("symbol").orderBy("ts")


def roll(n: int):
    return series().rowsBetween(-(n - 1), 0)


def running():
    return series().rowsBetween(*UNTIL_NOW)


def full(value: Column, aggregate, n: int) -> Column:
    """An aggregate over the last n rows, null until n values are there."""
    return F.when(F.count(value).over(roll(n)) == n, aggregate(value).over(roll(n)))


def lag(value: Column | str, n: int = 1) -> Column:
    return F.lag(value, n).over(series())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """Null for what is no number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


class Ewm:
    """Exponentially weighted moments as windows in linear time.

    Weights relative to a row's place would grow without bound, so places are counted within blocks of L rows, after which
    a weight is below one part in 1e17: the moments of a row are those of its block so far and of the block before it.
    Rows carry their place in _place (see placed()), as windows do not nest.
    """

    def __init__(self, alpha: float) -> None:
        self.keep = 1 - alpha
        self.length = max(2, ceil(log(1e-17) / log(self.keep)))

    def _sum(self, term: Column, square: bool = False) -> Column:
        base = self.keep**2 if square else self.keep
        block = F.floor(F.col("_place") / self.length)
        inner = F.col("_place") - block * self.length
        grown = term * F.pow(F.lit(1 / base), inner)
        own = F.sum(grown).over(Window.partitionBy("symbol", block).orderBy("ts").rowsBetween(*UNTIL_NOW))
        last = F.sum(grown).over(Window.partitionBy("symbol").orderBy(block).rangeBetween(-1, -1))
        decay = F.pow(F.lit(base), inner)
        return decay * F.coalesce(own, F.lit(0.0)) + decay * (base**self.length) * F.coalesce(last, F.lit(0.0))

    def mean(self, x: Column, least: int = 1) -> Column:
        some = F.when(x.isNotNull(), 1.0)
        return F.when(F.count(x).over(running()) >= least, ratio(self._sum(x), self._sum(some)))

    def std(self, x: Column, least: int = 2) -> Column:
        """Bias-corrected, as of reliability weights."""
        some = F.when(x.isNotNull(), 1.0)
        w, w2 = self._sum(some), self._sum(some, square=True)
        mean = ratio(self._sum(x), w)
        spread = ratio(self._sum(x * x), w) - mean * mean
        var = F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))) * ratio(w * w, w * w - w2)
        return F.when(F.count(x).over(running()) >= least, F.sqrt(var))


def span(n: float) -> Ewm:
    return Ewm(2 / (n + 1))


def placed(df: DataFrame) -> DataFrame:
    """`df` with _place, each row's number in its series from 0."""
    return df.withColumn("_place", F.row_number().over(series()) - 1)


def backward(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """As-of join: each left row of (symbol, ts) with the latest `value` of `right` at or before it, in one shuffle."""
    names = left.columns
    mine = left.select(*names, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_of"))
    theirs = right.select("symbol", "ts", value).withColumn("_of", F.lit(0))
    for c in names:
        if c not in ("symbol", "ts"):
            theirs = theirs.withColumn(c, F.lit(None).cast(dict(left.dtypes)[c]))
    both = mine.unionByName(theirs)
    window = Window.partitionBy("symbol").orderBy("ts", "_of").rowsBetween(*UNTIL_NOW)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(window)).where("_of = 1").select(*names, value)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """All double columns rounded, what is no number as null."""
    return df.select(*(F.round(finite(F.col(c)), own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
