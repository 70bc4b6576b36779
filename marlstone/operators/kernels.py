"""Array kernels for what windows cannot express, each over one symbol's series or one window of it, in Arrow batches."""

from __future__ import annotations

from math import log, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.ts import roll
from marlstone.operators.evaluate import phi
from marlstone.operators.features import log_return

#: Response-surface coefficients of the unit-root t statistic with a constant: limits, and polynomials of the normal
#: quantile left and right of the break (published by MacKinnon; fixed values).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def lempel_ziv(bits: np.ndarray) -> int:
    """Number of phrases of the 1976 parsing: each phrase is the shortest that has not occurred before its last symbol."""
    s = "".join("1" if b else "0" for b in bits)
    start, phrases = 0, 0
    while start < len(s):
        size = 1
        while start + size <= len(s) and s[start : start + size] in s[: start + size - 1]:
            size += 1
        phrases += 1
        start += size
    return phrases


def rescaled_range(x: np.ndarray, sizes: tuple[int, ...] = (14, 30, 60, 90)) -> float:
    """Hurst exponent: the slope of log R/S on log size, R/S averaged over whole chunks."""
    points = []
    for n in sizes:
        chunks = x[: len(x) // n * n].reshape(-1, n)
        walk = np.cumsum(chunks - chunks.mean(1, keepdims=True), axis=1)
        spread, sd = walk.max(1) - walk.min(1), chunks.std(1, ddof=1)
        ok = sd > 1e-14
        if ok.any():
            points.append((log(n), log((spread[ok] / sd[ok]).mean())))
    if len(points) < 2:
        return np.nan
    a = np.array(points)
    return float(np.polyfit(a[:, 0], a[:, 1], 1)[0])


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors, the residual sum of squares."""
    q, r = np.linalg.qr(x)
    b = np.linalg.solve(r, q.T @ y)
    rss = float(((y - x @ b) ** 2).sum())
    inverse = np.linalg.inv(r)
    return b, np.sqrt(np.maximum((inverse**2).sum(1) * rss / max(1, len(y) - x.shape[1]), 0)), rss


def dickey_fuller(y: np.ndarray, lags: int, usable: int | None = None) -> tuple[float, float]:
    """t statistic of the level in the augmented regression with a constant, and the regression's AIC."""
    d = np.diff(y)
    keep = len(d) - (lags if usable is None else usable)
    level, target = y[:-1][-keep:], d[-keep:]
    columns = [level, *(d[len(d) - keep - i : len(d) - i] for i in range(1, lags + 1)), np.ones(keep)]
    b, se, rss = ols(np.column_stack(columns), target)
    aic = keep * (log(2 * np.pi * max(rss, 1e-300) / keep) + 1) + 2 * len(b)
    return (float(b[0] / se[0]) if se[0] > 0 else np.nan), aic


def unit_root_p(t: float) -> float:
    """Approximate p value of the statistic."""
    if np.isnan(t):
        return 1.0
    if t > TAU_MAX:
        return 1.0
    if t < TAU_MIN:
        return 0.0
    from statistics import NormalDist

    c = SMALL_P if t <= TAU_STAR else LARGE_P
    return NormalDist().cdf(sum(a * t**i for i, a in enumerate(c)))


def adf(y: np.ndarray, most: int = 14) -> tuple[float, float]:
    """Statistic and p value, lags chosen by AIC on a common sample; short or constant series have p = 1."""
    y = y[~np.isnan(y)]
    if len(y) < 50 or np.ptp(y) < 1e-14:
        return np.nan, 1.0
    most = min(most, len(y) // 2 - 2)
    best = min(range(most + 1), key=lambda k: dickey_fuller(y, k, most)[1])
    t = dickey_fuller(y, best)[0]
    return t, unit_root_p(t)


def _window_kernel(bars: DataFrame, n: int, name: str, kernel) -> DataFrame:
    @F.pandas_udf("double")
    def apply(windows: pd.Series) -> pd.Series:
        return pd.Series([kernel(np.asarray(w, float)) if len(w) == n else None for w in windows], dtype=float)

    df = bars.withColumn("_r", log_return()).withColumn("_w", F.collect_list("_r").over(roll(n)))
    return df.select("symbol", "ts", apply("_w").alias(name))


def lz_complexity(bars: DataFrame, n: int = 90) -> DataFrame:
    return _window_kernel(bars, n, "lz_complexity", lambda w: lempel_ziv(w > 0) / (n / log2(n)))


def hurst(bars: DataFrame, n: int = 180) -> DataFrame:
    return _window_kernel(bars, n, "hurst", rescaled_range)


def _suprema(bars: DataFrame, names: list[str], kernel, block: int = 64) -> DataFrame:
    """Expanding suprema: tasks are ranges of end points of a symbol, each with the series up to its end; the kernel gives the
    values of all end points of a task."""
    series = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s"))
    blocks = F.sequence(F.lit(0), (F.floor((F.size("s") - 1) / block)).cast("int"))
    tasks = series.select("symbol", F.explode(blocks).alias("_b"), "s").select("symbol", "_b", F.slice("s", F.lit(1), (F.col("_b") + 1) * block).alias("s"))
    # each task carries a prefix of one symbol's closes: a day is sixteen bytes
    kind = "symbol string, ts date, " + ", ".join(f"{x} double" for x in names)

    def run(frames):
        for f in frames:
            for symbol, b, s in zip(f["symbol"], f["_b"], f["s"]):
                y = np.log(np.array([r["close"] for r in s], float))
                days = [r["ts"] for r in s]
                found = kernel(y, np.arange(b * block, len(y)))
                yield pd.DataFrame({"symbol": symbol, "ts": days[b * block :]} | dict(zip(names, found)))

    return tasks.repartition("symbol", "_b").mapInPandas(run, kind)


def sadf(bars: DataFrame, least: int = 90) -> DataFrame:
    """Supremum over start points of the unit-root statistic with one lag, for every end point."""

    def supremum(y: np.ndarray, t: int) -> float:
        if t < least:
            return np.nan
        # all regressions end at t: normal equations of suffixes, centred, as running sums from the end
        d = np.diff(y[: t + 1])
        z = np.column_stack([y[1:t] - y[t], d[:-1], np.ones(t - 1)])
        target = d[1:]
        products = np.cumsum((z[:, :, None] * z[:, None, :])[::-1], axis=0)[::-1]
        moments = np.cumsum((z * target[:, None])[::-1], axis=0)[::-1]
        squares = np.cumsum((target**2)[::-1])[::-1]
        starts = np.arange(0, t - least + 1)
        a, m, s = products[starts], moments[starts], squares[starts]
        inverse = np.linalg.pinv(a)
        b = (inverse @ m[:, :, None])[:, :, 0]
        n = (t - 1) - starts
        rss = np.maximum(s - (b * m).sum(1), 0)
        se = np.sqrt(np.maximum(rss / (n - 3) * inverse[:, 0, 0], 1e-300))
        return float(np.nanmax(b[:, 0] / se))

    def kernel(y: np.ndarray, ends: np.ndarray) -> list[list[float]]:
        return [[supremum(y, int(t)) for t in ends]]

    return _suprema(bars, ["sadf"], kernel)


def smt(bars: DataFrame, least: int = 90) -> DataFrame:
    """Suprema over start points of |t| of a linear and an exponential trend, damped by the root of the length."""

    def kernel(y: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        last = int(ends[-1])
        back = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(last), y - y.mean()]), last + 1)[ends, ::-1]
        n = np.arange(1, last + 2)
        # for every end and length: sums of the part, and its products with each trend, counted back from the end
        total, square = np.cumsum(back, 1), np.cumsum(back**2, 1)
        out = [np.zeros(len(ends)), np.zeros(len(ends))]
        for low in range(least, last + 1, 256):
            own = n[low : low + 256]
            place = own[:, None] - 1 - np.arange(own[-1])[None, :]
            held = place >= 0
            for i, trend in enumerate((place, np.exp(place / own[:, None]))):
                x = np.where(held, trend, 0.0)
                sx, sxx = x.sum(1), (x**2).sum(1) - x.sum(1) ** 2 / own
                sy, syy = total[:, own - 1], square[:, own - 1] - total[:, own - 1] ** 2 / own
                sxy = back[:, : own[-1]] @ x.T - sx * sy / own
                rss = np.maximum(syy - sxy**2 / sxx, 1e-300)
                value = np.abs(sxy / sxx) / np.sqrt(rss / (own - 2) / sxx) / np.sqrt(own)
                value[own[None, :] > ends[:, None] + 1] = 0
                out[i] = np.maximum(out[i], value.max(1))
        return [np.where(ends >= least, x, np.nan) for x in out]

    return _suprema(bars, ["smt_poly1", "smt_exp"], kernel)


def stationarity(features: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(symbol, feature, n, statistic, p_value, stationary) of each feature's series."""
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    stacked = features.select("symbol", "ts", F.explode(entries).alias("p")).select("symbol", "ts", "p.*").where("x IS NOT NULL")

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values("ts")["x"].to_numpy(float)
        t, p = adf(y)
        return pd.DataFrame([(frame["symbol"].iloc[0], frame["feature"].iloc[0], len(y), t, p, bool(p < alpha))], columns=["symbol", "feature", "n", "statistic", "p_value", "stationary"])

    return stacked.groupBy("symbol", "feature").applyInPandas(test, "symbol string, feature string, n long, statistic double, p_value double, stationary boolean")


def kernel_of(d: float, tau: float = 1e-4, most: int = 200) -> list[float]:
    """Weights of fractional differencing, cut where they fall below tau."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < tau:
            break
        out.append(w)
    return out


def fractional(df: DataFrame, column: str, d: float, name: str | None = None) -> DataFrame:
    """The column differenced d times: a fixed window's dot product, null until the window is full."""
    w = kernel_of(d)
    window = roll(len(w))
    held = F.collect_list(F.struct("ts", F.col(column).alias("x"))).over(window)
    df = df.withColumn("_held", held)
    values = F.transform("_held", lambda s: s["x"])
    total = F.aggregate(F.zip_with(values, F.array(*map(F.lit, reversed(w))), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(name or column, F.when(F.size("_held") == len(w), total)).drop("_held")


def optimal_d(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(symbol, d): the smallest of 0, .05, ..., 1 that makes each symbol's x stationary; 1 if none does."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values("ts")["x"].to_numpy(float)
        found = 1.0
        for i in range(21):
            w = np.array(kernel_of(i / 20))
            x = np.convolve(y, w, "valid") if len(y) >= len(w) else np.empty(0)
            if adf(x)[1] < alpha:
                found = i / 20
                break
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "d": [found]})

    return series.groupBy("symbol").applyInPandas(find, "symbol string, d double")


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for x >= 1: raised to 6 and more, then its asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def neighbour_information(x: np.ndarray, label: np.ndarray, k: int = 5) -> float:
    """Mutual information in nats of a number and a class by nearest neighbours: for each point, those within the distance of its
    k-th neighbour of its own class are counted among all points; classes of one point are left out."""
    x = x / (x.std() or 1.0)
    kept, own, sizes, within = np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    radius = np.zeros(len(x))
    for c in np.unique(label):
        at = np.flatnonzero(label == c)
        if len(at) < 2:
            continue
        near = min(k, len(at) - 1)
        order = at[np.argsort(x[at], kind="stable")]
        v = x[order]
        # the k-th neighbour of a sorted value is an end of one of the runs of k + 1 values around it
        padded = np.concatenate([np.full(near, -np.inf), v, np.full(near, np.inf)])
        runs = np.lib.stride_tricks.sliding_window_view(padded, near + 1)
        spread = np.stack([np.maximum(v - runs[j : j + len(v), 0], runs[j : j + len(v), -1] - v) for j in range(near + 1)])
        radius[order] = spread.min(0)
        kept[at], own[at], sizes[at] = True, near, len(at)
    every = np.sort(x[kept])
    if not len(every):
        return 0.0
    at, r, n = x[kept], radius[kept], len(every)
    low, high = np.searchsorted(every, at - r, "left"), np.searchsorted(every, at + r, "right")
    while True:  # ends at exactly that distance, or by rounding, are out
        out = (low < n) & (every[np.minimum(low, n - 1)] < at) & (at - every[np.minimum(low, n - 1)] >= r)
        off = (high > 0) & (every[high - 1] > at) & (every[high - 1] - at >= r)
        if not out.any() and not off.any():
            break
        low, high = low + out, high - off
    within = high - low
    value = digamma(np.array([len(every)]))[0] + digamma(own[kept]).mean() - digamma(sizes[kept]).mean() - digamma(np.maximum(within, 1)).mean()
    return max(0.0, float(value))


def mutual_information_knn(features: DataFrame, columns: list[str], label: str, k: int = 5) -> DataFrame:
    """(feature, nats) of each feature and a label, over rows that have the feature; a feature's values are one group."""
    entries = F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("x")) for x in columns))
    stacked = features.select(F.col(label).cast("int").alias("label"), F.explode(entries).alias("p")).select("label", "p.*").where("x IS NOT NULL")

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [frame["feature"].iloc[0]], "nats": [neighbour_information(frame["x"].to_numpy(float), frame["label"].to_numpy(), k)]})

    return stacked.groupBy("feature").applyInPandas(measure, "feature string, nats double")


def black_scholes(options: DataFrame) -> DataFrame:
    """Prices of (spot, strike, years, rate, vol, call) options; intrinsic value at or after expiry."""
    s, k, t, r, v = (F.col(c) for c in ("spot", "strike", "years", "rate", "vol"))
    spread = v * F.sqrt(F.greatest(t, F.lit(0.0)))
    d1 = (F.log(s / k) + (r + v * v / 2) * t) / F.nullif(spread, F.lit(0.0))
    df = options.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - spread)
    sign = F.when(F.col("call"), 1.0).otherwise(-1.0)
    df = df.withColumn("_n1", phi(sign * F.col("_d1"))).withColumn("_n2", phi(sign * F.col("_d2")))
    live = sign * (s * F.col("_n1") - k * F.exp(-r * t) * F.col("_n2"))
    return df.withColumn("price", F.when(t <= 0, F.greatest(sign * (s - k), F.lit(0.0))).otherwise(live)).drop("_d1", "_d2", "_n1", "_n2")


def pricing_errors(options: DataFrame, spots: DataFrame, day: str, rate: float = 0.05, least: int = 7, most: int = 90, floor: float = 10.0) -> DataFrame:
    """How far Black-Scholes prices of calls are from the market's, with realised and with Yang-Zhang volatility.

    `options` are (mark, strike, expiry, call), the mark in units of the underlying; `spots` (symbol, spot, realized_vol, yz_vol), a row
    a series. Calls that end at 8 o'clock of a day more than `least` and less than `most` days ahead, with a market price of `floor` or
    more, count. Per series: their number, mean absolute errors, median errors in percent, and by how many points the median falls with
    Yang-Zhang volatility.
    """
    years = (F.datediff("expiry", F.lit(day).cast("date")) + 8 / 24) / 365
    near = options.where("call").withColumn("years", years).where((years * 365 > least) & (years * 365 < most))
    rows = near.crossJoin(F.broadcast(spots)).withColumn("market", F.col("mark") * F.col("spot")).where(F.col("market") >= floor)  # a row a series
    rows = rows.withColumn("rate", F.lit(rate)).drop("price", "vol")
    for name, vol in (("rv", "realized_vol"), ("yz", "yz_vol")):
        rows = black_scholes(rows.withColumn("vol", F.col(vol))).withColumn(name, F.abs(F.col("price") - F.col("market"))).drop("price", "vol")
    share = {n: 100 * F.col(n) / F.col("market") for n in ("rv", "yz")}
    found = rows.groupBy("symbol").agg(F.count("*").alias("n"), *(F.avg(n).alias(f"mean_{n}") for n in share), *(F.percentile(x, 0.5).alias(f"median_{n}") for n, x in share.items()))
    return found.withColumn("gain", F.col("median_rv") - F.col("median_yz"))
