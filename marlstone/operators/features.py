"""Technical, statistical, lag and external features of bars, as window expressions over (symbol, ts)."""

from __future__ import annotations

from math import e, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.ts import Ewm, full, lag, placed, ratio, roll, running, span

LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 30)
WINDOW, YEAR = 30, 365
EPS = 1e-10


def _ohlcv() -> list[Column]:
    return [F.col(x) for x in ("open", "high", "low", "close", "volume")]


def _clamped(x: Column) -> Column:
    """max(x, 0) that keeps nulls, which greatest() would drop."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def log_return() -> Column:
    return F.log(F.col("close") / lag("close"))


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_returns", log_return()).withColumn("roc_14", (F.col("close") / lag("close", 14) - 1) * 100)


def volatility(bars: DataFrame) -> DataFrame:
    """Width of Bollinger bands; realised, Garman-Klass and Yang-Zhang volatility; terms of volatility."""
    o, h, l, c, _ = _ohlcv()
    r = F.col("log_returns")
    df = bars.withColumns(
        {
            "log_returns": log_return(),
            "_gk": 0.5 * F.log(h / l) ** 2 - (2 * F.log(F.lit(2.0)) - 1) * F.log(c / o) ** 2,
            "_on": F.log(o / lag(c)),
            "_oc": F.log(c / o),
            "_rs": F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o),
        }
    )
    n = WINDOW
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = full(F.col("_on"), F.var_samp, n) + k * full(F.col("_oc"), F.var_samp, n) + (1 - k) * full(F.col("_rs"), F.avg, n)
    sd = {m: full(r, F.stddev_samp, m) for m in (7, 30, 90)}
    return df.withColumns(
        {
            "bb_width": 4 * ratio(full(c, F.stddev_samp, 20), full(c, F.avg, 20)),
            "realized_vol": sd[30] * sqrt(YEAR),
            "gk_vol": F.sqrt(_clamped(full(F.col("_gk"), F.avg, n))),
            "yz_vol": F.sqrt(_clamped(yz)),
            "vol_term_7_30": ratio(sd[7], sd[30]),
            "vol_term_30_90": ratio(sd[30], sd[90]),
        }
    ).drop("_gk", "_on", "_oc", "_rs")


def sample_moments(x: Column, n: int) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis of the last n values."""
    g1, g2 = full(x, F.skewness, n), full(x, F.kurtosis, n)
    skew = g1 * sqrt(n * (n - 1)) / (n - 2)
    return skew, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def moments(bars: DataFrame) -> DataFrame:
    df = bars.withColumn("log_returns", log_return())
    skew, kurt = sample_moments(F.col("log_returns"), WINDOW)
    return df.withColumns({"skewness": skew, "kurtosis": kurt})


def oscillators(bars: DataFrame) -> DataFrame:
    """Stochastic, Williams %R, CCI."""
    _, h, l, c, _ = _ohlcv()
    high, low = full(h, F.max, 14), full(l, F.min, 14)
    df = bars.withColumns({"stoch_k": 100 * (c - low) / (high - low + EPS), "williams_r": -100 * (high - c) / (high - low + EPS), "_tp": (h + l + c) / 3})
    mean = full(F.col("_tp"), F.avg, 14)
    df = df.withColumns({"stoch_d": full(F.col("stoch_k"), F.avg, 3), "_mean": mean, "_list": F.collect_list("_tp").over(roll(14))})
    # windows do not nest in lambdas: the mean is a column first
    mad = F.aggregate("_list", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / 14
    return df.withColumn("cci_14", (F.col("_tp") - F.col("_mean")) / (0.015 * mad + EPS)).drop("_tp", "_mean", "_list")


def volumes(bars: DataFrame) -> DataFrame:
    """On-balance volume, money flow, volume-weighted averages, accumulation-distribution."""
    _, h, l, c, v = _ohlcv()
    tp = F.col("_tp")
    df = bars.withColumns({"_tp": (h + l + c) / 3, "_d": c - lag(c)})
    df = df.withColumn("_flow", tp * v).withColumn("_dt", tp - lag(tp))
    pos = F.when(F.col("_dt") > 0, F.col("_flow")).otherwise(0.0)
    neg = F.when(F.col("_dt") < 0, F.col("_flow")).otherwise(0.0)
    vwma = {m: ratio(full(c * v, F.sum, m), full(v, F.sum, m)) for m in (20, 50)}
    return df.withColumns(
        {
            "obv": F.sum(v * F.coalesce(F.signum("_d"), F.lit(0.0))).over(running()),
            "mfi_14": 100 - 100 / (1 + full(pos, F.sum, 14) / (full(neg, F.sum, 14) + EPS)),
            "vwma_ratio_20_50": ratio(vwma[20], vwma[50]),
            "adl": F.sum((2 * c - h - l) / (h - l + EPS) * v).over(running()),
        }
    ).drop("_tp", "_d", "_flow", "_dt")


def averages(bars: DataFrame) -> DataFrame:
    """Exponential features: RSI, MACD, ATR, ratios of averages, Chaikin's oscillator."""
    _, h, l, c, v = _ohlcv()
    d = c - lag(c)
    df = placed(bars).withColumns(
        {
            "_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
            "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
            "_tr": F.greatest(h - l, F.abs(h - lag(c)), F.abs(l - lag(c))),  # greatest skips the missing first close
            "_adl": F.sum((2 * c - h - l) / (h - l + EPS) * v).over(running()),
        }
    )
    wilder = Ewm(1 / 14)
    ema = {n: span(n).mean(c, n) for n in (12, 20, 26, 50, 200)}
    df = df.withColumns(
        {
            "rsi": 100 - 100 / (1 + ratio(wilder.mean(F.col("_up"), 14), wilder.mean(F.col("_down"), 14))),
            "macd": ema[12] - ema[26],
            "atr": wilder.mean(F.col("_tr"), 14),
            "ema_ratio_20_50": ratio(ema[20], ema[50]),
            "ema_ratio_50_200": ratio(ema[50], ema[200]),
            "chaikin_osc": span(3).mean(F.col("_adl"), 3) - span(10).mean(F.col("_adl"), 10),
        }
    )
    df = df.withColumn("macd_signal", span(9).mean(F.col("macd"), 9))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_up", "_down", "_tr", "_adl", "_place")


TA = (
    "log_returns rsi macd macd_signal macd_hist bb_width atr obv skewness kurtosis realized_vol gk_vol yz_vol ema_ratio_20_50 ema_ratio_50_200 "
    "vwma_ratio_20_50 roc_14 stoch_k stoch_d williams_r cci_14 chaikin_osc mfi_14 vol_term_7_30 vol_term_30_90"
).split()


MATH = "shannon_entropy negentropy lz_complexity variance_ratio jarque_bera hurst sadf smt_poly1 smt_exp".split()


def technical(bars: DataFrame) -> DataFrame:
    """All 25 technical features; every window shares one partitioning by symbol."""
    df = bars
    for part in (returns, volatility, moments, oscillators, volumes, averages):
        df = part(df)
    return df.select("symbol", "ts", *TA)


def statistical(bars: DataFrame) -> DataFrame:
    """Entropies, variance ratio and Jarque-Bera statistic of log returns."""
    r = F.col("log_returns")
    df = bars.withColumn("log_returns", log_return()).withColumn("_sum7", full(F.col("log_returns"), F.sum, 7))
    n = 90
    var30 = full(r, F.var_samp, 30)
    gauss = F.when(var30 >= 1e-20, 0.5 * F.log(2 * pi * e * var30))
    sums = F.var_samp("_sum7").over(roll(1).rowsBetween(-83, -1))
    a = (n - 1) / n
    s, k = full(r, F.skewness, n) * a**1.5, (full(r, F.kurtosis, n) + 3) * a**2 - 3
    low, high, held = full(r, F.min, 30), full(r, F.max, 30), F.collect_list(r).over(roll(30))
    df = df.withColumns(
        {
            "gaussian_entropy": gauss,
            "variance_ratio": ratio(F.when(F.count(r).over(roll(n)) == n, sums), 7 * full(r, F.var_samp, n)),
            "jarque_bera": n / 6 * (s * s + k * k / 4),
            "_low": low,
            "_high": high,
            "_held": held,
        }
    )
    width = (F.col("_high") - F.col("_low") + 2 * EPS) / 10
    bins = F.transform("_held", lambda x: F.least(F.greatest(F.floor((x - F.col("_low") + EPS) / width), F.lit(0)), F.lit(9)))
    df = df.withColumn("_bins", bins)

    def share(number: int) -> Column:
        return F.size(F.filter("_bins", lambda b: b == number)) / F.lit(30.0)

    shares = list(map(share, range(10)))
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    entropy = F.when(F.col("_high") - F.col("_low") < 1e-14, 0.0).otherwise(entropy)
    df = df.withColumn("shannon_entropy", F.when(F.col("_low").isNotNull(), entropy))
    return df.withColumn("negentropy", F.col("gaussian_entropy") - F.col("shannon_entropy")).select(
        "symbol", "ts", "shannon_entropy", "gaussian_entropy", "negentropy", "variance_ratio", "jarque_bera"
    )


def lags(bars: DataFrame, of: tuple[int, ...] = LAGS) -> DataFrame:
    df = bars.withColumn("log_returns", log_return())
    return df.select("symbol", "ts", *(lag("log_returns", k).alias(f"log_returns_lag{k}") for k in of))


def symmetric_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """sign(x) * ln(|x| + 1); absent columns are skipped."""
    return df.withColumns({x: F.signum(x) * F.log1p(F.abs(x)) for x in columns if x in df.columns})


def shifted_log(df: DataFrame, columns: list[str], eps: float = 1e-8) -> DataFrame:
    return df.withColumns({x: F.log(F.abs(x) + eps) for x in columns if x in df.columns})


def rescaled_yield(df: DataFrame, column: str) -> DataFrame:
    """Yields quoted in tenths of a percent brought to percent: divided by ten if their median is above ten."""
    middle = df.agg(F.percentile(column, 0.5).alias("_m"))
    return df.crossJoin(F.broadcast(middle)).withColumn(column, F.when(F.col("_m") > 10, F.col(column) / 10).otherwise(F.col(column))).drop("_m")


#: External features as (name, kind, source column, days or second column): rate of change in percent, log return, level,
#: difference, ratio, share in percent (fixed values).
EXTERNAL = (
    ("dxy_roc_30", "roc", "dxy", 30), ("us10y", "level", "us10y", None), ("us2y", "level", "us2y", None),
    ("yield_curve_2y10y", "difference", "us10y", "us2y"), ("yield_curve_10y30y", "difference", "us30y", "us10y"), ("vix", "level", "vix", None),
    *((f"{s}_ret_{k}", "log", s, k) for s in ("sp500", "nasdaq", "gold", "silver", "copper", "oil", "natgas") for k in (30, 14)),
    ("eth_btc_ratio", "ratio", "eth", "close"), ("active_addr_roc_14", "roc", "active_addr", 14), ("tx_count_roc_14", "roc", "tx_count", 14),
    ("hashrate_roc_30", "roc", "hashrate", 30), ("mvrv", "level", "mvrv", None), ("net_exchange_flow", "difference", "flow_in", "flow_out"),
    ("fee_per_tx", "ratio", "fees", "tx_count"), ("exchange_supply_pct", "share", "exchange_supply", "supply"), ("issuance_ntv", "level", "issuance", None),
)


def external_feature(kind: str, a: str, b) -> Column:
    x = F.col(a)
    if kind == "roc":
        return (ratio(x, lag(x, b)) - 1) * 100
    if kind == "log":
        return F.log(ratio(x, lag(x, b)))
    if kind == "difference":
        return x - F.col(b)
    if kind == "ratio":
        return ratio(x, F.col(b))
    if kind == "share":
        return 100 * ratio(x, F.col(b))
    return x


#: Categories of external features that can be left out, by the names' position in EXTERNAL.
CATEGORIES = {"macro": EXTERNAL[:20], "crypto": EXTERNAL[20:21], "onchain": EXTERNAL[21:]}


def chosen(macro: bool = True, crypto: bool = True, onchain: bool = True) -> tuple:
    """The external features of the categories that are switched on."""
    return tuple(x for name, on in (("macro", macro), ("crypto", crypto), ("onchain", onchain)) if on for x in CATEGORIES[name])


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_missing, share): rows without a value."""
    row = df.agg(F.count("*").alias("_t"), *(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns))
    stacked = row.select("_t", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in columns))).alias("x"))
    return stacked.select("x.*", ratio(F.col("x.n_missing").cast("double"), F.col("_t").cast("double")).alias("share"))


def external(bars: DataFrame, sources: dict[str, DataFrame], wanted=EXTERNAL) -> DataFrame:
    """External features on the bars' days: sources aligned backward first, all in one shuffle, then shifted by calendar days; a
    feature whose source is missing is a column of nulls."""
    empty = F.lit(None)
    both = bars.select("symbol", "ts", "close", empty.cast("string").alias("_name"), empty.cast("double").alias("_value"), F.lit(1).alias("_of"))
    for name, source in sources.items():
        both = both.union(source.select("symbol", "ts", empty.cast("double"), F.lit(name), F.col("value").cast("double"), F.lit(0)))
    until = Window.partitionBy("symbol").orderBy("ts", "_of").rowsBetween(Window.unboundedPreceding, 0)
    known = {n: F.last(F.when(F.col("_name") == n, F.col("_value")), ignorenulls=True).over(until) for n in sources}
    df = both.select("symbol", "ts", "close", "_of", *(x.alias(n) for n, x in known.items())).where("_of = 1")
    have = {"close", *sources}
    out = {n: external_feature(k, a, b) if a in have and (not isinstance(b, str) or b in have) else empty.cast("double") for n, k, a, b in wanted}
    return df.select("symbol", "ts", *(x.alias(n) for n, x in out.items()))


def align(features: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Features, labels and weights on their common events, with event_pos, the event's number from 0."""
    df = features.join(labels, ["symbol", "ts"]).join(weights, ["symbol", "ts"])
    return placed(df).withColumnRenamed("_place", "event_pos")


def alignment_faults(aligned: DataFrame) -> DataFrame:
    """Counts of what an aligned set must not have."""
    numbers = [x for x, t in aligned.dtypes if t == "double"]
    row = aligned.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("symbol", "ts")).alias("repeated"),
        F.count_if(F.col("t1").isNull()).alias("open_ended"),
        F.count_if(F.col("w") <= 0).alias("weightless"),
        *(F.count(x).alias(f"_{x}") for x in numbers),
    )
    return row.withColumn("empty_columns", sum((F.when(F.col(f"_{x}") == 0, 1).otherwise(0) for x in numbers), F.lit(0))).drop(*(f"_{x}" for x in numbers))
