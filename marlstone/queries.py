"""The registered queries of the library and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import ts
from marlstone.functions.store import stored
from marlstone.operators import cv, diagnose, evaluate, features, kernels, labeling, models
from marlstone.plans import flows
from marlstone.sources import bars as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6, **own: int):
    """Register a query by its function's name; double columns are rounded, so that the last bits do not matter."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = lambda spark, d: ts.rounded(make(spark, d), digits, **own)
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


def _ohlcv(key: str, name: str = "bars") -> str:
    return f"""{name} AS (SELECT {key} AS symbol, CAST(o_orderdate AS DATE) AS ts, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, round(sum(o_totalprice), 2) AS volume FROM orders GROUP BY 1, 2)"""


MULTI, DAILY = _ohlcv("o_orderpriority"), _ohlcv("'ALL'")
W = "(PARTITION BY symbol ORDER BY ts)"


def _roll(agg: str, x: str, n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def _select(columns: dict[str, str], digits: dict[str, int] | None = None, keys: str = "symbol, ts", source: str = "t") -> str:
    own = digits or {}
    return f"SELECT {keys}, " + ", ".join(f"round({x}, {own.get(k, 6)}) AS {k}" for k, x in columns.items()) + f" FROM {source}"


R = f"r AS (SELECT *, ln(close / lag(close) OVER {W}) AS log_returns FROM bars)"


@query(f"WITH {DAILY} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_daily(spark, d):
    return source.bars_daily(spark, d)


@query(f"WITH {MULTI} SELECT symbol, ts, open, high, low, close, volume FROM bars", 2)
def bars_multi(spark, d):
    return source.bars_multi(spark, d)


@query(
    """SELECT 'ALL' AS symbol, date_trunc('hour', ts) AS ts, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
    round(arg_max(value, (ts, event_id)), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 2"""
)
def bars_hourly(spark, d):
    return source.bars_hourly(spark, d)


@query(
    f"""WITH {DAILY}, n AS (SELECT symbol, ts, lead(ts) OVER {W} AS nx FROM bars)
    SELECT symbol, CAST(ts + 1 AS DATE) AS gap_start, CAST(nx - ts - 1 AS INTEGER) AS days FROM n WHERE nx - ts > 1"""
)
def gap_runs(spark, d):
    return source.gaps(source.bars_daily(spark, d))


@query(
    f"""WITH {DAILY}, s AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM bars),
    j AS (SELECT 'ALL' AS symbol, s.ts, open, high, low, close, volume FROM s LEFT JOIN bars USING (ts)) SELECT symbol, ts,
    """
    + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS {c}" for c in ("open", "high", "low", "close"))
    + ", coalesce(volume, 0.0) AS volume FROM j"
)
def gap_fill(spark, d):
    return source.fill_gaps(source.bars_daily(spark, d), check=False)  # prices of longer gaps stay null


@query(
    f"""WITH {MULTI} SELECT symbol, count(*) AS n_bars, count(*) FILTER (high < greatest(open, close)) AS high_below, count(*) FILTER (low > least(open, close)) AS low_above,
    count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (close IS NULL) AS no_close, count(ts) - count(DISTINCT ts) AS duplicates FROM bars GROUP BY 1"""
)
def ohlcv_audit(spark, d):
    return source.audit(source.bars_multi(spark, d))


@query(f"WITH {MULTI}, {R}, t AS (SELECT *, (close / lag(close, 14) OVER {W} - 1) * 100 AS roc_14 FROM r) " + _select({"log_returns": "log_returns", "roc_14": "roc_14"}))
def returns(spark, d):
    return features.returns(source.bars_multi(spark, d)).select("symbol", "ts", "log_returns", "roc_14")


_VOL = ("bb_width", "realized_vol", "gk_vol", "yz_vol", "vol_term_7_30", "vol_term_30_90")


@query(
    f"""WITH {MULTI}, {R}, p AS (SELECT *, 0.5 * ln(high / low) ** 2 - (2 * ln(2.0::DOUBLE) - 1) * ln(close / open) ** 2 AS gk, ln(open / lag(close) OVER {W}) AS n1, ln(close / open) AS n2,
    ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM r), t AS (SELECT symbol, ts, 4 * ({_roll("stddev_samp", "close", 20)}) / ({_roll("avg", "close", 20)}) AS bb_width,
    ({_roll("stddev_samp", "log_returns", 30)}) * sqrt(365) AS realized_vol, sqrt(CASE WHEN ({_roll("avg", "gk", 30)}) < 0 THEN 0 ELSE ({_roll("avg", "gk", 30)}) END) AS gk_vol,
    sqrt(({_roll("var_samp", "n1", 30)}) + 0.34 / (1.34 + 31 / 29) * ({_roll("var_samp", "n2", 30)}) + (1 - 0.34 / (1.34 + 31 / 29)) * ({_roll("avg", "rs", 30)})) AS yz_vol,
    ({_roll("stddev_samp", "log_returns", 7)}) / nullif(({_roll("stddev_samp", "log_returns", 30)}), 0) AS vol_term_7_30,
    ({_roll("stddev_samp", "log_returns", 30)}) / nullif(({_roll("stddev_samp", "log_returns", 90)}), 0) AS vol_term_30_90 FROM p) """
    + _select({k: k for k in _VOL})
)
def volatility(spark, d):
    return features.volatility(source.bars_multi(spark, d)).select("symbol", "ts", *_VOL)


@query(
    f"WITH {MULTI}, {R}, t AS (SELECT symbol, ts, {_roll('skewness', 'log_returns', 30)} AS skewness, {_roll('kurtosis', 'log_returns', 30)} AS kurtosis FROM r) "
    + _select({"skewness": "skewness", "kurtosis": "kurtosis"})
)
def rolling_skew_kurt(spark, d):
    return features.moments(source.bars_multi(spark, d)).select("symbol", "ts", "skewness", "kurtosis")


_OSC = ("stoch_k", "stoch_d", "williams_r", "cci_14")
_L14 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {MULTI}, a AS (SELECT *, ({_roll("max", "high", 14)}) AS hh, ({_roll("min", "low", 14)}) AS ll, (high + low + close) / 3 AS tp FROM bars),
    b AS (SELECT *, 100 * (close - ll) / (hh - ll + 1e-10) AS stoch_k, -100 * (hh - close) / (hh - ll + 1e-10) AS williams_r, list(tp) {_L14} AS l, ({_roll("avg", "tp", 14)}) AS m FROM a),
    t AS (SELECT *, ({_roll("avg", "stoch_k", 3)}) AS stoch_d, CASE WHEN m IS NOT NULL THEN (tp - m) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - m))) + 1e-10) END AS cci_14 FROM b) """
    + _select({k: k for k in _OSC}),
    5,
)
def oscillators(spark, d):
    return features.oscillators(source.bars_multi(spark, d)).select("symbol", "ts", *_OSC)


ORACLES["oscillators"] = ORACLES["oscillators"].replace(", 6) AS", ", 5) AS")
_VOLUME = ("obv", "mfi_14", "vwma_ratio_20_50", "adl")


@query(
    f"""WITH {MULTI}, a AS (SELECT *, (high + low + close) / 3 AS tp, close - lag(close) OVER {W} AS dc FROM bars), b AS (SELECT *, tp * volume AS flow, tp - lag(tp) OVER {W} AS dt FROM a),
    c AS (SELECT *, CASE WHEN dt > 0 THEN flow ELSE 0.0 END AS pos, CASE WHEN dt < 0 THEN flow ELSE 0.0 END AS neg, close * volume AS cv FROM b),
    t AS (SELECT symbol, ts, sum(volume * coalesce(sign(dc), 0)) OVER {W} AS obv, 100 - 100 / (1 + ({_roll("sum", "pos", 14)}) / (({_roll("sum", "neg", 14)}) + 1e-10)) AS mfi_14,
    (({_roll("sum", "cv", 20)}) / nullif(({_roll("sum", "volume", 20)}), 0)) / nullif((({_roll("sum", "cv", 50)}) / nullif(({_roll("sum", "volume", 50)}), 0)), 0) AS vwma_ratio_20_50,
    sum((2 * close - high - low) / (high - low + 1e-10) * volume) OVER {W} AS adl FROM c) """
    + _select({k: k for k in _VOLUME}, {"obv": 2, "adl": 0, "mfi_14": 4}),
    6,
    obv=2,
    adl=0,
    mfi_14=4,
)
def volumes(spark, d):
    return features.volumes(source.bars_multi(spark, d)).select("symbol", "ts", *_VOLUME)


def _ewm(x: str, keep: str, least: int, block: int = 200) -> str:
    """Weighted mean: weights relative to the start of a block, and the block before it."""
    inner = f"(k - (k // {block}) * {block})"
    own = f"(PARTITION BY symbol, k // {block} ORDER BY ts)"
    last = f"(PARTITION BY symbol ORDER BY k // {block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    parts = []
    for v in (x, f"CASE WHEN {x} IS NOT NULL THEN 1.0::DOUBLE END"):
        g = f"({v}) * pow({keep}, -{inner})"
        parts.append(
            f"(coalesce(sum({g}) OVER {own}, 0) + pow({keep}, {block}) * coalesce(sum({g}) OVER {last}, 0)"
            + "".join(f" + pow({keep}, {block * i}) * coalesce(sum({g}) OVER (PARTITION BY symbol ORDER BY k // {block} RANGE BETWEEN {i} PRECEDING AND {i} PRECEDING), 0)" for i in range(2, 20) if i * block * _rate(keep) < 45)
            + ")"
        )
    return f"CASE WHEN count({x}) OVER {W} >= {least} THEN {parts[0]} / {parts[1]} END"


def _rate(keep: str) -> float:
    from math import log

    a, b = keep.strip("()").split("/")
    return -log(float(a) / float(b))


_AVG = ("rsi", "macd", "macd_signal", "macd_hist", "atr", "ema_ratio_20_50", "ema_ratio_50_200", "chaikin_osc")


@query(
    f"""WITH {MULTI}, a AS (SELECT *, row_number() OVER {W} - 1 AS k, close - lag(close) OVER {W} AS dc, lag(close) OVER {W} AS pc,
    sum((2 * close - high - low) / (high - low + 1e-10) * volume) OVER {W} AS adl FROM bars), b AS (SELECT *, CASE WHEN dc > 0 THEN dc WHEN dc IS NOT NULL THEN 0.0 END AS up,
    CASE WHEN dc < 0 THEN -dc WHEN dc IS NOT NULL THEN 0.0 END AS down, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM a),
    c AS (SELECT *, {_ewm("up", "(13.0/14.0)", 14)} AS ru, {_ewm("down", "(13.0/14.0)", 14)} AS rd, {_ewm("tr", "(13.0/14.0)", 14)} AS atr, {_ewm("close", "(11.0/13.0)", 12)} - {_ewm("close", "(25.0/27.0)", 26)} AS macd,
    {_ewm("close", "(19.0/21.0)", 20)} AS e20, {_ewm("close", "(49.0/51.0)", 50)} AS e50, {_ewm("close", "(199.0/201.0)", 200)} AS e200, {_ewm("adl", "(2.0/4.0)", 3)} - {_ewm("adl", "(9.0/11.0)", 10)} AS chaikin_osc FROM b),
    e AS (SELECT *, {_ewm("macd", "(8.0/10.0)", 9)} AS macd_signal FROM c), t AS (SELECT symbol, ts, 100 - 100 / (1 + ru / nullif(rd, 0)) AS rsi, macd, macd_signal, macd - macd_signal AS macd_hist, atr,
    e20 / e50 AS ema_ratio_20_50, e50 / e200 AS ema_ratio_50_200, chaikin_osc FROM e) """
    + _select({k: k for k in _AVG}, {"macd": 3, "macd_signal": 3, "macd_hist": 3, "atr": 3, "chaikin_osc": 1}),
    6,
    macd=3,
    macd_signal=3,
    macd_hist=3,
    atr=3,
    chaikin_osc=1,
)
def exponential_averages(spark, d):
    return features.averages(source.bars_multi(spark, d)).select("symbol", "ts", *_AVG)


TA_DIGITS = {"stoch_k": 5, "stoch_d": 5, "williams_r": 5, "cci_14": 5, "obv": 2, "mfi_14": 4, "macd": 3, "macd_signal": 3, "macd_hist": 3, "atr": 3, "chaikin_osc": 1}


def _joined(parts: list[str], columns: list[str]) -> str:
    """Queries side by side on (symbol, ts)."""
    tables = f"({ORACLES[parts[0]]}) AS {parts[0]}" + "".join(f" JOIN ({ORACLES[p]}) AS {p} USING (symbol, ts)" for p in parts[1:])
    return f"SELECT symbol, ts, {', '.join(columns)} FROM {tables}"


TA_SQL = _joined(["returns", "volatility", "rolling_skew_kurt", "oscillators", "volumes", "exponential_averages"], features.TA)


@query(TA_SQL, 6, **TA_DIGITS)
def ta_features(spark, d):
    return features.technical(source.bars_multi(spark, d))


_STAT = ("shannon_entropy", "gaussian_entropy", "negentropy", "variance_ratio", "jarque_bera")
_F30 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {MULTI}, {R}, a AS (SELECT *, ({_roll("sum", "log_returns", 7)}) AS s7, ({_roll("var_samp", "log_returns", 30)}) AS v30, ({_roll("min", "log_returns", 30)}) AS lo, ({_roll("max", "log_returns", 30)}) AS hi,
    list(log_returns) {_F30} AS l, ({_roll("skewness", "log_returns", 90)}) * 88 / sqrt(90.0 * 89) * pow(89.0 / 90, 1.5) AS s,
    (((({_roll("kurtosis", "log_returns", 90)}) * 88 * 87 / 89 - 6) / 91) + 3) * pow(89.0 / 90, 2) - 3 AS kk FROM r),
    b AS (SELECT *, list_transform(l, lambda x: least(greatest(floor((x - lo + 1e-10) / ((hi - lo + 2e-10) / 10)), 0), 9)) AS bins FROM a),
    c AS (SELECT *, list_sum(list_transform(range(10), lambda i: CASE WHEN len(list_filter(bins, lambda q: q = i)) > 0 THEN -len(list_filter(bins, lambda q: q = i)) / 30.0::DOUBLE * log2(len(list_filter(bins, lambda q: q = i)) / 30.0::DOUBLE) ELSE 0 END)) AS ent FROM b),
    e AS (SELECT symbol, ts, CASE WHEN lo IS NULL THEN NULL WHEN hi - lo < 1e-14 THEN 0.0 ELSE ent END AS shannon_entropy, CASE WHEN v30 >= 1e-20 THEN 0.5 * ln(2 * pi() * exp(1) * v30) END AS gaussian_entropy,
    CASE WHEN count(log_returns) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) = 90 THEN var_samp(s7) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 83 PRECEDING AND 1 PRECEDING) END / nullif(7 * ({_roll("var_samp", "log_returns", 90)}), 0) AS variance_ratio,
    90 / 6.0 * (s * s + kk * kk / 4) AS jarque_bera FROM c), t AS (SELECT *, gaussian_entropy - shannon_entropy AS negentropy FROM e) """
    + _select({k: k for k in _STAT}),
    6,
)
def math_features(spark, d):
    return features.statistical(source.bars_multi(spark, d)).select("symbol", "ts", *_STAT)


@query(f"WITH {MULTI}, {R} SELECT symbol, ts, " + ", ".join(f"round(lag(log_returns, {k}) OVER {W}, 6) AS log_returns_lag{k}" for k in features.LAGS) + " FROM r")
def lag_features(spark, d):
    return features.lags(source.bars_multi(spark, d))


@query(f"WITH {MULTI} SELECT symbol, ts, round(sign(close - open) * ln(abs(close - open) + 1), 6) AS move, round(ln(abs(volume) + 1e-8), 6) AS volume FROM bars")
def log_transforms(spark, d):
    df = source.bars_multi(spark, d).select("symbol", "ts", (F.col("close") - F.col("open")).alias("move"), "volume")
    return features.shifted_log(features.symmetric_log(df, ["move", "absent"]), ["volume"])


EXT = "ext AS (SELECT CAST(l_shipdate AS DATE) AS ts, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1)"


@query(f"WITH {DAILY}, {EXT} SELECT symbol, bars.ts AS ts, round(value, 2) AS value FROM bars ASOF LEFT JOIN ext ON bars.ts >= ext.ts", 2)
def asof_backward(spark, d):
    return ts.backward(source.bars_daily(spark, d).select("symbol", "ts"), source.external(spark, d), "value")


@query(
    f"""WITH {DAILY}, {EXT}, a AS (SELECT symbol, bars.ts AS ts, close, value AS sp500 FROM bars ASOF LEFT JOIN ext ON bars.ts >= ext.ts), t AS (SELECT *, sp500 / nullif(close, 0) AS eth_btc_ratio,
    ln(sp500 / nullif(lag(sp500, 30) OVER {W}, 0)) AS sp500_ret_30, (sp500 / nullif(lag(sp500, 14) OVER {W}, 0) - 1) * 100 AS tx_count_roc_14 FROM a) """
    + _select({"sp500_ret_30": "sp500_ret_30", "tx_count_roc_14": "tx_count_roc_14", "eth_btc_ratio": "eth_btc_ratio"})
)
def external_features(spark, d):
    wanted = [x for x in features.EXTERNAL if x[0] in ("sp500_ret_30", "tx_count_roc_14", "eth_btc_ratio")]
    own = source.external(spark, d)
    return features.external(source.bars_daily(spark, d), {"sp500": own, "tx_count": own, "eth": own}, wanted).select("symbol", "ts", "sp500_ret_30", "tx_count_roc_14", "eth_btc_ratio")


def _vol(name: str = "bars", key: str = "v") -> str:
    keep, keep2 = 49 / 51, (49 / 51) ** 2
    k = "(k - (k // 1000) * 1000)"

    def s(x: str, a: float) -> str:
        return f"(sum(({x}) * pow({a!r}, -{k})) OVER (PARTITION BY symbol, k // 1000 ORDER BY ts) + pow({a!r}, 1000) * coalesce(sum(({x}) * pow({a!r}, -{k})) OVER (PARTITION BY symbol ORDER BY k // 1000 RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0))"

    one = "CASE WHEN ret IS NOT NULL THEN 1.0::DOUBLE END"
    return f"""{key}0 AS (SELECT symbol, ts, close, row_number() OVER {W} - 1 AS k, close / lag(close) OVER {W} - 1 AS ret FROM {name}),
    {key}1 AS (SELECT *, {s(one, keep)} AS w, {s(one, keep2)} AS w2, {s("ret", keep)} AS x, {s("ret * ret", keep)} AS xx, count(ret) OVER {W} AS c FROM {key}0),
    {key} AS (SELECT symbol, ts, close, ret, CASE WHEN c >= 2 THEN sqrt(greatest(xx / w - (x / w) ** 2, 0) * w * w / (w * w - w2)) END AS vol FROM {key}1)"""


@query(f"WITH {MULTI}, {_vol()} SELECT symbol, ts, round(close, 6) AS close, round(ret, 6) AS ret, round(vol, 6) AS vol FROM v")
def daily_vol(spark, d):
    return labeling.daily_volatility(source.bars_multi(spark, d))


CUSUM = """h AS (SELECT symbol, avg(vol) AS h FROM v GROUP BY 1), n AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM v WHERE ret IS NOT NULL),
    c(symbol, i, ts, up, down, side) AS (SELECT symbol, 0::BIGINT, NULL::DATE, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM h UNION ALL
    SELECT q.symbol, q.i, q.ts, CASE WHEN u >= hh THEN 0.0 ELSE u END, CASE WHEN u < hh AND l <= -hh THEN 0.0 ELSE l END, CASE WHEN u >= hh THEN 1 WHEN l <= -hh THEN -1 ELSE 0 END FROM
    (SELECT n.symbol, n.i, n.ts, h.h AS hh, greatest(0, c.up + n.ret) AS u, least(0, c.down + n.ret) AS l FROM c JOIN n ON n.symbol = c.symbol AND n.i = c.i + 1 JOIN h ON h.symbol = n.symbol) q),
    e AS (SELECT symbol, ts, side FROM c WHERE side <> 0)"""
BINS = """j AS (SELECT e.symbol, e.ts AS t0, a.vol, b.ts, b.close / a.close - 1 AS r FROM e JOIN v a ON a.symbol = e.symbol AND a.ts = e.ts JOIN v b ON b.symbol = e.symbol AND b.ts BETWEEN e.ts AND e.ts + 10 WHERE a.vol IS NOT NULL),
    g AS (SELECT symbol, t0, min(ts) FILTER (r > 1.5 * vol) AS up, min(ts) FILTER (r < -1.5 * vol) AS down, max(ts) AS last, count(*) AS n FROM j GROUP BY 1, 2),
    k AS (SELECT g.symbol, g.t0, least(coalesce(up, last), coalesce(down, last), last) AS t1, coalesce(up, last + 1) > last AND coalesce(down, last + 1) > last AS vertical FROM g WHERE n >= 2),
    bins AS (SELECT k.symbol, k.t0, k.t1, r AS ret, CAST(CASE WHEN vertical AND abs(r) < 0.02 THEN 0 ELSE sign(r) END AS INTEGER) AS bin FROM k JOIN j ON j.symbol = k.symbol AND j.t0 = k.t0 AND j.ts = k.t1)"""
EVENTS = f"WITH RECURSIVE {MULTI}, {_vol()}, {CUSUM}"
LABELS = f"{EVENTS}, {BINS}"


def _vols(spark, d):
    return labeling.daily_volatility(source.bars_multi(spark, d))


def _bins(spark, d):
    vol = _vols(spark, d)
    return labeling.triple_barrier(vol, labeling.cusum_events(vol)).cache()  # events are few, and many queries start there


@query(f"{EVENTS} SELECT symbol, ts, side FROM e")
def cusum_events(spark, d):
    return labeling.cusum_events(_vols(spark, d))


@query(f"{LABELS} SELECT symbol, t0, t1, round(ret, 6) AS ret, bin FROM bins")
def triple_barrier(spark, d):
    return _bins(spark, d)


@query(f"{LABELS}, s AS (SELECT bin, count(*) / sum(count(*)) OVER () AS share FROM bins GROUP BY 1) SELECT symbol, t0, t1, round(ret, 6) AS ret, bin FROM bins WHERE bin IN (SELECT bin FROM s WHERE share >= 0.05)")
def drop_rare(spark, d):
    return labeling.drop_rare(_bins(spark, d)).select("symbol", "t0", "t1", "ret", "bin")


@query(f"{LABELS} SELECT symbol, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM bins GROUP BY 1, 2")
def label_distribution(spark, d):
    return labeling.label_distribution(_bins(spark, d))


LIVE = "live AS (SELECT bars.symbol, bars.ts, count(bins.t0) AS n FROM bars LEFT JOIN bins ON bins.symbol = bars.symbol AND bars.ts BETWEEN bins.t0 AND bins.t1 GROUP BY 1, 2)"


@query(f"{LABELS}, {LIVE} SELECT symbol, ts, n FROM live")
def concurrency(spark, d):
    return labeling.concurrency(source.bars_multi(spark, d), _bins(spark, d))


UNIQUE = "u AS (SELECT bins.symbol, t0, t1, ret, bin, avg(1.0 / n) AS uniqueness FROM bins JOIN live ON live.symbol = bins.symbol AND live.ts BETWEEN t0 AND t1 GROUP BY ALL)"


@query(f"{LABELS}, {LIVE}, {UNIQUE} SELECT symbol, t0, t1, round(ret, 6) AS ret, bin, round(uniqueness, 6) AS uniqueness FROM u")
def avg_uniqueness(spark, d):
    return labeling.uniqueness(source.bars_multi(spark, d), _bins(spark, d))


@query(
    f"""{LABELS}, {LIVE}, {UNIQUE}, w0 AS (SELECT symbol, t0, abs(ret) * uniqueness AS w FROM u), w1 AS (SELECT symbol, t0, w * count(*) OVER p / sum(w) OVER p AS w, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS i, count(*) OVER p AS n FROM w0 WINDOW p AS (PARTITION BY symbol)),
    w2 AS (SELECT symbol, t0, w * (0.4 + 0.6 * i / (n - 1)) AS w FROM w1), w3 AS (SELECT symbol, t0, w * count(*) OVER p / sum(w) OVER p AS w FROM w2 WINDOW p AS (PARTITION BY symbol)),
    q AS (SELECT symbol, quantile_cont(w, 0.99) AS cap FROM w3 GROUP BY 1), w4 AS (SELECT symbol, t0, least(w, cap) AS w FROM w3 JOIN q USING (symbol))
    SELECT symbol, t0, round(w * count(*) OVER p / sum(w) OVER p, 6) AS w FROM w4 WINDOW p AS (PARTITION BY symbol)"""
)
def sample_weights(spark, d):
    return labeling.sample_weights(source.bars_multi(spark, d), _bins(spark, d))


# Cross-validation and evaluation run over the events of the one daily series.
DAILY_LABELS = f"WITH RECURSIVE {DAILY}, {_vol()}, {CUSUM}, {BINS}, ev AS (SELECT *, row_number() OVER (ORDER BY t0, symbol) - 1 AS event_pos, count(*) OVER () AS t FROM bins), ge AS (SELECT *, CAST(least(event_pos // (t // 8), 7) AS INTEGER) AS group_id FROM ev)"
SPLITS = "sp AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split_id, a, b FROM range(8) x(a), range(8) y(b) WHERE a < b), st AS (SELECT split_id, unnest([a, b])::INTEGER AS group_id FROM sp)"
PATHS = "pm AS (SELECT CAST(row_number() OVER (PARTITION BY group_id ORDER BY split_id) - 1 AS INTEGER) AS path_id, group_id, split_id FROM st)"
ROLES = """gs AS (SELECT group_id, min(t0) AS g0, max(t0) AS g1, max(event_pos) AS ge FROM ge GROUP BY 1), tg AS (SELECT split_id, gs.* FROM st JOIN gs USING (group_id)),
    ro AS (SELECT tg.split_id, ge.event_pos, ge.group_id, ge.t0, ge.t1, bool_or(ge.group_id = tg.group_id) AS te, bool_or((ge.t0 >= g0 AND ge.t0 <= g1) OR (ge.t1 >= g0 AND ge.t1 <= g1) OR (ge.t0 <= g0 AND ge.t1 >= g1)) AS pu,
    bool_or(event_pos > tg.ge AND event_pos <= tg.ge + floor(t * 0.01)) AS em FROM ge, tg GROUP BY ALL),
    roles AS (SELECT split_id, event_pos, group_id, t0, t1, CASE WHEN te THEN 'test' WHEN pu THEN 'purged' WHEN em THEN 'embargoed' ELSE 'train' END AS role FROM ro)"""


def _daily_bins(spark, d):
    vol = labeling.daily_volatility(source.bars_daily(spark, d))
    return labeling.triple_barrier(vol, labeling.cusum_events(vol)).cache()


@query(f"{DAILY_LABELS} SELECT event_pos, t0, group_id FROM ge")
def group_bounds(spark, d):
    return cv.grouped(cv.events(_daily_bins(spark, d))).select("event_pos", "t0", "group_id")


@query(f"{DAILY_LABELS}, {SPLITS}, {PATHS} SELECT path_id, group_id, split_id, count(*) AS n_events, min(t0) AS first_t0, max(t0) AS last_t0 FROM pm JOIN ge USING (group_id) GROUP BY ALL")
def path_map(spark, d):
    """The split that tests each group on each path, with the group's events."""
    groups = cv.grouped(cv.events(_daily_bins(spark, d))).groupBy("group_id").agg(F.count("*").alias("n_events"), F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0"))
    return groups.join(cv.path_map(spark), "group_id").select(F.col("path_id").cast("int").alias("path_id"), "group_id", "split_id", "n_events", "first_t0", "last_t0")


@query(f"{DAILY_LABELS}, {SPLITS}, {ROLES} SELECT split_id, event_pos, group_id, t0, t1, role FROM roles")
def cpcv_roles(spark, d):
    return cv.roles(cv.events(_daily_bins(spark, d)))


@query(f"{DAILY_LABELS}, {SPLITS}, {ROLES} SELECT split_id, " + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("train", "test", "purged", "embargoed")) + " FROM roles GROUP BY 1")
def split_info(spark, d):
    return cv.split_info(cv.roles(cv.events(_daily_bins(spark, d))))


@query(
    f"""{DAILY_LABELS}, {SPLITS}, {ROLES}, ts_ AS (SELECT split_id, group_id, min(t0) AS g0, max(t0) AS g1 FROM roles WHERE role = 'test' GROUP BY 1, 2)
    SELECT a.split_id, count(b.g0) AS n_leaks, CASE WHEN count(b.g0) = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM roles a LEFT JOIN ts_ b ON a.split_id = b.split_id AND (a.t1 BETWEEN b.g0 AND b.g1 OR (a.t0 <= b.g0 AND a.t1 >= b.g1)) WHERE a.role = 'train' GROUP BY 1"""
)
def leak_audit(spark, d):
    return cv.audit(cv.roles(cv.events(_daily_bins(spark, d))))


@query(
    f"""{DAILY_LABELS}, {SPLITS}, {ROLES}, te AS (SELECT split_id, group_id, min(event_pos) AS a, max(event_pos) AS b FROM roles WHERE role = 'test' GROUP BY 1, 2),
    nr AS (SELECT r.split_id, te.group_id, r.event_pos, r.role, CASE WHEN r.event_pos < a THEN r.event_pos - a ELSE r.event_pos - b END AS distance FROM roles r JOIN te USING (split_id) WHERE r.role IN ('purged', 'embargoed'))
    SELECT * FROM nr WHERE abs(distance) <= 3"""
)
def purge_boundaries(spark, d):
    return cv.boundaries(cv.roles(cv.events(_daily_bins(spark, d))))


@query(
    f"""{DAILY_LABELS}, {SPLITS}, {ROLES}, tr AS (SELECT split_id, event_pos, t0, t1, row_number() OVER (PARTITION BY split_id ORDER BY event_pos) - 1 AS p, count(*) OVER (PARTITION BY split_id) AS n FROM roles WHERE role = 'train'),
    fo AS (SELECT *, CAST(least(p // (n // 5), 4) AS INTEGER) AS own FROM tr), ru AS (SELECT split_id, own AS fold, min(t0) AS g0, max(t0) AS g1, max(p) AS last FROM fo GROUP BY 1, 2)
    SELECT split_id, event_pos, t0, t1, fold, CASE WHEN own = fold THEN 'validate' WHEN t0 BETWEEN g0 AND g1 OR t1 BETWEEN g0 AND g1 OR (t0 <= g0 AND t1 >= g1) THEN 'purged' WHEN p > last AND p <= last + 10 THEN 'embargoed' ELSE 'train' END AS role
    FROM fo JOIN ru USING (split_id)"""
)
def purged_folds(spark, d):
    return cv.purged_folds(cv.roles(cv.events(_daily_bins(spark, d))))


PREDS = f"""{DAILY_LABELS}, {SPLITS}, {PATHS}, preds AS (SELECT 'm' || m AS model, split_id, sd AS seed, ge.group_id, t0 AS ts, CAST(bin > 0 AS INTEGER) AS y_true,
    (((event_pos * 7919 + split_id * 104729 + m * 1299709 + sd * 15485863) % 1000) + 0.5::DOUBLE) / 1000 * 0.9::DOUBLE + 0.05::DOUBLE AS p_up, ret FROM ge JOIN st USING (group_id), range(3) mm(m), range(2) ss(sd)),
    av AS (SELECT model, split_id, group_id, ts, avg(p_up) AS p_up, first(y_true) AS y_true, first(ret) AS ret FROM preds GROUP BY 1, 2, 3, 4),
    stitched AS (SELECT model, path_id, ts, p_up, y_true, ret FROM av JOIN pm USING (split_id, group_id))"""
_CUT = [repr(x) for x in evaluate.CUTS]
BETS = f"""z AS (SELECT *, (p_up - 0.5) / sqrt(p_up * (1 - p_up) + 1e-10) AS z FROM stitched), bt AS (SELECT *, CASE WHEN abs(z) > {_CUT[2]} THEN 0.75 WHEN abs(z) > {_CUT[1]} THEN 0.5 WHEN abs(z) > {_CUT[0]} THEN 0.25 ELSE 0.0 END::DOUBLE * sign(z) + 0.0 AS bet FROM z),
    net AS (SELECT model, path_id, ts, bet, bet * ret AS gross, 0.001 * abs(bet - lag(bet, 1, 0.0) OVER (PARTITION BY model, path_id ORDER BY ts)) AS cost FROM bt), nt AS (SELECT *, gross - cost AS net FROM net)"""
CURVE = f"{BETS}, eq AS (SELECT *, product(1 + net) OVER w AS equity FROM nt WINDOW w AS (PARTITION BY model, path_id ORDER BY ts)), cu AS (SELECT *, (equity - max(equity) OVER w) / max(equity) OVER w AS drawdown FROM eq WINDOW w AS (PARTITION BY model, path_id ORDER BY ts ROWS UNBOUNDED PRECEDING))"
# Path metrics from their definitions: lists of a path's returns and bets in order of time.
PERF = f"""{CURVE}, pl AS (SELECT model, path_id, list(net ORDER BY ts) AS r, list(net ORDER BY ts) FILTER (bet <> 0) AS tr, list(abs(bet)) FILTER (bet <> 0) AS tb, min(drawdown) AS max_drawdown, min(ts) AS t0, max(ts) AS t1 FROM cu GROUP BY 1, 2),
    pm1 AS (SELECT *, len(r) AS n_events, coalesce(len(tr), 0) AS n_trades, list_avg(r) AS m, list_avg(list_transform(r, lambda x: pow(x - list_avg(r), 2))) AS v2, list_filter(r, lambda x: x < 0) AS dn, list_product(list_transform(r, lambda x: 1 + x)) - 1 AS cum_return,
    list_sum(list_filter(tr, lambda x: x > 0)) AS pos, list_sum(list_filter(tr, lambda x: x < 0)) AS neg, greatest(date_diff('day', t0::TIMESTAMP, t1::TIMESTAMP) / 365.25, 1 / 365.25) AS years FROM pl),
    pm2 AS (SELECT *, CASE WHEN n_events > 1 THEN sqrt(v2 * n_events / (n_events - 1)) ELSE 1e-10::DOUBLE END AS sd, sqrt(list_avg(list_transform(dn, lambda x: x * x))) AS rms, CASE WHEN n_events > 1 THEN pow(1 + cum_return, 1 / years) - 1 ELSE 0.0 END AS ann_return FROM pm1),
    pf AS (SELECT model, path_id, n_events, n_trades, CASE WHEN sd < 1e-10 THEN 0.0 ELSE m / sd * sqrt(365) END AS sharpe, CASE WHEN len(dn) = 0 OR rms < 1e-10 THEN CASE WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0.0 END ELSE m / rms * sqrt(365) END AS sortino, cum_return, max_drawdown,
    CASE WHEN n_trades > 0 THEN len(list_filter(tr, lambda x: x > 0)) / n_trades::DOUBLE ELSE 0.0 END AS win_rate, CASE WHEN n_trades > 0 THEN CASE WHEN coalesce(neg, 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(pos, 0) / abs(neg) END END AS profit_factor,
    CASE WHEN n_trades > 0 THEN list_avg(tb) ELSE 0.0 END AS avg_bet, CASE WHEN n_events > 2 AND v2 > 0 THEN list_avg(list_transform(r, lambda x: pow(x - m, 3))) / pow(v2, 1.5) ELSE 0.0 END AS skew,
    CASE WHEN n_events > 3 AND v2 > 0 THEN list_avg(list_transform(r, lambda x: pow(x - m, 4))) / pow(v2, 2) - 3 ELSE 0.0 END AS excess_kurtosis, ann_return, CASE WHEN abs(max_drawdown) < 1e-10 THEN CASE WHEN ann_return > 0 THEN 'inf'::DOUBLE ELSE 0.0 END ELSE ann_return / abs(max_drawdown) END AS calmar,
    CASE WHEN n_events > 1 THEN years ELSE 0.0 END AS years FROM pm2)"""


def _preds(spark, d):
    return flows.synthetic_predictions(spark, d, stored(_daily_bins(spark, d)))


def _stitched(spark, d):
    return evaluate.stitch(_preds(spark, d), cv.path_map(spark))


def _curve(spark, d):
    return evaluate.equity(evaluate.strategy(_stitched(spark, d)))


@query(f"{PREDS} SELECT model, CAST(path_id AS INTEGER) AS path_id, ts, round(p_up, 6) AS p_up, y_true, round(ret, 6) AS ret FROM stitched")
def stitch_paths(spark, d):
    return _stitched(spark, d)


@query(f"{PREDS}, {BETS} SELECT model, path_id, ts, round(bet, 6) AS bet, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM nt")
def strategy_returns(spark, d):
    return evaluate.strategy(_stitched(spark, d)).select("model", "path_id", "ts", "bet", "gross", "cost", "net")


@query(f"{PREDS}, {CURVE} SELECT model, path_id, ts, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM cu")
def drawdown(spark, d):
    return _curve(spark, d).select("model", "path_id", "ts", "equity", "drawdown")


@query(
    f"""{PREDS}, {CURVE}, uk AS (SELECT *, row_number() OVER w AS k, max(equity) OVER w AS peak FROM cu WINDOW w AS (PARTITION BY model, path_id ORDER BY ts)), ur AS (SELECT model, path_id, k - row_number() OVER (PARTITION BY model, path_id ORDER BY ts) AS run FROM uk WHERE equity < peak),
    ux AS (SELECT model, path_id, max(n) AS n FROM (SELECT model, path_id, run, count(*) AS n FROM ur GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT c.model, c.path_id, coalesce(ux.n, 0) AS time_under_water FROM (SELECT DISTINCT model, path_id FROM cu) c LEFT JOIN ux ON ux.model = c.model AND ux.path_id = c.path_id"""
)
def time_under_water(spark, d):
    return evaluate.under_water(_curve(spark, d))


_PERF = ("sharpe", "sortino", "cum_return", "max_drawdown", "win_rate", "profit_factor", "avg_bet", "skew", "excess_kurtosis", "ann_return", "calmar", "years")
_PERF_DIGITS = {"ann_return": 4, "calmar": 4, "excess_kurtosis": 4}
_PERF_SQL = ", ".join(f"round({x}, {_PERF_DIGITS.get(x, 6)}) AS {x}" for x in _PERF)


@query(f"{PREDS}, {PERF} SELECT model, path_id, n_events, n_trades, {_PERF_SQL} FROM pf", 6, **_PERF_DIGITS)
def path_performance(spark, d):
    return evaluate.performance(_curve(spark, d)).select("model", "path_id", "n_events", "n_trades", *_PERF)


@query(
    f"""{PREDS}, {PERF}, wn AS (SELECT 'm' || m AS model, p::INTEGER AS path_id FROM range(4) a(m), range(7) b(p)) SELECT model, path_id, coalesce(n_events, 0) AS n_events, round(coalesce(sharpe, 0.0), 6) AS sharpe,
    round(coalesce(max_drawdown, 0.0), 6) AS max_drawdown, round(profit_factor, 6) AS profit_factor FROM wn LEFT JOIN pf USING (model, path_id)"""
)
def empty_performance(spark, d):
    """A fourth model has no predictions."""
    wanted = spark.range(4).crossJoin(spark.range(7).withColumnRenamed("id", "p")).selectExpr("concat('m', id) AS model", "cast(p AS int) AS path_id")
    return evaluate.empty_performance(evaluate.performance(_curve(spark, d)), wanted).select("model", "path_id", "n_events", "sharpe", "max_drawdown", "profit_factor")


def _phi(x: str) -> str:
    """The normal distribution function as SQL: its power series with double factorials."""
    v = f"least(greatest({x}, -8.0::DOUBLE), 8.0::DOUBLE)"
    return f"(0.5::DOUBLE + exp(-{v} * {v} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(81), lambda k: {v} * pow({v} * {v}, k) / exp(lgamma(2 * k + 2) - k * ln(2.0::DOUBLE) - lgamma(k + 1)))))"


def _best_of(trials: int) -> float:
    from math import e
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    return (1 - 0.5772156649015329) * z(1 - 1 / trials) + 0.5772156649015329 * z(1 - 1 / (trials * e))


_MEDIANS = {"median_sharpe": "sharpe", "median_sortino": "sortino", "median_calmar": "calmar", "median_max_drawdown": "max_drawdown", "median_cum_return": "cum_return", "median_win_rate": "win_rate", "median_profit_factor": "profit_factor"}


@query(
    f"""{PREDS}, {PERF}, ms AS (SELECT model, {", ".join(f"median({x}) AS {n}" for n, x in _MEDIANS.items())}, avg(sharpe) AS mean_sharpe, coalesce(stddev_samp(sharpe), 0.0) AS std_sharpe, avg(skew) AS pooled_skew, avg(excess_kurtosis) AS pooled_kurtosis,
    CAST(floor(avg(n_events)) AS BIGINT) AS n_obs, count(*) AS n_paths FROM pf GROUP BY 1), se AS (SELECT *, median_sharpe / sqrt(365) AS sr, sqrt(greatest(1 - pooled_skew * median_sharpe / sqrt(365) + (pooled_kurtosis + 2) / 4 * pow(median_sharpe / sqrt(365), 2), 1e-10) / (greatest(n_obs, 2) - 1)) AS err FROM ms)
    SELECT model, n_paths, n_obs, CAST(row_number() OVER (ORDER BY median_sharpe DESC NULLS LAST, std_sharpe, model) AS INTEGER) AS rank, round({_phi(f"(sr - {_best_of(3)!r} * err) / err")}, 6) AS dsr, """
    + ", ".join(f"round({x}, {4 if x in ('median_calmar', 'pooled_kurtosis') else 6}) AS {x}" for x in (*_MEDIANS, "mean_sharpe", "std_sharpe", "pooled_skew", "pooled_kurtosis"))
    + " FROM se",
    6,
    median_calmar=4,
    pooled_kurtosis=4,
)
def model_ranking(spark, d):
    return evaluate.model_summary(evaluate.performance(_curve(spark, d)))


_HELD = "held AS (SELECT DISTINCT 'buy_and_hold' AS model, path_id, ts, ret FROM stitched), bt AS (SELECT *, 1.0::DOUBLE AS bet FROM held)"


@query(f"{PREDS}, {PERF.replace(BETS.split(",\n    net AS", 1)[0], _HELD)} SELECT model, path_id, n_events, n_trades, {_PERF_SQL} FROM pf", 6, **_PERF_DIGITS)
def buy_and_hold(spark, d):
    return evaluate.buy_and_hold(_stitched(spark, d)).select("model", "path_id", "n_events", "n_trades", *_PERF)


_SPLIT = ("log_loss", "brier", "accuracy", "macro_f1", "macro_precision", "macro_recall", "auc")


@query(
    f"""{PREDS}, hits AS (SELECT *, CAST(p_up >= 0.5 AS INTEGER) AS h FROM av), cn AS (SELECT model, split_id, count(*) AS n, avg(-(y_true * ln(p_up) + (1 - y_true) * ln(1 - p_up))) AS log_loss, avg((p_up - y_true) ** 2) AS brier,
    sum(CASE WHEN y_true = 0 AND h = 0 THEN 1.0::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN y_true = 0 AND h = 1 THEN 1.0::DOUBLE ELSE 0 END) AS b, sum(CASE WHEN y_true = 1 AND h = 0 THEN 1.0::DOUBLE ELSE 0 END) AS c, sum(CASE WHEN y_true = 1 AND h = 1 THEN 1.0::DOUBLE ELSE 0 END) AS d FROM hits GROUP BY 1, 2),
    au AS (SELECT x.model, x.split_id, avg(CASE WHEN x.p_up > y.p_up THEN 1.0 WHEN x.p_up = y.p_up THEN 0.5 ELSE 0 END::DOUBLE) AS auc FROM av x JOIN av y ON x.model = y.model AND x.split_id = y.split_id WHERE x.y_true = 1 AND y.y_true = 0 GROUP BY 1, 2),
    sm AS (SELECT *, (a + d) / n AS accuracy, (coalesce(2 * a / nullif(2 * a + b + c, 0), 0) + coalesce(2 * d / nullif(2 * d + b + c, 0), 0)) / 2 AS macro_f1, (coalesce(a / nullif(a + c, 0), 0) + coalesce(d / nullif(d + b, 0), 0)) / 2 AS macro_precision,
    (coalesce(a / nullif(a + b, 0), 0) + coalesce(d / nullif(d + c, 0), 0)) / 2 AS macro_recall FROM cn JOIN au USING (model, split_id)) SELECT model, split_id, n, """
    + ", ".join(f"round({x}, 6) AS {x}" for x in _SPLIT)
    + " FROM sm"
)
def split_metrics(spark, d):
    return evaluate.split_metrics(_preds(spark, d)).select("model", "split_id", "n", *_SPLIT)


PLACED = """pl AS (SELECT x.model, x.split_id, x.ts, x.y_true, avg(CASE WHEN x.p_up > y.p_up THEN 1.0 WHEN x.p_up = y.p_up THEN 0.5 ELSE 0 END::DOUBLE) AS g FROM av x JOIN av y ON x.model = y.model AND x.y_true <> y.y_true GROUP BY 1, 2, 3, 4),
    pc AS (SELECT model, split_id, ts, y_true, CASE WHEN y_true = 1 THEN g ELSE 1 - g END AS placement FROM pl)"""
PAIRED = f"""{PLACED}, dq AS (SELECT a.model AS model_a, b.model AS model_b, a.y_true AS y, count(*) AS n, avg(a.placement) AS va, avg(b.placement) AS vb, var_samp(a.placement - b.placement) AS s FROM pc a JOIN pc b ON a.split_id = b.split_id AND a.ts = b.ts AND a.model < b.model GROUP BY 1, 2, 3),
    dl AS (SELECT model_a, model_b, max(va) FILTER (y = 1) AS auc_a, max(vb) FILTER (y = 1) AS auc_b, sum(s / n) AS variance FROM dq GROUP BY 1, 2), dz AS (SELECT *, (auc_a - auc_b) / nullif(sqrt(variance), 0) AS z FROM dl)"""


def _pooled(spark, d):
    """Seed-averaged predictions of all splits."""
    return evaluate.averaged(_preds(spark, d))


@query(f"{PREDS}, {PLACED} SELECT model, split_id, ts, y_true, round(placement, 6) AS placement FROM pc")
def delong_components(spark, d):
    return evaluate.placements(_pooled(spark, d)).select("model", "split_id", "ts", "y_true", "placement")


@query(f"{PREDS}, {PAIRED} SELECT model_a, model_b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(variance, 6) AS variance, round(z, 4) AS z FROM dz", 6, z=4)
def delong_pairs(spark, d):
    return evaluate.delong(_pooled(spark, d), ["split_id", "ts"])


@query(f"{PREDS}, {PAIRED}, pp AS (SELECT *, 2 * (1 - {_phi('abs(z)')}) AS p FROM dz) SELECT model_a, model_b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta_auc, round(variance, 6) AS variance, round(z, 4) AS z, round(p, 4) AS p_value, p < 0.05 AS significant FROM pp", 6, z=4, p_value=4)
def auc_significance(spark, d):
    return evaluate.significance(_pooled(spark, d), ["split_id", "ts"])


HALVES = """dv AS (SELECT row_number() OVER (ORDER BY x, y, z) AS division, [x, y, z] AS own FROM range(7) a(x), range(7) b(y), range(7) c(z) WHERE x < y AND y < z)"""


def _pbo_sql(base: str, source: str) -> str:
    by = f"{base}, " if base else ""
    return f"""bm AS (SELECT {by}division, model, avg(sharpe) FILTER (list_contains(own, path_id)) AS i, avg(sharpe) FILTER (NOT list_contains(own, path_id)) AS o FROM {source}, dv GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY {by}division ORDER BY i DESC, model) AS k FROM bm), wr AS (SELECT {by}division, max(o) FILTER (k = 1) AS best, median(o) AS middle FROM rk GROUP BY ALL)
    SELECT {by}round(avg(CASE WHEN best < middle THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_divisions FROM wr {"GROUP BY 1" if base else ""}"""


@query(f"{PREDS}, {PERF}, {HALVES}, {_pbo_sql('', 'pf')}")
def pbo(spark, d):
    return evaluate.pbo(spark, evaluate.performance(_curve(spark, d)), 7)


@query(f"{PREDS}, {PERF}, {HALVES}, px AS (SELECT b.model AS excluded, pf.* FROM pf, (SELECT DISTINCT model FROM pf) b WHERE pf.model <> b.model), {_pbo_sql('excluded', 'px')}")
def loo_pbo(spark, d):
    return evaluate.pbo(spark, evaluate.performance(_curve(spark, d)), 7, leave_one_out=True)


@query(
    f"""{PREDS}, {PERF}, bk AS (SELECT model, sharpe AS x, row_number() OVER (PARTITION BY model ORDER BY sharpe) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM pf WHERE sharpe IS NOT NULL),
    bd AS (SELECT model, n, draw, j, (draw * 1009 + j)::BIGINT AS number FROM (SELECT DISTINCT model, n FROM bk), range(1000) a(draw), range(7) b(j) WHERE j < n), b1 AS (SELECT *, (number + 42) * 48271 % 2147483647 AS f FROM bd),
    b2 AS (SELECT b1.model, draw, median(x) AS m FROM b1 JOIN bk ON bk.model = b1.model AND bk.k = (f * f % 2147483647 + number) * 69621 % 2147483647 % b1.n GROUP BY 1, 2)
    SELECT model, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b2 GROUP BY 1"""
)
def bootstrap_ci(spark, d):
    return evaluate.bootstrap_median(evaluate.performance(_curve(spark, d)), "sharpe")


@query(f"{PREDS} SELECT model, CAST(least(floor(p_up * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p_up), 6) AS mean_p, round(avg(y_true), 6) AS observed FROM preds GROUP BY 1, 2 HAVING count(*) >= 10")
def reliability_curve(spark, d):
    return diagnose.reliability(_preds(spark, d))


@query(f"{PREDS} SELECT model, round(avg(p_up), 6) AS mean_p, round(avg(y_true), 6) AS base_rate, round(avg(p_up) - avg(y_true), 6) AS gap, abs(avg(p_up) - avg(y_true)) >= 0.03 AS flag FROM preds GROUP BY 1")
def calibration_mean(spark, d):
    return diagnose.calibration_mean(_preds(spark, d))


@query(
    f"""{PREDS}, {BETS}, ck AS (SELECT *, row_number() OVER (PARTITION BY model, path_id ORDER BY abs(net) DESC, ts) AS k FROM nt), cc AS (SELECT model, path_id, count(*) AS n, product(1 + net) - 1 AS total, product(CASE WHEN k > 5 THEN 1 + net ELSE 1.0 END) - 1 AS rest FROM ck GROUP BY 1, 2)
    SELECT model, path_id, n, round(total, 6) AS total, round(CASE WHEN n > 5 AND total <> 0 THEN (total - rest) / nullif(1 + total, 0) END, 6) AS concentration FROM cc"""
)
def topk_concentration(spark, d):
    return diagnose.concentration(evaluate.strategy(_stitched(spark, d)))


@query(
    f"""{PREDS}, {BETS} SELECT model, count(*) AS n, round(avg(CAST(bet = 0 AS INTEGER)), 6) AS abstained, round(median(abs(bet)) FILTER (bet <> 0), 6) AS median_bet, round(avg(CAST(abs(bet) >= 0.75 AS INTEGER)), 6) AS at_most,
    count(*) FILTER (bet > 0) AS n_long, count(*) FILTER (bet < 0) AS n_short FROM nt GROUP BY 1"""
)
def bet_summary(spark, d):
    return diagnose.bet_summary(evaluate.strategy(_stitched(spark, d)))


@query(f"{PREDS}, {BETS} SELECT model, round(bet, 6) AS bet, count(*) AS n FROM nt GROUP BY 1, 2")
def bet_histogram(spark, d):
    return diagnose.bet_histogram(evaluate.strategy(_stitched(spark, d)))


@query(f"{PREDS}, {PERF} SELECT model, round(min(sharpe), 6) AS min_sharpe, round(median(sharpe), 6) AS median_sharpe, round(max(sharpe), 6) AS max_sharpe, round(avg(sharpe), 6) AS mean_sharpe, round(quantile_cont(sharpe, 0.25), 6) AS q1_sharpe, round(quantile_cont(sharpe, 0.75), 6) AS q3_sharpe FROM pf GROUP BY 1")
def path_dispersion(spark, d):
    return diagnose.dispersion(evaluate.performance(_curve(spark, d)))


@query(f"{PREDS} SELECT model, y_true, count(*) FILTER (p_up < 0.5) AS pred_0, count(*) FILTER (p_up >= 0.5) AS pred_1 FROM av GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return diagnose.confusion(evaluate.averaged(_preds(spark, d)))


@query(
    f"{PREDS}, {CURVE}, pv AS (SELECT model, ts, "
    + ", ".join(f"max(equity) FILTER (path_id = {i}) AS p{i}" for i in range(7))
    + " FROM cu GROUP BY 1, 2) SELECT model, ts, "
    + ", ".join(f"round(last_value(p{i} IGNORE NULLS) OVER (PARTITION BY model ORDER BY ts), 6) AS path_{i}" for i in range(7))
    + " FROM pv"
)
def equity_pivot(spark, d):
    return diagnose.equity_pivot(_curve(spark, d), list(range(7)))


@query(
    f"""{PREDS}, {CURVE}, sn AS (SELECT *, equity / first_value(equity) OVER (PARTITION BY model, path_id ORDER BY ts) AS value FROM cu WHERE ts >= DATE '1998-01-01')
    SELECT model, ts, round(median(value), 6) AS median_value, count(*) AS n_paths FROM sn GROUP BY 1, 2"""
)
def paths_since(spark, d):
    return diagnose.since(_curve(spark, d), "1998-01-01")


FEATS = ["log_returns", "realized_vol", "gk_vol", "bb_width", "yz_vol"]


def _feats(spark, d):
    return features.volatility(source.bars_multi(spark, d)).select("symbol", "ts", *FEATS)


FEATS_SQL = "fe AS (" + _joined(["returns", "volatility"], FEATS) + ")"
_PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]]


@query(
    f"WITH {FEATS_SQL}, ok AS (SELECT * FROM fe WHERE {' AND '.join(f'{x} IS NOT NULL' for x in FEATS)}), co AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM ok" for a, b in _PAIRS)
    + ") SELECT a, b, round(correlation, 4) AS correlation FROM co WHERE abs(correlation) > 0.5",
    4,
)
def corr_pairs(spark, d):
    return diagnose.correlated(_feats(spark, d), FEATS, 0.5)


@query(
    f"WITH {FEATS_SQL}, st AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS x FROM fe" for x in FEATS) + ") SELECT feature, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(kurtosis(x), 2) AS kurtosis, kurtosis(x) > 10 AS heavy FROM st GROUP BY 1",
    4,
    kurtosis=2,
)
def feature_distributions(spark, d):
    return diagnose.distributions(_feats(spark, d), FEATS)


_UP = "up AS (SELECT *, CAST(log_returns > 0 AS INTEGER) AS up FROM fe WHERE log_returns IS NOT NULL)"
_INFORM = ["realized_vol", "gk_vol", "bb_width", "yz_vol"]


@query(
    f"WITH {FEATS_SQL}, {_UP}, st AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS x, up FROM up WHERE {x} IS NOT NULL" for x in _INFORM)
    + """), bi AS (SELECT *, ntile(10) OVER (PARTITION BY feature ORDER BY x, up) AS bin FROM st), cn AS (SELECT feature, bin, up, count(*) AS n FROM bi GROUP BY 1, 2, 3),
    mi AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * log2(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, bin) * sum(n) OVER (PARTITION BY feature, up))) AS i FROM cn) SELECT feature, round(sum(i), 4) AS bits FROM mi GROUP BY 1""",
    4,
)
def mutual_information(spark, d):
    df = ts.rounded(_feats(spark, d)).withColumn("up", (F.col("log_returns") > 0).cast("int"))
    return diagnose.mutual_information(df.where("up IS NOT NULL"), _INFORM, "up")


@query()
def mutual_information_knn(spark, d):
    df = _feats(spark, d).withColumn("up", (F.col("log_returns") > 0).cast("int"))
    return kernels.mutual_information_knn(df.where("up IS NOT NULL"), _INFORM, "up")


@query(
    f"WITH {MULTI}, t AS (SELECT symbol, ts, close, lead(close) OVER {W} AS nx FROM bars) SELECT symbol, ts, CAST(nx > close AS INTEGER) AS raw, CAST(ln(nx / close) > 0 AS INTEGER) AS logged, (nx > close) = (ln(nx / close) > 0) AS same FROM t WHERE nx IS NOT NULL"
)
def next_day_direction(spark, d):
    return diagnose.next_direction(source.bars_multi(spark, d))


_FFD = kernels.kernel_of(0.4)


@query(
    f"WITH {MULTI}, n AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {len(_FFD) - 1} PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, ts, round(CASE WHEN len(l) = {len(_FFD)} THEN list_sum(list_transform(list_zip(l, {[*reversed(_FFD)]!r}), lambda z: z[1] * z[2])) END, 3) AS close FROM n",
    3,
)
def ffd_fixed_d(spark, d):
    return kernels.fractional(source.bars_multi(spark, d).select("symbol", "ts", "close"), "close", 0.4)


@query()
def ffd_optimal_d(spark, d):
    return kernels.optimal_d(source.bars_multi(spark, d).select("symbol", "ts", F.col("close").alias("x")))


@query(
    f"WITH {MULTI}, q AS (SELECT symbol, median(close) AS m, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS i FROM bars GROUP BY 1) SELECT symbol, ts, round((close - m) / CASE WHEN i = 0 THEN 1 ELSE i END, 6) AS close FROM bars JOIN q USING (symbol)"
)
def robust_scale(spark, d):
    return models.robust_scale(source.bars_multi(spark, d).select("symbol", "ts", "close"), ["close"], by=["symbol"]).select("symbol", "ts", "close")


@query()
def lz_complexity(spark, d):
    return kernels.lz_complexity(source.bars_multi(spark, d))


@query()
def hurst(spark, d):
    return kernels.hurst(source.bars_multi(spark, d))


@query()
def sadf(spark, d):
    return kernels.sadf(source.bars_daily(spark, d))


@query()
def smt(spark, d):
    return kernels.smt(source.bars_daily(spark, d))


@query()
def adf_stationarity(spark, d):
    return kernels.stationarity(_feats(spark, d), FEATS)


_OPT = "op AS (SELECT p_partkey AS id, p_retailprice AS spot, p_size / 50.0::DOUBLE AS years, p_retailprice * 1.05::DOUBLE AS strike, 0.03::DOUBLE AS rate, 0.5::DOUBLE AS vol, p_partkey % 2 = 0 AS call FROM part)"


@query(
    f"""WITH {_OPT}, dd AS (SELECT *, CASE WHEN call THEN 1.0 ELSE -1.0 END::DOUBLE AS s, (ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * sqrt(years)) AS d1 FROM op), d2 AS (SELECT *, d1 - vol * sqrt(years) AS d2 FROM dd)
    SELECT id, round(spot, 4) AS spot, round(years, 4) AS years, round(strike, 4) AS strike, round(rate, 4) AS rate, round(vol, 4) AS vol, call, round(s * (spot * {_phi("s * d1")} - strike * exp(-rate * years) * {_phi("s * d2")}), 4) AS price FROM d2""",
    4,
)
def black_scholes(spark, d):
    t = source.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("spot"), (F.col("p_size") / 50.0).alias("years"))
    return kernels.black_scholes(t.withColumns({"strike": F.col("spot") * 1.05, "rate": F.lit(0.03), "vol": F.lit(0.5), "call": F.col("id") % 2 == 0}))


def _aligned(spark, d):
    """The aligned set of daily bars, which are built once: the plan reads them in many places."""
    return flows.dataset(stored(source.bars_daily(spark, d)))


def _of_daily(name: str) -> str:
    return ORACLES[name].replace(MULTI, DAILY)


_KEPT = "bins AS (SELECT * FROM bins0 WHERE bin <> 0 AND bin IN (SELECT bin FROM (SELECT bin, count(*) / sum(count(*)) OVER () AS share FROM bins0 GROUP BY 1) WHERE share >= 0.05))"
_DAILY_BINS = BINS.replace("bins AS (SELECT k.symbol", "bins0 AS (SELECT k.symbol")
_WEIGHTS = _of_daily("sample_weights").replace(BINS, f"{_DAILY_BINS}, {_KEPT}")
_LABELS = f"{EVENTS.replace(MULTI, DAILY)}, {_DAILY_BINS}, {_KEPT} SELECT symbol, t0 AS ts, t1, round(ret, 6) AS ret, bin FROM bins"
_ALIGNED = (
    f"SELECT symbol, ts, {', '.join(features.TA)}, {', '.join(_STAT)}, {', '.join(f'log_returns_lag{k}' for k in features.LAGS)}, t1, ret, bin, w, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS event_pos "
    f"FROM ({TA_SQL.replace(MULTI, DAILY)}) JOIN ({_of_daily('math_features')}) USING (symbol, ts) JOIN ({_of_daily('lag_features')}) USING (symbol, ts) JOIN ({_LABELS}) USING (symbol, ts) JOIN (SELECT symbol, t0 AS ts, w FROM ({_WEIGHTS})) USING (symbol, ts)"
)
_NUMBERS = [*features.TA, *_STAT, *(f"log_returns_lag{k}" for k in features.LAGS), "ret", "w"]


@query(_ALIGNED, 6, **TA_DIGITS)
def aligned_dataset(spark, d):
    return _aligned(spark, d)


@query(
    f"""WITH al AS ({_ALIGNED}) SELECT count(*) AS rows, count(*) - count(DISTINCT (symbol, ts)) AS repeated, count(*) FILTER (t1 IS NULL) AS open_ended, count(*) FILTER (w <= 0) AS weightless,
    CAST({" + ".join(f"(CASE WHEN count({x}) = 0 THEN 1 ELSE 0 END)" for x in _NUMBERS)} AS INTEGER) AS empty_columns FROM al"""
)
def alignment_checks(spark, d):
    return features.alignment_faults(_aligned(spark, d))
