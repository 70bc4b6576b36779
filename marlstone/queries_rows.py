"""Registered queries of sources, external features, labels, options and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import ts
from marlstone.functions.store import folder
from marlstone.operators import cv, diagnose, features, kernels, labeling, models
from marlstone.plans import flows
from marlstone.queries import DAILY, DAILY_LABELS, EVENTS, EXT, FEATS_SQL, LABELS, MULTI, ORACLES, ROLES, SPLITS, TA_DIGITS, W, _bins, _daily_bins, _feats, _phi, _vols, query
from marlstone.sources import bars as source
from marlstone.streaming import cusum as streams

_FILLED = "s AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM bars)"


@query(
    f"""WITH {DAILY}, lo AS (SELECT * REPLACE (CASE WHEN day(ts) = 10 THEN NULL ELSE close END AS close) FROM bars), {_FILLED}, j AS (SELECT 'ALL' AS symbol, s.ts, close, coalesce(volume, 0.0) AS volume FROM s LEFT JOIN lo USING (ts)),
    f AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close, volume FROM j) SELECT symbol, ts, round(close, 6) AS close, volume FROM f WHERE ts NOT IN (SELECT ts FROM lo WHERE close IS NULL)"""
)
def lost_closes(spark, d):
    """Days that lose their close stay out after filling."""
    daily = source.bars_daily(spark, d).withColumn("close", F.when(F.dayofmonth("ts") != 10, F.col("close")))
    return source.without_lost_closes(daily, source.fill_gaps(daily, check=False)).select("symbol", "ts", "close", "volume")


@query(f"WITH {EXT} SELECT 'ALL' AS symbol, ts, round(value - value * 0.25, 4) AS value FROM ext", 4)
def yield_fallback(spark, d):
    """No series has 10**9 rows, so the long one less the spread stands in."""
    own = source.external(spark, d)
    return source.with_fallback(own, own, own.withColumn("value", F.col("value") * 0.25), least=10**9)


@query(f"""WITH {DAILY}, {EXT}, j AS (SELECT coalesce(bars.ts, ext.ts) AS ts, close, value FROM bars FULL JOIN ext ON bars.ts = ext.ts), f AS (SELECT 'ALL' AS symbol, ts, last_value(close IGNORE NULLS) OVER (ORDER BY ts) AS close, last_value(value IGNORE NULLS) OVER (ORDER BY ts) AS turnover FROM j)
    SELECT symbol, ts, round(close, 4) AS close, round(turnover, 4) AS turnover FROM f WHERE close IS NOT NULL AND turnover IS NOT NULL""", 4)
def merged_sources(spark, d):
    return source.merged({"close": source.bars_daily(spark, d).select("symbol", "ts", F.col("close").alias("value")), "turnover": source.external(spark, d)})


@query(f"""WITH {DAILY}, t AS (SELECT symbol, ts, CASE WHEN day(ts) % 7 = 0 THEN 'n/a' ELSE CAST(CAST(round(volume) AS BIGINT) AS VARCHAR) END AS x FROM bars) SELECT symbol, ts, lag(TRY_CAST(x AS DOUBLE)) OVER (ORDER BY ts) AS x FROM t""")
def coerced_and_late(spark, d):
    raw = source.bars_daily(spark, d).withColumn("x", F.when(F.dayofmonth("ts") % 7 == 0, "n/a").otherwise(F.round("volume").cast("long").cast("string")))
    return source.numeric(raw, ["x"])


@query(f"WITH {DAILY}, {_FILLED}, j AS (SELECT 'ALL' AS symbol, s.ts, close FROM s LEFT JOIN bars USING (ts)) SELECT symbol, ts, round(first_value(close IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS close FROM j")
def filled_back(spark, d):
    daily = source.bars_daily(spark, d)
    spine = source.fill_gaps(daily, check=False).select("symbol", "ts")
    return source.filled_back(spine.join(daily.select("symbol", "ts", "close"), ["symbol", "ts"], "left"), ["close"])


@query(f"WITH {DAILY}, {_FILLED} SELECT 'ALL' AS symbol, ts FROM s EXCEPT SELECT symbol, ts FROM bars")
def missing_days(spark, d):
    """The difference of two indexes."""
    daily = source.bars_daily(spark, d)
    return source.fill_gaps(daily, check=False).select("symbol", "ts").subtract(daily.select("symbol", "ts"))


@query(f"WITH {DAILY}, {EXT} SELECT ts FROM bars UNION SELECT ts FROM ext")
def all_days(spark, d):
    """The union of two indexes."""
    return source.bars_daily(spark, d).select("ts").union(source.external(spark, d).select("ts")).distinct()


@query(f"WITH {DAILY} SELECT count(*) AS n_bars, min(ts) AS first_day, max(ts) AS last_day, 'close,high,low,open,volume' AS columns FROM bars")
def fingerprint(spark, d):
    daily = source.bars_daily(spark, d)
    return source.fingerprint(daily).crossJoin(daily.agg(F.count("*").alias("n_bars")))  # one row each


@query(f"WITH {DAILY}, {ORACLES['returns'].replace(MULTI, 'r0 AS (SELECT 1)').split('SELECT symbol, ts', 1)[0].split('WITH ', 1)[1].replace('r0 AS (SELECT 1), ', '')} SELECT symbol, ts, round(log_returns, 6) AS log_returns, round(roc_14, 6) AS roc_14 FROM t")
def cached_matrix(spark, d):
    """A stored matrix that lacks a column gets it on the next call and serves both after that."""
    daily, path = source.bars_daily(spark, d), folder(spark)
    ends = daily.agg(F.min("ts"), F.max("ts")).first()
    build = lambda columns: features.returns(daily).select("symbol", "ts", *columns)
    source.cached(build, path, spark, ["log_returns"], *ends)
    source.cached(build, path, spark, ["roc_14"], *ends)
    return source.cached(lambda columns: daily.limit(0), path, spark, ["log_returns", "roc_14"], *ends)


#: How each source of the external features follows from the one series at hand: a factor, and whether it is set against the volume.
SOURCES = "dxy us10y us2y us30y vix sp500 nasdaq gold silver copper oil natgas eth active_addr tx_count hashrate mvrv flow_in flow_out fees exchange_supply supply issuance".split()


def _sources(spark, d):
    own = source.external(spark, d)
    return {name: own.withColumn("value", F.col("value") * (1 + i / 10) + i * 1000) for i, name in enumerate(SOURCES)}


def _roc(x: str, n: int) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER {W}, 0) - 1) * 100"


def _gain(x: str, n: int) -> str:
    return f"ln({x} / nullif(lag({x}, {n}) OVER {W}, 0))"


EXTERNAL_SQL = {
    "dxy_roc_30": _roc("dxy", 30), "us10y": "us10y", "us2y": "us2y", "yield_curve_2y10y": "us10y - us2y", "yield_curve_10y30y": "us30y - us10y", "vix": "vix",
    **{f"{s}_ret_{k}": _gain(s, k) for s in ("sp500", "nasdaq", "gold", "silver", "copper", "oil", "natgas") for k in (30, 14)},
    "eth_btc_ratio": "eth / nullif(close, 0)", "active_addr_roc_14": _roc("active_addr", 14), "tx_count_roc_14": _roc("tx_count", 14), "hashrate_roc_30": _roc("hashrate", 30), "mvrv": "mvrv",
    "net_exchange_flow": "flow_in - flow_out", "fee_per_tx": "fees / nullif(tx_count, 0)", "exchange_supply_pct": "100 * exchange_supply / nullif(supply, 0)", "issuance_ntv": "issuance",
}
_EXTERNAL = f"""{DAILY}, {EXT}, e0 AS (SELECT symbol, bars.ts AS ts, close, value FROM bars ASOF LEFT JOIN ext ON bars.ts >= ext.ts), e1 AS (SELECT symbol, ts, close, {", ".join(f"value * (1 + {i} / 10.0::DOUBLE) + {i} * 1000 AS {n}" for i, n in enumerate(SOURCES))} FROM e0),
    ex AS (SELECT symbol, ts, {", ".join(f"{x} AS {n}" for n, x in EXTERNAL_SQL.items())} FROM e1)"""


@query(f"WITH {_EXTERNAL} SELECT symbol, ts, {', '.join(f'round({n}, 4) AS {n}' for n in EXTERNAL_SQL)} FROM ex", 4)
def external_all(spark, d):
    return features.external(source.bars_daily(spark, d), _sources(spark, d))


@query(f"WITH {_EXTERNAL} SELECT symbol, ts, round(eth_btc_ratio, 4) AS eth_btc_ratio FROM ex", 4)
def external_crypto_only(spark, d):
    return features.external(source.bars_daily(spark, d), _sources(spark, d), features.chosen(macro=False, onchain=False))


@query(
    f"WITH {_EXTERNAL} "
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER ({n} IS NULL) AS n_missing, round(count(*) FILTER ({n} IS NULL) / count(*)::DOUBLE, 6) AS share FROM ex" for n in EXTERNAL_SQL)
)
def external_missing(spark, d):
    return features.missing(features.external(source.bars_daily(spark, d), _sources(spark, d)), list(EXTERNAL_SQL))


@query(f"WITH {EXT}, m AS (SELECT median(value) AS m FROM ext) SELECT 'ALL' AS symbol, ts, round(CASE WHEN m > 10 THEN value / 10 ELSE value END, 4) AS value FROM ext, m", 4)
def rescaled_yield(spark, d):
    return features.rescaled_yield(source.external(spark, d), "value")


@query()
def feature_matrix(spark, d):
    """All 73 features of the daily bars, in their order."""
    return flows.matrix(source.bars_daily(spark, d), sources=_sources(spark, d))


@query(
    f"SELECT symbol, ts, {', '.join(f'ta.{x}' for x in features.TA)}, shannon_entropy, jarque_bera, {', '.join(f'log_returns_lag{k}' for k in features.LAGS)} FROM ({ORACLES['ta_features']}) AS ta JOIN ({ORACLES['math_features']}) USING (symbol, ts) JOIN ({ORACLES['lag_features']}) USING (symbol, ts)",
    6,
    **TA_DIGITS,
)
def feature_subset(spark, d):
    return flows.matrix(source.bars_multi(spark, d), which=("shannon_entropy", "jarque_bera"))


@query(ORACLES["drop_rare"])
def labelled(spark, d):
    return labeling.label(source.bars_multi(spark, d)).select("symbol", "t0", "t1", "ret", "bin")


@query(
    EVENTS.replace("c(symbol, i, ts, up, down, side) AS (SELECT symbol, 0::BIGINT, NULL::DATE, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM h", "c(symbol, i, ts, up, down, side, su, sd) AS (SELECT symbol, 0::BIGINT, NULL::DATE, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM h").replace(
        "WHEN l <= -hh THEN -1 ELSE 0 END FROM", "WHEN l <= -hh THEN -1 ELSE 0 END, u, l FROM"
    )
    + " SELECT symbol, ts, side, round(su, 6) AS up, round(sd, 6) AS down FROM c WHERE i > 0"
)
def cusum_states(spark, d):
    return labeling.cusum_events(_vols(spark, d), states=True)


@query(f"{LABELS} SELECT bins.symbol, t0, t1, round(bins.ret, 6) AS ret, CASE WHEN bins.ret >= 1.5 * v.vol THEN 'profit' WHEN bins.ret <= -1.5 * v.vol THEN 'stop' ELSE 'vertical' END AS touch FROM bins JOIN v ON v.symbol = bins.symbol AND v.ts = t0")
def barrier_examples(spark, d):
    return diagnose.barrier_examples(_bins(spark, d), _vols(spark, d))


@query(
    f"""{DAILY_LABELS}, {SPLITS}, {ROLES}, de AS (SELECT 'early' AS kind, split_id FROM sp WHERE a = 0 AND b = 1 UNION ALL SELECT 'gap', min(split_id) FROM sp WHERE b - a > 1 UNION ALL SELECT 'tail', split_id FROM sp WHERE a = 6 AND b = 7)
    SELECT kind, split_id, """ + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("train", "test", "purged", "embargoed")) + " FROM de JOIN roles USING (split_id) GROUP BY 1, 2"
)
def demo_splits(spark, d):
    """The three splits that are shown, with the roles of the events in them."""
    return cv.demo_splits(spark).join(cv.split_info(cv.roles(cv.events(_daily_bins(spark, d)))), "split_id")


@query(
    f"""WITH q AS ({ORACLES['volatility']}), x AS (SELECT symbol, realized_vol AS rv, yz_vol * sqrt(365.0) AS yz FROM q WHERE realized_vol IS NOT NULL AND yz_vol IS NOT NULL)
    SELECT symbol, count(*) AS n, round(corr(rv, yz), 3) AS correlation, round(avg(abs(rv - yz)), 3) AS mean_absolute, round(avg(abs(rv - yz) / nullif(yz, 0)), 3) AS mean_relative, round(quantile_cont(rv - yz, 0.025), 3) AS low, round(quantile_cont(rv - yz, 0.975), 3) AS high FROM x GROUP BY 1""",
    3,
)
def volatility_comparison(spark, d):
    return diagnose.volatility_comparison(ts.rounded(features.volatility(source.bars_multi(spark, d)).select("symbol", "ts", "realized_vol", "yz_vol")))


_NAMES = "nm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'BTC-bad-' || p_partkey ELSE 'BTC-' || (1 + p_partkey % 28) || (['JUN', 'JUL', 'SEP'])[1 + p_partkey % 3] || '25-' || (p_size * 1000) || '-' || CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END END AS name, p_retailprice - 900 AS price FROM part)"
_PARSED = "op AS (SELECT id, name, price, string_split(name, '-') AS p FROM nm), ok AS (SELECT id, name, price, p[1] AS asset, CAST(strptime(p[2], '%d%b%y') AS DATE) AS expiry, CAST(p[3] AS DOUBLE) AS strike, p[4] = 'C' AS call FROM op WHERE len(p) = 4)"


def _instruments(spark, d):
    month = F.element_at(F.array(*map(F.lit, ("JUN", "JUL", "SEP"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("BTC-"), (1 + F.col("p_partkey") % 28).cast("string"), month, F.lit("25-"), (F.col("p_size") * 1000).cast("string"), F.lit("-"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"))
    bad = F.concat(F.lit("BTC-bad-"), F.col("p_partkey").cast("string"))
    return source.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, bad).otherwise(name).alias("name"), (F.col("p_retailprice") - 900).alias("price"))


@query(f"WITH {_NAMES}, {_PARSED} SELECT id, name, round(price, 6) AS price, asset, expiry, strike, call FROM ok")
def instrument_names(spark, d):
    return diagnose.options_of(_instruments(spark, d))


@query(
    f"""WITH {_NAMES}, {_PARSED}, nr AS (SELECT *, expiry - DATE '2025-06-01' AS days FROM ok WHERE expiry - DATE '2025-06-01' BETWEEN 7 AND 90 AND price > 0), be AS (SELECT expiry FROM nr GROUP BY 1 ORDER BY count(*) DESC, expiry LIMIT 1)
    SELECT id, name, round(price, 6) AS price, asset, expiry, strike, call, CAST(days AS INTEGER) AS days FROM nr WHERE expiry IN (SELECT expiry FROM be)"""
)
def instrument_filter(spark, d):
    return diagnose.tradable(diagnose.options_of(_instruments(spark, d)), "2025-06-01")


def _call_sql(name: str, vol: str) -> str:
    d1 = f"((ln(spot / strike) + (0.05 + {vol} * {vol} / 2) * years) / ({vol} * sqrt(years)))"
    return f"abs(spot * {_phi(d1)} - strike * exp(-0.05 * years) * {_phi(f'({d1} - {vol} * sqrt(years))')} - market) AS {name}"


@query(
    f"""WITH {_NAMES}, {_PARSED}, {FEATS_SQL}, bm AS ({ORACLES["bars_multi"]}), sp AS (SELECT fe.symbol, arg_max(close, fe.ts) AS spot, arg_max(round(realized_vol, 4), fe.ts) AS realized_vol, arg_max(round(yz_vol, 4), fe.ts) AS yz_vol FROM fe JOIN bm ON bm.symbol = fe.symbol AND bm.ts = fe.ts WHERE realized_vol IS NOT NULL AND yz_vol IS NOT NULL GROUP BY 1),
    nr AS (SELECT ok.*, sp.*, price / 1000 * spot AS market, (expiry - DATE '2025-06-01' + 8 / 24.0::DOUBLE) / 365 AS years FROM ok, sp WHERE call), er AS (SELECT symbol, market, {_call_sql("rv", "realized_vol")}, {_call_sql("yz", "yz_vol")} FROM nr WHERE years * 365 > 7 AND years * 365 < 90 AND market >= 10),
    me AS (SELECT symbol, count(*) AS n, avg(rv) AS mean_rv, avg(yz) AS mean_yz, median(100 * rv / market) AS median_rv, median(100 * yz / market) AS median_yz FROM er GROUP BY 1)
    SELECT symbol, n, round(mean_rv, 2) AS mean_rv, round(mean_yz, 2) AS mean_yz, round(median_rv, 4) AS median_rv, round(median_yz, 4) AS median_yz, round(median_rv - median_yz, 4) AS gain FROM me""",
    4,
    mean_rv=2,
    mean_yz=2,
)
def pricing_errors(spark, d):
    """Errors of two volatilities over all calls of the tables, for the last bar of each series."""
    bars = source.bars_multi(spark, d)
    last = _feats(spark, d).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"]).where("realized_vol IS NOT NULL AND yz_vol IS NOT NULL")
    spots = last.groupBy("symbol").agg(F.max_by("close", "ts").alias("spot"), *(F.max_by(F.round(c, 4), "ts").alias(c) for c in ("realized_vol", "yz_vol")))
    return kernels.pricing_errors(diagnose.options_of(_instruments(spark, d)).withColumn("mark", F.col("price") / 1000), spots, "2025-06-01")


@query(f"WITH q AS ({ORACLES['returns']}), s AS (SELECT symbol, ts, lag(log_returns, 13) OVER {W} AS oldest, log_returns AS newest, row_number() OVER {W} AS k FROM q) SELECT symbol, ts, round(oldest, 6) AS oldest, round(newest, 6) AS newest, 14 AS length FROM s WHERE k >= 14")
def sequences(spark, d):
    rows = features.returns(source.bars_multi(spark, d))
    found = models.sequences(rows.select("symbol", "ts", "log_returns", "roc_14"), ["log_returns", "roc_14"], 14, "symbol", "ts")
    return found.select("symbol", "ts", F.col("sequence")[0][0].alias("oldest"), F.element_at("sequence", -1)[0].alias("newest"), F.size("sequence").alias("length"))


@query(
    """WITH b AS (SELECT 'ALL' AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 2), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
    SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b, m WHERE ts + INTERVAL 1 HOUR <= w"""
)
def stream_bars(spark, d):
    """Hourly bars of the stream of events; the last hour waits for the watermark."""
    schema = source.table(spark, d, "events").schema
    ticks = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return streams.finished(streams.hourly_bars(ticks.select(F.lit("ALL").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")))


@query(f"{EVENTS.replace('avg(vol) AS h FROM v', '0.4::DOUBLE AS h FROM v')} SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, side FROM e")
def stream_cusum(spark, d):
    """Events of the stream of returns, two sums of state a symbol."""
    path = folder(spark)
    _vols(spark, d).where("ret IS NOT NULL").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "ret").write.parquet(path)
    returns = spark.readStream.schema("symbol string, ts timestamp, ret double").parquet(path)
    return streams.finished(streams.cusum(returns, 0.4))


@query(f"{EVENTS.replace('avg(vol) AS h FROM v', '0.4::DOUBLE AS h FROM v')} SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, side FROM e WHERE ts <= (SELECT max(ts) FROM v WHERE ret IS NOT NULL) - INTERVAL 10 DAY")
def stream_cusum_late(spark, d):
    """Events of the stream of returns whose rows may come up to ten days late; the last ten days wait for newer rows."""
    path = folder(spark)
    _vols(spark, d).where("ret IS NOT NULL").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "ret").write.parquet(path)
    returns = spark.readStream.schema("symbol string, ts timestamp, ret double").parquet(path)
    return streams.finished(streams.cusum(returns, 0.4, late="10 days"))
