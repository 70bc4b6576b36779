import datetime

import pandas as pd
import pytest

import oracle
from conftest import SF
from marlstone import catalog as queries
from marlstone.functions import ts
from marlstone.operators import cv, evaluate, features, labeling
from marlstone.sources import bars as source
from pyspark.sql import functions as F

CHEAP = ["lost_closes", "merged_sources", "coerced_and_late", "filled_back", "all_days", "cached_matrix", "external_missing", "rescaled_yield", "demo_splits", "instrument_names", "sequences", "stream_bars", "black_scholes", "leak_audit", "purged_folds", "bars_daily", "gap_runs", "gap_fill", "ohlcv_audit", "returns", "volatility", "oscillators", "volumes", "exponential_averages", "math_features", "asof_backward", "daily_vol", "cusum_events", "triple_barrier", "concurrency", "path_map", "robust_scale"]


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def frame(spark, closes, symbol="A", days=None):
    rows = [(symbol, day(i if days is None else days[i]), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_its_sql(spark, name):
    mine, theirs, difference = oracle.differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], oracle.connection(SF))
    assert mine == theirs and not difference


def test_short_gaps_fill_and_long_ones_raise(spark):
    filled = source.fill_gaps(frame(spark, [1.0, 2.0, 3.0], days=[0, 1, 5])).orderBy("ts").collect()
    assert [r.close for r in filled] == [1, 2, 2, 2, 2, 3] and [r.volume for r in filled] == [1, 1, 0, 0, 0, 1]
    with pytest.raises(source.InputError):
        source.fill_gaps(frame(spark, [1.0, 2.0], days=[0, 5]))
    with pytest.raises(source.InputError):
        source.validated(frame(spark, [1.0, 2.0], days=[0, 0]))
    with pytest.raises(source.InputError):
        source.validated(frame(spark, []))


def test_ewm_matches_pandas(spark):
    x = pd.Series([None, 1.0, 2.0, 4.0, 3.0, 5.0] * 12)
    df = spark.createDataFrame([("A", day(i), None if pd.isna(v) else v) for i, v in enumerate(x)], "symbol string, ts date, x double")
    got = ts.placed(df).select("ts", ts.span(3).mean(F.col("x"), 2).alias("m"), ts.span(10).std(F.col("x")).alias("s")).orderBy("ts").toPandas()
    assert got["m"].tolist() == pytest.approx(x.ewm(span=3, min_periods=2).mean().tolist(), nan_ok=True)
    assert got["s"].tolist()[3:] == pytest.approx(x.ewm(span=10).std().tolist()[3:], rel=1e-9)


def test_future_bars_do_not_change_past_features(spark):
    closes = [100 + (i * 37 % 11) - (i * 17 % 7) for i in range(80)]
    whole = {r.ts: r for r in features.oscillators(frame(spark, map(float, closes))).select("ts", "stoch_k", "cci_14").collect()}
    part = features.oscillators(frame(spark, map(float, closes[:50]))).select("ts", "stoch_k", "cci_14").collect()
    assert all(whole[r.ts] == r for r in part)


def test_cusum_fires_on_either_side_and_restarts(spark):
    vol = spark.createDataFrame([("A", day(i), 1.0, r, 0.1) for i, r in enumerate([0.06, 0.05, 0.02, -0.12, -0.1])], "symbol string, ts date, close double, ret double, vol double")
    assert [(r.ts, r.side) for r in labeling.cusum_events(vol).orderBy("ts").collect()] == [(day(1), 1), (day(3), -1), (day(4), -1)]


def test_exact_touch_is_no_touch_and_last_bar_has_no_label(spark):
    vol = spark.createDataFrame([("A", day(0), 100.0, None, 0.1), ("A", day(1), 115.0, 0.15, 0.1), ("A", day(2), 116.0, 0.01, 0.1)], "symbol string, ts date, close double, ret double, vol double")
    events = vol.select("symbol", "ts")
    rows = {r.t0: r for r in labeling.triple_barrier(vol, events).collect()}
    assert rows[day(0)].t1 == day(2) and rows[day(0)].bin == 1 and day(2) not in rows


def test_groups_paths_and_leaks(spark):
    bins = spark.createDataFrame([("A", day(3 * i), day(3 * i + 5), 0.1, 1) for i in range(100)], "symbol string, t0 date, t1 date, ret double, bin int")
    found = cv.roles(cv.events(bins)).cache()
    assert found.groupBy("event_pos").agg(F.count_if(F.col("role") == "test").alias("n")).select("n").distinct().collect() == [(7,)]
    assert cv.audit(found).where("n_leaks > 0").count() == 0
    sizes = [r[1] for r in cv.grouped(cv.events(bins)).groupBy("group_id").count().orderBy("group_id").collect()]
    assert sizes == [12] * 7 + [16]
    assert cv.path_map(spark).groupBy("path_id").count().select("count").distinct().collect() == [(8,)]


def test_weights_have_mean_one(spark):
    bars = frame(spark, [100.0 + i for i in range(40)])
    bins = spark.createDataFrame([("A", day(i), day(i + 4), 0.01 * (i + 1), 1) for i in range(0, 30, 3)], "symbol string, t0 date, t1 date, ret double, bin int")
    w = [r.w for r in labeling.sample_weights(bars, bins).collect()]
    assert sum(w) == pytest.approx(len(w)) and min(w) > 0


def test_bets_are_steps(spark):
    p = [0.5, 0.56, 0.57, 0.69, 0.82, 0.44, 0.2]  # 2 * Phi(z) - 1 of the last is -0.55
    got = [r.b for r in spark.createDataFrame([(x,) for x in p], "p double").select(evaluate.bet_size(F.col("p")).alias("b")).collect()]
    assert set(map(abs, got)) <= {0, 0.25, 0.5, 0.75} and got[0] == 0 and got[-1] == -0.5 and got == sorted(got[:5]) + got[5:]


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.6)], "model string, y_true int, p_up double")
    assert evaluate.auc(df, ["model"]).first().auc is None


def test_entry_survives_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['marlstone.llm'] = None\nimport builtins\nreal = builtins.__import__\ndef guarded(name, *a, **k):\n    if name == 'corpus_pipeline': raise ModuleNotFoundError(name='corpus_pipeline')\n    return real(name, *a, **k)\nbuiltins.__import__ = guarded\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_purge_ends_with_the_last_start_of_a_group(spark):
    bins = spark.createDataFrame([("A", day(i), day(i + 6), 0.1, 1) for i in range(40)], "symbol string, t0 date, t1 date, ret double, bin int")
    ev = cv.events(bins)
    assert [r.event_pos for r in ev.orderBy("t0").collect()] == list(range(40))
    found = {(r.split_id, r.event_pos): r.role for r in cv.roles(ev, 4, 1, 0.0).collect()}
    assert [found[0, p] for p in (9, 10, 15)] == ["test", "train", "train"]  # the labels of the group last until day 15
    strict = {(r.split_id, r.event_pos): r.role for r in cv.roles(ev, 4, 1, 0.0, through_labels=True).collect()}
    assert [strict[0, p] for p in (9, 10, 15, 16)] == ["test", "purged", "purged", "train"]


def test_first_buy_costs(spark):
    rows = spark.createDataFrame([("m", 0, day(i), 0.5, 1, 0.01) for i in range(3)], "model string, path_id int, ts date, p_up double, y_true int, ret double")
    assert evaluate.buy_and_hold(rows).first().cum_return == pytest.approx(1.009 * 1.01**2 - 1)


def test_cache_keeps_what_it_has(spark, tmp_path):
    rows = frame(spark, [1.0, 2.0, 3.0]).withColumn("x", F.col("close") * 2)
    asked = []

    def build(columns):
        asked.append(columns)
        return rows.select("symbol", "ts", *columns)

    path = f"file://{tmp_path}/m"
    for columns in (["close"], ["close", "x"], ["x"]):
        assert source.cached(build, path, spark, columns, day(0), day(2)).count() == 3
    assert asked == [["close"], ["x"]]
    assert source.cached(build, path, spark, ["x"], day(1), day(4), slack=3).count() == 3 and len(asked) == 2
    source.cached(build, path, spark, ["x"], day(0), day(9))
    assert asked[-1] == ["x"]
    assert source.unexpected(rows, ["close", "y"]) == {"missing": ["y"], "extra": ["open", "high", "low", "volume", "x"]}


def test_path_metrics_of_odd_paths(spark):
    """No bets, no losses, a cost on closing, a first loss, one event: values computed by hand."""
    from math import inf, sqrt

    paths = {
        0: [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)],
        1: [(0.5, 0.01), (0.5, 0.03)],
        2: [(0.5, 0.02), (0.0, -0.0005), (0.25, -0.01)],
        3: [(0.5, -0.1), (0.5, 0.05), (0.5, 0.01)],
        4: [(0.75, 0.02)],
    }
    rows = [("m", p, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), bet, net) for p, own in paths.items() for i, (bet, net) in enumerate(own)]
    curve = evaluate.equity(spark.createDataFrame(rows, "model string, path_id int, ts date, bet double, net double"))
    got = {r.path_id: r for r in evaluate.performance(curve).collect()}
    no, up, closed, first, one = (got[i] for i in range(5))
    assert (no.sharpe, no.sortino, no.calmar, no.profit_factor, no.win_rate, no.avg_bet, no.n_trades, no.skew, no.max_drawdown) == (0, 0, 0, None, 0, 0, 0, 0, 0)
    assert (up.sortino, up.calmar, up.profit_factor, up.win_rate, up.skew) == (inf, inf, inf, 1, 0) and up.sharpe == pytest.approx(0.02 / (0.01 * sqrt(2)) * sqrt(365))
    assert closed.profit_factor == pytest.approx(0.02 / 0.01) and closed.avg_bet == pytest.approx(0.375) and closed.win_rate == 0.5 and closed.n_trades == 2
    assert first.max_drawdown == 0 and first.calmar == 0 and first.ann_return < 0 and first.years == pytest.approx(2 / 365.25)
    assert one.sharpe == pytest.approx(0.02 / 1e-10 * sqrt(365)) and one.ann_return == 0 and one.years == 0 and one.excess_kurtosis == 0
    wanted = spark.createDataFrame([("m", 3), ("m", 9)], "model string, path_id int")
    filled = {r.path_id: r for r in evaluate.empty_performance(evaluate.performance(curve), wanted).collect()}
    assert filled[3] == first or filled[3].sharpe == first.sharpe
    assert filled[9].sharpe == 0 and filled[9].n_trades == 0 and filled[9].profit_factor is None


def test_time_under_water_below_a_negative_peak(spark):
    """Events below the highest value so far count, whatever its sign, in the code and in the SQL: runs counted by hand."""
    nets = {
        0: [-1.5, 0.5, 0.2, -0.9, -0.5],  # -0.5, -0.75, -0.9, -0.09, -0.045: two below -0.5
        1: [-0.1, 0.05, -0.2],  # 0.9, 0.945, 0.756: the start of 1 is no peak
        2: [0.1, 0.1],
        3: [0.1, -2.0, 0.5, -3.0],  # 1.1, -1.1, -1.65, 3.3
    }
    rows = [("m", p, day(i), net) for p, own in nets.items() for i, net in enumerate(own)]
    curve = evaluate.equity(spark.createDataFrame(rows, "model string, path_id int, ts date, net double"))
    expected = [(0, 2), (1, 1), (2, 0), (3, 2)]
    assert sorted((r.path_id, r.time_under_water) for r in evaluate.under_water(curve).collect()) == expected
    con = oracle.connection(SF)
    con.register("cu", curve.toPandas())
    steps = queries.ORACLES["time_under_water"].partition(", uk AS ")[2]
    assert sorted(r[1:] for r in con.sql(f"WITH uk AS {steps}").fetchall()) == expected


def test_drawdown_from_the_first_below_zero_and_from_nothing(spark):
    """The peak is the highest equity itself, in the code and in the SQL; a path that loses all at once ends no other's row."""
    nets = {
        0: [-0.2, 0.5, -0.5],  # 0.8, 1.2, 0.6
        1: [-0.2, -0.5, 0.25],  # 0.8, 0.4, 0.5: never at the start of 1
        2: [-1.5, 0.5, -0.5],  # -0.5, -0.75, -0.375
        3: [-1.0, 0.5, 0.5],  # 0, 0, 0
        4: [0.5, -1.0, 0.5],  # 1.5, 0, 0
    }
    expected = {0: [0, 0, -0.5], 1: [0, -0.5, -0.375], 2: [0, 0.5, 0], 3: [None] * 3, 4: [0, -1, -1]}
    table = spark.createDataFrame([("m", p, day(i), net) for p, own in nets.items() for i, net in enumerate(own)], "model string, path_id int, ts date, net double")
    got = {(r.path_id, r.ts): r.drawdown for r in evaluate.equity(table).collect()}
    assert {p: [got[p, day(i)] for i in range(3)] for p in nets} == {p: pytest.approx(x, abs=1e-12) if p != 3 else x for p, x in expected.items()}
    con = oracle.connection(SF)
    con.register("nt", table.toPandas())
    steps = "eq AS " + queries.ORACLES["drawdown"].partition(", eq AS ")[2]
    sql = {r[:2]: oracle.value(r[2]) for r in con.sql(f"WITH {steps}").project("path_id, CAST(ts AS DATE), drawdown").fetchall()}
    assert {p: [sql[p, day(i)] for i in range(3)] for p in nets} == {p: pytest.approx(x, abs=1e-6) if p != 3 else x for p, x in expected.items()}


def test_stability_of_selections_and_orders(spark):
    """Features dealt to 28 splits by arithmetic, counted by plain Python."""
    import collections
    import statistics

    from pyspark.sql import functions as F

    from marlstone.operators import diagnose, evaluate, features, models

    dealt = {s: sorted(f for i, f in enumerate(features.TA) if (i * 7 + s * 3) % 10 < i % 9) for s in range(28)}
    selected = spark.createDataFrame(list(dealt.items()), "split_id int, selected array<string>")
    n = collections.Counter(f for own in dealt.values() for f in own)
    got = evaluate.feature_stability(selected)
    assert {r.feature: (r.n, round(r.frequency, 9), r.stable) for r in got.collect()} == {f: (k, round(k / 28, 9), k / 28 > 0.8) for f, k in n.items()}
    names = spark.createDataFrame([(x,) for x in (*features.TA, "hurst", "log_returns_lag3")], "feature string")
    table = {r.feature: (r.n, r.tier) for r in diagnose.stability_table(got.drop("stable"), names).collect()}
    assert table == {f: (n[f], "stable" if n[f] > 22.4 else "moderate" if n[f] > 14 else "low" if n[f] else "never") for f in (*features.TA, "hurst", "log_returns_lag3")}
    own = models.extraction_features(selected, spark.createDataFrame([(3,)], "split_id int"), 5).collect()
    assert [r.feature for r in own] == sorted(dealt[3], key=lambda f: (-n[f], f))[:5]
    orders = {s: (s * 7 % 5) * 0.05 for s in range(28)}
    found = spark.createDataFrame(list(orders.items()), "split_id int, d double").select("split_id", F.create_map(F.lit("atr"), "d").alias("ffd"))
    r = evaluate.ffd_stability(found).first()
    assert (r.feature, round(r.mean_d, 9), round(r.std_d, 9), r.min_d, r.max_d, r.unstable) == ("atr", round(statistics.mean(orders.values()), 9), round(statistics.pstdev(orders.values()), 9), 0.0, max(orders.values()), False)
