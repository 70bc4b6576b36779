import math

import numpy as np
import pandas as pd
import pytest

from marlstone.operators import evaluate, kernels


def test_lempel_ziv_counts_phrases():
    assert kernels.lempel_ziv(np.array([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1])) == 6  # 0 001 10 100 1000 101


def test_weights_of_whole_orders():
    assert kernels.kernel_of(0.0) == [1.0]
    assert kernels.kernel_of(1.0) == [1.0, -1.0]
    assert len(kernels.kernel_of(0.3)) == 200


def test_unit_roots():
    noise = np.random.default_rng(1).normal(size=400)
    assert kernels.adf(noise)[1] < 0.01
    assert kernels.adf(np.cumsum(noise))[1] > 0.05
    assert kernels.adf(np.ones(100))[1] == 1.0 and kernels.adf(noise[:20])[1] == 1.0
    assert kernels.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.002)  # the published 5 % point


def test_hurst_of_noise():
    assert 0.4 < kernels.rescaled_range(np.random.default_rng(2).normal(size=180)) < 0.75


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 100, 0.2, 1.0, 1), (1.0, 100, 0.2, 1.0, 6), (3.0, 100, 0.2, 1.0, 6)], "sr double, n int, skew double, kurt double, trials int")
    got = [r.d for r in df.select(evaluate.deflated_sharpe(*map(F.col, ("sr", "n", "skew", "kurt", "trials"))).alias("d")).collect()]
    z, sr = NormalDist().inv_cdf, 1 / math.sqrt(365)
    error = math.sqrt((1 - 0.2 * sr + 0.75 * sr * sr) / 99)
    best = (1 - 0.5772156649015329) * z(1 - 1 / 6) + 0.5772156649015329 * z(1 - 1 / (6 * math.e))
    assert got[0] == 1.0 and got[1] == pytest.approx(NormalDist().cdf(sr / error - best), abs=1e-9) and got[2] > got[1]
    x = spark.createDataFrame([(i / 8,) for i in range(-80, 81)], "x double").select("x", evaluate.phi(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - NormalDist().cdf(r.x)) < 1e-12 for r in x)


def test_nearest_neighbour_information():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 300)
    x = rng.normal(size=300) + label
    k = 3
    z = x / x.std()
    values = []
    for i in range(300):
        same = np.sort(np.abs(z[label == label[i]] - z[i]))
        values.append((np.abs(z - z[i]) < same[k]).sum())
    psi = kernels.digamma
    want = psi([300])[0] + psi([k])[0] - np.mean([psi([(label == c).sum()])[0] for c in label]) - psi(np.array(values, float)).mean()
    assert kernels.neighbour_information(x, label, k) == pytest.approx(want, abs=1e-9)
    assert kernels.neighbour_information(rng.normal(size=300), label, k) < 0.1
    assert psi([1.0, 0.5 + 9.5])[0] == pytest.approx(-0.5772156649015329, abs=1e-10)


def test_grouped_logistic_fits_match_one_by_one(spark):
    from marlstone.operators import glm, models

    rng = np.random.default_rng(5)
    rows, each = [], {}
    for g in ("a", "b"):
        x = rng.normal(size=(200, 3))
        y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0.3).astype(int)
        w = rng.uniform(0.5, 2, 200)
        each[g] = x, y, w
        rows += [(g, xi.tolist(), int(yi), float(wi)) for xi, yi, wi in zip(x, y, w)]
    df = spark.createDataFrame(rows + [("one", [0.0, 0.0, 0.0], 1, 1.0)], "g string, x array<double>, y int, w double")
    beta = glm.fit(df, "g", "x", "y", "w", c=0.5)
    for g, (x, y, w) in each.items():
        design = np.column_stack([x, np.ones(200)])
        p = 1 / (1 + np.exp(-design @ beta[g]))
        slope = design.T @ (w * (p - y)) + np.append(beta[g][:3] / 0.5, 0)
        assert np.abs(slope).max() < 1e-6  # the least of the penalised loss
    assert beta["one"][-1] == 30.0
    scored = glm.margin(df.where("g = 'a'"), "g", "x", beta).collect()
    assert scored[0].raw == pytest.approx(float(np.append(each["a"][0][0], 1) @ beta["a"]))
    raw = df.where("g <> 'one'").selectExpr("g", "y", "3 * (x[0] - 2 * x[1]) AS raw")
    t, shift = models.calibrate(raw, "g", "temperature")["a"]
    pdf = raw.where("g = 'a'").toPandas()
    loss = lambda a: float(np.mean(np.logaddexp(0, a * pdf.raw) - pdf.y * a * pdf.raw))
    assert shift == 0 and all(loss(t) <= loss(a) + 1e-9 for a in np.linspace(0.05, 20, 400))
    a, b = models.calibrate(raw, "g", "vector")["a"]
    assert 0.05 <= a <= 20 and np.mean(np.logaddexp(0, a * pdf.raw + b) - pdf.y * (a * pdf.raw + b)) <= loss(t) + 1e-9


def test_suprema_match_loops(spark):
    rng = np.random.default_rng(3)
    y = np.exp(np.cumsum(rng.normal(0, 0.02, 130)))
    days = pd.date_range("2020-01-01", periods=130).date
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days, "close": y}), "symbol string, ts date, close double")
    got = {r.ts: r for r in kernels.smt(bars).join(kernels.sadf(bars), ["symbol", "ts"]).collect()}
    z = np.log(y)
    for t in (89, 90, 129):
        row = got[days[t]]
        if t < 90:
            assert row.sadf is None or math.isnan(row.sadf)
            continue
        best, line = -np.inf, 0.0
        for s in range(0, t - 90 + 1):
            d = np.diff(z[s : t + 1])
            x = np.column_stack([z[s + 1 : t], d[:-1], np.ones(len(d) - 1)])
            b, se, _ = kernels.ols(x, d[1:])
            best = max(best, b[0] / se[0])
            part = z[s : t + 1]
            n = len(part)
            b, se, _ = kernels.ols(np.column_stack([np.arange(n), np.ones(n)]), part)
            line = max(line, abs(b[0] / se[0]) / math.sqrt(n))
        assert row.sadf == pytest.approx(best, rel=1e-5)
        assert row.smt_poly1 == pytest.approx(line, rel=1e-6)


def test_pricing_errors_of_exact_marks(spark):
    from marlstone.operators import kernels

    spots = spark.createDataFrame([("A", 100.0, 0.5, 0.8)], "symbol string, spot double, realized_vol double, yz_vol double")
    rows = [(k, e, c) for k in (80.0, 100.0, 120.0) for e, c in (("2025-07-01", True), ("2025-07-01", False), ("2025-06-03", True), ("2026-06-01", True))]
    options = spark.createDataFrame(rows, "strike double, expiry string, call boolean").selectExpr("strike", "cast(expiry AS date) AS expiry", "call", "0.5 AS price")
    years = (30 + 8 / 24) / 365
    ready = options.selectExpr("*", "100.0D AS spot", f"{years!r}D AS years", "0.05D AS rate", "0.8D AS vol").drop("price")
    marks = kernels.black_scholes(ready).selectExpr("strike", "expiry", "call", "price / 100 AS mark")
    got = kernels.pricing_errors(marks, spots, "2025-06-01", floor=0.0).first()
    assert got.n == 3 and got.mean_yz < 1e-9 and got.median_yz < 1e-9 and got.mean_rv > 1 and got.gain == got.median_rv - got.median_yz
    assert kernels.pricing_errors(marks, spots, "2025-06-01", floor=1e9).count() == 0


def test_normal_distribution_runs_in_batches(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i / 16,) for i in range(-160, 161)] + [(None,)], "x double").select("x", evaluate.phi(F.col("x")).alias("p"))
    assert "lambda" not in rows._jdf.queryExecution().analyzed().toString()  # no interpreted loop a row
    *got, none = rows.collect()
    assert none.p is None and all(abs(r.p - math.erfc(-r.x / math.sqrt(2)) / 2) < 1e-15 for r in got)


def test_malformed_names_are_left_out_in_any_order_of_filters(spark):
    from marlstone.operators import diagnose

    names = spark.createDataFrame([("BTC",), ("BTC-bad-1",), ("BTC-27JUN25-60000-C",), (None,)], "name string")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        assert [(r.strike, r.call) for r in diagnose.options_of(names).where("call").collect()] == [(60000.0, True)]
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")


def test_groups_have_own_penalties_and_all_are_fitted_to_the_end(spark):
    """A group that is done early, here one of a single class, does not end the others."""
    from marlstone.operators import glm

    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2))
    y = (x @ [3.0, -2.0] + rng.normal(size=150) > 0.5).astype(int)
    rows = [(g, xi.tolist(), int(yi), 1.0) for g in ("a/0", "a/1") for xi, yi in zip(x, y)] + [(g, [0.0, 0.0], 1, 1.0) for g in ("one/0", "one/1")]
    grid = (0.05, 20.0)
    beta = glm.fit(spark.createDataFrame(rows, "g string, x array<double>, y int, w double"), "g", "x", "y", "w", lambda g: grid[int(g[-1])])
    design = np.column_stack([x, np.ones(150)])
    for i, c in enumerate(grid):
        b = beta[f"a/{i}"]
        slope = design.T @ (1 / (1 + np.exp(-design @ b)) - y) + np.append(b[:2] / c, 0)
        assert np.abs(slope).max() < 1e-6
    alone = glm.fit(spark.createDataFrame([r for r in rows if r[0] in ("a/1", "one/1")], "g string, x array<double>, y int, w double"), "g", "x", "y", "w", grid[1])
    assert np.abs(alone["a/1"] - beta["a/1"]).max() < 1e-7


def test_penalties_are_searched_in_one_fit(spark, monkeypatch):
    from marlstone.operators import glm
    from marlstone.plans import flows

    rng = np.random.default_rng(7)
    rows = [(s, f, "validate" if i % 3 == f else "train", i, float(v), int(v + rng.normal() > 0), 1.0) for s in range(2) for f in range(3) for i, v in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "split_id int, fold int, role string, event_pos int, v double, y int, w double")
    calls, own = [], glm.fit
    monkeypatch.setattr(glm, "fit", lambda *a: calls.append(a) or own(*a))
    got = flows.tuned(df, ["v"], (0.01, 1.0)).collect()
    assert len(calls) == 1 and sorted((r.split_id, r.c) for r in got) == [(s, c) for s in range(2) for c in (0.01, 1.0)]
    for c in (0.01, 1.0):
        alone = {r.split_id: r for r in flows.tuned(df, ["v"], (c,)).collect()}
        assert all(abs(r.log_loss - alone[r.split_id].log_loss) < 1e-9 and r.accuracy == alone[r.split_id].accuracy for r in got if r.c == c)
