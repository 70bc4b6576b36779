"""Spline networks: slopes, splines, finer grids, and training over partitions against training in one piece."""

import numpy as np
import pytest

from marlstone.operators import spline_net as net


def test_splines_sum_to_one_and_their_slopes_are_right():
    x = np.linspace(-1, 0.999, 57)
    b, slope = net.basis(x, 5, 3)
    assert b.shape == (57, 8) and np.allclose(b.sum(-1), 1) and np.allclose(slope.sum(-1), 0)
    e = 1e-6
    assert np.allclose((net.basis(x + e, 5, 3)[0] - net.basis(x - e, 5, 3)[0]) / (2 * e), slope, atol=1e-6)
    assert not net.basis(np.array([-5.0, 5.0]), 5, 3)[0].any()


def test_slopes_match_differences():
    rng = np.random.default_rng(0)
    p = net.Net(hidden=3, grid=4)
    w = net.start(4, p, 1, 2)
    x, y, weight = np.tanh(rng.normal(size=(50, 4))), rng.integers(0, 2, 50).astype(float), rng.uniform(0.5, 2, 50)
    _, g = net.slopes(w, x, y, weight, p)
    flat, e = w.flat(), 1e-5
    for i in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += e
        down[i] -= e
        assert (net.slopes(w.moved(up), x, y, weight, p)[0] - net.slopes(w.moved(down), x, y, weight, p)[0]) / (2 * e) == pytest.approx(g[i], abs=1e-6)


def test_finer_grids_keep_the_functions():
    p = net.Net(hidden=4, grid=3)
    w = net.start(3, p, 0, 0)
    w.first[:, 1:] *= 5
    x = np.random.default_rng(1).uniform(-0.99, 0.99, (200, 3))
    fine = net.finer(w, 12, 3)  # its knots hold the old ones, so nothing is lost
    assert fine.first.shape == (3, 16, 4) and np.allclose(net.margin(fine, x, 3), net.margin(w, x, 3), atol=1e-9)


def _rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for split in (0, 1):
        for i in range(600):
            a, b = rng.uniform(-2, 2, 2)
            y = int((np.sin(2 * a) > 0) if split == 0 else (abs(b) > 1))
            rows.append((split, i, ("fit", "fit", "stop", "test")[i % 4], 0, i, y, 0.0, float(rng.uniform(0.5, 1.5)), float(a), float(b), 1.0))
    return spark.createDataFrame(rows, "split_id int, event_pos long, part string, group_id int, ts long, y int, ret double, w double, a double, b double, c double")


def test_training_over_partitions_is_training_in_one_piece(spark):
    p = net.Net(epochs=12, finer=((6, 8),), patience=50, rate=0.05)
    rows = net.ready(_rows(spark), ["a", "b", "c"])
    nets = net.fit(rows.repartition(7), 2, p)
    assert sorted(nets) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    f = rows.orderBy("event_pos").toPandas()
    for (split, seed), found in nets.items():
        own = f[f.split_id == split]
        part = {k: (net._matrix(g), g["y"].to_numpy(float), g["weight"].to_numpy(float)) for k, g in own.groupby("part")}
        run = net._Run.of(net.start(3, p, split, seed))
        for epoch in range(p.epochs + 1):
            if epoch == 6:
                run.regrid(8, 3)
            late = net.slopes(run.now, *part["stop"], p)[0] / part["stop"][2].sum()
            if late < run.loss:
                run.best, run.loss = run.now, late
            if epoch < p.epochs:
                run.step(net.slopes(run.now, *part["fit"], p)[1] / part["fit"][2].sum(), epoch, p)
        assert found.grid == run.best.grid and np.allclose(found.flat(), run.best.flat(), atol=1e-7)


def test_curved_classes_are_learned(spark):
    rows = net.ready(_rows(spark), ["a", "b", "c"])
    nets = net.fit(rows, 1, net.Net(epochs=60, rate=0.1))
    got = net.predict(rows, nets).toPandas()
    assert len(got) == 300 and set(got["part"]) == {"test"}
    for _, own in got.groupby("split_id"):
        assert ((own["raw"] > 0) == (own["y"] == 1)).mean() > 0.9


def test_groups_without_stop_rows_or_of_one_class(spark):
    one = _rows(spark).where("part <> 'stop'").selectExpr("split_id", "event_pos", "part", "group_id", "ts", "1 AS y", "ret", "w", "a", "b", "c")
    rows = net.ready(one, ["a", "b", "c"])
    nets = net.fit(rows, 1, net.Net(epochs=5))
    got = net.predict(rows, nets).toPandas()
    assert np.isfinite(got["raw"]).all() and (got["raw"] > -0.5).all()
    empty = net.ready(_rows(spark).limit(0), ["a", "b", "c"])
    assert net.fit(empty, 1) == {} and net.predict(empty, {}).count() == 0
