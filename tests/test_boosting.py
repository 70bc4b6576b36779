"""Boosted trees against a plain version of the same steps, and their defined behaviour."""

import numpy as np
import pytest

from marlstone.operators import boosting

COLUMNS = ["a", "b", "c"]


def table(spark, n=400, splits=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.5 > 0.3).astype(int)
    w = rng.random(n) + 0.5
    parts = np.where(np.arange(n) < 0.6 * n, "fit", np.where(np.arange(n) < 0.75 * n, "stop", np.where(np.arange(n) < 0.85 * n, "calibrate", "test")))
    rows = [(s, i, str(parts[i]), 0, i, int(y[i]), float(w[i]), 0.0, *map(float, x[(i + 7 * s) % n])) for s in range(splits) for i in range(n)]
    return spark.createDataFrame(rows, "split_id int, event_pos long, part string, group_id int, ts long, y int, w double, ret double, a double, b double, c double")


def plain(rows, split, seed, p, cuts):
    """Each tree by direct search over all cuts of all inputs."""
    rows = [r for r in rows if r.split_id == split]
    bins = np.array([[int(np.searchsorted(cuts[split][i], r[c], "left")) for i, c in enumerate(COLUMNS)] for r in rows])
    y, w, pos = (np.array([getattr(r, c) for r in rows], float) for c in ("y", "w", "event_pos"))
    fit, stop = (np.array([r.part == x for r in rows]) for x in ("fit", "stop"))
    z, losses, after = np.zeros(len(rows)), [], []
    shrunk = lambda g: np.sign(g) * max(abs(g) - p.alpha, 0)
    for number in range(p.trees):
        chance = 1 / (1 + np.exp(-z))
        g, h = w * (chance - y), w * chance * (1 - chance)
        use = fit & boosting.drawn(pos.astype(np.int64), number, seed, p.rows)
        allowed = boosting.inputs_of(3, None, number, seed, split, p.inputs)
        step = np.zeros(len(rows))

        def gain(a):
            return shrunk(g[a].sum()) ** 2 / (h[a].sum() + p.square)

        def build(here, depth):
            """(gain, left, right, where) or the value of a leaf, pruned from the bottom."""
            own = here & use
            best = None
            if depth < p.depth:
                for i in allowed:
                    for b in range(p.bins - 1):
                        left, right = own & (bins[:, i] <= b), own & (bins[:, i] > b)
                        if h[left].sum() < p.child or h[right].sum() < p.child:
                            continue
                        v = gain(left) + gain(right) - gain(own)
                        if v > boosting.LEAST and (best is None or v > best[0] + 1e-12):
                            best = v, here & (bins[:, i] <= b), here & (bins[:, i] > b)
            value = -p.rate * shrunk(g[own].sum()) / (h[own].sum() + p.square)
            if best is None:
                return value, here, None
            sides = build(best[1], depth + 1), build(best[2], depth + 1)
            if all(s[2] is None for s in sides) and best[0] < p.gamma:
                return value, here, None
            return value, here, sides

        def fill(node):
            if node[2] is None:
                step[node[1]] = node[0]
            else:
                for s in node[2]:
                    fill(s)

        fill(build(np.ones(len(rows), bool), 0))
        z = z + step
        losses.append((w * (np.logaddexp(0, z) - y * z))[stop].sum() / w[stop].sum())
        after.append(z)
        if number - int(np.argmin(losses)) >= p.patience:
            break
    at = int(np.argmin(losses))
    return dict(zip([(r.part, r.ts) for r in rows], after[at])), at + 1


def test_trees_are_those_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 3)
    p = boosting.Boost(trees=8, depth=3, rate=0.4, child=2.0, gamma=0.5, patience=3, bins=8)
    df = table(spark)
    cuts = boosting.quantiles(df, COLUMNS, p.bins)
    rows = boosting.binned(df, COLUMNS, cuts, 2)
    trees = boosting.fit(rows, 2, p)
    found = boosting.predict(rows, trees, p.depth).collect()
    assert len(found) == 2 * 2 * 100 and set(trees) == {(s, k) for s in (0, 1) for k in (0, 1)}
    source = df.collect()
    for split in (0, 1):
        for seed in (0, 1):
            want, n = plain(source, split, seed, p, cuts)
            assert len(trees[split, seed]) == n
            for r in found:
                if (r.split_id, r.seed) == (split, seed):
                    assert r.raw == pytest.approx(want[r.part, r.ts], abs=1e-9)


def test_groups_without_a_choice(spark):
    """One class, no stop rows, no allowed inputs: still a margin for each row."""
    p = boosting.Boost(trees=3, bins=8)
    df = table(spark, 60).where("part <> 'stop'")
    rows = boosting.binned(df, COLUMNS, boosting.quantiles(df, COLUMNS, p.bins), 1)
    trees = boosting.fit(rows, 1, p, {0: [], 1: [1]})
    assert len(trees[0, 0]) == 3 and all((t.input < 0).all() for t in trees[0, 0]) and all(set(t.input.tolist()) <= {-1, 1} for t in trees[1, 0])
    assert boosting.predict(rows, trees, p.depth).count() == df.where("part IN ('calibrate', 'test')").count()
