"""Second-order gradient boosting of many groups and seeds at once.

Inputs are cut into bins by quantiles of each group's training rows, so a row is a string of bytes. For a level of a tree, tasks
sum gradients and curvatures of their rows by (group, seed, node, input, bin); Spark adds up the tasks' sums and finds the best
cut of each node where they meet. One job a level thus grows a tree of every group and seed. The driver keeps the trees, some
numbers a node; every STORED trees the rows' margins are stored, so that tasks apply only the trees since then. Groups stop each on
their own, by the loss of their `stop` rows, which the first level of the next tree takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.store import stored

#: Trees after which margins are stored, rows of a group that lie together, and the least gain that grows a node.
STORED, CHUNK, LEAST = 10, 100_000, 1e-6


@dataclass(frozen=True)
class Boost:
    """Parameters: number, depth and rate of trees, shares of rows and inputs that a tree gets, least curvature of a leaf, least gain
    of a cut, penalties on size and square of leaves, trees without a lower loss before a group stops, and bins."""

    trees: int = 300
    depth: int = 3
    rate: float = 0.05
    rows: float = 0.7
    inputs: float = 0.7
    child: float = 5.0
    gamma: float = 1.0
    alpha: float = 0.1
    square: float = 2.0
    patience: int = 20
    bins: int = 64

    def shrunk(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)

    def strength(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """What a node takes off the loss, doubled."""
        return self.shrunk(g) ** 2 / (h + self.square)

    def leaf(self, g: float, h: float) -> float:
        return float(-self.rate * self.shrunk(np.float64(g)) / (h + self.square))


class Tree:
    """Nodes in the order of a heap: input (-1: a leaf), the last bin that goes left, value and gain."""

    def __init__(self, depth: int) -> None:
        n = (2 << depth) - 1
        self.input, self.cut = np.full(n, -1), np.zeros(n, np.int64)
        self.value, self.gain = np.zeros(n), np.zeros(n)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after so many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            own = self.input[at]
            at = np.where(own >= 0, 2 * at + 1 + (bins[rows, own] > self.cut[at]), at)
        return at

    def prune(self, gamma: float) -> None:
        """From the bottom, cuts between leaves that gain less than gamma go."""
        for i in range(len(self.input) // 2 - 1, -1, -1):
            if self.input[i] >= 0 and self.input[2 * i + 1] < 0 and self.input[2 * i + 2] < 0 and self.gain[i] < gamma:
                self.input[i] = -1


def drawn(position: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree gets, by a hash."""
    x = position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 1_000_003 + seed + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) < share * 2.0**64


def inputs_of(n: int, allowed: list[int] | None, tree: int, seed: int, split: int, share: float) -> np.ndarray:
    """The inputs that a tree gets."""
    own = np.array(allowed if allowed is not None else range(n), int)
    if not len(own):
        return own
    order = np.random.default_rng((seed, split, tree)).permutation(len(own))
    return np.sort(own[order[: max(1, round(share * len(own)))]])


def sums(bins: np.ndarray, node: np.ndarray, first: int, count: int, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(2, node, input, bin): gradients and curvatures of rows by the nodes of a level."""
    n, k = bins.shape
    place = ((node - first)[:, None] * k + np.arange(k)) * n_bins + bins
    total = count * k * n_bins
    return np.stack([np.bincount(place.ravel(), np.repeat(v, k), total) for v in (g, h)]).reshape(2, count, k, n_bins)


def best_cuts(found: np.ndarray, inputs: np.ndarray, p: Boost) -> list[tuple[int, int, float, float, float, float, float]]:
    """Of each node of a level: input (-1: none), last bin to the left, gain, sums of both sides."""
    out = []
    for g, h in zip(*found, strict=True):
        total_g, total_h = float(g[0].sum()), float(h[0].sum())
        left_g, left_h = g[inputs].cumsum(1)[:, :-1], h[inputs].cumsum(1)[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = p.strength(left_g, left_h) + p.strength(right_g, right_h) - p.strength(np.float64(total_g), np.float64(total_h))
        gain = np.where((left_h >= p.child) & (right_h >= p.child), gain, -np.inf)
        at = int(gain.argmax()) if gain.size else 0
        if not gain.size or gain.flat[at] <= LEAST:
            out.append((-1, 0, 0.0, total_g, total_h, 0.0, 0.0))
        else:
            i, b = divmod(at, gain.shape[1])
            out.append((int(inputs[i]), b, float(gain[i, b]), float(left_g[i, b]), float(left_h[i, b]), float(right_g[i, b]), float(right_h[i, b])))
    return out


def grow(tree: Tree, level: int, cuts: list[tuple], p: Boost) -> None:
    """Add the cuts of a level's nodes and the values of their children."""
    first = (1 << level) - 1
    for j, (own, cut, gain, lg, lh, rg, rh) in enumerate(cuts):
        i = first + j
        if level == 0:
            tree.value[0] = p.leaf(lg + rg, lh + rh)
        if level and tree.input[(i - 1) // 2] < 0 or own < 0:
            continue
        tree.input[i], tree.cut[i], tree.gain[i] = own, cut, gain
        tree.value[2 * i + 1], tree.value[2 * i + 2] = p.leaf(lg, lh), p.leaf(rg, rh)


def quantiles(rows: DataFrame, columns: list[str], bins: int) -> dict[int, np.ndarray]:
    """The cuts of each split's inputs, (inputs, bins - 1), from its `fit` rows: splits x inputs x bins numbers."""
    shares = F.array(*(F.lit((i + 1) / bins) for i in range(bins - 1)))
    found = rows.where("part = 'fit'").groupBy("split_id").agg(F.array(*(F.percentile(c, shares) for c in columns)).alias("cuts")).collect()
    return {r.split_id: np.array(r.cuts, float) for r in found}


def binned(rows: DataFrame, columns: list[str], cuts: dict[int, np.ndarray], seeds: int) -> DataFrame:
    """Rows with `bins`, a byte an input, and a margin of 0 for each seed, dealt by split and run of events."""
    keep = ["split_id", "event_pos", "part", "group_id", "ts", "y", "w", "ret"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", bins binary, margins array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for split, part in f.groupby("split_id"):
                if split not in cuts:
                    continue
                x = part[columns].to_numpy(float)
                placed = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts[split])], 1).astype(np.uint8)
                yield part[keep].assign(bins=[r.tobytes() for r in placed], margins=[[0.0] * seeds] * len(part))

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.select(*keep, *columns).repartition(tasks, "split_id", F.floor(F.col("event_pos") / CHUNK))
    return stored(dealt.mapInPandas(run, schema))


def _matrix(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(f["bins"]), np.uint8).reshape(len(f), -1), np.stack(f["margins"].to_numpy())


Key = tuple[int, int]


def _raised(rows: DataFrame, trees: dict[Key, list[Tree]], depth: int) -> DataFrame:
    """Rows with the trees' values added to their margins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for split, part in f.groupby("split_id"):
                bins, margins = _matrix(part)
                for seed in range(margins.shape[1]):
                    for t in trees.get((split, seed), ()):
                        margins[:, seed] += t.value[t.nodes(bins, depth)]
                yield part.assign(margins=list(margins))

    return rows.mapInPandas(run, rows.schema)


PARTS = "split_id int, seed int, sums binary, loss double, weight double"
CUTS = "split_id int, seed int, cuts array<array<double>>, loss double, weight double"


def _level(rows: DataFrame, since: dict[Key, list[Tree]], growing: dict[Key, Tree], level: int, number: int, allowed: dict[int, list[int]] | None, p: Boost) -> list:
    """One job: the best cuts of a level of all growing trees, and at the first level the loss of the `stop` rows."""
    first, count = (1 << level) - 1, 1 << level

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Key, list] = {}
        for f in frames:
            for split, part in f.groupby("split_id"):
                bins, margins = _matrix(part)
                y, w = part["y"].to_numpy(float), part["w"].to_numpy(float)
                fit, stop = (part["part"] == "fit").to_numpy(), (part["part"] == "stop").to_numpy()
                position = part["event_pos"].to_numpy()
                for seed in range(margins.shape[1]):
                    if (split, seed) not in growing:
                        continue
                    z = margins[:, seed].copy()
                    for t in since.get((split, seed), ()):
                        z += t.value[t.nodes(bins, p.depth)]
                    chance = 1 / (1 + np.exp(-z))
                    own = fit & drawn(position, number, seed, p.rows)
                    node = growing[split, seed].nodes(bins, level)
                    own &= node >= first
                    g, h = w * (chance - y), w * chance * (1 - chance)
                    found = sums(bins[own], node[own], first, count, g[own], h[own], p.bins)
                    loss = float((w * (np.logaddexp(0, z) - y * z))[stop].sum()) if level == 0 else 0.0
                    now = held.setdefault((split, seed), [0.0, 0.0, 0.0])
                    now[0], now[1], now[2] = now[0] + found, now[1] + loss, now[2] + float(w[stop].sum())
        if held:
            yield pd.DataFrame([(split, seed, found.tobytes(), loss, weight) for (split, seed), (found, loss, weight) in held.items()], columns=["split_id", "seed", "sums", "loss", "weight"])

    def cuts(f: pd.DataFrame) -> pd.DataFrame:  # a row a task
        split, seed = int(f["split_id"].iloc[0]), int(f["seed"].iloc[0])
        found = np.sum([np.frombuffer(x) for x in f["sums"]], axis=0).reshape(2, count, -1, p.bins)
        inputs = inputs_of(found.shape[2], None if allowed is None else allowed.get(split, []), number, seed, split, p.inputs)
        best = [list(map(float, c)) for c in best_cuts(found, inputs, p)]
        return pd.DataFrame({"split_id": [split], "seed": [seed], "cuts": [best], "loss": [f["loss"].sum()], "weight": [f["weight"].sum()]})

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.mapInPandas(parts, PARTS).repartition(tasks, "split_id", "seed").groupBy("split_id", "seed").applyInPandas(cuts, CUTS).collect()


def fit(rows: DataFrame, seeds: int = 1, p: Boost = Boost(), allowed: dict[int, list[int]] | None = None) -> dict[Key, list[Tree]]:
    """The trees of each split and seed for the rows of binned(), up to the one of the least loss of its `stop` rows; all trees
    where it has none. allowed: the inputs that the splits' trees may take."""
    keys = [(r[0], s) for r in rows.where("part = 'fit'").select("split_id").distinct().collect() for s in range(seeds)]
    trees: dict[Key, list[Tree]] = {k: [] for k in keys}
    best: dict[Key, tuple[float, int]] = {k: (np.inf, 0) for k in keys}
    judged = dict.fromkeys(keys, False)
    now, kept, living = rows, 0, set(keys)
    for number in range(p.trees + 1):  # one round more takes the loss of the last tree
        if number - kept == STORED:
            now, kept = stored(_raised(now, {k: trees[k][kept:] for k in keys}, p.depth)), number
        growing = {k: Tree(p.depth) for k in living}
        since = {k: trees[k][kept:] for k in living}
        for level in range(p.depth if number < p.trees else 1):
            for r in _level(now, since, growing, level, number, allowed, p):
                key = r.split_id, r.seed
                if level == 0 and number and r.weight > 0:
                    judged[key] = True
                    if r.loss / r.weight < best[key][0]:
                        best[key] = r.loss / r.weight, number
                    elif number - best[key][1] >= p.patience:
                        living.discard(key)
                        growing.pop(key)
                        continue
                grow(growing[key], level, [(int(c[0]), int(c[1]), *c[2:]) for c in r.cuts], p)
            if not living:
                break
        if number == p.trees or not living:
            break
        for k in living:
            growing[k].prune(p.gamma)
            trees[k].append(growing[k])
    return {k: own[: best[k][1]] if judged[k] else own for k, own in trees.items()}


def predict(rows: DataFrame, trees: dict[Key, list[Tree]], depth: int) -> DataFrame:
    """(split_id, seed, part, group_id, ts, y, ret, raw) of the calibrating and testing rows."""
    raised = _raised(rows.where("part IN ('calibrate', 'test')"), trees, depth)
    return raised.select("split_id", "part", "group_id", "ts", "y", "ret", F.posexplode("margins").alias("seed", "raw")).select("split_id", "seed", "part", "group_id", "ts", "y", "ret", "raw")
