"""Two-layer networks of B-spline edges for many groups and seeds at once.

An edge is a weight on silu and a spline of degree `order` over a uniform grid on [-1, 1]; inputs are brought there by tanh of their
standard scores over the group's training rows. Each epoch is one job: tasks sum loss and gradients of their rows by (group, seed),
Spark adds up the tasks' sums, and the driver, which keeps some numbers an edge, takes a step of Adam for all groups. Groups stop
each on their own, by the loss of their `stop` rows, which the same job sums. On the way grids can be made finer: the new
spline is the least-squares fit of the old one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.store import stored

#: Rows of a group that lie together, and rows whose splines are held at a time.
CHUNK, BLOCK = 100_000, 4096
Key = tuple[int, int]


@dataclass(frozen=True)
class Net:
    """Parameters: hidden nodes, intervals of the grid and degree of splines, step size at the start (it falls by a cosine), epochs,
    epochs without a lower loss before a group stops, decay of weights, smoothing of labels, largest norm of a gradient, weight of the
    absolute coefficients, and (epoch, intervals) of finer grids."""

    hidden: int = 5
    grid: int = 5
    order: int = 3
    rate: float = 0.02
    epochs: int = 200
    patience: int = 20
    decay: float = 1e-4
    smoothing: float = 0.1
    clip: float = 1.0
    sparsity: float = 1e-4
    finer: tuple[tuple[int, int], ...] = ()


def basis(x: np.ndarray, grid: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid + order splines at x and their slopes, on a new last axis; zero off the knots."""
    h = 2 / grid
    knots = -1 + h * np.arange(-order, grid + order + 1)
    x = np.asarray(x, float)[..., None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    slope = np.zeros_like(b)
    for k in range(1, order + 1):
        if k == order:
            slope = (b[..., :-1] - b[..., 1:]) / h
        b = ((x - knots[: -k - 1]) * b[..., :-1] + (knots[k + 1 :] - x) * b[..., 1:]) / (k * h)
    return b, slope


def design(x: np.ndarray, grid: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """What each edge's weights multiply, silu first, and its slope: (rows, inputs, 1 + grid + order)."""
    b, slope = basis(x, grid, order)
    s = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    return np.concatenate([(x * s)[..., None], b], -1), np.concatenate([(s * (1 + x * (1 - s)))[..., None], slope], -1)


@dataclass
class Weights:
    """(inputs, 1 + grid + order, outputs) of both layers, the outputs of the second being the falling and the rising class."""

    grid: int
    first: np.ndarray
    second: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first.ravel(), self.second.ravel()])

    def moved(self, flat: np.ndarray) -> Weights:
        n = self.first.size
        return Weights(self.grid, flat[:n].reshape(self.first.shape), flat[n:].reshape(self.second.shape))

    def splines(self) -> np.ndarray:
        """Which of the flat weights are coefficients of splines."""
        return np.concatenate([np.broadcast_to((np.arange(w.shape[1]) > 0)[None, :, None], w.shape).ravel() for w in (self.first, self.second)])


def start(inputs: int, p: Net, split: int, seed: int) -> Weights:
    rng = np.random.default_rng((seed, split, 77))

    def layer(n: int, out: int) -> np.ndarray:
        w = rng.normal(0, 0.1 / p.grid, (n, 1 + p.grid + p.order, out))
        w[:, 0] = rng.uniform(-1, 1, (n, out)) / np.sqrt(n)
        return w

    return Weights(p.grid, layer(inputs, p.hidden), layer(p.hidden, 2))


def _through(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    return d.reshape(len(d), w.shape[0] * w.shape[1]) @ w.reshape(-1, w.shape[2])


def margin(w: Weights, x: np.ndarray, order: int) -> np.ndarray:
    """The rising class's output less the falling one's."""
    out = [np.zeros(0)]
    for at in range(0, len(x), BLOCK):
        hidden = _through(design(x[at : at + BLOCK], w.grid, order)[0], w.first)
        z = _through(design(hidden, w.grid, order)[0], w.second)
        out.append(z[:, 1] - z[:, 0])
    return np.concatenate(out)


def slopes(w: Weights, x: np.ndarray, y: np.ndarray, weight: np.ndarray, p: Net) -> tuple[float, np.ndarray]:
    """Weighted log loss with smoothed labels, summed, and its gradient by the flat weights."""
    loss, first, second = 0.0, np.zeros_like(w.first), np.zeros_like(w.second)
    for at in range(0, len(x), BLOCK):
        own = slice(at, at + BLOCK)
        d1, _ = design(x[own], w.grid, p.order)
        hidden = _through(d1, w.first)
        d2, s2 = design(hidden, w.grid, p.order)
        z = _through(d2, w.second)
        m, target = z[:, 1] - z[:, 0], y[own] * (1 - p.smoothing) + p.smoothing / 2
        loss += float((weight[own] * (np.logaddexp(0, m) - target * m)).sum())
        g = weight[own] * (1 / (1 + np.exp(-np.clip(m, -500, 500))) - target)
        out = np.stack([-g, g], 1)
        second += (d2.reshape(len(g), -1).T @ out).reshape(second.shape)
        back = np.einsum("njm,jmo,no->nj", s2, w.second, out, optimize=True)
        first += (d1.reshape(len(g), -1).T @ back).reshape(first.shape)
    return loss, np.concatenate([first.ravel(), second.ravel()])


def finer(w: Weights, grid: int, order: int) -> Weights:
    """The same functions, as near as least squares on [-1, 1] bring them, over a grid of so many intervals."""
    u = np.linspace(-1, 1, 40 * max(grid, w.grid), endpoint=False)
    old, new = basis(u, w.grid, order)[0], basis(u, grid, order)[0]
    turn = np.linalg.lstsq(new, old, rcond=None)[0]  # (new coefficients, old ones)

    def layer(a: np.ndarray) -> np.ndarray:
        return np.concatenate([a[:, :1], np.einsum("ko,iom->ikm", turn, a[:, 1:])], 1)

    return Weights(grid, layer(w.first), layer(w.second))


@dataclass
class _Run:
    """A group's weights on the way: moments of Adam since the last change of grid, the best so far and its loss and epoch."""

    now: Weights
    one: np.ndarray
    two: np.ndarray
    steps: int = 0
    best: Weights | None = None
    loss: float = np.inf
    epoch: int = 0

    @classmethod
    def of(cls, w: Weights) -> _Run:
        n = len(w.flat())
        return cls(w, np.zeros(n), np.zeros(n))

    def regrid(self, grid: int, order: int) -> None:
        self.now = finer(self.now, grid, order)
        n = len(self.now.flat())
        self.one, self.two, self.steps = np.zeros(n), np.zeros(n), 0

    def step(self, gradient: np.ndarray, epoch: int, p: Net) -> None:
        """One step of Adam with decoupled decay."""
        flat = self.now.flat()
        g = gradient + p.sparsity * np.sign(flat) * self.now.splines()
        g *= min(1.0, p.clip / (float(np.linalg.norm(g)) + 1e-12))
        self.steps += 1
        self.one, self.two = 0.9 * self.one + 0.1 * g, 0.999 * self.two + 0.001 * g * g
        rate = p.rate * (1 + np.cos(np.pi * epoch / p.epochs)) / 2
        move = self.one / (1 - 0.9**self.steps) / (np.sqrt(self.two / (1 - 0.999**self.steps)) + 1e-8)
        self.now = self.now.moved(flat - rate * (move + p.decay * flat))


def ready(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with `x`, the inputs brought to (-1, 1) as bytes, and `weight`, the sample weight times the balance of its class; dealt
    by split and run of events. A constant input is zero."""
    own = rows.where("part = 'fit'").groupBy("split_id").agg(
        F.count("*").alias("_t"), F.sum("y").alias("_o"), F.array(*(F.avg(c) for c in columns)).alias("_m"), F.array(*(F.coalesce(F.stddev(c), F.lit(0.0)) for c in columns)).alias("_s")
    )
    keep = ["split_id", "event_pos", "part", "group_id", "ts", "y", "ret"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", weight double, x binary"
    balance = F.col("_t") / (2 * F.greatest(F.when(F.col("y") == 1, F.col("_o")).otherwise(F.col("_t") - F.col("_o")), F.lit(1)))
    scores = F.zip_with(F.zip_with(F.array(*(F.col(c).cast("double") for c in columns)), "_m", lambda a, b: a - b), "_s", lambda a, s: F.tanh(a / (s + 1e-8)))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.join(F.broadcast(own), "split_id").select(*keep, (F.col("w") * balance).alias("weight"), scores.alias("x"))  # own: a row a split
    dealt = dealt.repartition(tasks, "split_id", F.floor(F.col("event_pos") / CHUNK))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(x=[np.asarray(v, float).tobytes() for v in f["x"]])

    return stored(dealt.mapInPandas(run, schema))


def _matrix(f: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(f["x"])).reshape(len(f), -1)


PARTS = "split_id int, seed int, sums binary, loss double, weight double, stop double, held double"


def _epoch(rows: DataFrame, nets: dict[Key, Weights], p: Net) -> list:
    """One job: of each group and seed the gradient, loss and weight of its `fit` rows, loss and weight of its `stop` rows."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Key, np.ndarray] = {}
        for f in frames:
            for split, part in f.groupby("split_id"):
                x, y, w = _matrix(part), part["y"].to_numpy(float), part["weight"].to_numpy(float)
                fit, stop = (part["part"] == "fit").to_numpy(), (part["part"] == "stop").to_numpy()
                for (own, seed), net in nets.items():
                    if own != split:
                        continue
                    loss, g = slopes(net, x[fit], y[fit], w[fit], p)
                    m, target = margin(net, x[stop], p.order), y[stop] * (1 - p.smoothing) + p.smoothing / 2
                    late = float((w[stop] * (np.logaddexp(0, m) - target * m)).sum())
                    sums = np.concatenate([g, [loss, w[fit].sum(), late, w[stop].sum()]])
                    held[own, seed] = held[own, seed] + sums if (own, seed) in held else sums
        if held:
            yield pd.DataFrame([(*k, s[:-4].tobytes(), *map(float, s[-4:])) for k, s in held.items()], columns=["split_id", "seed", "sums", "loss", "weight", "stop", "held"])

    def total(f: pd.DataFrame) -> pd.DataFrame:  # a row a task
        g = np.sum([np.frombuffer(s) for s in f["sums"]], axis=0)
        return pd.DataFrame({"split_id": f["split_id"].iloc[:1].to_list(), "seed": f["seed"].iloc[:1].to_list(), "sums": [g.tobytes()], **{c: [f[c].sum()] for c in ("loss", "weight", "stop", "held")}})

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.mapInPandas(parts, PARTS).repartition(tasks, "split_id", "seed").groupBy("split_id", "seed").applyInPandas(total, PARTS).collect()


def fit(rows: DataFrame, seeds: int = 1, p: Net = Net()) -> dict[Key, Weights]:
    """The network of each split and seed for the rows of ready(), that of the least loss of its `stop` rows; the last where it has
    none."""
    sizes = rows.where("part = 'fit'").groupBy("split_id").agg(F.first(F.length("x")).alias("n")).collect()
    runs = {(r.split_id, s): _Run.of(start(r.n // 8, p, r.split_id, s)) for r in sizes for s in range(seeds)}
    living, grids = set(runs), dict(p.finer)
    for epoch in range(p.epochs + 1):  # one round more takes the loss of the last step
        if epoch in grids:
            for k in living:
                runs[k].regrid(grids[epoch], p.order)
        for r in _epoch(rows, {k: runs[k].now for k in living}, p):
            own = runs[r.split_id, r.seed]
            if r.held > 0 and r.stop / r.held < own.loss:
                own.best, own.loss, own.epoch = own.now, r.stop / r.held, epoch
            elif r.held > 0 and epoch - own.epoch >= p.patience:
                living.discard((r.split_id, r.seed))
                continue
            if epoch < p.epochs and r.weight > 0:
                own.step(np.frombuffer(r.sums) / r.weight, epoch, p)
        if not living:
            break
    return {k: own.best or own.now for k, own in runs.items()}


def predict(rows: DataFrame, nets: dict[Key, Weights], order: int = 3) -> DataFrame:
    """(split_id, seed, part, group_id, ts, y, ret, raw) of the calibrating and testing rows."""
    own = rows.where("part IN ('calibrate', 'test')").select("split_id", "part", "group_id", "ts", "y", "ret", "x")
    seeds = 1 + max((s for _, s in nets), default=-1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "x") + ", margins array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for split, part in f.groupby("split_id"):
                x = _matrix(part)
                found = np.stack([margin(nets[split, s], x, order) for s in range(seeds)], 1)
                yield part.drop(columns="x").assign(margins=list(found))

    raised = own.mapInPandas(run, schema)
    return raised.select("split_id", "part", "group_id", "ts", "y", "ret", F.posexplode("margins").alias("seed", "raw")).select("split_id", "seed", "part", "group_id", "ts", "y", "ret", "raw")
