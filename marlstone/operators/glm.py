"""Logistic models of many groups at once: Newton steps whose sums are taken by Spark, a job a step for all groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "g string, n long, sums array<double>"


def fit(rows: DataFrame, group: str, x: str, y: str, weight: str | None = None, c: float | Callable[[str], float] | None = 1.0, steps: int = 30, tolerance: float = 1e-8) -> dict[str, np.ndarray]:
    """The coefficients of each group, the intercept last: of C times the weighted log loss and half the squared norm of the
    coefficients (c = None: no penalty; a function gives each group its own). A group of one class has only an intercept, of its class.

    `rows` should be stored, as each step reads it. Tasks add up their rows by group; what reaches the driver is a row a group.
    """
    own = rows.select(F.col(group).cast("string").alias("g"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    beta: dict[str, np.ndarray] = {}
    done: set[str] = set()

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for f in frames:
            for g, part in f.groupby("g"):
                if g in done:
                    continue
                design = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))]).astype(float)
                y_, w = part["y"].to_numpy(float), part["w"].to_numpy(float)
                z = design @ beta.get(g, np.zeros(design.shape[1]))
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                slope = design.T @ (w * (p - y_))
                curve = (design * (w * p * (1 - p))[:, None]).T @ design
                loss = float((w * (np.logaddexp(0, z) - y_ * z)).sum())
                sums = np.concatenate([slope, curve.ravel(), [loss, (w * y_).sum(), w.sum()]])
                held[g] = held[g] + sums if g in held else sums
                counts[g] = counts.get(g, 0) + len(part)
        if held:
            yield pd.DataFrame({"g": list(held), "n": [counts[g] for g in held], "sums": [s.tolist() for s in held.values()]})

    def total(f: pd.DataFrame) -> pd.DataFrame:  # a row a task
        return pd.DataFrame({"g": [f["g"].iloc[0]], "n": [int(f["n"].sum())], "sums": [np.sum(np.stack(f["sums"].to_numpy()), axis=0).tolist()]})

    last: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    for _ in range(steps):
        found = own.mapInPandas(parts, PARTS).groupBy("g").applyInPandas(total, PARTS).collect()
        if not found:
            break
        for r in found:
            sums = np.array(r.sums)
            k = round((-1 + np.sqrt(1 + 4 * (len(sums) - 3))) / 2)
            slope, curve = sums[:k], sums[k : k + k * k].reshape(k, k)
            loss, ones, all_ = sums[-3:]
            if ones <= 0 or ones >= all_:
                beta[r.g] = np.append(np.zeros(k - 1), 30.0 if ones > 0 else -30.0)
                done.add(r.g)
                continue
            now = beta.setdefault(r.g, np.append(np.zeros(k - 1), 0.0))
            own_c = c(r.g) if callable(c) else c
            penalty = np.append(np.full(k - 1, 1 / own_c if own_c else 1e-10), 0.0)
            value = loss + 0.5 * float(penalty @ now**2)
            if r.g in last and value > last[r.g][0] + 1e-9 * abs(last[r.g][0]):
                beta[r.g] = (now + last[r.g][1]) / 2  # half the step
                continue
            move = np.linalg.lstsq(curve + np.diag(penalty) + 1e-12 * np.eye(k), slope + penalty * now, rcond=None)[0]
            last[r.g] = value, now, move
            beta[r.g] = now - move
            if np.abs(move).max() < tolerance:
                done.add(r.g)
        if all(r.g in done for r in found):  # `found` lacks the groups that were done before
            break
    return beta


def margin(df: DataFrame, group: str, x: str, beta: dict[str, np.ndarray], name: str = "raw") -> DataFrame:
    """`df` with the margin of each row by its group's coefficients, which are broadcast: a row a group."""
    spark = df.sparkSession
    table = spark.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], "_g string, _beta array<double>")
    joined = df.join(F.broadcast(table), F.col(group).cast("string") == F.col("_g"))
    products = F.zip_with(x, F.slice("_beta", F.lit(1), F.size("_beta") - 1), lambda a, b: a * b)
    value = F.aggregate(products, F.element_at("_beta", -1), lambda s, v: s + v)
    return joined.withColumn(name, value).drop("_g", "_beta")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
