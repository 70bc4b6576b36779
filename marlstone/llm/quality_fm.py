"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

A text's features are its words, hashed to 2**BITS buckets with damped counts of unit length, statistics of its structure
(shares of symbols, capitals, digits, repeats and so on) and its size, each cut into bins that are features of their own.
The score adds linear weights and low-rank interactions of all pairs of features in linear time: for each factor, half of
the square of the sum less the sum of squares.

The model learns from a bounded sample: TRAIN_ROWS labelled rows outside the held-out fold in order of a hash of the id,
of texts up to TRAIN_CHARS characters, each read whole.

Defined results: null and empty texts have the features of no text and get that score; with no row to learn from all scores
are 0.5; equal texts get equal scores; columns other than the id, the text and, for training, the label are never read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, held_out, map_texts, sampled, table
from marlstone.llm.words import windows, words_of

TRAIN_ROWS, TRAIN_CHARS = 4000, 40_000
BITS, FACTORS, BINS = 14, 8, 10
#: At least EPOCHS passes, and as many as make STEPS rows seen; rows a step; rate; weight decay.
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 36_000, 32, 0.05, 1e-5

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "symbols": b"#*$%&<>~^=+_@\\{}[]",
    "bars": b"|",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "stops": b".,;:?",
    "bangs": b"!",
    "lines": b"\n",
}
_RATIOS = (*CLASSES, "far", "repeated", "doubled", "distinct", "length")
N_FEATURES = (1 << BITS) + (len(_RATIOS) + 1) * BINS


def _bins(share: np.ndarray) -> np.ndarray:
    """Bins of shares: zero, then powers of two up from 1/256."""
    return np.clip(np.ceil(np.log2(np.maximum(share, 1e-9) * 256)) + 1, 0, BINS - 1).astype(np.int64) * (share > 0)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: the text, feature and value of each entry, in order of texts."""
    n = len(texts)
    data, starts, ends, doc, ids = words_of(texts)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, n)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    n_words = np.bincount(doc, minlength=n)
    chars = np.maximum(1, sizes)
    stats = {}
    for name, members in CLASSES.items():
        mask = np.zeros(256, np.uint8)
        mask[list(members)] = 1
        found = np.add.reduceat(mask[data], offsets, dtype=np.int64) - (name == "lines")  # but for the joint after each text
        stats[name] = found / chars
    stats["far"] = np.add.reduceat((data >= 0xC3).astype(np.uint8), offsets, dtype=np.int64) / chars
    some = np.maximum(1, n_words)
    run, at = windows(ids, doc, 5)
    stats["repeated"] = _repeats(run, doc[at], n) / some
    stats["doubled"] = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / some
    stats["distinct"] = 1 - _repeats(ids, doc, n) / some
    stats["length"] = np.bincount(doc, ends - starts, minlength=n) / some / 32
    key, count = np.unique((doc << BITS) | (ids >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row, bucket, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(count)
    value /= np.sqrt(np.maximum(1e-9, np.bincount(row, value * value, minlength=n)))[row]
    rows, cols, values = [row], [bucket], [value]
    for i, name in enumerate((*_RATIOS, "size")):
        cut = np.minimum(BINS - 1, np.log2(1 + n_words) / 1.5).astype(np.int64) if name == "size" else _bins(stats[name])
        rows.append(np.arange(n)), cols.append((1 << BITS) + i * BINS + cut), values.append(np.full(n, 0.5))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], values[order]


def _repeats(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many of its ids are equal to an earlier one."""
    order = np.lexsort((ids, doc))
    again = (ids[order][1:] == ids[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=n)


class Machine:
    """Bias, linear weights and factors."""

    def __init__(self, seed: int = 3) -> None:
        self.bias = 0.0
        self.linear = np.zeros(N_FEATURES)
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (N_FEATURES, FACTORS))

    def score(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factors' sums, of n texts."""
        out = self.bias + np.bincount(rows, self.linear[cols] * values, minlength=n)
        sums = np.empty((n, FACTORS))
        for f in range(FACTORS):
            part = self.factors[cols, f] * values
            sums[:, f] = np.bincount(rows, part, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(rows, part * part, minlength=n))
        return out, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: list[int], seed: int = 3) -> Machine | None:
    """A machine fitted by adaptive gradient steps on the log loss."""
    if not texts:
        return None
    y = np.array(labels, float)
    machine, random = Machine(seed), np.random.default_rng(seed)
    base = np.clip(y.mean(), 0.02, 0.98)
    machine.bias = float(np.log(base / (1 - base)))
    rows, cols, values = [], [], []
    for i in range(0, len(texts), 256):
        r, c, v = features(texts[i : i + 256])
        rows.append(r + i), cols.append(c), values.append(v)
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    squares = [np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, FACTORS), 1e-3)]
    for _ in range(max(EPOCHS, STEPS // len(texts))):
        order = random.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            at = np.concatenate([np.arange(bounds[j], bounds[j + 1]) for j in own])
            row = np.repeat(np.arange(len(own)), bounds[own + 1] - bounds[own])
            col, val = cols[at], values[at]
            raw, sums = machine.score(row, col, val, len(own))
            error = (sigmoid(raw) - y[own]) / len(own)
            used, where = np.unique(col, return_inverse=True)
            step = error[row] * val
            g = np.bincount(where, step, minlength=len(used)) + DECAY * machine.linear[used]
            squares[0][used] += g * g
            machine.linear[used] -= RATE * g / np.sqrt(squares[0][used])
            for f in range(FACTORS):
                v = machine.factors[used, f]
                g = np.bincount(where, step * (sums[row, f] - v[where] * val), minlength=len(used)) + DECAY * v
                squares[1][used, f] += g * g
                machine.factors[used, f] -= 0.5 * RATE * g / np.sqrt(squares[1][used, f])
            machine.bias -= RATE * float(error.sum())
    return machine


SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def scorer(machine: Machine | None, threshold: float) -> Callable[[list[bytes | None]], dict]:
    def step(texts: list[bytes | None]) -> dict:
        if machine is None:
            score = np.full(len(texts), 0.5)
        else:
            score = sigmoid(machine.score(*features(texts), len(texts))[0])
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return step


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> DataFrame:
    """(text, _label) of a bounded sample outside the held-out fold, in one partition.

    The sample is drawn from the labels, in order of a hash of the id, so only `rows` ids meet the texts: a join whose
    broadcast side is bounded by that number. A row labelled twice counts twice.
    """
    ids = labels.where(~held_out() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("_label"))
    ids = sampled(ids, rows)
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
    return found.select("text", "_label").orderBy(F.xxhash64("text"), "text", "_label").limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> tuple[list[bytes], list[int]]:
    """The texts and labels of labelled_rows."""
    own = labelled_rows(docs, labels, label, rows, chars).collect()
    return [r.text.encode() for r in own], [int(r._label) for r in own]


def score(docs: DataFrame, keep: list[str], machine: Machine | None, threshold: float = 0.5) -> DataFrame:
    """`keep`, the score of each text and whether it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # N_FEATURES rows, whatever the corpus
    return map_texts(docs, keep, lambda: scorer(shared.value, threshold), SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    machine = train(*labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAIN_ROWS, TRAIN_CHARS))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), ["doc_id", "held_out"], machine, threshold=0.3)
