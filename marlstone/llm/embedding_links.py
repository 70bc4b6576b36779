"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Equal vectors of a label are one node. Every node is rotated by seeded random orthogonal matrices; the signs are its code, and
the inner product of the first rotation's code and the vector is its correction factor. Both are computed once and stored with
the node.
1. Bands of code bits deal the nodes of a label into buckets. Their number and width follow from the number of rows: narrow
   enough that buckets stay small, and as many as make the chance that a pair at the threshold meets in none at most MISS.
2. In a bucket, the share of differing bits estimates the angle of a pair; pairs whose confidence bound reaches the threshold
   are candidates, and stars over them leave the task: rows in the size of a group, not in its pairs. Large buckets are dealt in
   blocks of bounded size.
3. In the candidates' components, in blocks of bounded size, each node's stored code and factor give an unbiased estimate of
   its inner products, in single precision; only where the estimate and its confidence bound reach the threshold is the
   cosine computed again from the whole vectors, in double precision.
Links have an exact cosine of at least the threshold; they are counted and their components give the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing and are kept; vectors of different lengths never link; rows of one id are nodes by their vectors; equal rows
share a component; an empty table gives no rows; other columns are never read. Long vectors cost memory in the square of their
length, for the rotation.
"""

from __future__ import annotations

from functools import cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import table, written
from marlstone.llm.jaccard_join import LINKS, VERIFIED, _arrow
from marlstone.llm.linking import blocked, components, dealt, map_runs, runs_of, star, with_row

COSINE = 0.98
#: Chance that a pair at the threshold shares no bucket, and the standard deviations that both confidence bounds allow.
MISS, SIGMAS = 1e-6, 6.0
#: Nodes that a bucket of unrelated vectors should hold about.
BUCKET, SEED = 64, 17
#: Code bits that travel with a bucket's rows; with more the bounds are tighter, not the result another.
FILTER_BITS = 512


@cache
def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, size, number)).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def bands(nodes: int, cosine: float = COSINE) -> tuple[int, int]:
    """The number of bands and their width in bits for so many nodes."""
    width = max(4, ceil(log2(max(2, nodes) / BUCKET)))
    same = (1 - acos(cosine) / pi) ** width
    return ceil(log(MISS) / log(1 - same)), width


def signs(unit: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` signs of as many rotations as are needed."""
    n, size = unit.shape
    return np.concatenate([unit @ rotation(size, i).T > 0 for i in range(-(-bits // size))], axis=1)[:, :bits]


def _packed(found: np.ndarray) -> np.ndarray:
    out = np.packbits(found, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8)))


def _unit(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), np.float64).reshape(-1, size)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


CODED = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType())])


def coded(nodes: DataFrame, bits: int) -> DataFrame:
    """`nodes` with the code of each, at least `bits` and as many bits as the vector is long, and its correction factor."""
    schema = T.StructType([*nodes.schema, *CODED])
    target = _arrow(schema)

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            for own in np.unique(size).tolist():
                part = batch.filter(pa.array(size == own))
                unit = _unit(part.column("embedding"), own)
                factor = np.abs(unit @ rotation(own, 0).T).sum(1) / sqrt(own)
                code = pa.array([row.tobytes() for row in _packed(signs(unit, max(bits, own)))], pa.binary())
                columns = [part.column(f.name).cast(f.type) for f in list(target)[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, code, pa.array(factor)], schema=target)

    return nodes.mapInArrow(run, schema)


def _bits(column: pa.ChunkedArray | pa.Array, start: int, stop: int) -> np.ndarray:
    """The bits start to stop of codes of one length."""
    codes = column.to_pylist()
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed[:, start // 8 : -(-stop // 8)], axis=1)[:, start % 8 : start % 8 + stop - start]


BUCKETED = T.StructType([T.StructField("place", T.LongType()), T.StructField("node", T.LongType()), T.StructField("code", T.BinaryType())])


def bucketed(nodes: DataFrame, n_bands: int, width: int) -> DataFrame:
    """A row for each coded node and band: the bucket's key, from label, length, band and bits, and the first FILTER_BITS bits."""
    target = _arrow(BUCKETED)
    held = -(-min(n_bands * width, FILTER_BITS) // 64) * 8
    weights = (1 << np.arange(width)).astype(np.int64)

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            for own in np.unique(size).tolist():
                part = batch.filter(pa.array(size == own))
                label = part.column("home").to_numpy()
                code = pa.array([c[:held] for c in part.column("code").to_pylist()], pa.binary())
                for k in range(n_bands):
                    key = _bits(part.column("code"), k * width, (k + 1) * width) @ weights
                    place = pa.array(_mixed(label, own, k, key))
                    yield pa.RecordBatch.from_arrays([place, part.column("node"), code], schema=target)

    return nodes.select("node", "size", F.xxhash64("label").alias("home"), "code").mapInArrow(run, BUCKETED)


def _mixed(label: np.ndarray, size: int, band: int, key: np.ndarray) -> np.ndarray:
    from marlstone.llm.words import mix

    return mix(mix(label.view(np.uint64) + np.uint64(size * 4096 + band)) ^ key.astype(np.uint64)).view(np.int64)


def candidates(found: DataFrame, bits: int, cosine: float) -> DataFrame:
    """Stars over the nodes of a bucket that may link, by the number of differing bits among their first `bits`."""
    target = _arrow(LINKS)
    p = acos(cosine) / pi
    most = bits * p + SIGMAS * sqrt(bits * p * (1 - p))
    block = ["place", "left", "right"]

    def step(run: pa.Table) -> pa.RecordBatch | None:
        node, side = run.column("node").to_numpy(), run.column("side").to_numpy()
        whole = run.column("left").to_numpy() == run.column("right").to_numpy()
        place = runs_of(run, block)
        code = np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint64).reshape(len(node), -1)
        last = -(-bits // 64) * 64 - bits
        if last:  # the bits behind the last are padding or of another rotation
            code = code.copy()
            code[:, -1] &= np.frombuffer(np.packbits(np.arange(64) < 64 - last).tobytes(), np.uint64)[0]
        a, b = [], []
        here = np.arange(len(node))
        for off in range(1, len(node)):
            here = here[here < len(node) - off]
            here = here[place[here] == place[here + off]]
            if not len(here):
                break
            far = here + off
            ok = np.bitwise_count(code[here] ^ code[far]).sum(1, dtype=np.int64) <= most
            ok &= whole[here] | (side[here] != side[far])
            a.append(node[here[ok]]), b.append(node[far[ok]])
            if len(a) > 256:
                a, b = ([v] for v in star(np.concatenate(a), np.concatenate(b)))
        if not a:
            return None
        low, high = star(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], schema=target)

    return map_runs(dealt(written(found, "buckets"), "place", "node"), block, step, LINKS, rows=8192)


def verified(meeting: DataFrame, cosine: float) -> DataFrame:
    """Of blocks of nodes with their vectors: the root of each node's star and its links in the block."""
    target = _arrow(VERIFIED)
    block = ["root", "left", "right"]

    def step(run: pa.Table) -> pa.RecordBatch | None:
        groups = runs_of(run, block)
        low, high, at, counts = [], [], [], []
        for g in range(int(groups[-1]) + 1 if len(groups) else 0):
            own = run.filter(pa.array(groups == g))
            node, side, copies = (own.column(c).to_numpy() for c in ("node", "side", "copies"))
            size = own.column("size")[0].as_py()
            unit = _unit(own.column("embedding"), size)
            code, factor = _bits(own.column("code"), 0, size), own.column("factor").to_numpy()
            x, y = _near(unit, code, factor, side, own.column("left")[0].as_py() != own.column("right")[0].as_py(), cosine)
            if not len(x):
                continue
            a, b = star(node[x], node[y])
            links = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
            linked = np.flatnonzero(links)
            low.append(a), high.append(b), at.append(node[linked]), counts.append(links[linked].astype(np.int64))
        if not low:
            return None
        a, b, at, counts = map(np.concatenate, (low, high, at, counts))
        links = np.concatenate([np.zeros(len(a), np.int64), counts])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, at])), pa.array(np.concatenate([b, at])), pa.array(links)], schema=target)

    return map_runs(meeting, block, step, VERIFIED, rows=1024)


def _near(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, side: np.ndarray, cross: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link, x before y; the code and factor of x estimate, the whole vectors decide."""
    size = unit.shape[1]
    turned = (unit @ rotation(size, 0).T).astype(np.float32).T
    # an estimate is the code's inner product with the other vector over the code's with its own; the bound allows for single precision
    scaled = ((2.0 * code - 1) / (sqrt(size) * factor[:, None])).astype(np.float32)
    bound = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / sqrt(max(1, size - 1)) + 1e-4
    xs, ys = [], []
    for s in range(0, len(unit), 512):
        x, y = np.nonzero(scaled[s : s + 512] @ turned >= (cosine - bound[s : s + 512, None]))
        x += s
        ok = (x < y) & ((side[x] != side[y]) if cross else True)
        x, y = x[ok], y[ok]
        exact = np.einsum("ij,ij->i", unit[x], unit[y])
        xs.append(x[exact >= cosine]), ys.append(y[exact >= cosine])
    return np.concatenate(xs), np.concatenate(ys)


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, label, embedding)."""
    values = F.col("embedding").cast("array<double>")
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    sound = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    rows = vectors.select("vec_id", "label", values.alias("embedding"), sound.alias("sound"))
    rows = rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("label", "embedding")))
    nodes = rows.where("sound").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies")
    )
    total = rows.count()
    n_bands, width = bands(total, cosine)
    nodes = written(coded(nodes.withColumn("size", F.size("embedding")), n_bands * width), "vectors")
    maybe = components(candidates(bucketed(nodes, n_bands, width), min(n_bands * width, FILTER_BITS), cosine), "near")
    meeting = blocked(nodes.select("node", "size", "embedding", "copies", "code", "factor").join(maybe, "node"))
    found = written(verified(meeting, cosine), "cosines")
    linked = components(found.where("a <> b").select("a", "b"), "linked")
    degree = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = nodes.select("node", "least", "copies").join(linked, "node", "left").join(degree, "node", "left")
    nodes = nodes.select("node", "least", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    nodes = written(nodes, "nodes")
    best = written(nodes.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("size")), "best")
    nodes = written(with_row(nodes, best, "root", "size", total).select("node", "best", "n_links", "copies"), "found")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    full = with_row(rows.where("sound").select("vec_id", "node"), nodes, "node", "copies", total).select("vec_id", "n_links", F.col("best").alias("component_id"))
    return full.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
