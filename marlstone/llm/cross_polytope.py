"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Equal vectors are one node, which keeps its NEAREST + 1 smallest ids: no other copy can be among the nearest of a query.
1. In each of TABLES tables, fast Hadamard pseudo-rotations (three rounds of random signs and a Hadamard transform) turn a unit
   vector, and the signed axis nearest to it is its hash; `parts` of them together are its bucket.
2. A query probes buckets in order of how much farther from it their axes are than its own. How many parts and probes there
   are is fitted once: SAMPLE queries, drawn by a hash, are searched by brute force against all rows, and the fewest probes
   are taken that find the share RECALL of their neighbours. With one part, all 2 d buckets are the whole table, so there always
   are enough. More parts, for larger tables, are tried first.
3. Nodes and probing queries of a bucket meet in blocks of bounded size. A block scores its queries against its nodes in double
   precision and passes on the best of each query; the best of all blocks and tables are the result. A query that finds fewer
   than NEAREST + 1 nodes is searched again against all rows, in blocks.
Every row is indexed; no bucket, block or list of candidates is cut but by exact score.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows of null vec_id, take no part;
vectors meet those of their own length only, and a query alone there has no result; equal rows (id and vector) are one; rows of
one id with different vectors are candidates each and, as queries, each give results under their id; ties go to the smaller
vec_id; an empty table gives no rows; other columns are never read. Nodes are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.llm.common import bound_batches, fields, table, written
from marlstone.llm.linking import LONG_RUNS, map_runs, runs_of, with_row
from marlstone.llm.words import mix

NEAREST, EVERY = 5, 50
TABLES, SEED = 2, 29
#: Queries that the number of probes is fitted on, and the share of their neighbours that it must find.
SAMPLE, RECALL = 256, 0.97
#: Nodes that a bucket should hold about, when the number of parts is chosen.
BUCKET = 512
#: Nodes and queries that a block holds at most, but in tables of more than LONG_RUNS such blocks.
NODE_BLOCK, QUERY_BLOCK = 8192, 2048


@cache
def _signs(size: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, size, number)).choice([-1.0, 1.0], (3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n steps; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of that number, of rows padded to a power of two."""
    size = 1 << (unit.shape[1] - 1).bit_length()
    x = np.pad(unit, ((0, 0), (0, size - unit.shape[1])))
    for sign in _signs(size, number):
        x = hadamard(x * sign)
    return x


def axes(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis: twice its number, and one more if its sign is positive."""
    at = np.abs(turned).argmax(1)
    return 2 * at + (turned[np.arange(len(at)), at] > 0)


def buckets(unit: np.ndarray, at: int, parts: int) -> np.ndarray:
    """The bucket of each row in a table."""
    out = np.zeros(len(unit), np.uint64)
    for part in range(parts):
        turned = rotated(unit, at * 16 + part)
        out = out * np.uint64(2 * turned.shape[1]) + axes(turned).astype(np.uint64)
    return out


def probed(unit: np.ndarray, at: int, parts: int, probes: int) -> np.ndarray:
    """The buckets that each row probes in a table, nearest first, at most `probes`: those of the least sum of squared gaps
    between the projections on their axes and the largest."""
    found, cost = np.zeros((len(unit), 1), np.uint64), np.zeros((len(unit), 1))
    for part in range(parts):
        turned = rotated(unit, at * 16 + part)
        both = np.stack([-turned, turned], 2).reshape(len(turned), -1)
        gaps = (both.max(1, keepdims=True) - both) ** 2
        axis = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
        gaps = np.take_along_axis(gaps, axis, 1)
        cost = (cost[:, :, None] + gaps[:, None, :]).reshape(len(unit), -1)
        found = (found[:, :, None] * np.uint64(both.shape[1]) + axis[:, None, :].astype(np.uint64)).reshape(len(unit), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        cost, found = np.take_along_axis(cost, order, 1), np.take_along_axis(found, order, 1)
    return found


def unit_rows(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), np.float64).reshape(-1, size)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares of very large or small components stay in range
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = batch.column("size").to_numpy()
    for own in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == own))
        for s in range(0, part.num_rows, 512):
            rows = part.slice(s, 512)
            yield own, rows, unit_rows(rows.column("embedding"), own)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, size, embedding) of the rows that take part; key tells vectors apart."""
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    values = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    ok = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    key = F.concat(F.hex(F.xxhash64(values)), F.lit("."), F.hex(F.xxhash64(F.lit(1), values)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), F.size(values).alias("size"), values.alias("embedding"))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(node, key, size, embedding, ids): distinct vectors with their `keep` smallest ids. Ranks are limited before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    least = rows.withColumn("_k", rank).where(F.col("_k") <= keep)
    ids = F.array_sort(F.collect_set("vec_id")).alias("ids")
    return least.groupBy("key").agg(F.first("size").alias("size"), F.first("embedding").alias("embedding"), ids).withColumn("node", F.monotonically_increasing_id())


class Sampled:
    """Sample queries of one vector length: their unit vectors, their nearest nodes' (a unit vector each), and whose those are."""

    def __init__(self, queries: np.ndarray, near: np.ndarray, of: np.ndarray) -> None:
        self.queries, self.near, self.of = queries, near, of

    def probes(self, parts: int, most: int, tables: int, recall: float) -> int | None:
        """The fewest probes a table that find the share `recall` of the neighbours; none if `most` are too few."""
        rank = np.full(len(self.near), most)
        for at in range(tables):
            own, tried = buckets(self.near, at, parts), probed(self.queries, at, parts, most)[self.of]
            hit = tried == own[:, None]
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), most))
        found = np.sort(rank)
        need = found[max(0, ceil(recall * len(found)) - 1)]
        return int(need) + 1 if need < most else None


def brute_force(sample: dict[int, tuple[np.ndarray, np.ndarray]], nodes: DataFrame, keep: int) -> DataFrame:
    """(q, node, score, least, size, embedding): each task's `keep` best nodes for every sample query. sample: by vector length, the
    queries' numbers and unit vectors."""
    found = T.StructType([T.StructField("q", T.LongType()), T.StructField("score", T.DoubleType()), *(nodes.schema[c] for c in ("node", "size", "embedding"))])
    target = to_arrow_schema(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, unit in by_size(batch):
                if own not in sample:
                    continue
                numbers, queries = sample[own]
                score = queries @ unit.T
                k = min(keep, len(unit))
                at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                rows = part.take(pa.array(at.ravel()))
                columns = [pa.array(np.repeat(numbers, k)), pa.array(np.take_along_axis(score, at, 1).ravel())]
                yield pa.RecordBatch.from_arrays([*columns, *(rows.column(c).cast(target.field(c).type) for c in ("node", "size", "embedding"))], schema=target)

    return nodes.select("node", "size", "embedding").mapInArrow(run, found)


def fitted(nodes: DataFrame, queries: DataFrame, total: int, keep: int, tables: int = TABLES, recall: float = RECALL) -> dict[int, tuple[int, int]]:
    """(parts, probes) by vector length, from at most SAMPLE queries; lengths that those miss are searched whole."""
    drawn = queries.select("q", "key", "size", "embedding").orderBy("key").limit(SAMPLE).collect()
    sample = {}
    for own in {r["size"] for r in drawn}:
        rows = [r for r in drawn if r["size"] == own]
        sample[own] = np.array([r.q for r in rows]), unit_rows(pa.array([r.embedding for r in rows]), own)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    near = brute_force(sample, nodes, keep).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= keep).collect()  # SAMPLE x keep
    out = {}
    for own, (numbers, units) in sample.items():
        rows = [r for r in near if r["size"] == own]
        place = {q: i for i, q in enumerate(numbers.tolist())}
        found = Sampled(units, unit_rows(pa.array([r.embedding for r in rows]), own), np.array([place[r.q] for r in rows]))
        width = 2 << (own - 1).bit_length()
        for parts in range(max(1, ceil(log(max(2, total / BUCKET)) / log(width))), 0, -1):
            probes = found.probes(parts, width, tables, recall)
            if probes is not None or parts == 1:
                out[own] = parts, probes or width
                break
    return out


def placed(rows: DataFrame, plan: dict[int, tuple[int, int]], tables: int, probing: bool) -> DataFrame:
    """A row of `rows` (size, embedding, ...) for each table and bucket that it lies in, or that it probes."""
    full = T.StructType([T.StructField("place", T.LongType()), *rows.schema])
    target = to_arrow_schema(full)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, unit in by_size(batch):
                parts, probes = plan.get(own, (1, 2 << (own - 1).bit_length()))
                for at in range(tables):
                    found = probed(unit, at, parts, probes) if probing else buckets(unit, at, parts)[:, None]
                    place = mix(mix(found.ravel() + np.uint64(1)) ^ np.uint64(own * 64 + at)).view(np.int64)
                    rows_ = part.take(pa.array(np.repeat(np.arange(len(unit)), found.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(place), *(rows_.column(f.name).cast(f.type) for f in list(target)[1:])], schema=target)

    return rows.mapInArrow(run, full)


def in_blocks(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Both, with columns a and b: a bucket's nodes and queries are dealt in blocks of bounded size, and every block of the one meets
    every block of the other. Only buckets of more than one block are counted out to the tasks, LONG_RUNS at most of either."""
    n, m = nodes.groupBy("place").agg(F.count("*").alias("_n")), queries.groupBy("place").agg(F.count("*").alias("_m"))
    total = [max(NODE_BLOCK, nodes.count() // LONG_RUNS), max(QUERY_BLOCK, queries.count() // LONG_RUNS)]
    long_n = n.where(F.col("_n") > total[0]).select("place", F.ceil(F.col("_n") / total[0]).cast("int").alias("_a"))
    long_m = m.where(F.col("_m") > total[1]).select("place", F.ceil(F.col("_m") / total[1]).cast("int").alias("_b"))
    one = F.lit(1)

    def dealt(rows: DataFrame, own: str, other: str, member: str) -> DataFrame:
        out = rows.join(F.broadcast(long_n), "place", "left").join(F.broadcast(long_m), "place", "left").withColumns({"_a": F.coalesce("_a", one), "_b": F.coalesce("_b", one)})
        out = out.withColumn(own[1:], F.pmod(F.xxhash64(member), F.col(own)).cast("int"))
        return out.withColumn(other[1:], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    a = dealt(nodes, "_a", "_b", "node").select("place", "a", "b", F.lit(None).cast("long").alias("q"), "node", "least", "size", "embedding")
    b = dealt(queries, "_b", "_a", "q").select("place", "a", "b", "q", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("least"), "size", "embedding")
    return a.unionByName(b)


BEST = fields("q long, node long, least long, score double")


def scored(blocks: DataFrame, keep: int) -> DataFrame:
    """The `keep` best nodes of a block for each of its queries; scores are taken pair by pair, so that they do not depend on the block."""
    target = to_arrow_schema(BEST)
    names = ["place", "a", "b"]

    def step(run: pa.Table) -> pa.RecordBatch | None:
        run_of = runs_of(run, names)
        is_query = run.column("q").is_valid().to_numpy()
        edges = np.flatnonzero(np.diff(run_of, prepend=-1, append=-1))
        out = []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            asked = is_query[start:stop]
            if asked.all() or not asked.any():
                continue
            part = run.slice(start, stop - start)
            unit = unit_rows(part.column("embedding"), part.column("size")[0].as_py())
            nodes, queries = np.flatnonzero(~asked), np.flatnonzero(asked)
            node, least, q = (part.column(c).to_numpy() for c in ("node", "least", "q"))
            k = min(keep, len(nodes))
            for s in range(0, len(queries), 256):
                own = queries[s : s + 256]
                rough = unit[own] @ unit[nodes].T
                bar = np.partition(rough, len(nodes) - k, axis=1)[:, len(nodes) - k]
                x, y = np.nonzero(rough >= bar[:, None] - 1e-12)
                score = (unit[own[x]] * unit[nodes[y]]).sum(1)
                order = np.lexsort((least[nodes[y]], -score, x))
                x, y, score = x[order], y[order], score[order]
                rank = np.arange(len(x)) - np.searchsorted(x, x)
                top = rank < k
                out.append((q[own[x[top]]].astype(np.int64), node[nodes[y[top]]].astype(np.int64), least[nodes[y[top]]].astype(np.int64), score[top]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=target)

    return map_runs(blocks, names, step, BEST, rows=4096)


def _nearest(nodes: DataFrame, queries: DataFrame, plan: dict[int, tuple[int, int]], tables: int, keep: int) -> DataFrame:
    """(q, node, score): the `keep` best nodes that each query finds, at least, each once."""
    index = written(placed(nodes.select("node", F.element_at("ids", 1).alias("least"), "size", "embedding"), plan, tables, False), "index")
    probes = written(placed(queries.select("q", "size", "embedding"), plan, tables, True), "probes")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least", "node")
    found = scored(in_blocks(index, probes), keep).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= keep * tables)  # a table finds a node once
    return found.select("q", "node", "score").distinct()


def search(vectors: DataFrame, wanted: Column, nearest: int = NEAREST, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the `nearest` rows found for each row that is `wanted`."""
    keep = nearest + 1
    rows = sound(vectors)
    nodes = written(nodes_of(rows, keep), "nodes")
    asking = rows.where(wanted)
    queries = written(asking.groupBy("key").agg(F.first("size").alias("size"), F.first("embedding").alias("embedding"), F.count("*").alias("copies")).withColumn("q", F.monotonically_increasing_id()), "queries")
    total = nodes.count()
    plan = fitted(nodes, queries, total, keep, tables, recall)
    found = written(_nearest(nodes, queries, plan, tables, keep), "near")
    few = queries.join(found.groupBy("q").agg(F.count("*").alias("_n")), "q", "left").where((F.col("_n") < keep) | F.col("_n").isNull()).select(queries["*"])
    if few.limit(1).count():  # too few nodes in the buckets they probe: all rows are searched
        few = written(few, "few")
        found = found.join(few, "q", "left_anti").unionByName(_nearest(nodes, few, {}, 1, keep))
    one = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = found.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("_k", F.row_number().over(one)).where(F.col("_k") <= keep)
    lists = ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_k", "vec_id", "score"))).alias("found"))
    lists = written(queries.select("q", "key", "copies").join(lists, "q").drop("q"), "found")
    mine = with_row(asking.select(F.col("vec_id").alias("query_id"), "key").distinct(), lists, "key", "copies", asking.count())
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, nearest)
    return mine.select("query_id", F.posexplode(others).alias("place", "f")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
