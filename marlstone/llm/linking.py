"""Connected components over links, and the blocks in which members of one component meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import written

#: Members of a component, or of a run of equal keys, that one side of a block holds.
BLOCK = 512
#: A key of more than this share of all rows is hot: fewer than 1 / HOT keys, so that what is known of them can be broadcast.
HOT = 1 / 1000
#: Keys whose runs are dealt in blocks: fewer than this many, whatever the number of rows.
LONG_RUNS = 1_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as a-b, from each node but the root to the root: at most one a node."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(back[: len(a)], back[len(a) :], len(nodes))
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[at]], nodes[at]


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node that it reaches.

    Large and small stars alternate until nothing changes. Minima are aggregated before they meet the links, so a hub is
    combined on the map side; what is known of hubs is broadcast to their links, so no task gathers those.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = written(ordered(links), f"{name}-links")
    before = state(now)
    for i in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # the ends of all links are twice as many as the links
        large = ordered(with_row(both.where("v > u"), least, "u", "n", 2 * before[0]).select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        # a node has few smaller neighbours by now: one for each group that it joins
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least.hint("merge"), "u")
        now = written(ordered(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))), f"{name}-{i}")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def with_row(rows: DataFrame, unique: DataFrame, key: str, size: str, total: int, keep: bool = False) -> DataFrame:
    """`rows` joined with the one row of `unique` for their key, of which `size` tells how many rows may have it; `total` bounds
    the sum of the sizes. Rows of hot keys meet a broadcast of fewer than 1 / HOT rows where they are; the others shuffle.
    With `keep` the result has the column `size` as well."""
    hot = F.col(size) > HOT * total
    if keep:
        unique = unique.withColumn("_size", F.col(size))
        return with_row(rows, unique, key, "_size", total)
    more = [c for c in unique.columns if c not in (key, size)]
    met = rows.join(F.broadcast(unique.where(hot).select(key, *more, F.lit(True).alias("_hot"))), key, "left")
    rest = met.where("_hot IS NULL").select(*rows.columns).join(unique.where(~hot).drop(size).hint("merge"), key)
    return met.where("_hot").select(*rows.columns, *more).unionByName(rest.select(*rows.columns, *more))


def dealt(rows: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """`rows` with columns side, left and right: runs of a key of up to two blocks stay whole, longer ones are dealt by a hash
    of the member into parts, of which every two meet. Which keys are long is counted first and broadcast: LONG_RUNS rows at most.
    `rows` is read twice, so it should be written."""
    longest = max(2 * block, rows.count() // LONG_RUNS)
    long_ = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > longest)
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(block)), F.lit(1)).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64(member), parts)).otherwise(0).cast("int")
    out = rows.join(F.broadcast(long_), key, "left").withColumn("side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.select(*rows.columns, "side", F.least("side", "_other").alias("left"), F.greatest("side", "_other").alias("right"))


def blocked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """`members` (node, root, ...) once for each block that a member meets others in: columns left and right number the two
    parts of the component that meet there, and side is the part that the row is of.

    A component of up to `block` members is one block; a larger one is dealt by hash into parts, and every two parts meet.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("int")
    dealt = members.join(sizes, "root").withColumn("side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.select(*members.columns, "side", F.least("side", "_other").alias("left"), F.greatest("side", "_other").alias("right"))


def map_runs(df: DataFrame, keys: list[str], step: Callable[[pa.Table], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: T.StructType, rows: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply `step` to tables of whole runs of equal keys, at least `rows` rows where there are as many."""
    source = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = step(table.combine_chunks())
            if out is not None and out.num_rows:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            cut = last_run(table, keys)
            if cut:
                yield from work(table.slice(0, cut))
                rest = table.slice(cut)
                held, size = rest.to_batches(), rest.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    return source.mapInArrow(run, schema)


def last_run(table: pa.Table, keys: list[str]) -> int:
    """Where the last run of equal keys begins."""
    n = table.num_rows
    same = np.ones(n, bool)
    for k in keys:
        column = table.column(k).to_numpy()
        same &= column == column[-1]
    differ = np.flatnonzero(~same)
    return int(differ[-1]) + 1 if len(differ) else 0


def runs_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of the run of each row."""
    n = table.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)
