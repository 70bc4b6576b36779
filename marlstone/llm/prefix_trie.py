"""A trie of conversations with shared first turns, from mergeable partial tries.

1. Conversations that are rebuilt from one another (of one base) meet in one task, sorted; it streams through them and emits a row
   for each rebuilt turn: the node of that prefix, named by a 128-bit digest chained over its turns, and the node above.
2. Every task combines its rows into a table of nodes: smallest member, number of members, and the list of those that end there.
   A table is passed on when it holds NODES nodes, so memory is bounded. Lists are cut by ranges of 2^SPAN ids: no row of a
   table grows with the number of conversations.
3. Tables are merged in a tree, by hash of node and range, from FAN sources into one at a time, until each node has one row a range;
   then ranges are summed. The list of a node streams through its hash in order of ranges.
4. Rollup from the bottom along the paths: a node's figures are counted once, on the path of its smallest member, whose turns
   are summed from the last to the first; sums of all paths through a node are its subtree's. That takes as many shuffles for
   any depth. Rows of hot nodes meet a broadcast of those, which are fewer than a thousand.

Defined results: turns are ordered by turn (null first), then role and text, where null is empty; rows of null conv_id belong to
no conversation and are left out; repeated rows are turns of their own; c % 5 has the sign of c; a turn without text is a
turn; an empty table gives no nodes; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.llm.common import bound_batches, fields, table, written
from marlstone.llm.linking import with_row

#: Conversations of a base, and first turns that may be taken from it: fewer than MOST_SHARED.
FAMILY, MOST_SHARED = 5, 9
#: Nodes that a task's table holds before it is passed on, bits of a range of ids, and tables that one merge takes together.
NODES, SPAN, FAN = 100_000, 16, 16
ROOT = bytes(16)


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % MOST_SHARED


def below(node: bytes, role: str, text: str) -> bytes:
    """The node that a turn leads to."""
    r = role.encode()
    return hashlib.blake2b(b"%b%d:%b" % (node, len(r), r) + text.encode(), digest_size=16).digest()


PATHS = fields("conv_id long, depth int, node binary, parent binary, bytes long, last boolean")


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included."""
    c = F.col("conv_id")
    base = (c - c % FAMILY).alias("base")
    rows = conversations.where(c.isNotNull()).select(base, c.cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the base comes first among those that take turns from it
    source = rows.withColumn("first", F.col("conv_id") != F.col("base")).repartition("base").sortWithinPartitions("base", "first", "conv_id", "turn", "role", "text")
    schema = to_arrow_schema(PATHS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family = now = None
        shared: list[tuple[str, str]] = []  # first turns of the base
        node, depth, skip, size = ROOT, 0, 0, 0
        held: tuple | None = None  # the last row of the conversation so far: whether it is the end is not known yet

        def turn(role: str, text: str) -> None:
            nonlocal node, depth, held
            out.append((*held, False))
            above, node = node, below(node, role, text)
            depth += 1
            held = (now, depth, node, above, len(text.encode()))

        def begin(conv: int) -> None:
            nonlocal now, node, depth, skip, held
            if held is not None:
                out.append((*held, True))
            now, node, depth, skip = conv, ROOT, 0, shared_turns(conv)
            held = (conv, 0, ROOT, None, 0)
            if conv != family:
                for role, text in shared[:skip]:
                    turn(role, text)
                skip = shared_turns(conv)

        def emit() -> pa.RecordBatch:
            done, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("base", "conv_id", "role", "text"))
            for base, conv, role, text in zip(*columns, strict=True):
                if base != family:
                    family, shared = base, []
                if conv != now:
                    begin(conv)
                if conv == family and len(shared) < MOST_SHARED:
                    shared.append((role, text))
                if conv == family or skip == 0:  # the base keeps its own first turns
                    turn(role, text)
                else:
                    skip -= 1
                if len(out) >= 4096:
                    yield emit()
        if held is not None:
            out.append((*held, True))
        if out:
            yield emit()

    return source.select("base", "conv_id", "role", "text").mapInArrow(run, PATHS)


TABLE = fields("node binary, span long, source int, depth int, parent binary, bytes long, least long, n_convs long, ends long[]")


def node_tables(rows: DataFrame, most: int = NODES) -> DataFrame:
    """The tasks' tables of nodes."""
    schema = to_arrow_schema(TABLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        source = TaskContext.get().partitionId()
        names = ("conv_id", "depth", "node", "parent", "bytes", "last")

        def emit() -> pa.RecordBatch:
            done = [(node, span, source, *fields[:5], sorted(fields[5])) for (node, span), fields in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, depth, node, parent, size, last in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                own = held.setdefault((node, conv >> SPAN), [depth, parent, size, conv, 0, []])
                own[3] = min(own[3], conv)
                own[4] += 1
                if last:
                    own[5].append(conv)
                if len(held) >= most:
                    yield emit()
        if held:
            yield emit()

    return rows.mapInArrow(run, TABLE)


def merged(tables: DataFrame) -> DataFrame:
    """One row for each node and range of ids."""
    total = [F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.min("least").alias("least"), F.sum("n_convs").alias("n_convs"), F.flatten(F.collect_list("ends")).alias("ends")]
    last = tables.agg(F.max("source")).first()[0] or 0
    while last >= FAN:
        tables = tables.groupBy("node", "span", F.floor(F.col("source") / FAN).cast("int").alias("source")).agg(*total)
        last //= FAN
    return tables.groupBy("node", "span").agg(*total)


ENDS = fields("node binary, ends_sha256 string")


def ends_digests(tables: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end: ids in order, range by range, through one hash."""
    source = tables.where(F.size("ends") > 0).select("node", "span", F.array_sort("ends").alias("ends")).repartition("node").sortWithinPartitions("node", "span")
    schema = to_arrow_schema(ENDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ends)).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], schema=schema)

    return source.mapInArrow(run, ENDS)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    rows = written(paths(conversations), "paths")
    tables = written(merged(written(node_tables(rows), "node-tables")), "merged-tables")
    nodes = tables.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.min("least").alias("least"), F.sum("n_convs").alias("n_convs"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    n_paths, n_nodes = rows.count(), nodes.count()

    # each node's share of the sums, on the path of its smallest member
    met = with_row(rows.select("conv_id", "depth", "node"), nodes.select("node", "n_convs", "least", "bytes", "n_children"), "node", "n_convs", n_paths, keep=True)
    own = F.col("least") == F.col("conv_id")
    met = met.select("conv_id", "depth", "node", F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"), F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).cast("long").alias("saved"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below_ = met.select("node", F.sum("leaf").over(up).alias("leaf"), F.sum("saved").over(up).alias("saved"))
    sums = below_.where("leaf > 0 OR saved > 0").groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    full = written(nodes.join(sums, "node", "left").join(ends_digests(tables), "node", "left"), "full-nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"), "n_children").where("n_children > 0")
    lower = with_row(full.where("parent IS NOT NULL"), above.withColumnRenamed("n_children", "_size"), "parent", "_size", n_nodes)
    root = full.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    number = lambda x: F.col(x).cast("long")
    return lower.unionByName(root).select(
        F.col("least").alias("conv_id"), number("depth"), "parent_conv_id", number("n_convs"), number("n_children"),
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return trie(table(spark, sf_dir, "conversations"))
