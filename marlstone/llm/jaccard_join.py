"""N-gram Jaccard join by prefixes under several global orders.

A document is the set of its distinct shingles; equal sets are one node. For a threshold t, two linked sets of any sizes
share a token in their prefixes, the first n - ceil(t n) + 1 tokens, under *every* order of all tokens. The orders here put
tokens that many documents hold last, by counts over the whole corpus in a sketch of fixed size (one row of counters and
one hash an order, so a rare token that meets a common one in one order is early in another).

1. One pass counts tokens and gives every document the key of its set.
2. Prefix tokens under the first order are dealt by token, once a task and set, with a sketch of the whole set: the least
   tokens of BINS random parts of all tokens, two bits of each. Sets that share a token are candidates if their sizes allow a
   link and as many parts agree as all but a share of MISS of pairs at the threshold have. What leaves a task are stars over
   the candidates, so a group of near copies costs rows in its size, not in its pairs; the sets of a token that very many hold
   are dealt in blocks of bounded size.
3. Within the candidates' components, in blocks of bounded size, pairs must share prefix tokens under all orders; what the
   filters leave in common is verified by exact intersection of the whole sets.
4. The links' components give each document the smallest id it reaches; the links themselves are counted.

Tokens are 64-bit hashes of shingles. Defined results: texts without words, empty and null texts have an empty set, no links
and themselves as component; rows of one id are nodes by their texts; rows with equal texts share a component; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, chunks, table, written
from marlstone.llm.linking import blocked, components, dealt, map_runs, runs_of, star, with_row
from marlstone.llm.words import mix, windows, words_of

SHINGLE, PERCENT = 3, 90
ORDERS, SLOTS = 3, 1 << 16
BINS, MISS = 64, 1e-9

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of texts as (text, token), in order of both; a text of fewer words has one, of all its words."""
    _, _, _, doc, ids = words_of([t.translate(_LOWER) if t else t for t in texts])
    token, at = windows(ids, doc, size)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(texts))
    for words in range(1, size):
        short = np.flatnonzero(count == words)
        first = np.searchsorted(doc, short)
        value = np.full(len(short), words, np.uint64)
        for j in range(words):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + ids[first + j])
        token, owner = np.concatenate([token, value]), np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of the values of each owner; owners are in order."""
    total = np.append(np.uint64(0), np.cumsum(values))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def _slots(token: np.ndarray, order: int) -> np.ndarray:
    return (mix(token + np.uint64(0x51ED270B * (order + 1))) & np.uint64(SLOTS - 1)).astype(np.int64)


class Orders:
    """The global orders: by the sketch's count of a token, then by a hash of it; each order has its own counts and hash."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def prefix(self, owner: np.ndarray, token: np.ndarray, n: np.ndarray, order: int, percent: int) -> np.ndarray:
        """The places of the prefix tokens of each owner's set; n is the size of each set."""
        # counts within a factor of two tie, so that the hash decides between tokens that are about as common
        weight = np.log2(1 + self.counts[order][_slots(token, order)]).astype(np.int64)
        arranged = np.lexsort((mix(token ^ np.uint64(0xA0761D6478BD642F * (order + 1) % 2**64)), weight, owner))
        place = np.arange(len(token)) - (np.cumsum(n) - n)[owner[arranged]]
        size = n - (percent * n + 99) // 100 + 1
        return arranged[place < size[owner[arranged]]]


KEYS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "key2", "n_shingles")])
COUNTED = ("order", "slot", "count")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def keyed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, two hashes and the size of each document's set, and, in rows of their own, each task's counts of tokens."""
    schema = T.StructType([docs.schema["doc_id"], *KEYS, *(T.StructField(c, T.LongType()) for c in COUNTED)])
    target = _arrow(schema)

    def run(batches):
        counts = np.zeros((ORDERS, SLOTS), np.int64)
        for batch in batches:
            for part, texts in chunks(batch):
                owner, token = shingle_sets(texts, size)
                n = np.bincount(owner, minlength=len(texts))
                for k in range(ORDERS):
                    counts[k] += np.bincount(_slots(token, k), minlength=SLOTS)
                keys = [_sums(owner, mix(token + np.uint64(s)), len(texts)).view(np.int64) for s in (1, 2)]
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(target.field("doc_id").type), pa.array(keys[0]), pa.array(keys[1]), pa.array(n), none, none, none], schema=target)
        order, slot = np.nonzero(counts)
        none = pa.nulls(len(slot), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), target.field("doc_id").type), none, none, none, pa.array(order), pa.array(slot), pa.array(counts[order, slot])], schema=target)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sketches(owner: np.ndarray, token: np.ndarray, rows: int) -> list[np.ndarray]:
    """For each set, 64 bits that say which bins hold a token, and the two lowest bits of the hash of each bin's least token."""
    value = mix(token + np.uint64(23))
    cell = owner * BINS + (value >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((value, cell))
    first = order[np.append(True, cell[order][1:] != cell[order][:-1])] if len(order) else order
    out = []
    for bits in (np.ones(len(first), np.uint8), (value[first] & np.uint64(1)).astype(np.uint8), (value[first] >> np.uint64(1) & np.uint64(1)).astype(np.uint8)):
        held = np.zeros(rows * BINS, np.uint8)
        held[cell[first]] = bits
        out.append(np.packbits(held.reshape(rows, BINS), axis=1).view("<i8").reshape(rows))
    return out


def least_agreeing(percent: int) -> np.ndarray:
    """For each number of bins that either set fills, the bins that agree in all but MISS of pairs at the threshold: the
    lower tail of a binomial law, where a bin agrees if the least tokens are equal, or by chance in both bits."""
    p = percent / 100 + (1 - percent / 100) / 4
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        tail, k = 0.0, 0
        while (tail := tail + comb(n, k) * p**k * (1 - p) ** (n - k)) <= MISS:
            k += 1
        out[n] = k
    return out


POSTINGS = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "key", "n", "filled", "low", "high")])


def postings(docs: DataFrame, orders: Orders, size: int, percent: int) -> DataFrame:
    """The prefix tokens of sets under the first order, with the set's key, size and sketch, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)  # ORDERS * SLOTS counters
    target = _arrow(POSTINGS)

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch):
                owner, token = shingle_sets(texts, size)
                key = _sums(owner, mix(token + np.uint64(1)), len(texts)).view(np.int64)
                n = np.bincount(owner, minlength=len(texts))
                new = np.zeros(len(texts), bool)
                for d in np.flatnonzero(n).tolist():
                    if int(key[d]) not in met:
                        met.add(int(key[d]))
                        new[d] = True
                held = new[owner]
                owner, token, n = owner[held], token[held], np.where(new, n, 0)
                sketch = sketches(owner, token, len(texts))
                at = shared.value.prefix(owner, token, n, 0, percent)
                own = owner[at]
                yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64)), pa.array(key[own]), pa.array(n[own]), *(pa.array(x[own]) for x in sketch)], schema=target)

    return docs.select("text").mapInArrow(run, POSTINGS)


LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])


def candidates(found: DataFrame, percent: int) -> DataFrame:
    """Stars over the sets that share a prefix token and that sizes and sketches allow to link."""
    target, least = _arrow(LINKS), least_agreeing(percent)
    block = ["token", "left", "right"]

    def step(run: pa.Table) -> pa.RecordBatch | None:
        key, n, filled, low_bit, high_bit, side = (run.column(c).to_numpy() for c in (*POSTINGS.names[1:], "side"))
        whole = run.column("left").to_numpy() == run.column("right").to_numpy()
        token = runs_of(run, block)
        a, b = [], []
        here = np.arange(len(token))
        for off in range(1, len(token)):
            here = here[here < len(token) - off]
            # rows are in order of size within a token, so a row that meets too large a set is done
            here = here[(token[here] == token[here + off]) & (100 * n[here] >= percent * n[here + off])]
            if not len(here):
                break
            far = here + off
            agree = filled[here] & filled[far] & ~(low_bit[here] ^ low_bit[far]) & ~(high_bit[here] ^ high_bit[far])
            needed = least[np.bitwise_count((filled[here] | filled[far]).view(np.uint64))]
            ok = (np.bitwise_count(agree.view(np.uint64)) >= needed) & (key[here] != key[far]) & (whole[here] | (side[here] != side[far]))
            a.append(key[here[ok]]), b.append(key[far[ok]])
            if len(a) > 256:
                a, b = ([x] for x in star(np.concatenate(a), np.concatenate(b)))
        if not a:
            return None
        low, high = star(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], schema=target)

    return map_runs(dealt(written(found, "postings"), "token", "key"), block, step, LINKS, rows=20_000, order=("n",))


VERIFIED = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "links")])


def verified(meeting: DataFrame, orders: Orders, size: int, percent: int) -> DataFrame:
    """Of blocks of sets with their texts: for each set with links, the root of its star in the block and its links there."""
    shared = meeting.sparkSession.sparkContext.broadcast(orders)
    target = _arrow(VERIFIED)
    block = ["root", "left", "right"]

    def step(run: pa.Table) -> pa.RecordBatch | None:
        key, side, copies = (run.column(c).to_numpy() for c in ("node", "side", "copies"))
        cross = run.column("left").to_numpy() != run.column("right").to_numpy()
        group = runs_of(run, block)
        texts = run.column("text").cast(pa.binary()).to_pylist()
        owner, token = shingle_sets(texts, size)
        n = np.bincount(owner, minlength=len(texts))
        pairs = None
        for k in range(ORDERS):
            at = shared.value.prefix(owner, token, n, k, percent)
            sharing = _sharing(group, side, cross, n, owner[at], token[at], percent)
            pairs = sharing if pairs is None else np.intersect1d(pairs, sharing, assume_unique=True)
            if not len(pairs):
                return None
        x, y = pairs // len(texts), pairs % len(texts)
        common = _common(x, y, owner, token, len(texts))
        ok = 100 * common >= percent * (n[x] + n[y] - common)
        x, y = x[ok], y[ok]
        if not len(x):
            return None
        links = np.bincount(x, copies[y], len(texts)) + np.bincount(y, copies[x], len(texts))
        low, high = star(key[x], key[y])
        linked = np.flatnonzero(links)
        a, b = np.concatenate([low, key[linked]]), np.concatenate([high, key[linked]])
        counted = np.concatenate([np.zeros(len(low)), links[linked]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counted)], schema=target)

    return map_runs(meeting, block, step, VERIFIED, rows=256)


def _sharing(group: np.ndarray, side: np.ndarray, cross: np.ndarray, n: np.ndarray, owner: np.ndarray, token: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows x < y of a block, as x * rows + y, that share a token and whose sizes let them link."""
    order = np.lexsort((n[owner], token, group[owner]))
    owner, token = owner[order], token[order]
    home = group[owner]
    out = np.empty(0, np.int64)
    held, size = [], 0
    here = np.arange(len(token))
    for off in range(1, len(token)):
        here = here[here < len(token) - off]
        x, y = owner[here], owner[here + off]
        ok = (token[here] == token[here + off]) & (home[here] == home[here + off]) & (100 * n[x] >= percent * n[y])
        here = here[ok]
        if not len(here):
            break
        x, y = x[ok], y[ok]
        meet = ~cross[x] | (side[x] != side[y])
        held.append(np.minimum(x, y)[meet] * len(n) + np.maximum(x, y)[meet])
        size += len(held[-1])
        if size > 2_000_000:
            out = np.unique(np.concatenate([out, *held]))
            held, size = [], 0
    return np.unique(np.concatenate([out, *held]))


def _common(x: np.ndarray, y: np.ndarray, owner: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """Sizes of the intersections of the sets of rows x and y; tokens are in order within a row."""
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    out = np.zeros(len(x), np.int64)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(x)).tolist()):
        own = token[bounds[x[s]] : bounds[x[s] + 1]]
        sizes = bounds[y[s:e] + 1] - bounds[y[s:e]]
        other = token[np.repeat(bounds[y[s:e]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        out[s:e] = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return out


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """What join() returns, with the key of each document's set and the root of its component."""
    first = written(keyed(docs, size), "sets")
    own = first.where("slot IS NULL").select("doc_id", "key", "key2", "n_shingles")
    # at most ORDERS * SLOTS rows
    counts = np.zeros((ORDERS, SLOTS), np.int64)
    summed = first.where("slot IS NOT NULL").groupBy("order", "slot").agg(F.sum("count").alias("count")).toArrow()
    counts[summed["order"].to_numpy(), summed["slot"].to_numpy()] = summed["count"].to_numpy()
    orders = Orders(counts)
    sets = own.where("n_shingles > 0").groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    maybe = components(candidates(postings(docs, orders, size, percent), percent), "candidates")
    # the text of a set is that of its document of the smallest id; of rows that share that id, only one with this set
    reps = maybe.join(sets, "node")
    own_text = docs.where("text IS NOT NULL").select("doc_id", "text")
    chosen = reps.select("least").distinct()
    texts = _with_key(own_text.join(chosen, own_text["doc_id"].eqNullSafe(chosen["least"]), "left_semi").select("text"), size)
    texts = reps.drop("least").join(texts.dropDuplicates(["key"]), F.col("node") == F.col("key")).drop("key")
    meeting = blocked(written(texts, "texts"))
    found = written(verified(meeting, orders, size, percent), "verified")
    linked = components(found.where("a <> b").select("a", "b"), "links")
    degree = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = sets.join(linked, "node", "left").join(degree, "node", "left")
    root = F.coalesce("root", "node")
    nodes = nodes.select("node", "least", "copies", root.alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    nodes = written(nodes, "nodes")
    total = own.count()
    best = written(nodes.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("size")), "best")
    nodes = written(with_row(nodes, best, "root", "size", total).select(F.col("node").alias("key"), "root", "best", "n_links", "copies"), "found")
    empty = own.where("n_shingles = 0").select("key", F.col("key").alias("root"), "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    full = with_row(own.where("n_shingles > 0"), nodes, "key", "copies", total).select("key", "root", "doc_id", "n_shingles", F.col("best").alias("component_id"), "n_links")
    return full.union(empty)


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and n_links (the other
    documents linked directly) of every document; links join sets whose Jaccard similarity is at least `percent` %."""
    return _joined(docs, size, percent).drop("key", "root")


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of `docs` with the smallest id of their component, one a component; rows without words stay."""
    found = _joined(docs, size, percent).where("n_shingles > 0")
    ident = F.coalesce("doc_id", F.lit(-(2**63)))  # a null id is an id of its own
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("key", ident.alias("_id"))).alias("_best"))
    rows = _with_key(docs.select(F.struct("*").alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), size)
    rows = rows.select("_row", "key", ident.alias("_id"))
    # copies of one text have ids of their own, so neither the join nor the choice among equal rows gathers them
    first = rows.where("key <> 0").join(best.select("_best.*"), ["_id", "key"]).groupBy("_id", "key").agg(F.first("_row").alias("_row"))
    return first.select("_row.*").unionByName(rows.where("key = 0").select("_row.*"))


def _with_key(docs: DataFrame, size: int) -> DataFrame:
    """The rows with the key of their text's set."""
    schema = T.StructType([*docs.schema, T.StructField("key", T.LongType())])
    target = _arrow(schema)

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch):
                owner, token = shingle_sets(texts, size)
                key = _sums(owner, mix(token + np.uint64(1)), len(texts)).view(np.int64)
                columns = [part.column(f.name).cast(f.type) for f in list(target)[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(key)], schema=target)

    return docs.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return join(table(spark, sf_dir, "documents"))
