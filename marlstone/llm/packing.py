"""Best-fit packing of token sequences by exact-complement hashing.

Every document is tokenised once, in Arrow batches, and cut into pieces of at most `capacity` tokens; the small piece rows
are written to the shared folder. What the packing needs of them is the number of pieces of each length (at most
`capacity` numbers, summed map-side), so the driver's plan is bounded whatever the corpus: it indexes the single, pair and
triple sums of the lengths at hand, uses up combinations that fill a gap exactly under the availability counts, many sequences
at a time, and best-fits what is left. Pieces then learn their place from their rank among the pieces of their length. Ranks
are counted within buckets of about BUCKET_ROWS pieces, so a length that holds a third of all pieces is spread like the rest;
pieces that fill a sequence need no rank.

Defined results: a null or empty text is the closing token alone; repeated rows are packed each on its own; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, chunks, table, written

CAPACITY = 1024
END_ID = 2
#: Pieces that are ranked together, about, in an input large enough for LEAST_BUCKETS buckets of that size.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 256

#: Texts of these characters, without two white-space characters in a row, split alike with and without look-ahead.
_odd = re.compile(r"\s\s|[^\x00-ɏ‐-‧]")
#: The split of the vocabulary without its look-ahead, which only matters where white space follows white space.
_PLAIN_SPLIT = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizer file at `path` gives them, as an array of 32-bit numbers.

    The file's own library reads the vocabulary and encodes unusual texts; the others go through a faster reader of the
    same merges, which the tests hold against it.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("plain", pat_str=_PLAIN_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        if _odd.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special=allowed)

    return encode


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id and the pieces of each text's ids plus the closing id; only the first piece of a text may be short of
    `capacity` when there are several. `with_ids` adds the ids themselves."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(PIECES)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    target = to_arrow_schema(schema)

    def run(batches):
        encode = encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part, texts in chunks(batch):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, raw in enumerate(texts):
                    ids = np.concatenate([encode(raw.decode()), end]) if raw else end
                    at, k = 0, 0
                    while at < len(ids):
                        size = (len(ids) - at - 1) % capacity + 1 if k == 0 else capacity
                        own = ids[at : at + size].astype("<u4", copy=False)
                        row.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            held.append(own.astype(np.int32))
                        at, k = at + size, k + 1
                arrays = [part.column("doc_id").take(pa.array(row, pa.int32())), piece, start, length, crc] + [held] * with_ids
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Index:
    """Sums of one, two and three available lengths, and the combinations behind each sum.

    Under a pair's sum are the longer lengths of its pairs, under a triple's sum the longest lengths of triples whose rest is the
    sum of a pair: `capacity` numbers a sum at most. Counts only fall, so what fails a look-up once is taken out for good.
    """

    def __init__(self, left: np.ndarray) -> None:
        """left: how many pieces there are of each length; the caller lowers the counts."""
        self.left = left
        capacity = len(left) - 1
        have = np.flatnonzero(left)
        held = left > 0
        # ascending, so that the longest is looked at first, from the end
        self.pairs = [have[(2 * have >= s) & (have < s) & held[np.maximum(0, s - have)]].tolist() for s in range(capacity + 1)]
        least = np.array([own[0] if own else capacity + 1 for own in self.pairs])
        self.triples = [have[(3 * have >= s) & (have < s - 1) & (least[np.maximum(0, s - have)] <= have)].tolist() for s in range(capacity + 1)]

    def find(self, gap: int, size: int, beside: int) -> tuple[int, ...] | None:
        """`size` available lengths, longest first, that sum to `gap`, beside one more piece of the length `beside`."""
        if size == 1:
            return (gap,) if self._ok(gap, beside) else None
        if size == 2:
            return self._pair(gap, (beside,), gap)
        own = self.triples[gap]
        while own:
            rest = self._pair(gap - own[-1], (beside, own[-1]), own[-1]) if self._ok(own[-1], beside) else None
            if rest:
                return (own[-1], *rest)
            own.pop()
        return None

    def _pair(self, total: int, beside: tuple[int, ...], most: int) -> tuple[int, int] | None:
        own = self.pairs[total]
        while own and not self._ok(own[-1], total - own[-1]):
            own.pop()
        for first in reversed(own):
            if first <= most and self._ok(first, total - first, *beside):
                return first, total - first
        return None

    def _ok(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, longest first, and how often each is used; all counts are used up.

    Exact fills can take the small pieces that other long ones need, most of all in small tables. So the plan is made with
    sums of up to three, two, one and no lengths, and the shortest is taken, the one with the larger sums among equals: never
    more sequences than best fit decreasing has alone.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    shortest = 0
    for most, rest in ((3, _fullest_fit), (3, _best_fit), (2, _best_fit), (1, _best_fit), (0, _best_fit)):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        found = _exact(left, capacity, most)
        found += rest(left, capacity)
        used = sum(times for _, times in found)
        if best is None or used < shortest:
            best, shortest = found, used
        if shortest == least:
            break
    return best


def _use(left: np.ndarray, pattern: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The pattern as often as the counts allow, which are lowered."""
    need = np.bincount(pattern, minlength=len(left))
    at = np.flatnonzero(need)
    times = int((left[at] // need[at]).min())
    left[at] -= need[at] * times
    return pattern, times


def _exact(left: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Full sequences: pieces of the whole capacity, then each longest piece with up to `most` others that fill its gap exactly."""
    out = [_use(left, (capacity,))] if left[capacity] else []
    index = Index(left) if most else None
    for size in range(1, most + 1):
        for longest in range(capacity - 1, 0, -1):
            while left[longest]:
                found = index.find(capacity - longest, size, longest)
                if found is None:
                    break
                out.append(_use(left, tuple(sorted((longest, *found), reverse=True))))
    return out


def _fullest_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit from the sequence's side: the fullest that the longest piece allows."""
    out = []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        fill = _fullest(left, capacity - longest)
        left[longest] += 1
        out.append(_use(left, (longest, *fill)))
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit from the piece's side, longest first: the smallest gap that holds it. Sequences with equal gaps stay together,
    so the work follows the number of lengths, not of pieces."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in map(int, np.flatnonzero(left)[::-1]):
        n = int(left[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=capacity)
            each = gap // length
            own = gaps.pop(gap, None) or [((), -(-n // each))]
            while own and n:
                pattern, times = own.pop()
                full, short = min(times, n // each), n % each if n // each < times else 0
                if full:
                    gaps.setdefault(gap - each * length, []).append(((*pattern, *(length,) * each), full))
                if short:
                    gaps.setdefault(gap - short * length, []).append(((*pattern, *(length,) * short), 1))
                n -= full * each + short
                if times > full + (short > 0):
                    own.append((pattern, times - full - (short > 0)))
            if own:
                gaps.setdefault(gap, []).extend(own)
    left[:] = 0
    return [each for own in gaps.values() for each in own]


def _fullest(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """Available lengths with the largest sum within the gap: a bounded subset sum over sets of reachable sums."""
    mask, reach = (1 << (gap + 1)) - 1, 1
    layers: list[tuple[int, int]] = []
    for length in map(int, np.flatnonzero(left[: gap + 1])[::-1]):
        for _ in range(min(int(left[length]), gap // length)):
            layers.append((length, reach))
            reach |= reach << length & mask
        if reach >> gap & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return tuple(sorted(out, reverse=True))


def pack(found: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`found`, as pieces() gives it, with sequence_id and offset."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = written(found, "pieces")
    full = F.col("length") == capacity
    rows = found.where(~full).count()
    # a bucket of a length holds a share of its pieces; there are about as many buckets as rows / bucket_rows, and some a length
    n_buckets = max(LEAST_BUCKETS, -(-rows // bucket_rows))
    found = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    lengths = found.where(~full).groupBy("length").agg(F.count("*").alias("_n"))  # at most `capacity` rows
    own = F.ceil(F.col("_n") * n_buckets / F.lit(max(1, rows))).cast("int")
    dealt = found.where(~full).join(F.broadcast(lengths), "length").withColumn("_bucket", F.pmod("_bucket", own)).drop("_n")
    counted = dealt.groupBy("length", "_bucket").count().toArrow()  # at most n_buckets + capacity rows: one for some bucket_rows pieces
    counted = counted.sort_by([("length", "ascending"), ("_bucket", "ascending")])
    length, count = counted["length"].to_numpy(), counted["count"].to_numpy().astype(np.int64)
    place_of = length << np.int64(32) | counted["_bucket"].to_numpy()
    totals = np.bincount(length, count, capacity + 1).astype(np.int64)
    before = np.cumsum(count) - count
    before -= before[np.searchsorted(length, length)]
    used = np.zeros(capacity + 1, np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    base = 0
    for pattern, times in plan({i: int(n) for i, n in enumerate(totals) if n}, capacity):
        at = 0
        for own_length in pattern:
            runs[own_length].append((int(used[own_length]), base, at))
            used[own_length] += times
            at += own_length
        base += times
    places = {own_length: np.array(own, np.int64).T for own_length, own in enumerate(runs) if own}
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    names = [f.name for f in found.schema if f.name != "_bucket"]
    schema = T.StructType([found.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])
    target = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            length, bucket, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_bucket", "_rank"))
            rank = rank + before[np.searchsorted(place_of, length << np.int64(32) | bucket)]
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                first, start, where = places[int(own)]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = start[run] + rank[at] - first[run]
                offset[at] = where[run]
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(target.field(n).type) for n in names] + [pa.array(sequence), pa.array(offset)], schema=target)

    # full pieces are sequences of their own, numbered below zero by their place in the written rows
    alone = found.where(full).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, schema).union(alone)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
