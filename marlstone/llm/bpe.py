"""Byte-level BPE in DuckDB: recursive queries encode, ordered aggregation decodes.

Each Arrow batch is cut into its different pieces once, with array operations; only pieces that the worker has not met go
to an in-memory DuckDB, where a recursive query holds the token sequence of each piece, lays it out as token-position
rows, joins neighbouring ids with the merge table, and contracts the leftmost pair of the lowest rank of every piece, until
no pair of a piece has a rank. A second query decodes: token-position rows joined with the vocabulary, aggregated in order.

A step of that query costs time in the length of a piece, so pieces of more than LONG_BYTES (a run of letters without a break)
are cut into blocks, which the query encodes together, and the seams are mended. Token sequences joined are the encoding of the
joined bytes exactly if at every seam the two tokens there, encoded together, stay those two: no merge ever crosses a seam
where none of the two tokens' own merges does. Where they don't stay, some tokens on either side are encoded anew, more of
them each time. Time thus grows in proportion to the length unless merges depend on each other over long distances, as in
periodic texts; then the mended parts are long, and a step contracts all pairs of the lowest rank up to the first that
gives rise to a pair of a lower one.

Defined results: null and empty texts have no tokens (the hashes are those of nothing); rows stand each on its own; other
columns are never read; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, map_texts, table
from marlstone.llm.words import _WHITE, hashes

#: Pieces that one query gets at most, by number and bytes, and that a worker remembers.
QUERY_PIECES, QUERY_BYTES, REMEMBERED = 60_000, 2 << 20, 700_000
#: Bytes of units that a worker remembers.
REMEMBERED_BYTES = 64 << 20
#: The sum of the squares of their lengths: a step of the query keeps its sequence of each piece.
QUERY_SQUARES = 24 << 20
#: Pieces of more bytes are encoded in blocks of BLOCK_BYTES; tokens on either side of a seam that are encoded anew at first.
LONG_BYTES, BLOCK_BYTES, SEAM = 128, 64, 4
#: Parts of more bytes go to the second query.
MANY_BYTES = 512

#: One row a piece and step; a piece without a pair of a rank drops out, so its last row is its result.
ENCODE = """
WITH RECURSIVE state(piece, ids, step) AS (
    SELECT piece, ids, 0 FROM seeds
    UNION ALL
    SELECT state.piece, list_concat(list_append(state.ids[:best.place - 1], best.merged), state.ids[best.place + 2:]), step + 1
    FROM state JOIN (
        SELECT piece, (min((rank << 32) | place) & 4294967295)::INTEGER AS place, (min((rank << 32) | place) >> 32)::INTEGER AS merged
        FROM (SELECT piece, unnest(range(1, len(ids))) AS place, unnest(ids[:-2]) AS id, unnest(ids[2:]) AS next_id FROM state) AS pairs
        JOIN merges ON pair = id::BIGINT * 4294967296 + next_id
        GROUP BY piece
    ) AS best ON state.piece = best.piece
)
SELECT piece, arg_max(ids, step) AS ids FROM state GROUP BY piece
"""
#: The same with all pairs of the lowest rank contracted in a step, from the left, up to the first that makes a pair of a lower
#: rank with a neighbour; of a run of equal ids every other pair. Only the last sequence of a piece is held.
ENCODE_LONG = """
WITH RECURSIVE state(piece, ids) USING KEY (piece) AS (
    SELECT piece, ids FROM seeds
    UNION
    SELECT piece, list(CASE WHEN keep THEN best ELSE id END ORDER BY place) FILTER (NOT covered) AS ids
    FROM (
        SELECT *, coalesce(lag(keep) OVER (PARTITION BY piece ORDER BY place), false) AS covered
        FROM (
            SELECT place.*, take AND place <= coalesce(min(CASE WHEN take AND (l.rank < best OR r.rank < best) THEN place END) OVER (PARTITION BY piece), place) AS keep
            FROM (
                SELECT *, CASE WHEN lag(take, 2) OVER w THEN best ELSE lag(id) OVER w END AS before
                FROM (
                    SELECT *, coalesce(rank = best, false) AND row_number() OVER (PARTITION BY piece, run, rank = best ORDER BY place) % 2 = 1 AS take
                    FROM (
                        SELECT *, sum(CASE WHEN rank = best THEN 0 ELSE 1 END) OVER (PARTITION BY piece ORDER BY place) AS run
                        FROM (
                            SELECT tokens.*, rank, (min(rank) OVER (PARTITION BY piece))::INTEGER AS best
                            FROM (SELECT piece, unnest(range(1, len(ids) + 1)) AS place, unnest(ids) AS id, unnest(list_append(ids[2:], NULL::INTEGER)) AS next_id, unnest(list_concat(ids[3:], [NULL::INTEGER, NULL::INTEGER])) AS third FROM state WHERE len(ids) > 1) AS tokens
                            LEFT JOIN merges ON pair = id::BIGINT * 4294967296 + next_id
                        ) WHERE best IS NOT NULL
                    )
                ) WINDOW w AS (PARTITION BY piece ORDER BY place)
            ) AS place
            LEFT JOIN merges AS l ON take AND l.pair = before::BIGINT * 4294967296 + best
            LEFT JOIN merges AS r ON take AND r.pair = best::BIGINT * 4294967296 + third
        )
    ) GROUP BY piece
)
SELECT piece, ids FROM state
"""
DECODE = """
SELECT piece, string_agg(hex, '' ORDER BY place) AS hex
FROM (SELECT piece, unnest(range(1, len(ids) + 1)) AS place, unnest(ids) AS id FROM encoded) AS tokens JOIN vocabulary USING (id)
GROUP BY piece
"""


class Codec:
    """Pieces to ids and back by the ranks of a vocabulary file, through one in-memory database."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.white_pair = regex.compile(r"\s\s").search
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        rules = [
            (a * 4294967296 + b, i)
            for token, i in ranks.items()
            for k in range(1, len(token))
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None
        ]
        self._load("merges", pa.table({"pair": pa.array([r[0] for r in rules], pa.int64()), "rank": pa.array([r[1] for r in rules], pa.int64())}))
        self._load("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {i: token for token, i in ranks.items()}
        self.pieces: dict[bytes, tuple[list[int], bytes]] = {}
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.sizes: list[int] = []
        self.listed: list[bytes] = []
        self.decoded: list[bytes] = []

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("loaded", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def _merged(self, batch: list[bytes], whole: bool = True) -> list[list[int]]:
        """The ids of each part; `whole`: a part that is itself a token is that token, else all start from their bytes."""
        ids = [[self.ranks[p]] if whole and p in self.ranks else self.of_byte[np.frombuffer(p, np.uint8)] for p in batch]
        self.db.register("seeds", pa.table({"piece": pa.array(range(len(batch)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
        found = self.db.sql(ENCODE_LONG if max(map(len, batch)) > MANY_BYTES else ENCODE).to_arrow_table()
        self.db.unregister("seeds")
        out: list[list[int]] = [[]] * len(batch)
        for i, own in zip(found["piece"].to_pylist(), found["ids"].to_pylist()):
            out[i] = own
        return out

    def _decoded(self, encoded: list[list[int]]) -> list[bytes]:
        self.db.register("encoded", pa.table({"piece": pa.array(range(len(encoded)), pa.int32()), "ids": pa.array(encoded, pa.list_(pa.int32()))}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("encoded")
        out = [b""] * len(encoded)
        for i, own in zip(found["piece"].to_pylist(), found["hex"].to_pylist()):
            out[i] = bytes.fromhex(own)
        return out

    def _batches(self, parts: Iterable[bytes]) -> Iterator[list[bytes]]:
        batch, held, squares = [], 0, 0
        for p in parts:
            batch.append(p)
            held += len(p)
            squares += len(p) ** 2 * (len(p) <= MANY_BYTES)  # of longer ones the query holds the last sequence alone
            if len(batch) >= QUERY_PIECES or held >= QUERY_BYTES or squares >= QUERY_SQUARES:
                yield batch
                batch, held, squares = [], 0, 0
        if batch:
            yield batch

    def _parts(self, parts: Iterable[bytes], known: dict[bytes, list[int]]) -> None:
        """Add the ids of parts of pieces to those known; parts of like length share a query."""
        new = sorted({p for p in parts if p not in known}, key=len)
        cut = next((i for i, p in enumerate(new) if len(p) > MANY_BYTES), len(new))
        for some in (new[:cut], new[cut:]):
            for batch in self._batches(some):
                known.update(zip(batch, self._merged(batch, whole=False)))

    def _long(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of long pieces: those of their blocks, mended at the seams; the parts of all pieces share queries."""
        known: dict[bytes, list[int]] = {}
        stable: dict[tuple[int, int], bool] = {}
        blocks = [[piece[i : i + BLOCK_BYTES] for i in range(0, len(piece), BLOCK_BYTES)] for piece in pieces]
        self._parts((b for own in blocks for b in own), known)
        segments = [[known[b] for b in own] for own in blocks]
        out: list[list[int]] = [[]] * len(pieces)
        token, width, left = self.tokens.__getitem__, SEAM, list(range(len(pieces)))
        while left:
            seams = {(a[-1], b[0]) for p in left for a, b in zip(segments[p], segments[p][1:])} - stable.keys()
            self._parts((token(a) + token(b) for a, b in seams), known)
            stable |= {(a, b): known[token(a) + token(b)] == [a, b] for a, b in seams}
            around: dict[int, dict[int, bytes]] = {}
            for p in left:
                own, last = segments[p], -2
                for i, (a, b) in enumerate(zip(own, own[1:])):
                    if not stable[a[-1], b[0]] and i > last + 1:  # neighbouring seams take turns
                        around.setdefault(p, {})[i] = b"".join(map(token, a[-width:] + b[:width]))
                        last = i
                if p not in around:
                    out[p] = [i for part in own for i in part]
            self._parts((part for own in around.values() for part in own.values()), known)
            for p, own in around.items():
                mended: list[list[int]] = []
                for i, part in enumerate(segments[p]):
                    if i - 1 in own:
                        part = part[width:]
                    if i in own:
                        mended += [part[:-width], known[own[i]]]
                    else:
                        mended.append(part)
                segments[p] = [part for part in mended if part]
            left = list(around)
            width *= 2
        return out

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Encode the pieces that are new."""
        new = [p for p in pieces if p not in self.pieces]
        for batch in self._batches(p for p in new if len(p) <= LONG_BYTES):
            ids = self._merged(batch)
            self.pieces.update(zip(batch, zip(ids, self._decoded(ids))))
        for batch in self._batches(p for p in new if len(p) > LONG_BYTES):
            whole = {p: [self.ranks[p]] for p in batch if p in self.ranks}
            rest = [p for p in batch if p not in whole]
            whole |= zip(rest, self._long(rest))
            ids = [whole[p] for p in batch]
            self.pieces.update(zip(batch, zip(ids, self._decoded(ids))))

    def rows(self, units: list[bytes]) -> list[int]:
        """Places of units, each some whole pieces, in the lists of sizes, decimal ids and decoded bytes."""
        new = {u: [p.encode() for p in self.find(u.decode())] for u in units if u not in self.index}
        if new:
            self.held += sum(map(len, new))
            if len(self.index) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES:
                self.index.clear(), self.pieces.clear()
                self.held = sum(map(len, units))
                self.sizes.clear(), self.listed.clear(), self.decoded.clear()
                new = {u: [p.encode() for p in self.find(u.decode())] for u in units}
            self.learn(dict.fromkeys(p for own in new.values() for p in own))
            for u, own in new.items():
                self.index[u] = len(self.sizes)
                if len(own) == 1:
                    ids, back = self.pieces[own[0]]
                else:
                    ids = [i for p in own for i in self.pieces[p][0]]
                    back = b"".join(self.pieces[p][1] for p in own)
                self.sizes.append(len(ids))
                self.listed.append(("%d," * len(ids) % tuple(ids)).encode())
                self.decoded.append(back)
        return list(map(self.index.__getitem__, units))

    def units(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buffer, starts and ends of units of texts without two white-space characters in a row, joined by line breaks.

        There the pattern always breaks before a space and around any other white space, so a word with the space before
        it, or a white-space character that no word follows, is some whole pieces.
        """
        data = np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        white = _WHITE[data]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        joint = np.zeros(len(data), bool)
        joint[np.concatenate([[0], np.cumsum(sizes)])] = True
        space = (data == 32) & ~joint
        opens = np.zeros(len(data), bool)
        word = ~white
        opens[1:] = word[1:] & white[:-1] & ~space[:-1]
        opens |= white & ~joint
        closes = np.zeros(len(data) + 1, bool)
        closes[1:][word & np.append(white[1:], True)] = True
        closes[1:][white & ~joint & ~(space & np.append(word[1:], False))] = True
        return data, np.flatnonzero(opens), np.flatnonzero(closes)


@cache
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digester(ranks_path: str, pattern: str, with_ids: bool = False) -> Callable[[list[bytes | None]], dict]:
    """A step from texts to token counts and digests of the ids and of the decoded bytes; `with_ids` adds both themselves."""
    own = codec(ranks_path, pattern)

    def step(texts: list[bytes | None]) -> dict:
        plain = [t if t and not own.white_pair(t.decode()) else None for t in texts]
        data, starts, ends = own.units(plain)
        key = hashes(data, starts, ends)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()
        odd = {i: [p.encode() for p in own.find(t.decode())] for i, t in enumerate(texts) if t and plain[i] is None}
        different = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        places = own.rows(different + list({p for ps in odd.values() for p in ps}))
        if len(own.index) < len(different):
            raise RuntimeError("one batch holds more pieces than a worker may remember")
        place = np.array(places[: len(different)], np.int64)[inverse]
        bounds = np.searchsorted(starts, np.concatenate([[1], 1 + np.cumsum([len(t or b"") + 1 for t in plain])]))
        listed, decoded, sizes = own.listed.__getitem__, own.decoded.__getitem__, own.sizes.__getitem__
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
        for i in range(len(texts)):
            at = [own.index[p] for p in odd[i]] if i in odd else place[bounds[i] : bounds[i + 1]].tolist()
            ids, back = b"".join(map(listed, at))[:-1], b"".join(map(decoded, at))
            out["n_tokens"].append(sum(map(sizes, at)))
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if with_ids:
                out["ids"].append(list(map(int, ids.split(b","))) if ids else [])
                out["decoded"].append(back)
        return out

    return step


def encode(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """`keep`, the number of tokens of each text, and SHA-256 of its ids and of what they decode to."""
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return map_texts(docs, keep, lambda: digester(ranks_path, pattern, with_ids), T.StructType([*SCHEMA, *more * with_ids]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    return encode(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
