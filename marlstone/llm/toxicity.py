"""Toxicity behind disguises: a noisy channel restores words, then the restored text is scored.

Disguised words (digits or signs among letters or in their place, letters repeated) of any length become lattices of
characters: a sign may stand for the letters it resembles, a separator or a repeated letter may be dropped. Runs of letters set
apart become one lattice, in which every space between them may be dropped or end a word. Known words stand for themselves, and
so do numbers and words of mostly signs behind which there is no known word. Viterbi decoding under a trigram model of
characters, counted over the words of all texts outside the held-out fold, and the odds that a word is a known one picks the
restored words. Restored texts are scored by a
logistic regression on counts of word beginnings, of three letters up to the whole word, that the training sample shows to
go with the label, and on the number of words: with counts that follow a Poisson law that is the likelihood ratio.

Only the regression learns from a bounded sample: TRAIN_ROWS labelled rows outside the held-out fold in order of a hash of the
id, of texts up to TRAIN_CHARS characters, each read whole. Words and trigrams are counted by Spark, so that they grow with
the corpus; the driver gets the trigrams and eight bytes for each known word.

Defined results: null and empty texts get the score of a text without words; with no row, or no row of a class, to learn
from, all scores are the share of the label (0 without rows); equal texts get equal scores; columns other than the id, the
text and, for training, the label are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from math import log
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import CACHE_WORDS, bound_batches, chunks, fields, held_out, map_texts, table, written
from marlstone.llm.quality_fm import labelled_rows, sigmoid
from marlstone.llm.words import mix, words_of

TRAIN_ROWS, TRAIN_CHARS = 6000, 40_000
#: Letters that signs stand for (fixed values).
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou",
}
#: Signs that may stand between letters and be dropped (fixed values).
SEPARATORS = "._-~*'`^,:;/\\+=|"
#: Costs, as log probabilities, of a letter standing for itself, of a sign for a letter, of dropping a separator or a repeat.
KEEP, SUBSTITUTE, DROP, REPEAT = 0.0, -1.0, -0.7, -0.9
#: The same of a space between lone letters that ends a word, and of a word that texts hold against one of likely letters alone.
BREAK, KNOWN = -3.0, 6.0
#: Words of the language have at most so many letters, disguises any number; so many lone letters in a row may hide words.
LONGEST, LONE = 40, 3
LENGTHS = (3, 4, 5, 6, 7)
#: Units in which the weights of trigrams are summed; different words that a task counts before it passes them on.
UNIT, HELD_WORDS = 1 << 20, 200_000
MAX_FEATURES, MIN_EVIDENCE, MIN_RATIO = 600, 14.0, 2.0

#: Characters that the decoder reads at a time, after which it keeps what all paths share.
STRIDE = 256

_trim = re.compile(r"^[^\w@$|(!+*#]+|[^\w@$|]+$")
#: The same, with all signs that resemble letters left at the end.
_trim_wide = re.compile(r"^[^\w@$|(!+*#]+|[^\w@$|(<€£!+*#]+$")
_drawn_out = re.compile(r"(.)\1\1")
_doubled = re.compile(r"(?:(.)\1+)+")
_repeat = re.compile(r"(.)\1")
_long_run = re.compile(r"(.)\1{2,}", re.S)
_inner_sign = re.compile(rf"(?!\A)[{re.escape(''.join(c for c in RESEMBLES if not c.isalnum() and c not in SEPARATORS))}](?!\Z)")


def disguised(word: str) -> bool:
    """Whether a lower-case word has signs among its letters or in their place, or a letter twice in a row.

    Numbers, with a currency's sign at an edge or separators between, are none.
    """
    own = sum(map(str.isalpha, word))
    return len(word) >= 3 and (own < len(word) and (own > 0 or bool(_inner_sign.search(word))) or bool(own and _repeat.search(word)))


def mostly_signs(word: str) -> bool:
    """Whether letters are too few to make a word likely that is not known."""
    own = sum(map(str.isalpha, word))
    return own < 2 or 3 * own < len(word)


def collapsed(word: str) -> str:
    """A word with runs of a separator as one of it, and other runs as two of a kind."""
    return _long_run.sub(lambda m: m[1] if m[1] in SEPARATORS else 2 * m[1], word)


def word_key(word: str) -> int:
    """A 64-bit hash of a word, the same in all processes."""
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def add_words(texts: list[bytes | None], counts: dict[str, int]) -> None:
    """Add the plain words of texts, in lower case and without edge signs, to their counts."""
    data, starts, ends, _, ids = words_of(texts)
    _, first, n = np.unique(ids, return_index=True, return_counts=True)
    raw = data.tobytes()
    for s, e, times in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
        core = _trim.sub("", raw[s:e].decode().lower())
        if core.isalpha() and len(core) <= LONGEST and not _drawn_out.search(core) and not _doubled.fullmatch(core):
            counts[core] = counts.get(core, 0) + times


def add_grams(word: str, n: int, grams: dict[str, int]) -> None:
    """Add the weight of a word met n times to its characters, pairs and trigrams, in whole units, so that order is no matter."""
    padded = f"\x02\x02{word}\x03"
    weight = round(log(1 + n) * UNIT)
    for i in range(2, len(padded)):
        for k in (1, 2, 3):
            g = padded[i - k + 1 : i + 1]
            grams[g] = grams.get(g, 0) + weight


class Channel:
    """Character trigrams with interpolated lower orders, the known words, and the decoder over them."""

    def __init__(self, grams: dict[str, int], known: Iterable[int]) -> None:
        """grams: weights in units of 1 / UNIT; known: the hashes of words met twice or more."""
        self.grams: tuple[dict[str, float], ...] = ({}, {}, {})
        for g in sorted(grams):
            self.grams[len(g) - 1][g] = grams[g] / UNIT
        self.total = sum(self.grams[0].values()) or 1.0
        self.sums: tuple[dict[str, float], ...] = ({}, {})
        for k in (1, 2):
            for g, n in self.grams[k].items():
                self.sums[k - 1][g[:-1]] = self.sums[k - 1].get(g[:-1], 0.0) + n
        self.known = np.unique(np.asarray(known, np.int64))
        self.cost: dict[str, float] = {}
        self.memory: dict[str, str] = {}

    @classmethod
    def of(cls, words: dict[str, int]) -> Channel:
        """A channel from the counts of words."""
        grams: dict[str, int] = {}
        for word, n in words.items():
            add_grams(word, n, grams)
        return cls(grams, [word_key(w) for w, n in words.items() if n > 1])

    def knows(self, word: str) -> bool:
        key = word_key(word)
        at = int(self.known.searchsorted(key))
        return at < len(self.known) and int(self.known[at]) == key

    def score(self, before: str, char: str) -> float:
        """Log probability of a character after two others."""
        g = before + char
        found = self.cost.get(g)
        if found is None:
            p = (self.grams[0].get(char, 0.0) + 0.05) / (self.total + 10)
            for k, weight in ((1, 0.7), (2, 0.8)):
                context = before[2 - k :]
                seen = self.sums[k - 1].get(context, 0.0)
                if seen:
                    p = weight * self.grams[k].get(context + char, 0.0) / seen + (1 - weight) * p
            self.cost[g] = found = log(p)
        return found

    def decode(self, word: str) -> str:
        """The likeliest word behind a disguised one."""
        word = collapsed(word)
        found = self.memory.get(word)
        if found is None:
            found = self._viterbi(word)
            if len(word) <= STRIDE:
                if len(self.memory) > CACHE_WORDS // 4:
                    self.memory.clear()
                self.memory[word] = found
        return found

    def segment(self, run: str) -> list[str]:
        """The likeliest words behind a run of lone letters: a lattice of characters and of word ends, a word of at most twice
        LONGEST characters between two ends."""
        run = collapsed(run)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-np.inf, 0, "")] * len(run)
        for i in range(len(run)):
            states, last = {"\x02\x02": (best[i][0] + (BREAK if i else 0.0), "")}, ""
            for j in range(i, min(len(run), i + 2 * LONGEST)):
                states, last = self._step(states, run[j], last)
                cost, word = self._end(states, "")
                if word and cost > best[j + 1][0]:
                    best[j + 1] = cost, i, word
        words, at = [], len(run)
        while at:
            words.append(best[at][2])
            at = best[at][1]
        return words[::-1]

    def _step(self, states: dict[str, tuple[float, str]], char: str, last: str) -> tuple[dict[str, tuple[float, str]], str]:
        """The best way to each pair of last letters after one more character, and what a repeat would repeat."""
        options = [(char, KEEP)] if char.isalpha() else []
        options += [(c, SUBSTITUTE) for c in RESEMBLES.get(char, "")]
        drop = DROP if char in SEPARATORS else REPEAT if char == last else None
        if not options and drop is None:
            drop = 2 * DROP
        step: dict[str, tuple[float, str]] = {}
        for state, (cost, out) in states.items():
            for c, price in options:
                to, value = state[1] + c, cost + price + self.score(state, c)
                if to not in step or value > step[to][0]:
                    step[to] = value, out + c
            if drop is not None and (state not in step or cost + drop > step[state][0]):
                step[state] = cost + drop, out
        return step, last if char in SEPARATORS else char

    def _end(self, states: dict[str, tuple[float, str]], head: str) -> tuple[float, str]:
        """The cost and letters of the best way that ends a word here; `head` are its letters that are settled."""
        return max(((cost + self.score(s, "\x03") + KNOWN * self.knows(head + out), head + out) for s, (cost, out) in states.items()), default=(0.0, head))

    def _viterbi(self, word: str) -> str:
        states: dict[str, tuple[float, str]] = {"\x02\x02": (0.0, "")}
        last, shared = "", []
        for i, char in enumerate(word):
            if i and i % STRIDE == 0:  # what all paths begin with is settled, so that long words take time in proportion
                own = commonprefix([out for _, out in states.values()])
                shared.append(own)
                states = {s: (cost, out[len(own) :]) for s, (cost, out) in states.items()}
            states, last = self._step(states, char, last)
        return self._end(states, "".join(shared))[1] if states else word


def restore(word: str, channel: Channel) -> str:
    """A word in lower case without edge signs, decoded if it is disguised; a sign at its end may be its last letter."""
    core = _trim.sub("", word)
    if core.isalpha() and (not _repeat.search(core) or channel.knows(core)):
        return core
    likeliest = channel.decode(core) if disguised(core) else core
    if channel.knows(likeliest):
        return likeliest
    wide = _trim_wide.sub("", word)
    if wide != core and disguised(wide):
        found = channel.decode(wide)
        if channel.knows(found):
            return found
    return core if mostly_signs(core) else likeliest


def restored_words(texts: list[bytes | None], channel: Channel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different restored words, and for each word of the texts its place among them and its text; words set apart letter
    by letter are added as one word."""
    data, starts, ends, doc, ids = words_of(texts)
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    raw = data.tobytes()
    different = [restore(raw[s:e].decode().lower(), channel) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    lone = np.fromiter((len(w) == 1 for w in different), bool, len(different))[inverse]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
    more, where = [], []
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        while b - a >= LONE:
            to = int(np.searchsorted(doc[a:b], doc[a], "right")) + a
            if to - a >= LONE:
                for word in channel.segment("".join(different[i] for i in inverse[a:to])):
                    if len(word) > 1:
                        more.append(word), where.append(doc[a])
            a = to
    place = np.concatenate([inverse, np.arange(len(different), len(different) + len(more))]).astype(np.int64)
    return different + more, place, np.concatenate([doc, np.array(where, np.int64)]).astype(np.int64)


def beginnings(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings of words, of LENGTHS letters and whole, and the word of each."""
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    place = np.arange(len(points)) - np.repeat(starts, size + 1)
    sums = np.append(np.uint64(0), np.cumsum(mix(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)))))
    keys, owners = [], []
    for n in LENGTHS:
        at = np.flatnonzero(size >= n)
        keys.append(mix(sums[starts[at] + n] - sums[starts[at]] + np.uint64(n))), owners.append(at)
    at = np.flatnonzero(size)
    keys.append(mix(sums[ends[at]] - sums[starts[at]])), owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


class Scorer:
    """Chosen beginnings in order of their hash, and the weights of their counts, of the number of words and of the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, channel: Channel) -> None:
        self.keys, self.weights, self.bias, self.channel = keys, weights, bias, channel

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        """Texts by features: counts of the chosen beginnings, damped, then thousands of words."""
        words, place, doc = restored_words(texts, self.channel)
        out = np.zeros((len(texts), len(self.keys) + 1))
        if not words:
            return out
        out[:, -1] = np.bincount(doc, minlength=len(texts)) / 1000
        if len(self.keys):
            key, owner = beginnings(words)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            feature, owner = at[hit], owner[hit]
            order = np.argsort(owner, kind="stable")
            feature, owner = feature[order], owner[order]
            low, high = np.searchsorted(owner, place, "left"), np.searchsorted(owner, place, "right")
            held = np.flatnonzero(high > low)
            spans = (high - low)[held]
            pick = np.repeat(low[held] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            np.add.at(out, (np.repeat(doc[held], spans), feature[pick]), 1)
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return sigmoid(self.counts(texts) @ self.weights + self.bias)


def train(texts: list[bytes], labels: list[int], channel: Channel | None = None) -> Scorer:
    """Beginnings and weights from labelled texts, and a channel from their words unless one is given."""
    y = np.array(labels, float)
    if channel is None:
        vocabulary: dict[str, int] = {}
        for i in range(0, len(texts), 512):
            add_words(texts[i : i + 512], vocabulary)
        channel = Channel.of(vocabulary)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        bias = 30.0 * (2 * share - 1) if len(y) else -30.0
        return Scorer(np.empty(0, np.uint64), np.zeros(1), bias, channel)
    keys, seen = np.empty(0, np.uint64), np.empty((0, 2))
    words = np.zeros(2)
    for i in range(0, len(texts), 512):
        different, place, doc = restored_words(texts[i : i + 512], channel)
        own = y[i : i + 512][doc]
        key, owner = beginnings(different)
        by_word = np.stack([np.bincount(place, own == c, minlength=len(different)) for c in (0, 1)], 1)
        words += by_word.sum(0)
        merged = np.concatenate([keys, key])
        counts = np.concatenate([seen, by_word[owner]])
        keys, where = np.unique(merged, return_inverse=True)
        seen = np.stack([np.bincount(where, counts[:, c]) for c in (0, 1)], 1)
    both = seen.sum(1)
    expected = both[:, None] * words / words.sum()
    evidence = 2 * (seen * np.log(np.maximum(seen, 0.5) / expected)).sum(1)
    ratio = (seen[:, 1] + 0.5) / (expected[:, 1] + 0.5)
    ok = np.flatnonzero((evidence >= MIN_EVIDENCE) & (ratio >= MIN_RATIO) & (seen[:, 1] >= 5))
    ok = ok[np.argsort(-evidence[ok], kind="stable")][:MAX_FEATURES]
    scorer = Scorer(np.sort(keys[ok]), np.zeros(len(ok) + 1), 0.0, channel)
    x = np.concatenate([scorer.counts(texts[i : i + 512]) for i in range(0, len(texts), 512)])
    scorer.weights, scorer.bias = _logistic(x, y)
    return scorer


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by damped Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-2:] = 1e-4
    value = np.inf
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        hessian = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        move = np.linalg.solve(hessian, x1.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-3:
            new = w - size * move
            z = x1 @ new
            loss = float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * new * new).sum())
            if loss < value:
                break
            size /= 2
        else:
            break
        w, done, value = new, value - loss < 1e-6, loss
        if done:
            break
    return w[:-1], float(w[-1])


SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def rater(scorer: Scorer, threshold: float = 0.5) -> Callable[[list[bytes | None]], dict]:
    def step(texts: list[bytes | None]) -> dict:
        score = scorer.score(texts)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return step


def rate(docs: DataFrame, keep: list[str], scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """`keep`, the toxicity of each text and whether it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # trigrams, and eight bytes for each known word
    return map_texts(docs, keep, lambda: rater(shared.value, threshold), SCHEMA)


def vocabulary(docs: DataFrame) -> DataFrame:
    """The plain words of all texts outside the held-out fold, and how often each is met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for _, texts in chunks(batch):
                add_words(texts, counts)
                if len(counts) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})

    own = docs.where(~F.coalesce(held_out(), F.lit(False))).select("text")
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def channel_of(docs: DataFrame) -> Channel:
    """The channel of all texts outside the held-out fold; the driver gets trigrams and the hashes of known words."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, int] = {}
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                add_grams(word, n, own)
            if len(own) > HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"gram": list(own), "weight": list(own.values())})
                own.clear()
        if own:
            yield pa.RecordBatch.from_pydict({"gram": list(own), "weight": list(own.values())})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(map(word_key, batch.column("word").to_pylist()), pa.int64())})

    words = written(vocabulary(docs), "vocabulary")
    summed = words.mapInArrow(grams, "gram string, weight long").groupBy("gram").agg(F.sum("weight").alias("weight")).toArrow()
    known = words.where("n > 1").mapInArrow(keys, "key long").toArrow()
    return Channel(dict(zip(summed["gram"].to_pylist(), summed["weight"].to_pylist())), known["key"].to_numpy())


FITTED = fields("keys long[], weights double[], bias double")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer of the sample, which one task trains; the driver gets its weights, MAX_FEATURES at most."""
    channel = channel_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(channel)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        toxic: list[int] = []
        for batch in batches:
            texts += batch.column("text").cast(pa.binary()).to_pylist()
            toxic += batch.column("_label").to_pylist()
        own = train(texts, toxic, shared.value)
        yield pa.RecordBatch.from_pydict({"keys": [own.keys.view(np.int64).tolist()], "weights": [own.weights.tolist()], "bias": [own.bias]})

    rows = labelled_rows(docs, labels, "toxic", TRAIN_ROWS, TRAIN_CHARS).repartition(1)  # a bounded sample
    found = rows.mapInArrow(learn, FITTED).first()
    if found is None:  # an empty sample may have no task
        return train([], [], channel)
    return Scorer(np.array(found["keys"], np.int64).view(np.uint64), np.array(found["weights"], float), found["bias"], channel)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", "text", held_out().alias("held_out")), ["doc_id", "held_out"], scorer)
