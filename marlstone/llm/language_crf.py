"""Language ID by a linear-chain conditional random field over words.

Every word is a position of the chain. Its scores come from hashed character n-grams of one to four letters with the word's
edges marked, so prefixes and suffixes are features of their own, and from its classes in lexicons counted on the training
rows; transitions between the languages are learned with them. Training joins runs of words of different languages, so that
switches within a text are learned; forward-backward gives each word's marginals, a text's language has the largest sum.

The model learns from a bounded sample of labelled rows outside the held-out fold: of each of the LANGUAGES languages with most
rows its share of TRAIN_ROWS, and LEAST_ROWS at least where it has as many, so that rare ones are learned too. Rows have at most
TRAIN_CHARS characters, are taken in order of a hash of the id and read whole. Everything else covers all texts, and whole ones.

Defined results: `und` with score 0 if a text is null, empty or has no letter, or if there is no row to learn from; equal
texts get equal results; columns other than the id, the text and, for training, the label are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, held_out, map_texts, table
from marlstone.llm.words import mix, words_of

TRAIN_ROWS, TRAIN_CHARS = 1200, 20_000
LANGUAGES, LEAST_ROWS = 100, 100
#: Sizes of the hashed n-gram table, of training sequences in words, and of the lexicons in words a language.
BITS, SEQUENCE, LEXICON = 16, 64, 20_000
EPOCHS, RATE = 3, 0.25


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.frombuffer(bytes(chr(i).isalpha() if not 0xD800 <= i < 0xE000 else 0 for i in range(0x110000)), bool)


def shapes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words as (buckets, word of each), whether each word has a letter, and a hash of its letters."""
    text = b"\n" + b"\n".join(words) + b"\n"
    points = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    breaks = points == 10
    is_letter = letters()[points]
    points = np.where(is_letter, points, 10)  # what is no letter is an edge
    word = np.cumsum(breaks) - 1
    n = len(points)
    buckets, owners = [], []
    mixed = mix(points.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n, np.uint64)
    inner = np.ones(n, bool)
    for size in range(1, 5):
        m = n - size + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + mixed[size - 1 :]
        # edges may start or end an n-gram, not stand within it
        if size > 1:
            inner = inner[:m] & (is_letter[size - 2 : n - 1][:m] if size > 2 else True)
        ok = inner[:m] & (is_letter[:m] | is_letter[size - 1 :]) if size > 1 else is_letter
        at = np.flatnonzero(ok)
        buckets.append((mix(key[at] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int32))
        # an n-gram that starts at an edge belongs to the word of its first letter
        owners.append(word[at + (size > 1) * ~is_letter[at]])
    has = np.bincount(word[is_letter], minlength=len(words))[: len(words)] > 0
    place = np.arange(n) - np.maximum.accumulate(np.where(breaks, np.arange(n), 0))
    whole = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(whole, word[is_letter], mix(points[is_letter].astype(np.uint64) + (place[is_letter].astype(np.uint64) << np.uint64(24))))
    return np.concatenate(buckets), np.concatenate(owners), has, mix(whole[: len(words)])


class Model:
    """Weights: n-gram table, lexicon classes, transitions; languages in order."""

    def __init__(self, names: list[str]) -> None:
        k = len(names)
        self.names = names
        self.grams = np.zeros((1 << BITS, k))
        self.lexicon_keys = np.empty(0, np.uint64)
        self.lexicon_class = np.empty(0, np.int64)
        self.classes = np.zeros((k + 1, k))
        self.moves = np.zeros((k, k))

    def lexical(self, keys: np.ndarray) -> np.ndarray:
        """The lexicon class of each word; len(names) for none."""
        out = np.full(len(keys), len(self.names))
        if len(self.lexicon_keys):
            at = np.minimum(np.searchsorted(self.lexicon_keys, keys), len(self.lexicon_keys) - 1)
            hit = self.lexicon_keys[at] == keys
            out[hit] = self.lexicon_class[at[hit]]
        return out

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's scores of the languages, and whether it has a letter."""
        buckets, owner, has, key = shapes(words)
        size = np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        out = np.stack([np.bincount(owner, self.grams[buckets, j], minlength=len(words)) for j in range(len(self.names))], 1)
        return out / np.sqrt(size) + self.classes[self.lexical(key)], has


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: each position's marginals, and the expected moves of all chains.

    The chains advance together, the longest first, so each step is one array operation over those that still run.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    k = scores.shape[1]
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(local), np.empty_like(local)
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = first[: running[t]] + t
        now = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        alpha[at] = now / now.sum(1, keepdims=True)
    for t in range(longest - 1, -1, -1):
        at = first[: running[t]] + t
        more = running[t + 1] if t + 1 < longest else 0
        now = np.ones((len(at), k))
        if more:
            now[:more] = (beta[at[:more] + 1] * local[at[:more] + 1]) @ step.T
        beta[at] = now / now.sum(1, keepdims=True)
    both = alpha * beta
    gamma = both / both.sum(1, keepdims=True)
    inner = np.ones(len(scores), bool)
    inner[first[sizes > 0]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * step * (local[at] * beta[at])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return gamma, pair.sum(0)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from (text, language) rows by stochastic gradient steps on the chain's log-likelihood."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    model, k = Model(names), len(names)
    words: list[bytes] = []
    gold: list[int] = []
    for text, lang in rows:
        own = [w for w in text.encode().split() if any(map(str.isalpha, w.decode()))]
        words += own
        gold += [names.index(lang)] * len(own)
    if not words:
        return None
    label = np.array(gold)
    different = {w: i for i, w in enumerate(dict.fromkeys(words))}
    index = np.fromiter((different[w] for w in words), np.int64, len(words))
    buckets, owner, _, key = shapes(list(different))
    counts = np.zeros((len(different), k))
    np.add.at(counts, (index, label), 1)
    # lexicons: words met twice or more, three quarters of it in one language
    total, best = counts.sum(1), counts.argmax(1)
    entries = [np.flatnonzero((best == j) & (total >= 2) & (counts.max(1) >= 0.75 * total)) for j in range(k)]
    entries = np.concatenate([e[np.argsort(-total[e], kind="stable")][:LEXICON] for e in entries])
    entries = entries[np.argsort(key[entries])]
    model.lexicon_keys, model.lexicon_class = key[entries], best[entries]
    lexical = model.lexical(key)
    # a word's own count must not tell its label: words rare in training also train without their class
    starts = np.searchsorted(owner, np.arange(len(different)), "left") if np.all(owner[:-1] <= owner[1:]) else None
    if starts is None:
        order = np.argsort(owner, kind="stable")
        owner, buckets = owner[order], buckets[order]
        starts = np.searchsorted(owner, np.arange(len(different)), "left")
    ends = np.searchsorted(owner, np.arange(len(different)), "right")
    random = np.random.default_rng(seed)
    runs = [np.arange(i, min(i + SEQUENCE // 4, len(words))) for i in range(0, len(words), SEQUENCE // 4)]
    runs = [r[label[r] == label[r[0]]] for r in runs]
    squares = [np.full(a.shape, 1e-2) for a in (model.grams, model.classes, model.moves)]
    for _ in range(EPOCHS):
        order = random.permutation(len(runs))
        for i in range(0, len(order), 512):
            own = [runs[j] for j in order[i : i + 512]]
            at = np.concatenate(own)
            sizes = np.array([sum(map(len, own[j : j + 4])) for j in range(0, len(own), 4)])
            use, back = np.unique(index[at], return_inverse=True)
            spans_ = ends[use] - starts[use]
            pick = np.repeat(starts[use] - np.cumsum(spans_) + spans_, spans_) + np.arange(spans_.sum())
            holder, bucket = np.repeat(np.arange(len(use)), spans_), buckets[pick]
            scale = 1 / np.sqrt(np.maximum(spans_, 1))
            hidden = random.random(len(use)) < 0.3
            lexicon = np.where(hidden, k, lexical[use])
            base = np.stack([np.bincount(holder, model.grams[bucket, j], minlength=len(use)) for j in range(k)], 1) * scale[:, None]
            gamma, moved = marginals((base + model.classes[lexicon])[back], sizes, model.moves)
            error = gamma.copy()
            error[np.arange(len(at)), label[at]] -= 1
            slope = np.stack([np.bincount(back, error[:, j], minlength=len(use)) for j in range(k)], 1)
            firsts = np.zeros(len(at), bool)
            firsts[np.cumsum(sizes) - sizes] = True
            inner = np.flatnonzero(~firsts)
            gold_moves = np.zeros((k, k))
            np.add.at(gold_moves, (label[at[inner - 1]], label[at[inner]]), 1)
            touched, where = np.unique(bucket, return_inverse=True)
            flat = (slope * scale[:, None])[holder]
            grads = np.stack([np.bincount(where, flat[:, j], minlength=len(touched)) for j in range(k)], 1)
            by_class = np.zeros_like(model.classes)
            np.add.at(by_class, lexicon, slope)
            for values, square, g, rows_ in ((model.grams, squares[0], grads, touched), (model.classes, squares[1], by_class, slice(None)), (model.moves, squares[2], moved - gold_moves, slice(None))):
                g = g / len(own) + 1e-5 * values[rows_]
                square[rows_] += g * g
                values[rows_] -= RATE * g / np.sqrt(square[rows_])
    model.grams = model.grams.astype(np.float32)
    return model


def labeller(model: Model | None) -> Callable[[list[bytes | None]], dict]:
    """A step from texts to language, score, words with letters, and switches between neighbouring words' languages."""

    def step(texts: list[bytes | None]) -> dict:
        out = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "n_words": [0] * len(texts), "n_switches": [0] * len(texts)}
        data, starts, ends, doc, ids = words_of(texts)
        if model is None or not len(starts):
            return out
        _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        raw = data.tobytes()
        scores, has = model.scores([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        at = np.flatnonzero(has[inverse])
        if not len(at):
            return out
        owner = doc[at]
        sizes = np.bincount(owner, minlength=len(texts))
        gamma, _ = marginals(scores[inverse[at]], sizes, model.moves)
        sums = np.stack([np.bincount(owner, gamma[:, j], minlength=len(texts)) for j in range(gamma.shape[1])], 1)
        likely = gamma.argmax(1)
        switch = np.append(0, (likely[1:] != likely[:-1]) & (owner[1:] == owner[:-1]))
        switches = np.bincount(owner, switch, minlength=len(texts)).astype(int)
        for d in np.flatnonzero(sizes):
            j = int(sums[d].argmax())
            out["lang_pred"][d] = model.names[j]
            out["score"][d] = float(min(1.0, sums[d, j] / sizes[d]))
        return out | {"n_words": sizes, "n_switches": switches}

    return step


SCHEMA = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType())]
)


def drawn(labelled: DataFrame) -> DataFrame:
    """The ids of the training rows of (doc_id, lang): only a few times as many as are drawn leave the tasks."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).collect()
    total = sum(r._n for r in counts)
    quotas = [(r.lang, max(LEAST_ROWS, round(TRAIN_ROWS * r._n / total)), r._n) for r in counts]
    spark = labelled.sparkSession
    limits = spark.createDataFrame([(lang, quota, int((1 << 31) * min(1.0, (3 * quota + 300) / n))) for lang, quota, n in quotas], "lang string, _quota int, _most long")
    value = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    some = labelled.select("doc_id", "lang", value.alias("_value")).join(F.broadcast(limits), "lang").where("_value < _most")
    order = Window.partitionBy("lang").orderBy("_value", "doc_id")
    return some.withColumn("_k", F.row_number().over(order)).where("_k <= _quota").select("doc_id").distinct()


def fit(docs: DataFrame) -> Model | None:
    """A model of a bounded sample: ids are drawn first, and only they meet the texts."""
    labelled = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    ids = drawn(labelled.select("doc_id", "lang"))
    most = 2 * (TRAIN_ROWS + LANGUAGES * LEAST_ROWS)  # ids may repeat
    rows = labelled.join(F.broadcast(ids), "doc_id").select("text", "lang").orderBy(F.xxhash64("text"), "text", "lang").limit(most).collect()
    return train(sorted((r.text, r.lang) for r in rows))


def identify(docs: DataFrame, keep: list[str], model: Model | None) -> DataFrame:
    """`keep`, the language of each text by the model, its score, and the numbers of words and of switches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights: 2**BITS rows, whatever the corpus
    return map_texts(docs, keep, lambda: labeller(shared.value), SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), ["doc_id", "held_out"], fit(docs))
