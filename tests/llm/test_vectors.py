"""Whitening, the prefix trie and nearest neighbours against brute force, and their defined results of odd input."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest

from conftest import SF

SF1 = f"{os.path.dirname(SF)}/sf0.01"
ODD = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e30, 1.0, 0.0, 0.0]]


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, None, "x") for i, e in rows], "vec_id long, embedding array<double>, label int, x string")


def whitened_by_hand(rows):
    x = {(i, k): np.array([int(np.floor(64 * c)) + 1_000_000 for c in e]) for k, (i, e) in enumerate(rows)}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    away = fit - s / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    return x, n, s, values[::-1], axes[:, ::-1].T


def test_symmetric_qr():
    from marlstone.llm.whitening import symmetric_qr

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        for kind in range(4):
            a = rng.normal(size=(n, n))
            a = a + a.T if kind == 0 else np.diag(np.arange(n) // 2).astype(float) if kind == 1 else a[:, :1] @ a[:, :1].T if kind == 2 else np.zeros((n, n))
            values, axes = symmetric_qr(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, n)) and np.allclose(axes @ axes.T, np.eye(n), atol=1e-12)
            assert np.allclose(axes.T @ np.diag(values) @ axes, a, atol=1e-11 * max(1, n))


def test_moments_merge_as_if_one():
    from marlstone.llm.whitening import Moments

    x = np.random.default_rng(1).normal(size=(50, 5)) + 1e6
    parts = [Moments(5) for _ in range(4)]
    for m, rows in zip(parts, (x[:1], x[1:20], x[20:20], x[20:]), strict=True):
        m.add(rows)
    total = Moments(5)
    for m in parts:
        total.merge(m)
    assert total.n == 50 and np.allclose(total.mean, x.mean(0)) and np.allclose(total.products / 50, np.cov(x.T, bias=True))


def test_whitening_matches_brute_force(spark):
    from marlstone.llm.whitening import op11, whiten

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF1}/embeddings.parquet").collect()]
    found = op11(spark, SF1).collect()
    x, n, s, values, axes = whitened_by_hand(rows)
    assert len(found) == 16 * len(rows)
    own = {i: v for (i, _), v in x.items()}
    sign = {}
    for r in found:
        c = r.component - 1
        want = (own[r.vec_id] - s / n) @ axes[c] / np.sqrt(values[c])
        if abs(want) > 0.1:
            sign.setdefault(c, np.sign(want * r.whitened))
        assert abs(r.whitened * sign.get(c, 1) - want) < 1e-7 or abs(r.whitened + want) < 1e-7
        assert r.n == n and r.deviation == sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(own[r.vec_id], s, strict=True))
        assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    assert whiten(vectors(spark, [])).count() == 0


def test_whitening_of_odd_rows(spark):
    from marlstone.llm.whitening import whiten

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(20)] + [(3, [0.5] * 4), (3, [0.5] * 4), (None, [0.25] * 4), (50, [0.0] * 4)]
    alone = [(60, [1.0, 2.0]), (61, [1.0, 2.001])]  # one vector of integers: no variance
    huge = [(70, [2.0**50, 0.0, 1.0]), (71, [-(2.0**50), 5.0, 1.0]), (72, [3.0, 5.0, 1.0])]
    found = whiten(vectors(spark, rows + [(100 + i, e) for i, e in enumerate(ODD) if e != [0.0] * 4] + alone + huge).repartition(7)).collect()
    count = collections.Counter((r.vec_id, r.component) for r in found)
    assert count[(3, 1)] == 3 and count[(None, 4)] == 1 and count[(60, 2)] == 1 and not any((i or 0) >= 100 for i, _ in count)
    x, n, s, values, _ = whitened_by_hand(rows)
    assert {r.n for r in found if (r.vec_id or 0) < 60} == {n} and len([r for r in found if (r.vec_id or 0) < 60]) == 4 * len(rows)
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in found if r.vec_id in (60, 61))
    assert {r.deviation for r in found if r.vec_id == 70} == {None} and {r.whitened is None for r in found if r.vec_id == 70 and r.component == 3} == {True}


def trie_by_hand(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    turns = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = collections.Counter(t[:-1] for t in members if t)
    leaves, saved = collections.Counter(), collections.Counter()
    for t, m in members.items():
        for d in range(len(t) + 1):
            leaves[t[:d]] += kids[t] == 0
            saved[t[:d]] += (len(m) - 1) * len(t[-1][1].encode()) if t else 0
    sha = lambda t: hashlib.sha256(",".join(map(str, sorted(ends[t]))).encode()).hexdigest()
    return sorted((min(m), len(t), min(members[t[:-1]]) if t else -1, len(m), kids[t], leaves[t], saved[t], sha(t)) for t, m in members.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CONV = "conv_id long, turn int, role string, text string, node string, span int"


def test_trie_matches_brute_force(spark):
    from marlstone.llm.prefix_trie import op12, trie

    rows = [tuple(r) for r in spark.read.parquet(f"{SF1}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(op12(spark, SF1)) == trie_by_hand(rows)
    assert trie(spark.createDataFrame([], CONV)).count() == 0


def test_trie_of_odd_rows(spark, monkeypatch):
    from marlstone.llm import prefix_trie

    rng = np.random.default_rng(2)
    rows = [(int(c), int(t) if t % 7 else None, ["user", None, "bot"][t % 3], ["hi", "", None, "ü" * 3][int(rng.integers(4))]) for c in rng.integers(-30, 40, 60) for t in range(int(rng.integers(1, 14)))]
    rows += [(200 + i, 0, "user", "hi") for i in range(300)] + [(None, 1, "user", "x")] + [(5, 1, "user", "hi")] * 3 + [(2**40, 0, "a", "word " * 30_000)]
    rows += [(7000, t, "user", str(t)) for t in range(5000)]  # one deep conversation
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    want = trie_by_hand([r for r in rows if r[0] != 7000])
    few = df.where("conv_id <> 7000 OR conv_id IS NULL")
    assert trie_rows(prefix_trie.trie(few)) == want
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    assert trie_rows(prefix_trie.trie(few.repartition(6))) == want
    deep = prefix_trie.trie(df.where("conv_id = 7000"))
    assert deep.count() == 5001 and {r.n_leaves for r in deep.collect()} == {1}


def test_node_tables_are_flushed(spark):
    from marlstone.llm.prefix_trie import merged, node_tables, paths

    df = spark.read.parquet(f"{SF1}/conversations.parquet")
    rows = paths(df)
    key = lambda x: sorted((bytes(r.node), r.span, r.n_convs, r.least, tuple(sorted(r.ends))) for r in x.collect())
    assert key(merged(node_tables(rows, 3))) == key(merged(node_tables(rows)))


def nearest_by_hand(rows, wanted, nearest=5):
    out = {}
    good = [(i, np.array(e, float)) for i, e in dict.fromkeys((i, tuple(e)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and any(e))]
    for i, v in good:
        if i % wanted == 0:
            scores = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in good if j != i and len(w) == len(v))[:nearest]
            out[i] = [(j, -s) for s, j in scores]
    return out


def test_pseudo_rotations_keep_lengths():
    from marlstone.llm.cross_polytope import buckets, probed, rotated

    x = np.random.default_rng(0).normal(size=(40, 37))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert rotated(x, 3).shape == (40, 64) and np.allclose(rotated(x, 3) @ rotated(x, 3).T, x @ x.T)
    for parts in (1, 2, 3):
        tried = probed(x, 1, parts, 50)
        assert (tried[:, 0] == buckets(x, 1, parts)).all() and all(len(set(t)) == 50 for t in tried.tolist())
    two = probed(x, 0, 2, 20)
    turned = [np.stack([-rotated(x, p), rotated(x, p)], 2).reshape(40, -1) for p in (0, 1)]
    gaps = [(t.max(1, keepdims=True) - t) ** 2 for t in turned]
    whole = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(40, -1)
    assert np.allclose(np.sort(whole, axis=1)[:, :20], np.take_along_axis(whole, two.astype(int), 1))


def test_neighbours_are_found(spark):
    from marlstone.llm.cross_polytope import op13

    for sf in ("sf0.01", "sf0.1"):
        at = f"{os.path.dirname(SF)}/{sf}"
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
        want = nearest_by_hand(rows, 50)
        found = collections.defaultdict(list)
        for r in sorted(op13(spark, at).collect(), key=lambda r: (r.query_id, r["rank"])):
            found[r.query_id].append((r.vec_id, r.score))
        own = dict(rows)
        hits = 0
        for q, near in want.items():
            assert len(found[q]) == 5 and [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
            for v, s in found[q]:
                a, b = np.array(own[q], float), np.array(own[v], float)
                assert v != q and abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
            hits += len({v for v, _ in near} & {v for v, _ in found[q]})
        assert set(found) == set(want) and hits >= 0.93 * sum(map(len, want.values()))


@pytest.mark.parametrize("recall", [1.0])
def test_neighbours_of_odd_rows(spark, recall, monkeypatch):
    from marlstone.llm import cross_polytope as cp

    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(120)] + [(300, [1.0, 2.0, 3.0, 4.0])] * 3
    rows += [(400 + 5 * i, e) for i, e in enumerate(ODD) if e != [1e30, 1.0, 0.0, 0.0]] + [(None, [1.0, 0.0, 0.0, 0.0]), (500, [1e300, 1e-300, 0.0, 0.0]), (505, [1.0, 2.0, 3.0]), (510, [1.0] * 7), (511, [2.0] * 7)]
    monkeypatch.setattr(cp, "NODE_BLOCK", 16)
    monkeypatch.setattr(cp, "QUERY_BLOCK", 4)
    monkeypatch.setattr(cp, "BUCKET", 4)
    found = collections.defaultdict(list)
    for r in sorted(cp.search(vectors(spark, rows), F.col("vec_id") % 5 == 0, recall=recall).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    want = {q: [v for v, _ in near] for q, near in nearest_by_hand([(i, e) for i, e in rows if i != 500], 5).items()}
    assert found.pop(500) and found[510] == [511] and 505 not in found
    for q, near in want.items():
        assert found.get(q, []) == near or 500 in found[q]
    assert cp.search(vectors(spark, []), F.col("vec_id") % 5 == 0).count() == 0
