"""op3: shards and the whole search against brute force."""

import random

import numpy as np
import pytest

from folia.llm import maxscore as M


def brute(rows, asked, k):
    out = []
    for qid, q in sorted(asked.items()):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qid]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_shard_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    n, width, k = int(r.integers(0, 300)), int(r.integers(1, 20)), int(r.integers(1, 7))
    scale = [2, 50, 10**9][seed % 3]
    v = r.integers(-scale, scale + 1, (n, width)).astype(float)
    v[r.random((n, width)) < [0.0, 0.9][seed % 2]] = 0
    if seed % 5 == 4:
        v = -np.abs(v)
    ids = r.permutation(n * 2)[:n]
    q = np.vstack([v[: min(5, n)], r.integers(-scale, scale + 1, (3, width)).astype(float), np.zeros((1, width))])
    qids = np.append(ids[: min(5, n)], [-1, -2, -3, -4])
    got = M.search_shard(ids, v, qids, q, k)
    want = brute(list(zip(ids.tolist(), v.tolist())), dict(zip(qids.tolist(), q.tolist())), k)
    assert sorted(zip(*got)) == sorted((a, c, s) for a, _, c, s in want)


def test_weak_lists_are_skipped_and_strong_ones_cut():
    r = np.random.default_rng(3)
    v = np.floor(r.random((4000, 40)) ** 8 * 256)
    v[r.random(v.shape) < 0.9] = 0
    lists = M.Postings(v)
    q = v[:20] * (np.arange(40) % 7 == 0) + v[:20] // 16
    M.search_shard(np.arange(4000), v, np.arange(20), q, 5, lists)
    total = sum(len(t[2]) for x in q for t in M.Postings(v).adding(x))
    assert lists.skipped > 0 and lists.read < total / 2


def test_search_with_repeats_nulls_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 7)
    monkeypatch.setattr(M, "QUERY_ROWS", 2)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(20)] + [(4, [1.0, 2.0, 3.0, 3.0]), (5, [3.0, 3.0, 3.0, 3.0]), (5, [3.0, 3.0, 3.0, 3.0])]
    bad = [(30, None), (31, [1.0, None]), (32, [float("nan")]), (33, [float("inf")]), (None, [1.0]), (0, None)]
    df = spark.createDataFrame([(i, v, 9, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, shard int")
    asked = {}
    for i, v in rows:
        if i % 2 == 0:
            asked[i] = min(asked.get(i, v), v)
    got = [tuple(x) for x in M.top_k(df, df.where("vec_id % 2 = 0"), 4, scale=1.0).collect()]
    assert sorted(got) == sorted(brute(rows, asked, 4))
    big = spark.createDataFrame([(i, [float(2**62 + i * 2**20), 3.0]) for i in range(6)], "vec_id long, embedding array<double>")
    order = [(x.rank, x.vec_id, x.score) for x in M.top_k(big, big.where("vec_id = 0"), 5, scale=1.0).collect()]
    assert sorted(order) == [(k + 1, 5 - k, None) for k in range(5)]
    assert M.top_k(df.limit(0), df.limit(0)).count() == 0
