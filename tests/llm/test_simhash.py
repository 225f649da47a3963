"""op2: fingerprints against the definition, the index and the groups against brute force."""

import re

import numpy as np
import pytest
import xxhash

from folia.llm import simhash_gray as G
from folia.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def defined(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "A b C", "x y z w x y z", "é ß b\x0bc\x0cd e f g", "w " * 200_000])
def test_fingerprint(text):
    assert G.fingerprint(text) == defined(text)


def roots(values):
    up = list(range(len(values)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(values, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2) + i + 1:
            x, y = top(i), top(int(j))
            up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(a))]


def near_values(n=700, seed=1):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    out = set(base) | {0, 2**64 - 1, 1, 3, 7}
    for _ in range(n):
        v = base[rng.integers(60)]
        for k in rng.integers(0, 64, rng.integers(0, 4)):
            v ^= 1 << int(k)
        out.add(v)
    return sorted(out, key=lambda v: v * 2654435761 % 2**64)


def test_index_finds_every_link():
    v = np.array(near_values(), dtype=np.uint64)
    got = {tuple(sorted(p)) for a, b in G.GrayIndex(v).links() for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 2) + i + 1}


def test_a_search_drops_whole_groups():
    v = np.unique(np.random.default_rng(4).integers(0, 2**63, 40_000, dtype=np.uint64))
    index = G.GrayIndex(v)
    assert sum(len(a) for a, _ in index.links()) == 0
    assert index.pruned > 0.8 * index.visited and index.visited < len(v) ** 2 / 20


@pytest.mark.parametrize("range_rows, least_rows", [(1 << 20, 4096), (20, 3), (400, 2)])
def test_links_span_the_components(spark, range_rows, least_rows):
    v = near_values(300)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in v], "fp long")
    got = {r.node: r.component for r in connected_components(G.links(df, 2, range_rows, least_rows)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    sets = lambda names: {frozenset(i for i, n in enumerate(names) if n == m) for m in set(names)}
    assert sets([got.get(x, x) for x in signed]) == sets(roots(v))


def test_groups_and_edge_cases(spark):
    rows = [(5, "a b c d"), (2, "A B c d"), (9, None), (7, ""), (5, "a b c d"), (None, "a b c d"), (1, "quite another text " * 4)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in G.simhash_groups(df).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (5, 2), (None, 2), (1, 1)], key=str)
    kept = G.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 7]
    assert G.simhash_groups(df.limit(0)).count() == 0 and G.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_goes_by_rows_not_by_ids(spark):
    rows = [(5, "this text is one"), (5, "and that text is quite another"), (5, "this text is one"), (None, "a third text of no id"), (None, "this text is one")]
    df = spark.createDataFrame([(i, t, "n", "r") for i, t in rows], "doc_id long, text string, _n string, _r string")
    assert sorted(((r.doc_id, r.text) for r in G.one_of_each(df).collect()), key=str) == sorted({(5, rows[0][1]), (5, rows[1][1]), (None, rows[3][1])}, key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 1000 for k in range(1000, 1100)) and 5000 not in got
