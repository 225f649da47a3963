"""op7: suffix arrays and removal against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from folia.llm import suffix_dedup as S
from folia.llm.induced_sort import Workspace, induced_sort


def sorted_suffixes(t):
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0] * len(t)
    for k in range(1, len(t)):
        a, b = t[sa[k - 1] :], t[sa[k] :]
        while lcp[k] < min(len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
            lcp[k] += 1
    return sa, lcp


@pytest.mark.parametrize("queue,base", [(1 << 28, 1 << 20), (64, 2), (700, 2)])
def test_suffix_array_in_memory_and_on_disk(queue, base):
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(1, rng.integers(2, 7), int(rng.integers(1, 120)))
        t = np.tile(t[: len(t) // 4 + 1], 5) if trial % 4 == 0 else t
        space = Workspace(queue_bytes=queue, text_rows=10 if queue < 1000 else 1 << 30)
        sa, lcp = induced_sort(t, space, None, base)
        space.close()
        assert (sa.tolist(), lcp.tolist()) == sorted_suffixes(t.tolist())


def removed(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    at = collections.defaultdict(list)
    for i, r in enumerate(raws):
        for k in range(len(r) - window + 1):
            at[r[k : k + window]].append((i, k))
    gone = [bytearray(len(r)) for r in raws]
    for places in at.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + window] = b"\1" * window
    return [(d, len(r), sum(g), sum(1 for i, y in enumerate(g) if y and (i == 0 or not g[i - 1])), hashlib.sha256(bytes(x for x, y in zip(r, g, strict=True) if not y)).hexdigest()) for (d, _), r, g in zip(rows, raws, gone, strict=True)]


@pytest.mark.parametrize("crowded", [2000, 3])
def test_removal_on_small_alphabets(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CUT_RUNS", crowded)
    monkeypatch.setattr(S, "SECOND", 2)
    random.seed(2)
    rows = [(i, "".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 70), (103, "ab" * 40), (103, "ab" * 40), (None, "abab" * 9), (104, "éé" * 20)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string")
    assert sorted(map(tuple, S.removal_digests(df, 10, 4).collect()), key=repr) == sorted(removed(rows, 10), key=repr)


def test_removal_of_two_hundred_bytes(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, S.removal_digests(df).collect())) == sorted(removed(rows, 200))


def test_long_texts_in_pieces_and_empty_tables(spark, monkeypatch):
    from folia.llm.suffix_dedup import _pieces

    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(4_000_000))
    parts = [p for group in _pieces([text], 200) for p in group]
    assert len(parts) == 3 and all(text.encode()[a : a + len(p)] == p for _, a, p in parts) and sum(len(p) - 199 for _, _, p in parts) == len(text) - 199
    assert S.removal_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_shard_of_shipped_size_spills_and_maps():
    rng = np.random.default_rng(6)
    parts = [rng.integers(2, 200, 400) for _ in range(700)]
    t = np.concatenate([parts[k] for k in rng.integers(0, 700, 3000)]).astype(np.uint16)
    assert len(t) < S.SHARD_ROWS
    small, large = Workspace(), Workspace(queue_bytes=1 << 34, text_rows=1 << 34)
    sa, lcp = induced_sort(t, small, 121)
    space = (small.spills, small.mapped)
    assert induced_sort(t, small, 121, 1 << 18)[0][0] == sa[0] and small.depth  # names that do not fit are induced again
    small.close()
    assert all(space)
    other, prefix = induced_sort(t, large, 121, 1 << 30)
    assert not large.spills and not large.mapped and not large.depth
    starts = [np.cumsum(x < 121) for x in (lcp, prefix)]
    names = [np.empty(len(t), dtype=np.int64) for _ in starts]
    for n, s, c in zip(names, (sa, other), starts):
        n[s] = c
    assert (names[0] == names[1]).all()  # the same suffixes agree on 121 symbols


def test_a_crowded_line_is_dealt_by_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(S, "CUT_RUNS", 20)
    r = random.Random(7)
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    line, shared = some(120), some(260)
    rows = [(i, some(r.randint(0, 90)) + line + some(r.randint(0, 150))) for i in range(150)] + [(200 + i, some(50) + shared + some(40)) for i in range(60)] + [(300, some(30) + line + shared), (301, some(99) + line + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.removal_digests(df).collect())) == sorted(removed(rows, 200))
    cuts = [S.second_anchors(t.encode(), t.index(line), max(1, len(t) - 199), 200, 80) for i, t in rows[:150] if 200 <= len(t)]
    codes = [c for x in cuts for c, _, _ in x]
    assert len(set(codes)) > len(cuts) / 2
