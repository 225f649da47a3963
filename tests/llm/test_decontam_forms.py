"""op9: the mask cover, the linear stretch, short and unspaced items, and both forms against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from folia.llm import spaced_decontam as D


def slow_stretch(equal):
    best = (0, 0, 0)
    on = [i for i, e in enumerate(equal) if e]
    for i in on:
        for j in on:
            same = sum(equal[i : j + 1])
            if j >= i and same * 5 >= (j + 1 - i) * 4 and j + 1 - i > best[1]:
                best = (i, j + 1 - i, same)
    return best


def brute(rows, items):
    out = Counter()
    for doc, text in rows:
        a = D.tokens(text)
        for item, ours in {x for x in items if x[0] is not None and x[1] is not None}:
            b = D.tokens(ours)
            best = None
            for offset in range(-len(b) + 1, len(a)):
                lo, hi = max(0, offset), min(len(a), offset + len(b))
                start, length, same = slow_stretch([a[k] == b[k - offset] for k in range(lo, hi)])
                if length and length >= min(D.MIN_TOKENS, len(b)):
                    got = (same, -lo - start, -length)
                    best = max(best, got) if best else got
            if best:
                out[doc, item, -best[1], -best[2], best[0]] += 1
    return out


def test_stretch_equals_trying_all():
    r = random.Random(2)
    for _ in range(400):
        equal = [r.random() < 0.75 for _ in range(r.randint(0, 30))]
        assert D.best_stretch(np.array(equal, dtype=bool)) == slow_stretch(equal)
    assert D.best_stretch(np.ones(300_000, dtype=bool)) == (0, 300_000, 300_000)


@pytest.mark.parametrize("size", range(1, 13))
def test_short_masks_find_every_accepted_item(size):
    from itertools import combinations

    for changes in range(size // 5 + 1):
        for gone in combinations(range(1, size - 1), changes):
            assert any(all(m[i] == "0" for i in gone) for m in D.short_masks(size))
    assert all(len(m) == size and "1" in m for m in D.short_masks(size))


def test_every_long_stretch_holds_a_mask():
    """The most equal tokens that a stretch without any placement can have stay under four of five."""
    masks = [(len(m), int(m, 2)) for m in D.MASKS]
    width = max(n for n, _ in masks)
    most = {(1, 1): 1}
    for size in range(2, 80):
        after = {}
        for (state, n), ones in most.items():
            for bit in (0, 1):
                s, k = (state << 1 | bit) & ((1 << width) - 1), min(n + 1, width)
                if not any(k >= w and s & m == m for w, m in masks):
                    after[s, k] = max(after.get((s, k), 0), ones + bit)
        most = after
        ended = max((v for (s, _), v in most.items() if s & 1), default=0)
        assert size < D.MIN_TOKENS or ended * 5 < size * 4


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_both_forms_equal_brute_force(spark, limit):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(9)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 10, 12, 14, 20))] + [(20, "三百年前的古老石桥还在河上静静地立着等人"), (4, " ".join(some(15))), (4, " ".join(some(15))), (None, "w1"), (21, None), (22, "")]
    items.append(items[-4])
    rows = []
    for k in range(40):
        item = items[r.randrange(12)][1]
        tokens = item.split() if k % 3 else list(item)
        body = [("x" if r.random() < 0.12 else t) for t in tokens]
        rows.append((k, " ".join(["u"] * r.randint(0, 4) + body + ["v"])))
    rows += [(7, "w1 w2 w3 w4"), (7, "w1 w2 w3 w4"), (7, items[9][1]), (None, items[9][1]), (None, items[10][1]), (50, "前面三百年前的古老石桥还在河上静静地立着等人后面"), (51, None), (52, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _r1 int, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert Counter(tuple(x) for x in D.overlaps(docs, bench, broadcast_bytes=limit).collect()) == want
    hit = {(d, t) for d, t in rows for (e, *_), _ in [(k, 0) for k in brute([(d, t)], items)] if e == d}
    kept = D.without_overlaps(docs, bench, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter(x for x in rows if x not in hit)
