"""The pipeline's near copies against brute force over 5-word Jaccard similarities."""

import random

import pytest

from folia.llm import near_copies as N

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    rows = sorted({i: grams(t) for i, t in rows}.items())
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(i for i in up if top(i) == i)


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    line = [word() for _ in range(30)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice((7, 40, 120, 300)))] + line
        for _ in range(r.choice((1, 2, 30))):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    r.shuffle(out)
    return [*enumerate(out, 10), (1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e")]


@pytest.mark.parametrize("file_rows", [16, 2])
def test_near_copies_equal_brute_force(spark, file_rows):
    rows = texts()
    got = sorted(r.doc_id for r in N.one_of_each(spark.createDataFrame(rows, SCHEMA), file_rows).collect())
    assert got == kept_by_brute_force(rows)


def test_files_make_rows_in_proportion_to_their_nodes(spark):
    def made(copies):  # forty files, each of so many near copies
        rows = [(key, 1000 * key + node, 100) for key in range(40) for node in range(copies)]
        filed = spark.createDataFrame(rows, "key long, node long, n long").repartition(2, "key").sortWithinPartitions("key")
        return N._first_pairs(filed, N.FILE_ROWS).count()

    for copies in (3, 5, 10, 16, 17, 100):
        assert made(copies) <= 2 * 40 * copies


def test_stage_drops_near_copies_of_the_tables(spark, data):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted(r.doc_id for r in C.near_dedup(spark, docs, data).collect())
    assert got == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_bitmaps_never_show_more_than_the_sets_differ_by():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 60, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[: n * 4 // 5], rng.integers(0, 2**63, n // 4 + 1, dtype=np.uint64)))
        x, y = N.parity(a), N.parity(b)
        size = min(len(x), len(y))
        assert int(np.bitwise_count(N.folded(x, size) ^ N.folded(y, size)).sum()) <= len(np.setxor1d(a, b))


def test_rows_of_one_id_and_repeated_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "quite another text than that one"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "of no id but all alone here")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, _n int")
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
    assert N.one_of_each(df.limit(0)).count() == 0
