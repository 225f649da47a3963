"""Golden cases of matching, layout, rows, reader and ledger."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.operators import layout as L
from folia.operators import matching as M
from folia.operators import reader as R
from folia.operators import rows as W
from folia.plans import ledger as G
from folia.plans import verify as V
from folia.sources import settings


@pytest.mark.parametrize("query,target,span", [
    ("xxabc", "abc", (2, 5, 0, 3)), ("xxabcyy", "zzabc", (2, 5, 2, 5)), ("abcd", "abcd", (0, 4, 0, 4)), ("abc", "xyz", None), ("abxcd", "abcd", (0, 5, 0, 4)),
])
def test_local_alignment(query, target, span):
    got = M.align_batch([list(query)], [list(target)])[0]
    assert (got[1:] if got else None) == span


def test_alignment_against_plain_dynamic_program():
    rng = np.random.default_rng(0)
    words = ["aa", "ab", "abc", "abcd", "xyz", "xy"]

    def plain(q, t):
        h = np.zeros((len(q) + 1, len(t) + 1))
        for i, a in enumerate(q, 1):
            for j, b in enumerate(t, 1):
                sim = 1 - M.edit_distance(a, b) / max(len(a), len(b))
                h[i, j] = max(0, h[i - 1, j - 1] + 2 * (sim if sim >= 0.5 else 0) - 1, h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    pairs = [([str(x) for x in rng.choice(words, rng.integers(1, 9))], [str(x) for x in rng.choice(words, rng.integers(1, 9))]) for _ in range(200)]
    got = M.align_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs((g[0] if g else 0) - plain(a, b)) < 1e-6 for g, (a, b) in zip(got, pairs, strict=True))


def test_accept_fold_continues(spark):
    aligned = spark.createDataFrame(
        [(1, 0, 0, 5.0, 0, 5, 10, 15, 1.0), (1, 1, 0, 2.0, 0, 2, 40, 42, 1.0), (1, 1, 1, 2.0, 0, 2, 15, 17, 1.0), (1, 2, 0, 1.0, 0, 1, 90, 91, 1.0)],
        "doc_id long, line_index int, rank int, score double, q_start int, q_end int, c_start long, c_end long, identity double",
    )
    lines = spark.createDataFrame([(1, 0, ["a"] * 5), (1, 1, ["a"] * 2), (1, 2, ["a"])], "doc_id long, line_index int, tokens array<string>")
    got = M.accept(aligned, lines, ["doc_id"]).orderBy("line_index").collect()
    assert [(r.line_index, r.action, r.continues, r.c_start, r.margin) for r in got] == [(0, "replaced", False, 10, 1.0), (1, "replaced", True, 15, 0.0)]


def test_splice_and_citation(spark):
    df = spark.createDataFrame([("pre BAD post", 4, 7, "good words", "replaced", None), ("pre BAD post", 4, 7, "good", "cited", None), ("x", 0, 9, "y", "replaced", None), ("pre BAD post", 4, 7, "g", "replaced", "first")], "t string, s int, e int, c string, a string, o string")
    a, b, c, d = (r.v for r in df.select(M.splice(F.col("t"), F.col("s"), F.col("e"), F.col("c"), F.col("a"), F.col("o")).alias("v")).collect())
    assert (a.text, a.original_text, len(a.spans)) == ("pre good words post", "BAD", 3)
    assert (b.text, b.original_text) == ("pre BAD post", None)
    assert (c.text, c.spans) == ("x", None)
    assert d.original_text == "first"
    refs = spark.createDataFrame([((2, 5), (2, 5)), ((2, 5), (2, 6)), ((2, 5), (3, 1))], "f struct<a:int,b:int>, l struct<a:int,b:int>")
    assert [r.v for r in refs.select(M.citation("q", F.col("f"), F.col("l")).alias("v")).collect()] == ["q:2:5", "q:2:5-6", "q:2:5-3:1"]


def _page(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page long, cell int, x long, y long, w long, h long, lang string")


def test_two_columns_and_note(spark):
    rows = [(320, 100 + 40 * i, 260, 30, "arabic") for i in range(3)] + [(20, 100 + 40 * i, 260, 30, "urdu") for i in range(3)]
    for order, n in (("column_major", 2), ("row_major", 1)):
        b = L.bands(_page(spark, rows))
        got = L.reading_order(b, L.column_runs(L.gutters(b)), order)
        assert got.select("region").distinct().count() == n
        assert got.count() == 6
    note = L.bands(_page(spark, [(20, 100 + 40 * i, 460, 30, "urdu") for i in range(3)] + [(520, 100 + 40 * i, 60, 30, "urdu") for i in range(3)]))
    last = L.regions(L.reading_order(note, L.column_runs(L.gutters(note)))).orderBy("region").collect()
    assert [r.region_type for r in last] == ["unknown", "marginalia"]


def test_prose_is_one_region(spark):
    b = L.bands(_page(spark, [(20, 100 + 40 * i, 560, 30, "urdu") for i in range(4)]))
    assert L.reading_order(b, L.column_runs(L.gutters(b))).select("region").distinct().count() == 1


def test_purity(spark):
    got = L.purity(spark.createDataFrame([(1, "urdu", 2), (1, "arabic", 1), (1, "unknown", 5), (2, "unknown", 1)], "k int, lang string, n int"), ["k"])
    assert {r.k: round(r.purity, 4) for r in got.collect()} == {1: 0.6667, 2: 1.0}


def test_image_rows(spark):
    gray = np.full((200, 300), 255, dtype=np.uint8)
    for i in range(5):
        gray[20 + 36 * i : 38 + 36 * i, 30:270] = 20
    images = spark.createDataFrame([(1, 300, 200, bytearray(gray.tobytes()))], "page long, width int, height int, pixels binary")
    got = W.text_rows(W.smooth(W.image_profile(images), 200))
    assert got.count() == 5


def test_rows_at_the_threshold_itself_are_text_in_any_order(spark):
    import random

    # the mean ink is 1500 / 3, so the faint band of 450 / 3 stands at the threshold itself
    ink = {**dict.fromkeys(range(20, 26), 450), **dict.fromkeys(range(40, 60), 500), **dict.fromkeys(range(60, 85), 2552)}
    assert sum(ink.values()) * 3 == len(ink) * 450 * 10
    rows = []
    for page in range(40):
        each = [(page, y, v / 3) for y, v in ink.items()]
        random.Random(page).shuffle(each)
        rows += each
    smoothed = spark.createDataFrame(rows, "page long, y long, value double").coalesce(1)
    found = [(0, 20, 25), (1, 40, 84)]
    assert sorted(map(tuple, W.text_rows(smoothed).collect())) == [(p, *b) for p in range(40) for b in found]
    stretches = smoothed.select("page", "y", (F.col("y") + 1).alias("to"), "value")
    assert sorted(map(tuple, W.text_rows_of(stretches).collect())) == [(p, *b) for p in range(40) for b in found]


def test_tiles_cover_a_line(spark):
    spans = spark.createDataFrame([(1, 2, 5, "a", 10), (1, 4, 8, "b", 10)], "line long, start int, end int, kind string, n int")
    got = sorted((r.start, r.end, r.kind) for r in R.tiles(spans, ["line"]).collect())
    assert got == [(0, 2, "plain"), (2, 5, "a"), (5, 8, "b"), (8, 10, "plain")]


def test_ledger(spark):
    old = spark.createDataFrame([("d", "p", "s", "h1", 1)], "doc_id string, source_path string, source_sha256 string, state_sha256 string, updated_at int")
    new = spark.createDataFrame([("d", "q", "t", "h2", 2)], old.schema)
    assert tuple(G.upsert_documents(old, new).first()) == ("d", "p", "s", "h2", 2)
    docs = spark.createDataFrame([("abc",), ("abd",)], "doc_id string")
    assert G.resolve(docs, "abc") == "abc"
    with pytest.raises(KeyError):
        G.resolve(docs, "ab")
    with pytest.raises(KeyError):
        G.resolve(docs, "%")


def test_stage_contract(spark):
    stage = V.Stage("count", "1", lambda df, p: df.limit(p["n"]), lambda doc, out, p: V.Verdict(out.count() == p["n"]))
    out, row = stage.execute(spark.range(5), {"n": 3})
    assert (out.count(), row["status"]) == (3, "ok")
    assert stage.execute(spark.range(2), {"n": 3})[1]["status"] == "degraded"
    assert V.stable_hash({"b": 1, "a": 2}) == V.stable_hash({"a": 2, "b": 1}) != V.stable_hash({"a": 1})


def test_parse_lines_without_json(spark):
    df = spark.createDataFrame([(1, "```\none\n\ntwo\n```", ["a", "b", "c"])], "k int, body string, expected array<string>")
    assert [(r.line_id, r.text) for r in V.parse_lines(df, ["k"]).orderBy("line_id").collect()] == [("a", "one"), ("b", "two"), ("c", "")]


def test_profile_round_trip(tmp_path):
    (tmp_path / "p.toml").write_text("[route]\nurdu_cut = 0.5\n")
    p = settings.load_profile("p", tmp_path)
    assert p.route.urdu_cut == 0.5 and p.order == settings.Order()
    (tmp_path / "q.toml").write_text(settings.to_toml(p))
    assert settings.load_profile("q", tmp_path) == p
    (tmp_path / "bad.toml").write_text("[route]\nurdu_cutt = 0.5\n")
    with pytest.raises(KeyError):
        settings.load_profile("bad", tmp_path)
    assert settings.parse_dotenv("export A='x y' # c\nB=1 # two\n# C=3\nD=\"q\"") == {"A": "x y", "B": "1", "D": "q"}
