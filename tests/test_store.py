"""The store, the stage runner, providers, images, rendering and columns on drawn pages."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.operators import columns as C
from folia.operators import document as D
from folia.plans import ledger as G
from folia.plans.store import Store, execute, report_text, summary
from folia.plans.verify import Stage, Verdict
from folia.sources import images as M
from folia.sources import providers as P
from folia.sources import render as H


def upper_stage(version="1"):
    return Stage("upper", version, lambda doc, params: doc.withColumn("text", F.upper("text")), lambda doc, out, params: Verdict(True, 0.5, (), {"lines": float(doc.count())}), lambda doc, out: out)


def test_a_stage_is_recorded_once_and_cached(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    doc = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "doc_id string, line int, text string")
    sources = spark.createDataFrame([("a", "a.pdf", "s1"), ("b", "b.pdf", "s2")], "doc_id string, source_path string, source_sha256 string")
    out, rows = execute(store, upper_stage(), doc, {"k": 1}, sources)
    assert sorted(r.text for r in out.collect()) == ["X", "Y", "Z"] and rows[0]["status"] == "ok"
    assert sorted((r.run_id, r.doc_id, r.stage_version) for r in store.read("runs").collect()) == [(1, "a", "1"), (2, "b", "1")]
    assert store.documents().count() == 2 and store.read("history").count() == 2
    more = doc.unionByName(spark.createDataFrame([("c", 0, "new")], doc.schema))
    again, fresh = execute(store, upper_stage(), more, {"k": 1}, sources)
    assert sorted(r.text for r in again.collect()) == ["NEW", "X", "Y", "Z"] and len(fresh) == 1
    assert [r.doc_id for r in store.read("runs").where("run_id > 2").collect()] == ["c"]
    assert execute(store, upper_stage(), more, {"k": 1}, sources)[1] == []
    assert len(execute(store, upper_stage("2"), more, {"k": 1}, sources)[1]) == 1  # another version is another key
    assert store.runs("a").count() == 2
    assert "upper ok" in report_text(rows[0]) and json.loads(report_text(rows[0], True))["metrics"] == {"lines": 3.0}
    assert summary("s", "degraded", {"n": 2}, 0.25, False) == "s degraded | n=2 | score=0.250 | VERIFY-FAILED"


def test_numbers_go_on_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 100, f"d{i}") for i in range(100)] + [(5, "tie")], "t long, d string")
    got = sorted((r._k, r.t, r.d) for r in G.in_order(rows, "t", "d", ranges=7).collect())
    assert [k for k, _, _ in got] == list(range(1, 102)) and [(t, d) for _, t, d in got] == sorted((t, d) for _, t, d in got)


def test_blobs_and_replies(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    blobs = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "bytes binary")
    store.put_blobs(blobs)
    store.put_blobs(blobs)
    assert store.read("blobs").count() == 2
    sha = blobs.select(F.sha2("bytes", 256).alias("sha256")).union(spark.createDataFrame([("none",)], "sha256 string"))
    assert sorted(r.bytes is not None for r in store.blobs(sha).collect()) == [False, True, True]
    keys = spark.createDataFrame([("k",), ("l",)], "key string")
    assert {r.key: r.body for r in store.replies(keys).collect()} == {"k": None, "l": None}
    store.put_replies(spark.createDataFrame([("k", "one")], "key string, body string"))
    assert {r.key: r.body for r in store.replies(keys).collect()} == {"k": "one", "l": None}


@pytest.mark.parametrize("shape", [(7, 5), (6, 4, 3), (6, 4, 4)])
def test_png_round_trip_and_gray(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    gray = M.to_gray(pixels)
    assert gray.shape == shape[:2] and (M.from_png(M.to_png(gray)) == gray).all()
    with pytest.raises(ValueError):
        M.from_png(b"GIF")


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(18, dtype=np.int64)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = want[y].reshape(-1).astype(np.int64)
        out = []
        for x in range(18):
            a, b, c = (line[x - 3] if x >= 3 else 0), above[x], (above[x - 3] if x >= 3 else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append(int(line[x] - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        raw += bytes([kind, *out])
        above = line
    png = b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + M._chunk(b"IDAT", zlib.compress(raw)) + M._chunk(b"IEND", b"")
    assert (M.from_png(png) == want[..., ::-1]).all()


def page(rows=10, split=(), width=600, stray=None):
    gray = np.full((60 + 40 * rows, width), 255, dtype=np.uint8)
    for i in range(rows):
        gray[40 + 40 * i : 60 + 40 * i, 20 : width - 20] = 0
        gray[40 + 40 * i : 60 + 40 * i, 100::50] = 255  # words
        gray[40 + 40 * i : 60 + 40 * i, 101::50] = 255
        if i in split:
            gray[40 + 40 * i : 60 + 40 * i, 260:340] = 255
    if stray:
        gray[stray[0] : stray[1], 60:160] = 0
    return gray


def drawn(spark, gray):
    rows = [(1, gray.shape[1], gray.shape[0], bytearray(gray.tobytes()))]
    return C.image_ink(spark.createDataFrame(rows, "page long, width int, height int, pixels binary"))


@pytest.mark.parametrize("split, rows", [((), 0), ((3,), 0), ((3, 4, 5), 3), ((2, 3, 4, 5), 4)])
def test_column_blocks_of_images(spark, split, rows):
    boxes = spark.createDataFrame([(1, i, 20, 40 + 40 * i, 560, 20) for i in range(10)], "page long, row int, x long, y long, w long, h long")
    ink = drawn(spark, page(10, split))
    found = C.column_rows(boxes, C.gutters(boxes, ink))
    assert sorted(r.row for r in found.collect()) == (list(split) if rows else [])
    if rows:
        blocks = C.column_blocks(found)
        assert [(r.rows, 290 < r.gutter_x < 310) for r in blocks.collect()] == [(rows, True)]
        cells = sorted((r.row, r.cell, r.x) for r in C.split_rows(boxes, found, blocks, ink).collect() if r.row in split)
        assert all(a[2] > b[2] for a, b in zip(cells[::2], cells[1::2], strict=True))  # the right cell comes first


def test_missed_and_merged_lines_of_images(spark):
    gray = page(10)
    rows = [(1, i, 20, 40 + 40 * i, 560, 20) for i in range(10) if i not in (4, 7)]
    rows[6] = (1, 8, 20, 40 + 40 * 7, 560, 60)  # two lines in one box
    boxes = spark.createDataFrame(rows, "page long, row int, x long, y long, w long, h long")
    judged, issues = C.assess(boxes, drawn(spark, gray))
    got = judged.first()
    assert (got.missed_lines, got.stranded_gaps, got.tall_boxes, got.merged_lines) == (1, 1, 1, 1)
    assert sorted(r.kind for r in issues.collect()) == ["merged_lines", "missed_line"]
    assert "look missed" in " ".join(r.finding for r in C.findings(judged).collect())
    few = boxes.limit(3)
    assert C.assess(few, drawn(spark, gray))[0].count() == 0


def test_providers(spark, monkeypatch):
    gray = page(4)
    pages = spark.createDataFrame([("d", 0, gray.shape[1], gray.shape[0], bytearray(gray.tobytes()), ["a", "b"]), ("d", 1, gray.shape[1], gray.shape[0], bytearray(gray.tobytes()), None)], "doc_id string, page_no int, width int, height int, pixels binary, line_ids array<string>")
    got = P.transcribe(pages).collect()
    assert [(r.line_id, r.text) for r in got if r.page_no == 0] == [("a", f"{P.STUB_WORD} 0"), ("b", f"{P.STUB_WORD} 1")]
    assert len([r for r in got if r.page_no == 1]) == 4
    with pytest.raises(KeyError):
        P.provider("other:model")
    monkeypatch.setenv("SOME_KEY", "x")
    assert P.credentials({"one": ("SOME_KEY",), "two": ("NO_SUCH_KEY",)}) == {"one": "SOME_KEY", "two": None}


def test_ingest_and_render(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    png = M.to_png(page(3))
    rows = [("book.pdf", M.hashlib.sha256(b"book").hexdigest(), i, bytearray(png), 612.0 if i else None, True) for i in range(3)]
    images = spark.createDataFrame(rows, "source_path string, source_sha256 string, page_no int, bytes binary, placed_points double, native boolean")
    pages = M.ingest(store, images, 2)
    got = sorted((r.page_no, r.doc_id, r.dpi is None) for r in pages.collect())
    assert got == [(0, M.doc_id(b"book"), True), (1, M.doc_id(b"book"), False)]
    assert store.read("blobs").count() == 1 and store.documents().count() == 1
    assert all(r.bytes for r in D.views(pages, store.read("blobs")).collect())
    lines = spark.createDataFrame([("d", 0, "r0", "l0", 0, 10, 20, 100, 30, "a <b> & c"), ("d", 0, "r0", "l1", 1, 10, 60, 100, 30, "verse")], "doc_id string, page_no int, region_id string, line_id string, line_index int, x long, y long, w long, h long, text string")
    regions = spark.createDataFrame([("d", 0, "r0", 1, "unknown", 1)], "doc_id string, page_no int, region_id string, seq int, region_type string, columns int")
    issues = spark.createDataFrame([("d", 0, "missed_line", 5.0, 5.0, 10.0, 10.0)], "doc_id string, page_no int, kind string, x double, y double, w double, h double")
    sizes = spark.createDataFrame([("d", 0, 200, 400, "data:x")], "doc_id string, page_no int, width int, height int, image string")
    html = H.documents(H.debug_pages(sizes, lines, regions, issues), ["page_no"]).first().html
    assert "a &lt;b&gt; &amp; c" in html and 'title="missed_line"' in html and "left:5.000%;top:5.000%" in html and "1 prose" in html and '<img src="data:x">' in html
    assert H.font_faces([str(tmp_path)], {"x": "*.ttf"}) == ""
    (tmp_path / "a.ttf").write_bytes(b"font")
    assert "format('truetype')" in H.font_faces([str(tmp_path)], {"x": "*.ttf"})
