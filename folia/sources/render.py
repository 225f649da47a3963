"""HTML of documents: the page with its boxes and issues, and the typeset reader.

Both are strings that are put together for each page from rows; the style sheet
and the frame are added once a document.
"""

from __future__ import annotations

import base64
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.operators.document import corpus_hit, pretty_ref, region_role
from folia.sources.tables import html_escape

# Fixed values. The height of letters in a line box, and the share of replaced text from which a line is verse.
LETTER_SHARE, VERSE_SHARE = 0.72, 0.6
STYLE = ".page{position:relative}.box{position:absolute}.region{outline:1px dashed}.issue{outline:2px solid}.cited{border-bottom:1px dotted}.quran{color:#15803d}.hadith{color:#1d4ed8}.note{float:inline-end;font-size:80%}.verse{text-align:center}.ref{font-size:70%}"


def percent(value: Column, of: Column) -> Column:
    return F.format_string("%.3f", F.round(100.0 * value / of, 3))


def position(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Style of a box in shares of its page."""
    return F.concat(F.lit("left:"), percent(x, width), F.lit("%;top:"), percent(y, height), F.lit("%;width:"), percent(w, width), F.lit("%;height:"), percent(h, height), F.lit("%"))


def _list(rows: DataFrame, keys: list[str], order: list[str], html: Column, gap: str = "\n") -> DataFrame:
    """(keys, html): the rows' strings in order; the rows of a key are those of one page, line or document."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, html.alias("_h")))).alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda p: p["_h"]), gap).alias("html"))


def span_html(kind: Column, ref: Column, text: Column) -> Column:
    """Verified text in colour, a cited reading with a mark, else plain."""
    plain = html_escape(text)
    mark = lambda name: F.concat(F.lit('<span class="'), name, F.lit('">'), plain, F.lit("</span>"))
    book = F.when(F.substring_index(ref, ":", 1) == "quran", "quran").otherwise("hadith")
    return F.when(kind != "ocr", mark(kind)).when(corpus_hit(kind, ref), mark(F.concat(F.lit("cited "), book))).otherwise(plain)


def line_boxes(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``lines`` with ``html``: a positioned box with letters of its height; ``pages`` has width and height."""
    sized = lines.join(pages.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"])
    style = F.concat(position(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height")), F.lit(";font-size:"), F.format_string("%.1f", F.round(F.col("h") * LETTER_SHARE, 1)), F.lit("px"))
    return sized.withColumn("html", F.concat(F.lit('<div class="box" style="'), style, F.lit('">'), html_escape(F.col("text")), F.lit("</div>")))


def debug_pages(pages: DataFrame, lines: DataFrame, regions: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, html): boxes of regions with role and number, lines, and issues with their kind; ``pages`` may have an image uri."""
    keys = ["doc_id", "page_no"]
    size = pages.select(*keys, "width", "height")
    at = position(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    box = lambda kind, label: F.concat(F.lit('<div class="box '), kind, F.lit('" style="'), at, F.lit('" title="'), html_escape(label), F.lit('"></div>'))
    hull = lines.groupBy(*keys, "region_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"))
    hull = hull.select(*keys, "region_id", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h")).join(regions.select(*keys, "region_id", "seq", region_role(F.col("region_type"), F.col("columns")).alias("role")), [*keys, "region_id"]).join(size, keys)
    parts = [_list(hull, keys, ["seq"], box(F.concat(F.lit("region "), F.col("role")), F.concat(F.col("seq").cast("string"), F.lit(" "), F.col("role")))), _list(line_boxes(lines, pages), keys, ["line_id"], F.col("html"))]
    if issues is not None:
        parts.append(_list(issues.join(size, keys), keys, ["y", "x", "kind"], box(F.lit("issue"), F.col("kind"))))
    out = pages.select(*keys, (F.concat(F.lit('<img src="'), F.col("image"), F.lit('">')) if "image" in pages.columns else F.lit("")).alias("_image"))
    for i, p in enumerate(parts):
        out = out.join(p.withColumnRenamed("html", f"_{i}"), keys, "left")
    body = F.concat_ws("\n", F.when(F.col("_image") != "", F.col("_image")), *[F.col(f"_{i}") for i in range(len(parts))])
    return out.select(*keys, F.concat(F.lit('<section class="page">\n'), body, F.lit("\n</section>")).alias("html"))


def reader_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_id, seq, html) of lines with paragraph, replaced share, ref and ``line_html``.

    A line that is mostly verified text is a block of its own with its citation;
    marginal regions stand beside the text.
    """
    keys = ["doc_id", "page_no", "region_id"]
    cite = F.when(F.col("ref").isNotNull(), F.concat(F.lit(' <span class="ref">'), html_escape(pretty_ref(F.col("ref"))), F.lit("</span>"))).otherwise("")
    verse = F.col("replaced") >= VERSE_SHARE
    said = lines.where("text <> ''").withColumns({"_verse": verse, "_block": F.when(verse, F.concat(F.lit("v"), F.format_string("%08d", "line_index"))).otherwise(F.concat(F.lit("p"), F.format_string("%08d", "paragraph")))})
    blocks = said.groupBy(*keys, "_block", "_verse").agg(F.min("line_index").alias("_first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", F.when(verse, F.concat("line_html", cite)).otherwise(F.col("line_html")).alias("h")))), lambda p: p["h"]), " ").alias("_t"))
    block = F.concat(F.when(F.col("_verse"), '<p class="verse">').otherwise("<p>"), F.col("_t"), F.lit("</p>"))
    body = _list(blocks, keys, ["_first", "_block"], block)
    role = regions.select(*keys, "seq", region_role(F.col("region_type"), F.col("columns")).alias("role"))
    frame = F.when(F.col("role") == "marginalia", F.concat(F.lit('<aside class="note">'), F.col("html"), F.lit("</aside>"))).otherwise(F.concat(F.lit("<div>"), F.col("html"), F.lit("</div>")))
    return body.join(role, keys).select(*keys, "seq", frame.alias("html"))


def line_html(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(line keys, line_html): a line's spans in order, each as its kind wants."""
    keys = ["doc_id", "page_no", "line_id"]
    cut = spans.join(lines.select(*keys, "text"), keys).withColumn("_t", F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return _list(cut, keys, ["char_start", "span_index"], span_html(F.col("kind"), F.col("ref"), F.col("_t")), "").withColumnRenamed("html", "line_html")


def documents(parts: DataFrame, order: list[str], fonts: str = "") -> DataFrame:
    """(doc_id, html): one file a document from its pages' or regions' HTML."""
    body = _list(parts, ["doc_id"], order, F.col("html"))
    head = f'<!DOCTYPE html><html dir="rtl"><head><meta charset="utf-8"><style>{STYLE}{fonts}</style></head><body>\n'
    return body.select("doc_id", F.concat(F.lit(head), F.col("html"), F.lit("\n</body></html>\n")).alias("html"))


def font_faces(folders: list[str], names: dict[str, str]) -> str:
    """``@font-face`` rules with the fonts' bytes for each family whose file is found in one of the folders."""
    out = []
    for family, file in names.items():
        path = next((p for f in folders for p in sorted(Path(f).expanduser().rglob(file))), None)
        if path:
            kind = {".ttf": "truetype", ".otf": "opentype", ".woff2": "woff2"}.get(path.suffix, "truetype")
            out.append(f"@font-face{{font-family:'{family}';src:url(data:font/{path.suffix[1:]};base64,{base64.b64encode(path.read_bytes()).decode()}) format('{kind}')}}")
    return "".join(out)
