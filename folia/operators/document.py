"""The document as tables: accessors, updates by stage results, and the predicates on lines and spans.

A document is pages, regions, lines and spans in four tables that share the keys
doc_id, page_no, region_id, line_id and span_index.  A stage's result is a table
of the same keys; applying it is a left join, so a key without a result keeps
what it had and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import script as S
from folia.operators.matching import splice

LINE = ["doc_id", "page_no", "line_id"]
SPAN = [*LINE, "span_index"]
# Fixed values. What counts as verified text, and the density of vowel marks from which a line looks sacred.
CORPUS_KINDS = ("quran", "hadith")
SACRED_DENSITY = 0.25


def only_pages(table: DataFrame, pages: list[int] | None = None, max_pages: int | None = None) -> DataFrame:
    """Rows of the wanted pages; without a list all, and of those the first ``max_pages``."""
    kept = table if pages is None else table.where(F.col("page_no").isin([int(p) for p in pages]))
    return kept if max_pages is None else kept.where(F.col("page_no") < max_pages)


def said(text: Column) -> Column:
    """Is there more than white space?"""
    return S.trimmed(text) != ""


def corpus_hit(kind: Column, ref: Column) -> Column:
    return kind.isin(*CORPUS_KINDS) | ref.isNotNull()


def looks_sacred(text: Column) -> Column:
    return S.tashkeel_density(text) > SACRED_DENSITY


def region_role(region_type: Column, columns: Column) -> Column:
    return F.when(region_type == "marginalia", "marginalia").when(columns >= 2, "column").otherwise("prose")


def pretty_ref(ref: Column) -> Column:
    """The reader's form of a citation: the book is left out for the one that everything is checked against."""
    book, rest = F.substring_index(ref, ":", 1), F.regexp_replace(ref, r"^[^:]*:?", "")
    return F.when(book == "quran", rest).otherwise(F.concat(book, F.lit(" "), rest))


def corpus_kind(ref: Column) -> Column:
    return F.when(F.substring_index(ref, ":", 1) == "quran", "quran").otherwise("hadith")


def apply_matches(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """``lines`` with text, spans and first reading after the accepted ``matches``; the others stay as they are."""
    got = matches.select(*LINE, "action", "ref", "corpus_text", "char_start", "char_end")
    both = lines.join(got, LINE, "left")
    made = splice(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("corpus_text"), F.col("action"), F.col("original_text") if "original_text" in lines.columns else None)
    rest = [c for c in lines.columns if c not in ("text", "original_text", "spans")]
    done = both.withColumn("_s", F.when(F.col("action").isNotNull(), made))
    return done.select(*rest, F.coalesce("_s.text", "text").alias("text"), F.col("_s.original_text").alias("original_text"), F.col("_s.spans").alias("spans"), "action", "ref")


def apply_routes(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """``spans`` with the routed language where there is one; ``changed`` tells where it differs."""
    got = routes.select(*SPAN, F.col("language").alias("_language"), "posterior")
    both = spans.join(got, SPAN, "left")
    changed = F.col("_language").isNotNull() & (F.col("_language") != F.col("language"))
    return both.select(*[c for c in spans.columns if c != "language"], F.coalesce("_language", "language").alias("language"), "posterior", changed.alias("changed"))


def apply_pages(pages: DataFrame, results: DataFrame, *columns: str) -> DataFrame:
    """``pages`` with the named columns of a stage's results by page; pages without a result keep theirs."""
    keys = ["doc_id", "page_no"]
    got = results.select(*keys, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = pages.join(got, keys, "left")
    return both.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in pages.columns])


def build_lines(reads: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of a page's reads: the box of the same id, else the box at the same place, else the page's.

    ``reads`` and ``boxes`` have (doc_id, page_no, position, line_id); ``pages``
    the size.  Texts are canonical (strict, one line).
    """
    keys = ["doc_id", "page_no"]
    box = F.struct("x", "y", "w", "h")
    by_id = boxes.select(*keys, "line_id", box.alias("_by_id"))
    by_place = boxes.select(*keys, "position", box.alias("_by_place"))
    whole = pages.select(*keys, F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("width").alias("w"), F.col("height").alias("h")).alias("_whole"))
    found = reads.join(by_id, [*keys, "line_id"], "left").join(by_place, [*keys, "position"], "left").join(whole, keys)
    at = F.coalesce("_by_id", "_by_place", "_whole")
    text = S.canonical(F.col("text"), "strict", keep_newlines=False)
    return found.select(*keys, "position", "line_id", at["x"].alias("x"), at["y"].alias("y"), at["w"].alias("w"), at["h"].alias("h"), text.alias("text"))


def reading_positions(regions: DataFrame, listed: DataFrame) -> DataFrame:
    """``regions`` with ``seq`` from 1: those of the page's reading order by their place in it, then the others in raw order."""
    keys = ["doc_id", "page_no"]
    place = listed.select(*keys, "region_id", "place")
    w = Window.partitionBy(*keys).orderBy(F.col("place").isNull(), "place", "raw")
    return regions.join(place, [*keys, "region_id"], "left").withColumn("seq", F.row_number().over(w)).drop("place")


def _joined(rows: DataFrame, keys: list[str], order: str, text: str, gap: str) -> DataFrame:
    """One text for each key, its parts in order; the parts of a key are those of one region or page."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), gap).alias("text"))


def region_texts(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, region_id, role, column_index, columns, text) of every region that has a line."""
    keys = ["doc_id", "page_no", "region_id"]
    return _joined(lines, keys, "line_index", "text", "\n").join(regions.select(*keys, "seq", region_role(F.col("region_type"), F.col("columns")).alias("role"), "column_index", "columns"), keys)


def page_texts(texts: DataFrame) -> DataFrame:
    return _joined(texts.where("text <> ''"), ["doc_id", "page_no"], "seq", "text", "\n\n")


def document_texts(texts: DataFrame) -> DataFrame:
    return _joined(page_texts(texts), ["doc_id"], "page_no", "text", "\n\n")


def text_dump(texts: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): each page's head and its regions in reading order, each with number and role; blank ones are left out."""
    place = F.when(F.col("role") == "column", F.concat(F.lit(" "), F.format_string("%+d/%d", F.col("column_index").cast("int"), F.col("columns").cast("int")))).otherwise("")
    head = F.concat(F.lit("-- ["), F.col("seq").cast("string"), F.lit("] "), F.col("role"), place, F.lit(" --\n"))
    chunks = texts.select("doc_id", "page_no", "seq", F.when(said(F.col("text")), F.concat(head, F.col("text"))).alias("chunk"))
    rule = "=" * 60
    top = F.concat(F.lit(f"{rule}\n== page "), (F.col("page_no") + 1).cast("string"), F.lit(f"\n{rule}"))
    body = chunks.groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("seq", "chunk")))), lambda p: p["chunk"]).alias("c"))
    return body.select("doc_id", "page_no", F.array_join(F.concat(F.array(top), F.col("c")), "\n\n").alias("text"))


def summary(pages: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pages, lines, chars)."""
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    n_lines = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    chars = document_texts(texts).select("doc_id", F.length("text").alias("chars"))
    return n_pages.join(n_lines, "doc_id", "left").join(chars, "doc_id", "left").select("doc_id", "pages", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("chars", F.lit(0)).alias("chars"))


def leading_spans(spans: DataFrame) -> DataFrame:
    """The span that speaks for each line: the first that is more than a reading, else the first cited, else the first."""
    rank = F.when(F.col("kind") != "ocr", 0).when(F.coalesce(F.col("ref"), F.lit("")) != "", 1).otherwise(2)
    best = F.min_by(F.struct("span_index", "kind", "ref", "language"), F.struct(rank, "span_index"))
    return spans.groupBy(*LINE).agg(best.alias("s")).select(*LINE, "s.span_index", "s.kind", "s.ref", "s.language")


def replaced_fraction(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, replaced): the share of a line's text that verified spans cover; 0 for an empty text."""
    size = F.when(F.col("kind").isin(*CORPUS_KINDS), F.col("char_end") - F.col("char_start")).otherwise(0)
    covered = spans.groupBy(*LINE).agg(F.sum(size).alias("_covered"))
    share = F.when(F.length("text") > 0, F.coalesce("_covered", F.lit(0)) / F.length("text")).otherwise(0.0)
    return lines.join(covered, LINE, "left").select(*LINE, share.alias("replaced"))


def body_height(lines: DataFrame) -> DataFrame:
    """(doc_id, body_h): the median over regions of their median line height."""
    each = lines.groupBy("doc_id", "page_no", "region_id").agg(F.median("h").alias("m"))
    return each.groupBy("doc_id").agg(F.coalesce(F.median("m"), F.lit(0.0)).alias("body_h"))


def verified_purity(spans: DataFrame, lines: DataFrame, regions: DataFrame, min_lines: int = 3) -> DataFrame:
    """(region, purity) of column regions with enough lines, by the language of each line's leading span."""
    from folia.operators.layout import purity

    keys = ["doc_id", "page_no", "region_id"]
    wide = regions.where("columns >= 2").select(*keys)
    large = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_lines).select(*keys)
    tagged = lines.select(*keys, "line_id").join(leading_spans(spans).select(*LINE, "language"), LINE, "left").withColumn("language", F.coalesce("language", F.lit("unknown")))
    counts = tagged.join(wide, keys, "left_semi").join(large, keys, "left_semi").groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("n"))
    return purity(counts, keys, "language")


def views(pages: DataFrame, blobs: DataFrame, view: str = "gray") -> DataFrame:
    """(doc_id, page_no, sha256, bytes) of each page's view, the raw one where it is missing."""
    at = pages.select("doc_id", "page_no", F.coalesce(F.col("views")[view], F.col("views")["raw"]).alias("sha256"))
    return at.join(blobs.select("sha256", "bytes"), "sha256", "left").select("doc_id", "page_no", "sha256", "bytes")


def full_page_image(pages: DataFrame, images: DataFrame, coverage: float = 0.5, max_text: int = 20) -> DataFrame:
    """(doc_id, page_no, image, x, y, w, h) of pages that are one scan: one image, no text to speak of, enough of the page covered.

    ``images`` has a row for each place of an image on a page; the largest is taken.
    """
    keys = ["doc_id", "page_no"]
    area = F.col("w") * F.col("h")
    found = images.groupBy(*keys).agg(F.count_distinct("image").alias("n"), F.sum(area).alias("covered"), F.max_by(F.struct("image", "x", "y", "w", "h"), F.struct(area, -F.col("place"))).alias("best"))
    both = pages.join(found.where("n = 1"), keys)
    size = F.col("width") * F.col("height")
    fits = (F.length(S.trimmed(F.col("text"))) <= max_text) & (size > 0) & (F.col("covered") / size >= coverage)
    return both.where(fits).select(*keys, "best.image", "best.x", "best.y", "best.w", "best.h")


def response_key(model: Column, image_sha256: Column, boxes: Column, prompt_version: str) -> Column:
    """A digest of what a reply depends on; ``boxes`` is JSON of the boxes by line id."""
    parts = F.concat(F.lit('{"boxes":'), boxes, F.lit(',"image":"'), image_sha256, F.lit('","model":"'), model, F.lit(f'","prompt_version":"{prompt_version}"}}'))
    return F.sha2(parts, 256)
