"""Tables shaped into what the operators read: lines, tokens, cells, rectangles, ledger rows.

Each shape has an SQL twin, a list of common table expressions over the same
tables, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions import fixed as X
from folia.functions.script import shown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes of what is dealt out by a key.
TASK_ROWS = 100_000


def n_tasks(rows: DataFrame, each: int = TASK_ROWS) -> int:
    return max(8, -(-rows.count() // each))


def dealt(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """The rows with those of a key together, for all that follows; the tasks grow in number with the table, not in size."""
    return rows.repartition(tasks or n_tasks(rows), *keys)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_index, text): a document's lines, counted from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "text"))


def words(text: Column) -> Column:
    """Match tokens of Latin prose: lower case, letters only, empty ones dropped."""
    bare = F.transform(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: F.regexp_replace(w, "[^a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]", ""))
    return F.filter(bare, lambda w: w != "")


def cells(lineitem: DataFrame) -> DataFrame:
    """(page, cell, x, y, w, h): page geometry from integer arithmetic on order lines.

    Two cells a row with a gutter; every seventh page has narrow left cells, every
    fifth a full-width row first.
    """
    side, row = F.col("l_linenumber") % 2, F.floor(F.col("l_linenumber") / 2)
    jitter = F.col("l_partkey") % 5
    narrow = F.col("l_orderkey") % 7 == 0
    whole = (F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1)
    x = F.when(whole, 20).when(side == 0, 320 + jitter).otherwise(20 + F.col("l_suppkey") % 5)
    w = F.when(whole, 560).when(side == 0, 260 - jitter).when(narrow, 60).otherwise(240 + F.col("l_suppkey") % 7)
    # a pseudo-language that is mostly steady in a column
    lang = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 9 == 0, "mixed").when(side == 0, "arabic").otherwise("urdu")
    return lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("cell"),
        x.cast("long").alias("x"), (100 + 40 * row + F.col("l_partkey") % 4).cast("long").alias("y"), w.cast("long").alias("w"),
        (30 + F.col("l_suppkey") % 3).cast("long").alias("h"), lang.alias("lang"),
    )


def rectangles(lineitem: DataFrame) -> DataFrame:
    """(page, row, x, y, w, h): one text row for each order line; some are tall, some gaps wide."""
    tall = (F.col("l_partkey") % 11 == 0).cast("int")
    skip = (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") >= 4)
    return lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("row"), (20 + F.col("l_suppkey") % 5).cast("long").alias("x"),
        (100 + 40 * F.col("l_linenumber") + F.when(skip, 60).otherwise(0) + F.col("l_partkey") % 3).cast("long").alias("y"),
        (360 - F.col("l_partkey") % 50).cast("long").alias("w"), (20 + 40 * tall + F.col("l_suppkey") % 2).cast("long").alias("h"),
    )


def boxes(lineitem: DataFrame) -> DataFrame:
    """``rectangles`` with rows numbered down the page, each once."""
    w = Window.partitionBy("page").orderBy("y", "row", "h", "w", "x")
    return rectangles(lineitem).select("page", F.row_number().over(w).alias("row"), "x", "y", "w", "h")


def ink(lineitem: DataFrame) -> DataFrame:
    """Ink of ``rectangles``: two runs in each row with a gap, wide in two rows of even pages, and ink between rows of some pages."""
    part, even = F.col("l_partkey"), (F.col("l_orderkey") % 2 == 0) & F.col("l_linenumber").isin(3, 4)
    left, gap = 100 + F.col("l_suppkey") % 9, F.when(even, 60 + part % 7).otherwise(9 + part % 3)
    x, y, w, h = 20 + F.col("l_suppkey") % 5, 100 + 40 * F.col("l_linenumber") + F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") >= 4), 60).otherwise(0) + part % 3, 360 - part % 50, 20 + 40 * (part % 11 == 0).cast("int") + F.col("l_suppkey") % 2
    at = lambda a, b, c, d: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), c.cast("long").alias("w"), d.cast("long").alias("h"))
    runs = F.array(at(x + 2, y + 1, left, h - 2), at(x + 2 + left + gap, y + 1, w - 4 - left - gap, h - 2))
    stray = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 2 == 1), F.array(at(F.lit(50), y - 30, F.lit(200), F.lit(12)))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"))
    return lineitem.select(F.col("l_orderkey").alias("page"), F.explode(F.concat(runs, stray)).alias("i")).select("page", "i.*")


def script_lines(docs: DataFrame, plain_vowels: bool = False) -> DataFrame:
    """Lines in letters of the script; with ``plain_vowels``, even documents write vowels as letters."""
    even = F.col("doc_id") % 2 == 0
    return lines(docs.withColumn("text", shown(F.col("text"), even if plain_vowels else None)))  # before they are lines: what follows finds it worked out


def ledger(events: DataFrame) -> DataFrame:
    """Events as runs of a stage over a document."""
    return events.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("d"), F.col("user_id")).alias("doc_id"), F.col("event_type").alias("stage"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("stage_version"), F.col("ts").alias("started_at"),
        F.sha2(F.concat_ws("|", F.col("event_type"), (F.col("event_id") % 3).cast("string")), 256).alias("params_hash"),
        F.sha2(F.concat(F.lit("in"), (F.col("user_id") % 50).cast("string")), 256).alias("input_hash"),
        F.sha2(F.concat(F.lit("out"), F.col("event_id").cast("string")), 256).alias("output_hash"),
        F.when(F.col("event_id") % 10 == 0, "failed").when(F.col("event_id") % 4 == 0, "degraded").otherwise("ok").alias("status"), F.col("props").alias("report"),
    )


def page_lines(docs: DataFrame) -> DataFrame:
    """Lines placed on pages of twelve, three regions each, with boxes from integer arithmetic."""
    slot, d, i = F.col("line_index") % 12, F.col("doc_id"), F.col("line_index")
    rows = lines(docs).withColumns({"page_no": F.floor(i / 12).cast("int"), "region_no": F.floor(slot / 4).cast("int")})
    return rows.select(
        "doc_id", "page_no", "region_no", F.format_string("p%03dr%03d", "page_no", "region_no").alias("region_id"), F.format_string("p%03dl%03d", F.col("page_no"), slot).alias("line_id"), "line_index",
        (20 + d % 5).cast("long").alias("x"), (100 + 40 * slot).cast("long").alias("y"), (200 + F.length("text") * 7 % 300).cast("long").alias("w"), (30 + (i * 3 + d) % 4).cast("long").alias("h"), "text",
    )


def page_regions(page_rows: DataFrame) -> DataFrame:
    """Regions of ``page_lines``: some in two columns, some marginal; raw is their order on the page."""
    two = (F.col("doc_id") + F.col("region_no")) % 3 == 0
    each = page_rows.select("doc_id", "page_no", "region_id", "region_no").distinct()
    return each.select("doc_id", "page_no", "region_id", F.col("region_no").alias("raw"), F.when(two, 2).otherwise(1).alias("columns"), (F.col("region_no") % 2).alias("column_index"), F.when((F.col("doc_id") + F.col("region_no")) % 7 == 0, "marginalia").otherwise("unknown").alias("region_type"))


def listed_regions(regions: DataFrame) -> DataFrame:
    """A reading order that lists all but the first region of odd documents, from the last on."""
    return regions.where("NOT (doc_id % 2 = 1 AND raw = 0)").select("doc_id", "page_no", "region_id", (10 - F.col("raw")).alias("place"))


def page_spans(page_rows: DataFrame) -> DataFrame:
    """Up to three spans of each line, cut at the thirds of its text, of several kinds."""
    n, k = F.length("text"), F.col("span_index")
    cut = page_rows.withColumn("span_index", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    key = (F.col("doc_id") + F.col("line_index") + k) % 8
    tail = F.concat(F.lit(":"), (1 + F.col("doc_id") % 114).cast("string"), F.lit(":"), (1 + F.col("line_index")).cast("string"))
    tongue = (F.col("doc_id") + F.col("line_index") + k) % 4
    return cut.withColumns({"char_start": F.floor(n * k / 3).cast("int"), "char_end": F.floor(n * (k + 1) / 3).cast("int")}).where("char_end > char_start").select(
        "doc_id", "page_no", "region_id", "line_id", "line_index", "span_index", "char_start", "char_end", F.when(key == 0, "quran").when(key == 1, "hadith").otherwise("ocr").alias("kind"),
        F.when(key.isin(0, 2), F.concat(F.lit("quran"), tail)).when(key == 1, F.concat(F.lit("bukhari"), tail)).alias("ref"),
        F.when(tongue == 0, "arabic").when(tongue == 1, "urdu").when(tongue == 2, "mixed").otherwise("unknown").alias("language"),
    )


def page_matches(page_rows: DataFrame) -> DataFrame:
    """Accepted matches of every third line of ten characters or more."""
    d, i, n = F.col("doc_id"), F.col("line_index"), F.length("text")
    start = (d * 100 + i * 10 + F.when(d % 5 == 0, i * 9).otherwise(0)).cast("long")
    return page_rows.where((n >= 10) & ((d + i) % 3 == 0)).select(
        "doc_id", "page_no", "region_id", "line_id", "line_index", F.when(i % 2 == 0, "replaced").otherwise("cited").alias("action"), F.concat(F.lit("quran:"), (1 + d % 114).cast("string"), F.lit(":"), (1 + i).cast("string")).alias("ref"),
        (0.9 + (d * 7 + i) % 11 / 100).alias("identity"), ((d * 3 + i) % 20 / 100).alias("margin"), F.concat(F.lit("corpus text "), i.cast("string")).alias("corpus_text"), (d % 3).cast("int").alias("char_start"),
        F.when((d + i) % 5 == 0, n + 3).otherwise(n - 2).cast("int").alias("char_end"), start.alias("corpus_start"), (start + 28).alias("corpus_end"), F.lit(3).alias("candidates"),
    )


def page_routes(spans: DataFrame) -> DataFrame:
    """Routes of the spans of even places."""
    hit = F.col("kind").isin("quran", "hadith") | F.col("ref").isNotNull()
    return spans.where("(doc_id + span_index) % 2 = 0").select("doc_id", "page_no", "line_id", "span_index", F.when(hit, "arabic").otherwise("urdu").alias("language"), ((F.col("doc_id") + F.col("line_index")) % 10 / 10).alias("posterior"), hit.alias("from_corpus"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_index, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
)"""
WORDS_SQL = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[ \\t\\n\\r]+'), lambda w: regexp_replace(w, '[^a-zß-öø-ÿ]', '', 'g')), lambda w: w <> '')"
SHOWN_SQL = f"translate(lower({{0}}), {_sql(X.LATIN)}, {_sql(X.SHOWN)})"
PLAIN_SQL = f"translate({SHOWN_SQL}, {_sql(X.PLAIN_VOWELS_FROM)}, {_sql(X.PLAIN_VOWELS_TO)})"
SCRIPT_LINES_SQL = f"{LINES_SQL}, script_lines AS (SELECT doc_id, line_index, {SHOWN_SQL.format('text')} AS text FROM lines)"
PLAIN_LINES_SQL = f"{LINES_SQL}, script_lines AS (SELECT doc_id, line_index, CASE WHEN doc_id % 2 = 0 THEN {PLAIN_SQL.format('text')} ELSE {SHOWN_SQL.format('text')} END AS text FROM lines)"
CELLS_SQL = """
cells AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS INTEGER) AS cell,
    CAST(CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 20 WHEN l_linenumber % 2 = 0 THEN 320 + l_partkey % 5 ELSE 20 + l_suppkey % 5 END AS BIGINT) AS x,
    CAST(100 + 40 * (l_linenumber // 2) + l_partkey % 4 AS BIGINT) AS y,
    CAST(CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 560 WHEN l_linenumber % 2 = 0 THEN 260 - l_partkey % 5 WHEN l_orderkey % 7 = 0 THEN 60 ELSE 240 + l_suppkey % 7 END AS BIGINT) AS w,
    CAST(30 + l_suppkey % 3 AS BIGINT) AS h,
    CASE WHEN (l_partkey + l_suppkey) % 9 = 0 THEN 'mixed' WHEN l_linenumber % 2 = 0 THEN 'arabic' ELSE 'urdu' END AS lang
  FROM lineitem
)"""
RECTANGLES_SQL = """
rects AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS INTEGER) AS "row", CAST(20 + l_suppkey % 5 AS BIGINT) AS x,
    CAST(100 + 40 * l_linenumber + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber >= 4 THEN 60 ELSE 0 END + l_partkey % 3 AS BIGINT) AS y,
    CAST(360 - l_partkey % 50 AS BIGINT) AS w,
    CAST(20 + CASE WHEN l_partkey % 11 = 0 THEN 40 ELSE 0 END + l_suppkey % 2 AS BIGINT) AS h
  FROM lineitem
)"""
INK_SQL = f"""{RECTANGLES_SQL.strip().replace("rects AS", "drawn AS", 1)},
rects AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y, "row", h, w, x) AS INTEGER) AS "row", x, y, w, h FROM drawn),
src AS (SELECT l_orderkey AS page, l_linenumber AS n, r.x, r.y, r.w, r.h, 100 + l_suppkey % 9 AS a, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber IN (3, 4) THEN 60 + l_partkey % 7 ELSE 9 + l_partkey % 3 END AS g
  FROM (SELECT *, CAST(20 + l_suppkey % 5 AS BIGINT) AS x, CAST(100 + 40 * l_linenumber + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber >= 4 THEN 60 ELSE 0 END + l_partkey % 3 AS BIGINT) AS y, CAST(360 - l_partkey % 50 AS BIGINT) AS w, CAST(20 + CASE WHEN l_partkey % 11 = 0 THEN 40 ELSE 0 END + l_suppkey % 2 AS BIGINT) AS h FROM lineitem) r),
ink AS (SELECT page, x + 2 AS x, y + 1 AS y, a AS w, h - 2 AS h FROM src UNION ALL SELECT page, x + 2 + a + g, y + 1, w - 4 - a - g, h - 2 FROM src UNION ALL SELECT page, 50, y - 30, 200, 12 FROM src WHERE page % 3 = 0 AND page % 2 = 1 AND n = 4),
inside AS (SELECT r.page, r."row", greatest(i.x, r.x) AS x0, greatest(i.y, r.y) AS y0, least(i.x + i.w, r.x + r.w) AS x1, least(i.y + i.h, r.y + r.h) AS y1 FROM rects r JOIN ink i ON i.page = r.page AND i.x < r.x + r.w AND r.x < i.x + i.w AND i.y < r.y + r.h AND r.y < i.y + i.h),
reach AS (SELECT *, max(x1) OVER (PARTITION BY page, "row" ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, lead(x0) OVER (PARTITION BY page, "row" ORDER BY x0, x1) AS nxt FROM inside),
gutters AS (SELECT page, "row", arg_max(upto, (nxt - upto, -upto)) AS lo, arg_max(nxt, (nxt - upto, -upto)) AS hi FROM reach JOIN rects USING (page, "row") WHERE nxt > upto AND upto - x > 5 AND nxt < x + w - 5 GROUP BY page, "row")"""
LEDGER_SQL = """
ledger AS (
  SELECT event_id AS run_id, 'd' || user_id AS doc_id, event_type AS stage, 'v' || event_id % 2 AS stage_version, ts AS started_at,
    sha256(event_type || '|' || CAST(event_id % 3 AS VARCHAR)) AS params_hash, sha256('in' || CAST(user_id % 50 AS VARCHAR)) AS input_hash,
    sha256('out' || CAST(event_id AS VARCHAR)) AS output_hash,
    CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 4 = 0 THEN 'degraded' ELSE 'ok' END AS status, props AS report
  FROM events
)"""

PAGES_SQL = f"""{LINES_SQL.strip()},
page_lines AS (
  SELECT doc_id, line_index // 12 AS page_no, line_index % 12 // 4 AS region_no, printf('p%03dr%03d', line_index // 12, line_index % 12 // 4) AS region_id, printf('p%03dl%03d', line_index // 12, line_index % 12) AS line_id, line_index,
    20 + doc_id % 5 AS x, CAST(100 + 40 * (line_index % 12) AS BIGINT) AS y, 200 + length(text) * 7 % 300 AS w, 30 + (line_index * 3 + doc_id) % 4 AS h, text FROM lines
), regions AS (
  SELECT DISTINCT doc_id, page_no, region_id, region_no AS raw, CASE WHEN (doc_id + region_no) % 3 = 0 THEN 2 ELSE 1 END AS columns, region_no % 2 AS column_index, CASE WHEN (doc_id + region_no) % 7 = 0 THEN 'marginalia' ELSE 'unknown' END AS region_type FROM page_lines
), listed AS (SELECT doc_id, page_no, region_id, 10 - raw AS place FROM regions WHERE NOT (doc_id % 2 = 1 AND raw = 0)),
ordered AS (SELECT regions.*, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place IS NULL, place, raw) AS INTEGER) AS seq FROM regions LEFT JOIN listed USING (doc_id, page_no, region_id)),
spans AS (
  SELECT * FROM (
    SELECT doc_id, page_no, region_id, line_id, line_index, span_index, CAST(length(text) * span_index // 3 AS INTEGER) AS char_start, CAST(length(text) * (span_index + 1) // 3 AS INTEGER) AS char_end,
      CASE (doc_id + line_index + span_index) % 8 WHEN 0 THEN 'quran' WHEN 1 THEN 'hadith' ELSE 'ocr' END AS kind,
      CASE WHEN (doc_id + line_index + span_index) % 8 IN (0, 2) THEN 'quran' WHEN (doc_id + line_index + span_index) % 8 = 1 THEN 'bukhari' END || ':' || (1 + doc_id % 114) || ':' || (1 + line_index) AS ref,
      CASE (doc_id + line_index + span_index) % 4 WHEN 0 THEN 'arabic' WHEN 1 THEN 'urdu' WHEN 2 THEN 'mixed' ELSE 'unknown' END AS language
    FROM page_lines, (SELECT CAST(range AS INTEGER) AS span_index FROM range(3))
  ) WHERE char_end > char_start
), matches AS (
  SELECT doc_id, page_no, region_id, line_id, line_index, CASE WHEN line_index % 2 = 0 THEN 'replaced' ELSE 'cited' END AS action, 'quran:' || (1 + doc_id % 114) || ':' || (1 + line_index) AS ref,
    CAST(0.9 AS DOUBLE) + (doc_id * 7 + line_index) % 11 / 100 AS identity, (doc_id * 3 + line_index) % 20 / 100 AS margin, 'corpus text ' || line_index AS corpus_text, CAST(doc_id % 3 AS INTEGER) AS char_start,
    CAST(CASE WHEN (doc_id + line_index) % 5 = 0 THEN length(text) + 3 ELSE length(text) - 2 END AS INTEGER) AS char_end,
    doc_id * 100 + line_index * 10 + CASE WHEN doc_id % 5 = 0 THEN line_index * 9 ELSE 0 END AS corpus_start, doc_id * 100 + line_index * 10 + CASE WHEN doc_id % 5 = 0 THEN line_index * 9 ELSE 0 END + 28 AS corpus_end, 3 AS candidates
  FROM page_lines WHERE length(text) >= 10 AND (doc_id + line_index) % 3 = 0
), routes AS (
  SELECT doc_id, page_no, line_id, span_index, kind IN ('quran', 'hadith') OR ref IS NOT NULL AS from_corpus, CASE WHEN kind IN ('quran', 'hadith') OR ref IS NOT NULL THEN 'arabic' ELSE 'urdu' END AS language, (doc_id + line_index) % 10 / 10 AS posterior
  FROM spans WHERE (doc_id + span_index) % 2 = 0
)"""
