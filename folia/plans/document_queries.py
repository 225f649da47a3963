"""Queries over documents as tables: updates by results, accessors, dumps, predicates and the verifiers' metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators import document as D
from folia.plans import inputs as I
from folia.plans import verify as V

QUERIES, SQL = {}, {}
KEYS = ["doc_id", "page_no"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, d):
    return I.page_lines(I.table(spark, d, "documents"))


def _regions(lines):
    regions = I.page_regions(lines)
    return D.reading_positions(regions, I.listed_regions(regions))


def _texts(spark, d):
    lines = _lines(spark, d)
    return D.region_texts(lines, _regions(lines))


ROLE_SQL = "CASE WHEN region_type = 'marginalia' THEN 'marginalia' WHEN columns >= 2 THEN 'column' ELSE 'prose' END"
BLANK = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
TEXTS_SQL = f"""{I.PAGES_SQL.strip()},
region_text AS (SELECT doc_id, page_no, region_id, string_agg(text, chr(10) ORDER BY line_index) AS text FROM page_lines GROUP BY ALL),
texts AS (SELECT doc_id, page_no, seq, region_id, {ROLE_SQL} AS role, column_index, columns, text FROM region_text JOIN ordered USING (doc_id, page_no, region_id)),
page_text AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM texts WHERE text <> '' GROUP BY ALL),
doc_text AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM page_text GROUP BY ALL)"""


@query(f"WITH {I.PAGES_SQL} SELECT doc_id, page_no, line_id FROM page_lines WHERE page_no IN (0, 2, 7) AND page_no < 3")
def page_filter(spark, d):
    return D.only_pages(_lines(spark, d), [0, 2, 7], 3).select(*KEYS, "line_id")


@query(f"WITH {I.PAGES_SQL} SELECT doc_id, page_no, line_id, length(text) AS n FROM page_lines WHERE {BLANK.format('text')} <> ''")
def spoken_lines(spark, d):
    return _lines(spark, d).where(D.said(F.col("text"))).select(*KEYS, "line_id", F.length("text").alias("n"))


@query(f"WITH {I.PAGES_SQL} SELECT doc_id, page_no, line_id, span_index, kind, ref, kind IN ('quran', 'hadith') OR ref IS NOT NULL AS corpus_hit FROM spans")
def corpus_hits(spark, d):
    return I.page_spans(_lines(spark, d)).select(*D.SPAN, "kind", "ref", D.corpus_hit(F.col("kind"), F.col("ref")).alias("corpus_hit"))


@query(f"WITH {I.PAGES_SQL} SELECT *, {ROLE_SQL} AS role FROM regions")
def region_roles(spark, d):
    return I.page_regions(_lines(spark, d)).withColumn("role", D.region_role(F.col("region_type"), F.col("columns")))


@query(f"""WITH {I.PAGES_SQL} SELECT DISTINCT ref, CASE WHEN starts_with(ref, 'quran:') THEN substr(ref, 7) ELSE replace(ref, 'bukhari:', 'bukhari ') END AS pretty, CASE WHEN starts_with(ref, 'quran:') THEN 'quran' ELSE 'hadith' END AS kind FROM spans WHERE ref IS NOT NULL""")
def pretty_refs(spark, d):
    refs = I.page_spans(_lines(spark, d)).where("ref IS NOT NULL").select("ref").distinct()
    return refs.select("ref", D.pretty_ref(F.col("ref")).alias("pretty"), D.corpus_kind(F.col("ref")).alias("kind"))


@query(f"""WITH {I.PAGES_SQL}, j AS (SELECT p.doc_id, p.page_no, p.line_id, p.text, m.action, m.ref, m.corpus_text, m.char_start AS a, m.char_end AS b, m.char_start < m.char_end AND m.char_end <= length(p.text) AS ok FROM page_lines p LEFT JOIN matches m USING (doc_id, page_no, line_id))
SELECT doc_id, page_no, line_id, action, ref, CASE WHEN ok AND action = 'replaced' THEN substr(text, 1, a) || corpus_text || substr(text, b + 1) ELSE text END AS text,
  CASE WHEN ok AND action = 'replaced' THEN substr(text, a + 1, b - a) END AS original_text,
  CASE WHEN ok THEN CASE WHEN a > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN b < length(text) THEN 1 ELSE 0 END END AS n_spans FROM j""")
def apply_matches(spark, d):
    lines = _lines(spark, d)
    done = D.apply_matches(lines, I.page_matches(lines))
    n = F.when(F.col("spans").isNotNull(), F.size("spans"))
    return done.select(*D.LINE, "action", "ref", "text", "original_text", n.alias("n_spans"))


@query(f"""WITH {I.PAGES_SQL} SELECT s.doc_id, s.page_no, s.line_id, s.span_index, coalesce(r.language, s.language) AS language, r.posterior, coalesce(r.language <> s.language, false) AS changed FROM spans s LEFT JOIN routes r USING (doc_id, page_no, line_id, span_index)""")
def apply_routes(spark, d):
    spans = I.page_spans(_lines(spark, d))
    return D.apply_routes(spans, I.page_routes(spans)).select(*D.SPAN, "language", "posterior", "changed")


@query(f"""WITH {I.PAGES_SQL}, p AS (SELECT doc_id, page_no, count(*) AS n_lines, 'raw' AS state FROM page_lines GROUP BY ALL), o AS (SELECT doc_id, page_no, count(*) AS n_regions FROM regions WHERE page_no % 2 = 0 GROUP BY ALL)
SELECT doc_id, page_no, n_lines, CASE WHEN o.n_regions IS NULL THEN state ELSE 'ordered' END AS state, coalesce(o.n_regions, 0) AS n_regions FROM p LEFT JOIN o USING (doc_id, page_no)""")
def apply_pages(spark, d):
    lines = _lines(spark, d)
    pages = lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_lines")).withColumns({"state": F.lit("raw"), "n_regions": F.lit(0).cast("long")})
    results = I.page_regions(lines).where("page_no % 2 = 0").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_regions")).withColumn("state", F.lit("ordered"))
    return D.apply_pages(pages, results, "state", "n_regions")


@query(f"""WITH {I.PAGES_SQL}, r AS (SELECT doc_id, page_no, line_index % 12 AS position, CASE WHEN line_index % 4 = 3 THEN 'made-up' ELSE line_id END AS line_id, text FROM page_lines), b AS (SELECT doc_id, page_no, line_index % 12 AS position, line_id, x, y, w, h FROM page_lines WHERE line_index % 12 <> 7)
SELECT r.doc_id, r.page_no, CAST(r.position AS INTEGER) AS position, r.line_id, coalesce(i.x, p.x, 0) AS x, coalesce(i.y, p.y, 0) AS y, coalesce(i.w, p.w, 600) AS w, coalesce(i.h, p.h, 800) AS h, length(r.text) > 0 AS has_text
FROM r LEFT JOIN b i ON i.doc_id = r.doc_id AND i.page_no = r.page_no AND i.line_id = r.line_id LEFT JOIN b p ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND p.position = r.position""")
def build_lines(spark, d):
    lines = _lines(spark, d).withColumn("position", F.col("line_index") % 12)
    reads = lines.select(*KEYS, "position", F.when(F.col("line_index") % 4 == 3, "made-up").otherwise(F.col("line_id")).alias("line_id"), F.when(F.length("text") > 0, F.lit("a")).otherwise("").alias("text"))
    pages = lines.select(*KEYS).distinct().withColumns({"width": F.lit(600).cast("long"), "height": F.lit(800).cast("long")})
    built = D.build_lines(reads, lines.where("position <> 7").select(*KEYS, "position", "line_id", "x", "y", "w", "h"), pages)
    return built.select(*KEYS, "position", "line_id", "x", "y", "w", "h", (F.length("text") > 0).alias("has_text"))


@query(f"WITH {I.PAGES_SQL} SELECT doc_id, page_no, region_id, seq FROM ordered")
def reading_positions(spark, d):
    return _regions(_lines(spark, d)).select(*KEYS, "region_id", "seq")


@query(f"WITH {TEXTS_SQL} SELECT * FROM page_text")
def page_texts(spark, d):
    return D.page_texts(_texts(spark, d))


@query(f"WITH {TEXTS_SQL} SELECT * FROM doc_text")
def document_texts(spark, d):
    return D.document_texts(_texts(spark, d))


@query(f"""WITH {TEXTS_SQL}, c AS (SELECT doc_id, page_no, seq, '-- [' || seq || '] ' || role || CASE WHEN role = 'column' THEN printf(' %+d/%d', CAST(column_index AS INTEGER), CAST(columns AS INTEGER)) ELSE '' END || ' --' || chr(10) || text AS chunk, {BLANK.format('text')} <> '' AS said FROM texts)
SELECT doc_id, page_no, repeat('=', 60) || chr(10) || '== page ' || (page_no + 1) || chr(10) || repeat('=', 60) || coalesce(string_agg(chr(10) || chr(10) || chunk, '' ORDER BY seq) FILTER (said), '') AS text FROM c GROUP BY doc_id, page_no""")
def document_dump(spark, d):
    return D.text_dump(_texts(spark, d))


@query(f"""WITH {TEXTS_SQL}, l AS (SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS lines FROM page_lines GROUP BY doc_id)
SELECT doc_id, pages, lines, coalesce(length(text), 0) AS chars FROM l LEFT JOIN doc_text USING (doc_id)""")
def document_summary(spark, d):
    lines = _lines(spark, d)
    return D.summary(lines.select(*KEYS).distinct(), lines, _texts(spark, d))


@query(f"""WITH {I.PAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY CASE WHEN kind <> 'ocr' THEN 0 WHEN coalesce(ref, '') <> '' THEN 1 ELSE 2 END, span_index) AS k FROM spans)
SELECT doc_id, page_no, line_id, span_index, kind, ref, language FROM r WHERE k = 1""")
def leading_spans(spark, d):
    return D.leading_spans(I.page_spans(_lines(spark, d)))


@query(f"""WITH {I.PAGES_SQL}, c AS (SELECT doc_id, page_no, line_id, sum(CASE WHEN kind IN ('quran', 'hadith') THEN char_end - char_start ELSE 0 END) AS covered FROM spans GROUP BY ALL)
SELECT doc_id, page_no, line_id, round(CASE WHEN length(text) > 0 THEN coalesce(covered, 0) / length(text) ELSE 0 END, 6) AS replaced FROM page_lines LEFT JOIN c USING (doc_id, page_no, line_id)""")
def replaced_fraction(spark, d):
    lines = _lines(spark, d)
    return D.replaced_fraction(I.page_spans(lines), lines).select(*D.LINE, F.round("replaced", 6).alias("replaced"))


@query(f"WITH {I.PAGES_SQL}, m AS (SELECT doc_id, page_no, region_id, median(h) AS m FROM page_lines GROUP BY ALL) SELECT doc_id, coalesce(median(m), 0.0) AS body_h FROM m GROUP BY doc_id")
def body_height(spark, d):
    return D.body_height(_lines(spark, d))


PURITIES_SQL = f"""{I.PAGES_SQL.strip()}, lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY CASE WHEN kind <> 'ocr' THEN 0 WHEN coalesce(ref, '') <> '' THEN 1 ELSE 2 END, span_index) AS k FROM spans) WHERE k = 1),
tags AS (SELECT p.doc_id, p.page_no, p.region_id, coalesce(lead.language, 'unknown') AS language FROM page_lines p JOIN regions r ON r.doc_id = p.doc_id AND r.page_no = p.page_no AND r.region_id = p.region_id AND r.columns >= 2 LEFT JOIN lead ON lead.doc_id = p.doc_id AND lead.page_no = p.page_no AND lead.line_id = p.line_id),
tally AS (SELECT doc_id, page_no, region_id, language, count(*) AS n FROM tags GROUP BY ALL),
purities AS (SELECT doc_id, page_no, region_id, sum(n) AS n_lines, coalesce(max(n) FILTER (language <> 'unknown') / sum(n) FILTER (language <> 'unknown'), 1.0) AS purity FROM tally GROUP BY ALL HAVING sum(n) >= 3)"""


def _purities(lines):
    return D.verified_purity(I.page_spans(lines), lines, I.page_regions(lines))


@query(f"WITH {PURITIES_SQL} SELECT doc_id, page_no, region_id, round(purity, 6) AS purity FROM purities")
def verified_purity(spark, d):
    return _purities(_lines(spark, d)).select(*KEYS, "region_id", F.round("purity", 6).alias("purity"))


@query("""WITH p AS (SELECT page_id AS doc_id, 0 AS page_no, sha256(url) AS raw, CASE WHEN page_id % 3 = 0 THEN sha256(coalesce(html, '')) END AS gray FROM pages), b AS (SELECT DISTINCT sha256(url) AS sha256 FROM pages UNION SELECT sha256(coalesce(html, '')) FROM pages WHERE page_id % 2 = 0)
SELECT doc_id, page_no, coalesce(gray, raw) AS sha256, b.sha256 IS NOT NULL AS found FROM p LEFT JOIN b ON b.sha256 = coalesce(gray, raw)""")
def page_views(spark, d):
    pages = I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_no"), "url", F.coalesce("html", F.lit("")).alias("html"))
    stored = pages.select("url").union(pages.where("doc_id % 2 = 0").select("html")).distinct().select(F.sha2("url", 256).alias("sha256"), F.encode("url", "UTF-8").alias("bytes")).dropDuplicates(["sha256"])
    seen = pages.select("doc_id", "page_no", F.create_map(F.lit("raw"), F.sha2("url", 256), F.lit("gray"), F.when(F.col("doc_id") % 3 == 0, F.sha2("html", 256))).alias("views"))
    return D.views(seen, stored).select("doc_id", "page_no", "sha256", F.col("bytes").isNotNull().alias("found"))


@query("""WITH p AS (SELECT p_partkey AS doc_id, 0 AS page_no, 600 AS width, 800 AS height, repeat('t', p_size) AS text FROM part),
i AS (SELECT l_partkey AS doc_id, CASE WHEN l_suppkey % 20 = 0 THEN 1 ELSE 0 END AS image, l_orderkey * 10 + l_linenumber AS place, l_suppkey % 20 AS x, l_orderkey % 30 AS y, 100 + l_orderkey % 500 AS w, 100 + l_suppkey % 7 * 100 AS h FROM lineitem),
g AS (SELECT doc_id, count(DISTINCT image) AS n, sum(w * h) AS covered, arg_max(struct_pack(image, x, y, w, h), struct_pack(a := w * h, b := -place)) AS best FROM i GROUP BY doc_id HAVING count(DISTINCT image) = 1)
SELECT doc_id, page_no, best.image AS image, best.x AS x, best.y AS y, best.w AS w, best.h AS h FROM p JOIN g USING (doc_id) WHERE length(text) <= 20 AND covered / (width * height) >= 0.5""")
def full_page_image(spark, d):
    pages = I.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(600).alias("width"), F.lit(800).alias("height"), F.expr("repeat('t', p_size)").alias("text"))
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    images = I.table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.lit(0).alias("page_no"), F.when(s % 20 == 0, 1).otherwise(0).alias("image"), (o * 10 + F.col("l_linenumber")).alias("place"), (s % 20).alias("x"), (o % 30).alias("y"), (100 + o % 500).alias("w"), (100 + s % 7 * 100).alias("h"))
    return D.full_page_image(pages, images)


@query("""SELECT page_id, sha256('{"boxes":' || '{"l0":' || page_id % 7 || '}' || ',"image":"' || sha256(url) || '","model":"stub","prompt_version":"1"}') AS key FROM pages""")
def response_keys(spark, d):
    pages = I.table(spark, d, "pages")
    boxes = F.concat(F.lit('{"l0":'), (F.col("page_id") % 7).cast("string"), F.lit("}"))
    return pages.select("page_id", D.response_key(F.lit("stub"), F.sha2("url", 256), boxes, "1").alias("key"))


# the verifiers

FORM = "SELECT doc_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME metric VALUE value) WHERE value IS NOT NULL"


def _rounded(metrics):
    return metrics.select("doc_id", "metric", F.round("value", 6).alias("value"))


def _double(*names):
    return ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in names)


EXTRACT_SQL = f"""{I.PAGES_SQL.strip()}, p AS (
  SELECT doc_id, page_no, count(*) + doc_id % 3 AS detected, count(*) FILTER ({BLANK.format('text')} <> '') AS returned, count(*) FILTER ({BLANK.format('text')} = '') AS empty, count(*) FILTER (length(text) > 300) AS implausible,
    (doc_id * 7 + page_no) % 10 / 10 AS purity, (doc_id + page_no) % 5 / 10 AS repeat, sum(length(text)) > 0 AS has_text FROM page_lines GROUP BY doc_id, page_no)"""


def _extract(spark, d):
    text = F.col("text")
    pages = _lines(spark, d).groupBy(*KEYS).agg(
        (F.count(F.lit(1)) + F.first("doc_id") % 3).alias("detected"), F.count_if(D.said(text)).alias("returned"), F.count_if(~D.said(text)).alias("empty"), F.count_if(F.length(text) > 300).alias("implausible"), (F.sum(F.length(text)) > 0).alias("has_text"),
    )
    pages = pages.withColumns({"purity": (F.col("doc_id") * 7 + F.col("page_no")) % 10 / 10, "repeat": (F.col("doc_id") + F.col("page_no")) % 5 / 10})
    return V.extract_metrics(pages)


@query(f"""WITH {EXTRACT_SQL}, m AS (SELECT doc_id, avg(least(CASE WHEN detected > 0 THEN returned / detected ELSE 1 END, 1)) AS c, avg(purity) AS u, max(repeat) AS r, sum(implausible) AS i, count(*) AS n FROM p GROUP BY doc_id),
wide AS (SELECT doc_id, {_double(("coverage.line_count", "c"), ("lexical.script_purity", "u"), ("degeneracy.repeat_rate", "r"), ("alignment.implausible_cells", "i"), ("pages", "n"), ("score", "least(c, u)"))} FROM m) {FORM}""")
def extract_metrics(spark, d):
    return _rounded(_extract(spark, d)[0])


@query(f"""WITH {EXTRACT_SQL} SELECT * FROM (SELECT doc_id, page_no, unnest([
  CASE WHEN implausible > 0 THEN 'page ' || page_no || ': ' || implausible || ' cell(s) hold more text than they have room for' END,
  CASE WHEN detected > 0 AND returned / detected < 0.95 THEN 'page ' || page_no || ': ' || returned || '/' || detected || ' lines returned' END,
  CASE WHEN empty > greatest(1, detected * 0.1) THEN 'page ' || page_no || ': ' || empty || ' lines came back empty' END,
  CASE WHEN has_text AND purity < 0.55 THEN 'page ' || page_no || ': only ' || CAST(round_even(purity * 100, 0) AS INTEGER) || '% of characters are of the script' END,
  CASE WHEN repeat > 0.25 THEN 'page ' || page_no || ': ' || CAST(round_even(repeat * 100, 0) AS INTEGER) || '% of the text is one repeated n-gram' END]) AS finding FROM p) WHERE finding IS NOT NULL""")
def extract_findings(spark, d):
    return _extract(spark, d)[1]


ORDER_SQL = f"""{PURITIES_SQL}, p AS (SELECT doc_id, page_no, count(*) AS lines_in, count(*) - CASE WHEN (doc_id + page_no) % 11 = 0 THEN 1 ELSE 0 END AS lines_out FROM page_lines GROUP BY doc_id, page_no),
b AS (SELECT doc_id, page_no, count(*) FILTER (columns >= 2) AS blocks FROM regions GROUP BY doc_id, page_no),
rg AS (SELECT r.doc_id, r.page_no, r.region_id, r.columns, u.purity FROM regions r LEFT JOIN purities u USING (doc_id, page_no, region_id))"""


def _order(spark, d):
    lines = _lines(spark, d)
    regions = I.page_regions(lines)
    short = F.when((F.first("doc_id") + F.first("page_no")) % 11 == 0, 1).otherwise(0)
    pages = lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lines_in"), (F.count(F.lit(1)) - short).alias("lines_out")).join(regions.groupBy(*KEYS).agg(F.count_if(F.col("columns") >= 2).alias("blocks")), KEYS)
    keys = [*KEYS, "region_id"]
    sized = regions.join(lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines")), keys).join(_purities(lines), keys, "left")
    return V.order_metrics(pages, sized.select(*keys, "columns", "n_lines", "purity"))


@query(f"""WITH {ORDER_SQL}, f AS (SELECT doc_id, sum(lines_in) AS i, sum(lines_out) AS o, sum(blocks) AS blocks FROM p JOIN b USING (doc_id, page_no) GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n, avg(purity) AS u FROM rg GROUP BY doc_id),
wide AS (SELECT doc_id, {_double(("order.column_blocks", "blocks"), ("order.regions", "n"), ("order.column_purity", "u"), ("order.line_conservation", "o / i"), ("score", "least(o / i, coalesce(u, 1.0))"))} FROM f JOIN g USING (doc_id)) {FORM}""")
def order_metrics(spark, d):
    return _rounded(_order(spark, d)[0])


@query(f"""WITH {ORDER_SQL} SELECT doc_id, page_no, 'page ' || page_no || ': grouped ' || lines_out || ' of ' || lines_in || ' lines' AS finding FROM p WHERE lines_in <> lines_out
UNION ALL SELECT doc_id, page_no, 'page ' || page_no || ': column region ' || region_id || ' mixes languages (' || CAST(round_even(purity * 100, 0) AS INTEGER) || '% agree)' FROM rg WHERE purity < 0.8""")
def order_findings(spark, d):
    return _order(spark, d)[1]


MATCH_SQL = f"""{I.PAGES_SQL.strip()}, considered AS (SELECT doc_id, page_no, line_id, (doc_id + line_index) % 9 = 1 AS sacred FROM page_lines WHERE {BLANK.format('text')} <> ''),
pairs AS (SELECT doc_id, line_index - lag(line_index) OVER w AS apart, corpus_start - lag(corpus_end) OVER w AS hop FROM matches WINDOW w AS (PARTITION BY doc_id, page_no, region_id ORDER BY line_index)),
runs AS (SELECT doc_id, count(*) AS runs, count(*) FILTER (hop BETWEEN 0 AND 3) AS good FROM pairs WHERE apart <= 2 GROUP BY doc_id),
open_lines AS (SELECT doc_id, count(*) FILTER (sacred) AS unresolved FROM considered ANTI JOIN matches USING (doc_id, page_no, line_id) GROUP BY doc_id),
said AS (SELECT doc_id, count(*) FILTER (action = 'replaced') AS r, count(*) FILTER (action = 'cited') AS c, sum(candidates) AS k, avg(identity) AS identity, min(margin) AS margin, count(*) FILTER (margin < 0.05) AS vague FROM matches GROUP BY doc_id),
every AS (SELECT doc_id, n, coalesce(r, 0) AS r, coalesce(c, 0) AS c, coalesce(k, 0) AS k, identity, margin, vague, coalesce(unresolved, 0) AS unresolved, runs, good FROM (SELECT doc_id, count(*) AS n FROM considered GROUP BY doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN open_lines USING (doc_id) LEFT JOIN runs USING (doc_id))"""


def _match(spark, d):
    lines = _lines(spark, d)
    considered = lines.where(D.said(F.col("text"))).select(*D.LINE, ((F.col("doc_id") + F.col("line_index")) % 9 == 1).alias("sacred"))
    return V.match_metrics(I.page_matches(lines), considered)


@query(f"""WITH {MATCH_SQL}, wide AS (SELECT doc_id, {_double(("match.replaced", "r"), ("match.cited", "c"), ("match.candidates_considered", "k"), ("match.identity", "identity"), ("match.margin_min", "margin"), ("match.ambiguous_citations", "vague"), ("match.unresolved", "unresolved"), ("match.lines_considered", "n"), ("match.run_continuity", "good / runs"))} FROM every) {FORM}""")
def match_metrics(spark, d):
    return _rounded(_match(spark, d)[0])


@query(f"""WITH {MATCH_SQL} SELECT doc_id, 'page ' || page_no || ': ' || line_id || ' matched ' || ref || ' at identity ' || printf('%.2f', round_even(identity, 2)) || ' but margin ' || printf('%.2f', round_even(margin, 2)) AS finding
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_index) AS k FROM matches WHERE margin < 0.05) WHERE k <= 8
UNION ALL SELECT doc_id, (runs - good) || ' of ' || runs || ' neighbouring match pairs do not run on' FROM every WHERE good < runs
UNION ALL SELECT doc_id, unresolved || ' vocalized line(s) matched nothing' FROM every WHERE unresolved > 0""")
def match_findings(spark, d):
    return _match(spark, d)[1]


ROUTE_SQL = f"""{PURITIES_SQL}, routed AS (SELECT s.doc_id, coalesce(r.language, s.language) AS language, r.posterior, coalesce(r.from_corpus, false) AS from_corpus, coalesce(r.language <> s.language, false) AS changed FROM spans s LEFT JOIN routes r USING (doc_id, page_no, line_id, span_index))"""


def _route(spark, d):
    lines = _lines(spark, d)
    spans = I.page_spans(lines)
    routes = I.page_routes(spans)
    routed = D.apply_routes(spans, routes).join(routes.select(*D.SPAN, "from_corpus"), D.SPAN, "left").withColumn("from_corpus", F.coalesce("from_corpus", F.lit(False)))
    return V.route_metrics(routed, _purities(lines))


@query(f"""WITH {ROUTE_SQL}, m AS (SELECT doc_id, count(*) AS n, count(*) FILTER (from_corpus) AS f, count(*) FILTER (changed) AS t, avg(posterior) AS p, count(*) FILTER (language = 'arabic') / count(*) AS a, count(*) FILTER (language = 'urdu') / count(*) AS u, count(*) FILTER (language = 'mixed') / count(*) AS x FROM routed GROUP BY doc_id),
wide AS (SELECT doc_id, {_double(("route.spans", "n"), ("route.from_corpus", "f"), ("route.retagged", "t"), ("route.mean_posterior", "p"), ("route.arabic_frac", "a"), ("route.urdu_frac", "u"), ("route.mixed_frac", "x"), ("route.column_purity", "c"))} FROM m LEFT JOIN (SELECT doc_id, avg(purity) AS c FROM purities GROUP BY doc_id) USING (doc_id)) {FORM}""")
def route_metrics(spark, d):
    return _rounded(_route(spark, d)[0])


@query(f"WITH {ROUTE_SQL} SELECT doc_id, page_no, 'page ' || page_no || ': column region ' || region_id || ' still mixes languages (' || CAST(round_even(purity * 100, 0) AS INTEGER) || '% agree)' AS finding FROM purities WHERE purity < 0.8")
def route_findings(spark, d):
    return _route(spark, d)[1]


INGEST_SQL = """p AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 100 + o_orderkey % 140 END AS dpi, CASE WHEN o_orderkey % 9 = 0 THEN 0.001 ELSE 0.1 END AS ink, o_orderkey % 2 = 0 AS native FROM orders),
m AS (SELECT doc_id, min(dpi) AS lo, avg(dpi) AS mean, count(*) FILTER (ink < 0.002) AS blank, count(*) AS n, avg(CAST(native AS INTEGER)) AS native FROM p GROUP BY doc_id)"""


def _ingest(spark, d):
    k = F.col("o_orderkey")
    pages = I.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(k % 5 != 0, 100 + k % 140).alias("dpi"), F.when(k % 9 == 0, 0.001).otherwise(0.1).alias("ink"), (k % 2 == 0).alias("native"))
    return V.ingest_metrics(pages)


@query(f"""WITH {INGEST_SQL}, wide AS (SELECT doc_id, {_double(("min_source_dpi", "lo"), ("mean_source_dpi", "mean"), ("blank_pages", "blank"), ("pages", "n"), ("native_extraction_ratio", "native"))} FROM m) {FORM}""")
def ingest_metrics(spark, d):
    return _rounded(_ingest(spark, d)[0])


@query(f"""WITH {INGEST_SQL} SELECT doc_id, 'source resolution is low (min ' || lo || ' DPI)' AS finding FROM m WHERE lo < 150 UNION ALL SELECT doc_id, blank || ' page(s) appear blank' FROM m WHERE blank > 0""")
def ingest_findings(spark, d):
    return _ingest(spark, d)[1]


# rendering

ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
PERCENT = "printf('%.3f', round(100.0::DOUBLE * {0} / {1}, 3))"


def _sized(lines):
    return lines.select(*KEYS).distinct().withColumns({"width": F.lit(600), "height": F.lit(800)})


@query(f"""WITH {I.PAGES_SQL} SELECT doc_id, page_no, line_id, '<div class="box" style="left:' || {PERCENT.format('x', 600)} || '%;top:' || {PERCENT.format('y', 800)} || '%;width:' || {PERCENT.format('w', 600)} || '%;height:' || {PERCENT.format('h', 800)} || '%;font-size:' || printf('%.1f', round(h * 0.72::DOUBLE, 1)) || 'px">' || {ESCAPED.format('text')} || '</div>' AS html FROM page_lines""")
def line_boxes(spark, d):
    from folia.sources import render as H

    lines = _lines(spark, d)
    return H.line_boxes(lines, _sized(lines)).select(*D.LINE, "html")


SPAN_HTML_SQL = f"""CASE WHEN kind <> 'ocr' THEN '<span class="' || kind || '">' || t || '</span>' WHEN ref IS NOT NULL THEN '<span class="cited ' || CASE WHEN starts_with(ref, 'quran:') THEN 'quran' ELSE 'hadith' END || '">' || t || '</span>' ELSE t END"""
LINE_HTML_SQL = f"""{I.PAGES_SQL.strip()}, cut AS (SELECT s.*, {ESCAPED.format('substr(p.text, char_start + 1, char_end - char_start)')} AS t FROM spans s JOIN page_lines p USING (doc_id, page_no, line_id)),
line_html AS (SELECT doc_id, page_no, line_id, string_agg({SPAN_HTML_SQL}, '' ORDER BY char_start, span_index) AS line_html FROM cut GROUP BY ALL)"""


@query(f"WITH {LINE_HTML_SQL} SELECT * FROM line_html")
def span_markup(spark, d):
    from folia.sources import render as H

    lines = _lines(spark, d)
    return H.line_html(I.page_spans(lines), lines)


@query(f"""WITH {LINE_HTML_SQL}, covered AS (SELECT doc_id, page_no, line_id, sum(CASE WHEN kind IN ('quran', 'hadith') THEN char_end - char_start ELSE 0 END) AS n, min(ref) AS ref FROM spans GROUP BY ALL),
l AS (SELECT p.doc_id, p.page_no, p.region_id, p.line_index, h.line_html, c.ref, c.n / length(p.text) >= 0.6 AS verse, p.line_index // 2 AS paragraph FROM page_lines p JOIN line_html h USING (doc_id, page_no, line_id) JOIN covered c USING (doc_id, page_no, line_id) WHERE p.text <> ''),
b AS (SELECT doc_id, page_no, region_id, verse, CASE WHEN verse THEN printf('v%08d', line_index) ELSE printf('p%08d', CAST(paragraph AS INTEGER)) END AS blk, min(line_index) AS f,
  string_agg(line_html || CASE WHEN verse AND ref IS NOT NULL THEN ' <span class="ref">' || CASE WHEN starts_with(ref, 'quran:') THEN substr(ref, 7) ELSE replace(ref, 'bukhari:', 'bukhari ') END || '</span>' ELSE '' END, ' ' ORDER BY line_index) AS t FROM l GROUP BY ALL),
r AS (SELECT doc_id, page_no, region_id, string_agg(CASE WHEN verse THEN '<p class="verse">' ELSE '<p>' END || t || '</p>', chr(10) ORDER BY f, blk) AS html FROM b GROUP BY ALL)
SELECT doc_id, page_no, region_id, seq, CASE WHEN region_type = 'marginalia' THEN '<aside class="note">' || html || '</aside>' ELSE '<div>' || html || '</div>' END AS html FROM r JOIN ordered USING (doc_id, page_no, region_id)""")
def reader_regions(spark, d):
    from folia.sources import render as H

    lines = _lines(spark, d)
    spans = I.page_spans(lines)
    cited = spans.groupBy(*D.LINE).agg(F.min("ref").alias("ref"))
    rows = lines.join(H.line_html(spans, lines), D.LINE).join(D.replaced_fraction(spans, lines), D.LINE).join(cited, D.LINE).withColumn("paragraph", F.floor(F.col("line_index") / 2).cast("int"))
    return H.reader_regions(rows, _regions(lines))
