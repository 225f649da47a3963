"""Queries of the run ledger, blobs, parsing, dumps and verifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators import layout as L
from folia.operators import reader as R
from folia.plans import inputs as I
from folia.plans import ledger as G
from folia.plans import verify as V
from folia.plans.layout_queries import REGIONS_SQL, _ordered
from folia.plans.text_queries import PURITY_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ledger(spark, d):
    return I.ledger(I.table(spark, d, "events"))


@query(f"""WITH {I.LEDGER_SQL}, v AS (SELECT doc_id, stage AS source_path, input_hash AS source_sha256, output_hash AS state_sha256, started_at AS updated_at FROM ledger)
SELECT doc_id, arg_min(source_path, (updated_at, state_sha256)) AS source_path, arg_max(state_sha256, (updated_at, state_sha256)) AS state_sha256, max(updated_at) AS updated_at FROM v GROUP BY doc_id""")
def ledger_upsert(spark, d):
    v = _ledger(spark, d).select("doc_id", F.col("stage").alias("source_path"), F.col("input_hash").alias("source_sha256"), F.col("output_hash").alias("state_sha256"), F.col("started_at").alias("updated_at"), "run_id")
    old, new = v.where("run_id % 2 = 0").drop("run_id"), v.where("run_id % 2 = 1").drop("run_id")
    return G.upsert_documents(old, new).select("doc_id", "source_path", "state_sha256", "updated_at")


@query(f"""WITH {I.LEDGER_SQL}, p AS (SELECT DISTINCT stage, stage_version, params_hash, input_hash FROM ledger),
b AS (SELECT stage, stage_version, params_hash, input_hash, max(run_id) AS run_id, arg_max(output_hash, run_id) AS output_hash FROM ledger WHERE status = 'ok' GROUP BY ALL)
SELECT p.*, b.run_id, b.output_hash FROM p LEFT JOIN b USING (stage, stage_version, params_hash, input_hash)""")
def ledger_cache_probe(spark, d):
    g = _ledger(spark, d)
    return G.cached_run(g, g.select("stage", "stage_version", "params_hash", "input_hash").distinct())


@query(f"WITH {I.LEDGER_SQL} SELECT doc_id, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, min(run_id) AS first_run, max(run_id) AS last_run, count(DISTINCT stage) AS stages FROM ledger GROUP BY doc_id")
def ledger_runs(spark, d):
    return _ledger(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count_distinct("stage").alias("stages"))


@query(f"WITH {I.LEDGER_SQL} SELECT doc_id, stage, last_status, updated_at FROM (SELECT doc_id, stage, status AS last_status, started_at AS updated_at, row_number() OVER (PARTITION BY doc_id ORDER BY started_at DESC, run_id DESC) AS k FROM ledger) WHERE k = 1")
def ledger_latest(spark, d):
    top = F.max_by(F.struct("stage", "status", "started_at"), F.struct("started_at", "run_id")).alias("t")
    return _ledger(spark, d).groupBy("doc_id").agg(top).select("doc_id", "t.stage", F.col("t.status").alias("last_status"), F.col("t.started_at").alias("updated_at"))


@query("SELECT sha256(text) AS sha256, CAST(min(octet_length(encode(text))) AS INTEGER) AS n_bytes FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY 1")
def blob_dedupe(spark, d):
    blobs = I.table(spark, d, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("bytes"))
    stored = I.table(spark, d, "benchmark").select(F.sha2("text", 256).alias("sha256"))
    return G.new_blobs(blobs, stored).select("sha256", F.length("bytes").alias("n_bytes"))


@query("""WITH e AS (SELECT event_id, '```json' || chr(10) || '{"lines":[{"id":"a","text":"' || event_type || '"},{"id":"b","text":"x"},{"id":"b","text":"' || CAST(user_id AS VARCHAR) || '"}]}' || chr(10) || '```' AS body FROM events),
j AS (SELECT event_id, json_extract(regexp_extract(body, '(?s)\\{.*\\}'), '$.lines') AS ls FROM e),
r AS (SELECT event_id, i, json_extract_string(ls, '$[' || i || '].id') AS id, json_extract_string(ls, '$[' || i || '].text') AS text FROM (SELECT event_id, ls, unnest(range(0, CAST(json_array_length(ls) AS BIGINT))) AS i FROM j)),
k AS (SELECT event_id, id, arg_max(text, i) AS text FROM r GROUP BY event_id, id), want AS (SELECT event_id, unnest(['a', 'b', 'c']) AS id FROM events)
SELECT w.event_id, w.id AS line_id, coalesce(k.text, '') AS text FROM want w LEFT JOIN k ON k.event_id = w.event_id AND k.id = w.id""")
def parse_line_json(spark, d):
    """Fenced JSON replies against expected line ids: a missing line is empty, of equal ids the last holds."""
    e = I.table(spark, d, "events")
    body = F.concat(F.lit('```json\n{"lines":[{"id":"a","text":"'), "event_type", F.lit('"},{"id":"b","text":"x"},{"id":"b","text":"'), F.col("user_id").cast("string"), F.lit('"}]}\n```'))
    return V.parse_lines(e.select("event_id", body.alias("body"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("expected")), ["event_id"])


@query("""SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS dump, count(*) AS regions, CAST(sum(length(text)) AS BIGINT) AS chars
FROM conversations WHERE regexp_replace(text, '\\s', '', 'g') <> '' GROUP BY conv_id""")
def text_dump(spark, d):
    """A conversation as a text dump in reading order: blank regions are left out."""
    c = I.table(spark, d, "conversations").where(F.regexp_replace("text", r"(?U)\s", "") != "")
    part = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit("\n"), "text")
    each = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", part.alias("p")))).alias("r"), F.count(F.lit(1)).alias("regions"), F.sum(F.length("text")).alias("chars"))
    return each.select("conv_id", F.array_join(F.transform("r", lambda x: x["p"]), "\n\n").alias("dump"), "regions", "chars")


_PARA_SQL = f"""{I.CELLS_SQL.strip()}, l AS (SELECT page, cell, y, w, row_number() OVER (PARTITION BY page ORDER BY y, cell) AS seq, 600 AS measure FROM cells),
s AS (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY seq) AS step, lead(y) OVER (PARTITION BY page ORDER BY seq) - y AS gap FROM l),
p AS (SELECT page, coalesce(median(step) FILTER (step > 0), 0.0) AS pitch FROM s GROUP BY page),
e AS (SELECT s.*, p.pitch, CASE WHEN w < 0.8 * measure OR (pitch > 0 AND coalesce(gap, 0) > 1.25 * pitch) THEN 1 ELSE 0 END AS ends FROM s JOIN p USING (page))"""


def _paper(spark, d):
    from pyspark.sql import Window

    return I.cells(I.table(spark, d, "lineitem")).select("page", "cell", "y", "w", F.row_number().over(Window.partitionBy("page").orderBy("y", "cell")).alias("seq"), F.lit(600).alias("measure"))


@query(f"WITH {_PARA_SQL} SELECT page, seq, round(pitch, 6) AS pitch, CAST(sum(coalesce(b, 0)) OVER (PARTITION BY page ORDER BY seq) AS BIGINT) AS paragraph FROM (SELECT *, lag(ends) OVER (PARTITION BY page ORDER BY seq) AS b FROM e)")
def paragraph_breaks(spark, d):
    lines = _paper(spark, d)
    both = lines.join(R.line_pitch(lines, ["page"]), "page")
    return R.paragraphs(both, ["page"]).select("page", F.col("seq").cast("long").alias("seq"), F.round("pitch", 6).alias("pitch"), "paragraph")


_SPANS_SQL = """s AS (SELECT l_orderkey AS line, (l_partkey % 50)::INTEGER AS start, (l_partkey % 50 + 3 + l_suppkey % 20)::INTEGER AS "end", CASE WHEN l_linenumber % 2 = 0 THEN 'sacred' ELSE 'cited' END AS kind, 60 AS n FROM lineitem),
c AS (SELECT *, least("end", n) AS e, greatest(0, coalesce(max(least("end", n)) OVER (PARTITION BY line ORDER BY start, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cur FROM s),
w AS (SELECT *, greatest(cur, start) AS st FROM c)"""


@query(f"""WITH {_SPANS_SQL} SELECT line, st AS start, e AS "end", kind FROM w WHERE e > st
UNION ALL SELECT line, cur, least(st, n), 'plain' FROM w WHERE least(st, n) > cur
UNION ALL SELECT line, greatest(0, max(e)), 60, 'plain' FROM w GROUP BY line HAVING greatest(0, max(e)) < 60""")
def span_tiling(spark, d):
    a = F.col("l_partkey") % 50
    s = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), a.cast("int").alias("start"), (a + 3 + F.col("l_suppkey") % 20).cast("int").alias("end"), F.when(F.col("l_linenumber") % 2 == 0, "sacred").otherwise("cited").alias("kind"), F.lit(60).alias("n"))
    return R.tiles(s, ["line"])


@query(f"""WITH RECURSIVE {REGIONS_SQL}, aside AS (SELECT * FROM hull WHERE marginalia), side AS (SELECT page, median(x + w / 2) > 300 AS rt FROM aside GROUP BY page),
g AS (SELECT CASE WHEN s.rt THEN n.x - (b.x + b.w) ELSE b.x - (n.x + n.w) END AS g FROM aside n JOIN side s USING (page) JOIN hull b ON b.page = n.page AND NOT b.marginalia AND b.y < n.y + n.h AND n.y < b.y + b.h)
SELECT round(coalesce(least(22.0, greatest(12.0, (SELECT median(100 * w / 600) FROM aside))), 14.0), 6) AS width, round(coalesce(least(6.0, greatest(2.5, (SELECT median(100 * g / 600) FROM g WHERE g > 0))), 3.5), 6) AS gutter,
  (SELECT coalesce(sum(CASE WHEN rt = (page % 2 = 0) THEN 1 ELSE -1 END), 0) >= 0 FROM side) AS right_on_even""")
def side_notes(spark, d):
    got = R.side_notes(L.regions(_ordered(spark, d)), 600)
    return got.select(F.round("width", 6).alias("width"), F.round("gutter", 6).alias("gutter"), "right_on_even")


@query(f"""WITH RECURSIVE {REGIONS_SQL}, b AS (SELECT *, CASE WHEN block >= 0 AND lag(block) OVER (PARTITION BY page ORDER BY region) IS NOT DISTINCT FROM block THEN 0 ELSE 1 END AS n FROM hull),
r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY region) - 1 AS rband FROM b), body AS (SELECT * FROM r WHERE NOT marginalia),
m AS (SELECT *, count(*) OVER (PARTITION BY page, rband) AS k, min(x) OVER (PARTITION BY page, rband) AS lf, max(x + w) OVER (PARTITION BY page, rband) AS rg, lag(x) OVER (PARTITION BY page, rband ORDER BY column_index, region) AS px FROM body)
SELECT page, CAST(region AS INTEGER) AS region, CAST(rband AS BIGINT) AS rband, round(CASE WHEN k = 1 THEN 100.0 ELSE 100.0 * w / coalesce(nullif(rg - lf, 0), 1) END, 6) AS width,
  round(CASE WHEN k = 1 THEN 0.0 ELSE greatest(0, coalesce(px, rg) - (x + w)) / coalesce(nullif(rg - lf, 0), 1) * 100 END, 6) AS gap FROM m""")
def body_cells(spark, d):
    got = R.body_cells(R.region_bands(L.regions(_ordered(spark, d))))
    return got.select("page", "region", "rband", F.round("width", 6).alias("width"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {I.LINES_SQL}, c AS (SELECT doc_id, line_index, 40 + (doc_id * 7 + line_index * 13) % 400 AS w, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM lines),
s AS (SELECT * FROM c WHERE n > 0), t AS (SELECT doc_id, list_sort(list(w / n))[len(list(w / n)) // 2 + 1] AS typical FROM s GROUP BY doc_id HAVING count(*) >= 4)
SELECT doc_id, count(*) FILTER (n > 2.5 * w / typical) AS implausible FROM s JOIN t USING (doc_id) WHERE typical > 0 GROUP BY doc_id""")
def capacity_overrun(spark, d):
    l = I.lines(I.table(spark, d, "documents")).withColumn("w", 40 + (F.col("doc_id") * 7 + F.col("line_index") * 13) % 400)  # noqa: E741
    return R.implausible(l, ["doc_id"]).select("doc_id", "implausible")


@query(f"""WITH {I.PLAIN_LINES_SQL}, m AS (SELECT doc_id, count(*) AS detected, count(*) FILTER (regexp_replace(text, '\\s', '', 'g') <> '') AS returned, avg({PURITY_SQL}) AS purity FROM script_lines GROUP BY doc_id)
SELECT doc_id, detected, detected - returned AS empty_lines, round(least(returned / detected, 1.0), 6) AS coverage, round(purity, 6) AS purity, returned / detected >= 0.95 AND detected - returned <= greatest(1, detected * 0.1) AND purity >= 0.55 AS passed FROM m""")
def extract_verdict(spark, d):
    got = V.extract_verdict(I.script_lines(I.table(spark, d, "documents"), True), ["doc_id"])
    return got.select("doc_id", "detected", "empty_lines", F.round("coverage", 6).alias("coverage"), F.round("purity", 6).alias("purity"), "passed")


VERSIONS_SQL = f"""{I.LEDGER_SQL.strip()}, docs AS (SELECT doc_id, arg_min(stage, (started_at, output_hash)) AS source_path, arg_max(output_hash, (started_at, output_hash)) AS state_sha256, max(started_at) AS updated_at FROM ledger GROUP BY doc_id)"""


def _versions(spark, d):
    v = _ledger(spark, d).select("doc_id", F.col("stage").alias("source_path"), F.col("input_hash").alias("source_sha256"), F.col("output_hash").alias("state_sha256"), F.col("started_at").alias("updated_at"))
    return G.upsert_documents(v, v.limit(0))


@query(f"WITH {VERSIONS_SQL} SELECT doc_id, source_path, updated_at FROM docs")
def document_listing(spark, d):
    return G.listing(_versions(spark, d))


@query(f"WITH {VERSIONS_SQL} SELECT 'd' || c_custkey AS doc_id, state_sha256 FROM customer LEFT JOIN docs ON docs.doc_id = 'd' || c_custkey")
def document_states(spark, d):
    wanted = I.table(spark, d, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc_id"))
    return G.state_of(_versions(spark, d), wanted)


@query(f"WITH {I.LEDGER_SQL}, o AS (SELECT max(run_id) AS last FROM ledger WHERE run_id % 2 = 0) SELECT doc_id, stage, started_at, last + row_number() OVER (ORDER BY started_at, doc_id, stage) AS run_id FROM ledger, o WHERE ledger.run_id % 2 = 1")
def ledger_append(spark, d):
    g = _ledger(spark, d)
    return G.numbered(g.where("run_id % 2 = 0"), g.where("run_id % 2 = 1").drop("run_id")).select("doc_id", "stage", "started_at", "run_id")


@query(f"WITH {I.LEDGER_SQL} SELECT run_id, stage, stage_version, status FROM ledger WHERE doc_id = 'd1'")
def document_runs(spark, d):
    return G.runs_for(_ledger(spark, d), "d1").select("run_id", "stage", "stage_version", "status")


@query("""WITH c AS (SELECT 'k' || user_id % 40 AS key, event_type || event_id AS body, event_id AS stored_at FROM events WHERE event_id % 3 = 0), w AS (SELECT DISTINCT 'k' || range AS key FROM range(60))
SELECT w.key, b.body FROM w LEFT JOIN (SELECT key, arg_max(body, stored_at) AS body FROM c GROUP BY key) b USING (key)""")
def cached_replies(spark, d):
    e = I.table(spark, d, "events").where("event_id % 3 = 0")
    cache = e.select(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), F.concat("event_type", F.col("event_id").cast("string")).alias("body"), F.col("event_id").alias("stored_at"))
    return G.replies(cache, spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")))


@query("""SELECT 'd' || user_id AS doc_id, CAST(sum(event_id % 7) AS BIGINT) AS input_tokens, CAST(sum(event_id % 5) AS BIGINT) AS output_tokens, count(*) AS provider_calls, round(sum(event_id % 3 / 2), 6) AS wall_seconds FROM events GROUP BY user_id""")
def document_costs(spark, d):
    k = F.col("event_id")
    report = F.to_json(F.struct((k % 7).alias("input_tokens"), (k % 5).alias("output_tokens"), F.lit(1).alias("provider_calls"), (k % 3 / 2).alias("wall_seconds")))
    got = G.costs(I.table(spark, d, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("doc_id"), report.alias("report")))
    return got.withColumn("wall_seconds", F.round("wall_seconds", 6))
