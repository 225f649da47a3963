"""Queries of page layout over cells from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators import layout as L
from folia.plans import inputs as I

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cells(spark, d):
    return I.cells(I.dealt(I.table(spark, d, "lineitem"), "l_orderkey"))


def _banded(spark, d):
    return L.bands(_cells(spark, d))


def _ordered(spark, d, order="column_major"):
    return L.ordered(L.in_runs(_banded(spark, d)), order)


BANDS_SQL = f"""
{I.CELLS_SQL.strip()}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x DESC, cell) AS k FROM cells),
fold(page, k, cell, x, y, w, h, lang, band, y0, y1) AS (
  SELECT page, k, cell, x, y, w, h, lang, 0, CAST(y AS DOUBLE), CAST(y + h AS DOUBLE) FROM o WHERE k = 1
  UNION ALL
  SELECT o.page, o.k, o.cell, o.x, o.y, o.w, o.h, o.lang,
    CASE WHEN (least(f.y1, o.y + o.h) - greatest(f.y0, o.y)) / coalesce(nullif(least(o.h, f.y1 - f.y0), 0), 1.0) >= 0.5 THEN f.band ELSE f.band + 1 END,
    CASE WHEN (least(f.y1, o.y + o.h) - greatest(f.y0, o.y)) / coalesce(nullif(least(o.h, f.y1 - f.y0), 0), 1.0) >= 0.5 THEN least(f.y0, o.y) ELSE o.y END,
    CASE WHEN (least(f.y1, o.y + o.h) - greatest(f.y0, o.y)) / coalesce(nullif(least(o.h, f.y1 - f.y0), 0), 1.0) >= 0.5 THEN greatest(f.y1, o.y + o.h) ELSE o.y + o.h END
  FROM fold f JOIN o ON o.page = f.page AND o.k = f.k + 1
), banded AS (SELECT page, cell, x, y, w, h, lang, CAST(band AS INTEGER) AS band FROM fold)"""
GUTTERS_SQL = f"""{BANDS_SQL.strip()}, gaps AS (
  SELECT page, band, count(*) AS n, list(g ORDER BY x) FILTER (g IS NOT NULL) AS gl
  FROM (SELECT page, band, x, CASE WHEN lead(x) OVER w IS NOT NULL THEN {{'lo': x + w, 'hi': lead(x) OVER w}} END AS g FROM banded WINDOW w AS (PARTITION BY page, band ORDER BY x, w)) GROUP BY page, band
), guttered AS (
  SELECT page, band, n, CASE WHEN n > 1 AND len(list_filter(gl, lambda g: g.hi <= g.lo)) = 0 THEN gl END AS gutters FROM gaps
)"""
RUNS_SQL = f"""{GUTTERS_SQL.strip()}, near AS (
  SELECT *, lag(gutters) OVER (PARTITION BY page ORDER BY band) AS last FROM guttered
), marked AS (
  SELECT page, band, n, gutters, CASE WHEN gutters IS NULL OR last IS NULL OR len(last) <> len(gutters)
    OR len(list_filter(range(1, len(gutters) + 1), lambda i: least(gutters[i].hi, last[i].hi) - greatest(gutters[i].lo, last[i].lo) < 4)) > 0 THEN 1 ELSE 0 END AS fresh FROM near
), islands AS (
  SELECT page, band, n, gutters, sum(fresh) OVER (PARTITION BY page ORDER BY band) AS island FROM marked
), long AS (
  SELECT *, count(*) OVER (PARTITION BY page, island) AS k FROM islands WHERE gutters IS NOT NULL
), runs AS (
  SELECT page, band, CAST(dense_rank() OVER (PARTITION BY page ORDER BY island) - 1 AS INTEGER) AS run, CAST(n AS INTEGER) AS "columns" FROM long WHERE k >= 2
)"""
ORDER_SQL = f"""{RUNS_SQL.strip()}, placed AS (
  SELECT b.*, r.run, r."columns", row_number() OVER (PARTITION BY b.page, b.band ORDER BY x DESC, cell) - 1 AS c FROM banded b LEFT JOIN runs r USING (page, band)
), parted AS (
  SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY band, c) AS part FROM (
    SELECT *, CASE WHEN lag(coalesce(run, -1)) OVER (PARTITION BY page ORDER BY band, c) IS NOT DISTINCT FROM coalesce(run, -1) THEN 0 ELSE 1 END AS fresh FROM placed)
), col AS (SELECT *, CASE WHEN run IS NULL THEN -1 ELSE c END AS column_index FROM parted),
widths AS (SELECT page, part, column_index, list_sort(list(w))[len(list(w)) // 2 + 1] AS mw FROM col GROUP BY page, part, column_index),
notes AS (SELECT page, part, column_index, column_index >= 0 AND mw / coalesce(nullif(max(mw) OVER (PARTITION BY page, part), 0), 1) < 0.35 AS marginalia FROM widths),
ordered AS (
  SELECT c.page, dense_rank() OVER (PARTITION BY c.page ORDER BY c.part, marginalia, c.column_index) - 1 AS region,
    row_number() OVER (PARTITION BY c.page, c.part, c.column_index ORDER BY band, c.c) - 1 AS seq,
    cell, x, y, w, h, lang, band, coalesce(run, -1) AS block, coalesce("columns", 1) AS "columns", c.column_index, marginalia
  FROM col c JOIN notes n ON c.page = n.page AND c.part = n.part AND c.column_index = n.column_index
)"""
REGIONS_SQL = f"""{ORDER_SQL.strip()}, hull AS (
  SELECT page, region, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n_lines, min(block) AS block, min("columns") AS "columns", min(column_index) AS column_index, bool_or(marginalia) AS marginalia
  FROM ordered GROUP BY page, region
), pure AS (
  SELECT page, region, coalesce(max(n) / sum(n), 1.0) AS purity FROM (SELECT page, region, lang, count(*) AS n FROM ordered WHERE lang <> 'unknown' GROUP BY ALL) GROUP BY page, region
)"""


@query(f"WITH RECURSIVE {BANDS_SQL} SELECT page, cell, band FROM banded")
def bands_fold(spark, d):
    return _banded(spark, d).select("page", "cell", "band")


@query(f"WITH RECURSIVE {GUTTERS_SQL} SELECT page, band, n, array_to_string(list_transform(gutters, lambda g: g.lo || '-' || g.hi), ',') AS gutters FROM guttered")
def gutters(spark, d):
    said = F.array_join(F.transform("gutters", lambda g: F.concat(g["lo"].cast("string"), F.lit("-"), g["hi"].cast("string"))), ",")
    return L.gutters(_banded(spark, d)).select("page", "band", F.col("n").cast("long").alias("n"), said.alias("gutters"))


@query(f"WITH RECURSIVE {RUNS_SQL} SELECT page, band, run, \"columns\" FROM runs")
def column_runs(spark, d):
    return L.column_runs(L.gutters(_banded(spark, d))).select("page", "band", "run", "columns")


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT page, CAST(region AS INTEGER) AS region, CAST(seq AS INTEGER) AS seq, cell, CAST(block AS INTEGER) AS block, CAST(column_index AS INTEGER) AS column_index, marginalia FROM ordered")
def reading_order(spark, d):
    return _ordered(spark, d).select("page", "region", "seq", "cell", "block", "column_index", "marginalia")


@query(f"""WITH RECURSIVE {ORDER_SQL} SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY part) - 1 AS INTEGER) AS region, CAST(row_number() OVER (PARTITION BY page, part ORDER BY band, c) - 1 AS INTEGER) AS seq, cell FROM parted""")
def row_major_order(spark, d):
    return _ordered(spark, d, "row_major").select("page", "region", "seq", "cell")


@query(f"WITH RECURSIVE {REGIONS_SQL} SELECT page, CAST(region AS INTEGER) AS region, 'p' || CASE WHEN length(CAST(page AS VARCHAR)) < 3 THEN lpad(CAST(page AS VARCHAR), 3, '0') ELSE CAST(page AS VARCHAR) END || 'r' || lpad(CAST(region AS VARCHAR), 3, '0') AS region_id, CASE WHEN marginalia THEN 'marginalia' ELSE 'unknown' END AS region_type, x, y, w, h, n_lines FROM hull")
def region_hull(spark, d):
    return L.regions(_ordered(spark, d)).select("page", "region", "region_id", "region_type", "x", "y", "w", "h", "n_lines")


@query(f"WITH RECURSIVE {REGIONS_SQL} SELECT page, CAST(region AS INTEGER) AS region, CAST(\"columns\" AS INTEGER) AS \"columns\", round(purity, 6) AS purity, purity < 0.8 AS suspect FROM hull JOIN pure USING (page, region) WHERE \"columns\" >= 2 AND n_lines >= 3")
def column_purity(spark, d):
    r = L.regions(_ordered(spark, d)).where("columns >= 2 AND n_lines >= 3")
    return r.select("page", "region", "columns", F.round("purity", 6).alias("purity"), (F.col("purity") < 0.8).alias("suspect"))


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT (SELECT count(*) FROM cells) AS lines_in, count(*) AS lines_out, (SELECT count(*) FROM (SELECT page, cell FROM cells EXCEPT ALL SELECT page, cell FROM ordered)) AS lost, (SELECT count(*) FROM (SELECT page, cell FROM ordered EXCEPT ALL SELECT page, cell FROM cells)) AS doubled FROM ordered")
def line_conservation(spark, d):
    """Grouping is a permutation of its input: bag equality both ways."""
    a, b = _cells(spark, d).select("page", "cell"), _ordered(spark, d).select("page", "cell")
    tally = a.select("page", "cell", F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(b.select("page", "cell", F.lit(0).alias("i"), F.lit(1).alias("o")))
    each = tally.groupBy("page", "cell").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return each.agg(F.sum("i").alias("lines_in"), F.sum("o").alias("lines_out"), F.sum(F.greatest(F.col("i") - F.col("o"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("o") - F.col("i"), F.lit(0))).alias("doubled"))


@query(f"""WITH {I.CELLS_SQL}, p AS (SELECT a.page, a.cell AS a, b.cell AS b, greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h + b.w * b.h AS areas,
  b.x >= a.x - 2 AND b.y >= a.y - 2 AND b.x + b.w <= a.x + a.w + 2 AND b.y + b.h <= a.y + a.h + 2 AS inside
  FROM cells a JOIN cells b ON a.page = b.page AND b.cell = a.cell + 1)
SELECT page, a, b, round(CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0.0 END, 6) AS iou, inside FROM p""")
def box_overlap(spark, d):
    c = _cells(spark, d)
    left = c.select("page", F.col("cell").alias("a"), F.struct("x", "y", "w", "h").alias("p"))
    right = c.select("page", (F.col("cell") - 1).alias("a"), F.col("cell").alias("b"), F.struct("x", "y", "w", "h").alias("q"))
    return left.join(right, ["page", "a"]).select("page", "a", "b", F.round(L.iou(F.col("p"), F.col("q")), 6).alias("iou"), L.contains(F.col("p"), F.col("q")).alias("inside"))
