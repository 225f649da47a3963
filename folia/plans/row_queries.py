"""Queries of row segmentation over rectangles from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators import columns as C
from folia.operators import rows as R
from folia.plans import inputs as I

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rects(spark, d):
    return I.rectangles(I.dealt(I.table(spark, d, "lineitem"), "l_orderkey"))


PROFILE_SQL = f"{I.RECTANGLES_SQL.strip()}, profile AS (SELECT page, yy AS y, CAST(sum(w) AS BIGINT) AS value FROM (SELECT page, w, unnest(range(y, y + h)) AS yy FROM rects) GROUP BY page, yy)"
SMOOTH_SQL = f"{PROFILE_SQL}, smoothed AS (SELECT page, y, sum(value) / 3 AS value FROM (SELECT page, unnest([y - 1, y, y + 1]) AS y, value FROM profile) WHERE y >= 0 GROUP BY page, y)"
ROWS_SQL = f"""{SMOOTH_SQL}, thr AS (SELECT page, greatest(1.0, avg(value) * 0.3) AS t FROM smoothed WHERE value > 0 GROUP BY page),
dark AS (SELECT page, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 3 THEN 0 ELSE 1 END AS fresh FROM smoothed JOIN thr USING (page) WHERE value >= t),
found AS (SELECT page, min(y) AS y0, max(y) AS y1 FROM (SELECT page, y, sum(fresh) OVER (PARTITION BY page ORDER BY y) AS island FROM dark) GROUP BY page, island)"""
ASSESS_SQL = f"""{I.RECTANGLES_SQL.strip()}, c AS (SELECT *, y + h / 2 AS centre FROM rects),
p AS (SELECT *, centre - lag(centre) OVER (PARTITION BY page ORDER BY y, "row", h, w, x) AS pitch FROM c),
g AS (SELECT page, count(*) AS "rows", median(h) AS median_h, median(pitch) AS median_pitch, coalesce(stddev_pop(pitch) / avg(pitch), 0.0) AS pitch_cv FROM p GROUP BY page HAVING count(*) >= 4)"""


@query(f"WITH {PROFILE_SQL} SELECT * FROM profile")
def row_profile(spark, d):
    return R.rectangle_profile(_rects(spark, d))


@query(f"WITH {SMOOTH_SQL} SELECT page, y, round(value, 6) AS value FROM smoothed")
def smoothed_profile(spark, d):
    return R.of_intervals(R.smoothed_intervals(_rects(spark, d))).select("page", "y", F.round("value", 6).alias("value"))


@query(f"WITH {ROWS_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0) - 1 AS INTEGER) AS \"row\", y0, y1 FROM found WHERE y1 - y0 + 1 >= 5")
def text_rows(spark, d):
    return R.text_rows_of(R.smoothed_intervals(_rects(spark, d)))


@query(f"WITH {ROWS_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0) - 1 AS INTEGER) AS \"row\", y0, y1 FROM found WHERE y1 - y0 + 1 >= 5")
def text_rows_of_profile(spark, d):
    """The same from a profile of pixel rows, the form that images have."""
    return R.text_rows(R.smooth(R.rectangle_profile(_rects(spark, d))))


@query(f"""WITH {ASSESS_SQL} SELECT page, g."rows", round(median_h, 6) AS median_h, round(median_pitch, 6) AS median_pitch, round(pitch_cv, 6) AS pitch_cv,
  count(*) FILTER (h > 1.6 * median_h) AS tall_boxes, CAST(sum(CASE WHEN h > 1.6 * median_h AND median_pitch > 0 THEN greatest(0, CAST(round_even((h - median_h) / median_pitch, 0) AS BIGINT)) ELSE 0 END) AS BIGINT) AS merged_lines,
  count(*) FILTER (median_pitch > 0 AND pitch > 1.5 * median_pitch) AS wide_gaps FROM p JOIN g USING (page) GROUP BY ALL""")
def row_assessment(spark, d):
    a = R.assess_rows(_rects(spark, d))
    return a.select("page", "rows", F.round("median_h", 6).alias("median_h"), F.round("median_pitch", 6).alias("median_pitch"), F.round("pitch_cv", 6).alias("pitch_cv"), "tall_boxes", "merged_lines", "wide_gaps")


@query(f"WITH {I.RECTANGLES_SQL} SELECT page, coalesce(median(h), 0.0) AS line_height FROM rects GROUP BY page")
def line_height(spark, d):
    return _rects(spark, d).groupBy("page").agg(F.coalesce(F.median("h"), F.lit(0.0)).alias("line_height"))


BLOCKS_SQL = f"""{I.INK_SQL.strip()}, every AS (SELECT r.page, r."row", r.y, r.h, g.lo, g.hi, coalesce(g.hi - g.lo, 0) AS width FROM rects r LEFT JOIN gutters g USING (page, "row")),
lim AS (SELECT page, greatest(3.0 * greatest(median(width), 1.0), 0.4 * median(h)) AS least_w FROM every GROUP BY page HAVING count(*) >= 2),
marked AS (SELECT every.*, lo IS NOT NULL AND width >= least_w AS ok FROM every JOIN lim USING (page)),
linked AS (SELECT *, CASE WHEN ok AND coalesce(lag(ok) OVER w, false) AND coalesce(least(hi, lag(hi) OVER w) - greatest(lo, lag(lo) OVER w) >= 4, false) THEN 0 ELSE 1 END AS fresh FROM marked WINDOW w AS (PARTITION BY page ORDER BY y, "row")),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y, "row") AS run FROM linked),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page, run) AS n FROM runs WHERE ok) WHERE n >= 2),
crows AS (SELECT page, "row", y, h, lo, hi, CAST(dense_rank() OVER (PARTITION BY page ORDER BY run) - 1 AS INTEGER) AS block FROM kept),
blocks AS (SELECT page, block, count(*) AS "rows", (max(lo) + min(hi)) / 2 AS gutter_x, median(hi - lo) AS gutter_width, min(y) AS y0, max(y + h) AS y1 FROM crows GROUP BY page, block)"""
JUDGED_SQL = f"""{BLOCKS_SQL}, row_ink AS (SELECT page, "row", sum((x1 - x0) * (y1 - y0)) AS ink FROM inside GROUP BY ALL),
placed AS (SELECT r.*, coalesce(i.ink, 0) AS ink, r.y + r.h / 2 - lag(r.y + r.h / 2) OVER w AS pitch, lag(r.y + r.h) OVER w AS y_from FROM rects r LEFT JOIN row_ink i USING (page, "row") WINDOW w AS (PARTITION BY r.page ORDER BY r.y, r."row")),
pg AS (SELECT page, count(*) AS "rows", median(h) AS median_h, coalesce(median(pitch), 0.0) AS median_pitch, coalesce(stddev_pop(pitch) / avg(pitch), 0.0) AS pitch_cv, median(ink) AS typical FROM placed GROUP BY page HAVING count(*) >= 4),
tall AS (SELECT p.*, CASE WHEN median_pitch > 0 THEN greatest(0, CAST(round_even((h - median_h) / median_pitch, 0) AS BIGINT)) ELSE 0 END AS more FROM placed p JOIN pg USING (page) WHERE h > 1.6 * median_h),
wide AS (SELECT p.*, median_pitch, typical FROM placed p JOIN pg USING (page) WHERE median_pitch > 0 AND pitch > 1.5 * median_pitch AND y > y_from),
left_ink AS (SELECT w.page, w."row", sum(i.w * (least(i.y + i.h, w.y) - greatest(i.y, w.y_from))) AS ink, min(i.x) AS x0, max(i.x + i.w) AS x1 FROM wide w JOIN ink i ON i.page = w.page AND i.y < w.y AND w.y_from < i.y + i.h GROUP BY ALL),
missed AS (SELECT w.page, w."row", w.y, w.y_from, l.x0, l.x1, greatest(1, CAST(round_even(pitch / median_pitch, 0) AS BIGINT) - 1) AS more FROM wide w JOIN left_ink l USING (page, "row") WHERE typical > 0 AND l.ink > 0.08 * typical),
judged AS (SELECT pg.page, pg."rows", median_h, median_pitch, pitch_cv, coalesce(t.n, 0) AS tall_boxes, coalesce(t.k, 0) AS merged_lines, coalesce(m.n, 0) AS stranded_gaps, coalesce(m.k, 0) AS missed_lines, coalesce(b.n, 0) AS column_blocks, coalesce(b.k, 0) AS multi_column_rows
  FROM pg LEFT JOIN (SELECT page, count(*) AS n, CAST(sum(more) AS BIGINT) AS k FROM tall GROUP BY page) t USING (page) LEFT JOIN (SELECT page, count(*) AS n, CAST(sum(more) AS BIGINT) AS k FROM missed GROUP BY page) m USING (page) LEFT JOIN (SELECT page, count(*) AS n, CAST(sum("rows") AS BIGINT) AS k FROM blocks GROUP BY page) b USING (page))"""


def _dealt(spark, d):
    return I.dealt(I.table(spark, d, "lineitem"), "l_orderkey")


def _boxes(spark, d):
    return I.boxes(_dealt(spark, d))


def _page_ink(spark, d):
    return I.ink(_dealt(spark, d))


def _in_blocks(spark, d):
    return C.in_blocks(C.measured(_boxes(spark, d), _page_ink(spark, d)))


@query(f"WITH {I.INK_SQL} SELECT page, \"row\", min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM inside GROUP BY page, \"row\"")
def tightened_rows(spark, d):
    return C.tighten(_boxes(spark, d), _page_ink(spark, d), "row")


@query(f"WITH {I.INK_SQL} SELECT * FROM gutters")
def row_gutters(spark, d):
    return C.gutters(_boxes(spark, d), _page_ink(spark, d))


@query(f"WITH {BLOCKS_SQL} SELECT page, block, \"rows\", CAST(gutter_x AS DOUBLE) AS gutter_x, CAST(gutter_width AS DOUBLE) AS gutter_width, y0, y1 FROM blocks")
def column_blocks(spark, d):
    return C.column_blocks(C.block_rows(_in_blocks(spark, d)))


@query(f"""WITH {BLOCKS_SQL}, cut AS (SELECT r.*, b.gutter_x AS g, coalesce(r.x < b.gutter_x AND b.gutter_x < r.x + r.w, false) AS cut FROM rects r LEFT JOIN crows c USING (page, "row") LEFT JOIN blocks b ON b.page = c.page AND b.block = c.block),
cells AS (SELECT page, "row", 0 AS cell, floor(g) AS a, x + w AS b, y, h FROM cut WHERE cut UNION ALL SELECT page, "row", 1, x, ceil(g), y, h FROM cut WHERE cut),
held AS (SELECT c.page, c."row", c.cell, greatest(i.x, c.a) AS x0, greatest(i.y, c.y) AS y0, least(i.x + i.w, c.b) AS x1, least(i.y + i.h, c.y + c.h) AS y1 FROM cells c JOIN ink i ON i.page = c.page AND i.x < c.b AND c.a < i.x + i.w AND i.y < c.y + c.h AND c.y < i.y + i.h)
SELECT page, "row", 0 AS cell, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM cut WHERE NOT cut
UNION ALL SELECT page, "row", cell, CAST(min(x0) AS DOUBLE), CAST(min(y0) AS DOUBLE), CAST(max(x1) - min(x0) AS DOUBLE), CAST(max(y1) - min(y0) AS DOUBLE) FROM held GROUP BY page, "row", cell""")
def split_rows(spark, d):
    return C.split_cells(C.with_gutter(_in_blocks(spark, d)), _page_ink(spark, d))


def _judged(spark, d):
    return C.assess(_boxes(spark, d), _page_ink(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT page, \"rows\", round(median_h, 6) AS median_h, round(median_pitch, 6) AS median_pitch, round(pitch_cv, 6) AS pitch_cv, tall_boxes, merged_lines, stranded_gaps, missed_lines, column_blocks, multi_column_rows, merged_lines + missed_lines + multi_column_rows AS suspect_lines FROM judged")
def page_judgement(spark, d):
    got = _judged(spark, d)[0]
    return got.withColumns({n: F.round(n, 6) for n in ("median_h", "median_pitch", "pitch_cv")})


@query(f"""WITH {JUDGED_SQL} SELECT page, 'merged_lines' AS kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM tall WHERE more > 0
UNION ALL SELECT page, 'missed_line', CAST(x0 AS DOUBLE), CAST(y_from AS DOUBLE), CAST(x1 - x0 AS DOUBLE), CAST(y - y_from AS DOUBLE) FROM missed
UNION ALL SELECT page, 'column_gutter', CAST(gutter_x - 1 AS DOUBLE), CAST(y0 AS DOUBLE), 2.0::DOUBLE, CAST(y1 - y0 AS DOUBLE) FROM blocks WHERE page IN (SELECT page FROM pg)""")
def page_issues(spark, d):
    return _judged(spark, d)[1]


@query(f"""WITH {JUDGED_SQL} SELECT * FROM (SELECT page, unnest([
  CASE WHEN merged_lines > 0 THEN merged_lines || ' line(s) look merged (' || tall_boxes || ' tall box(es))' END,
  CASE WHEN missed_lines > 0 THEN missed_lines || ' line(s) look missed (' || stranded_gaps || ' gap(s) hold ink)' END,
  CASE WHEN multi_column_rows > 0 THEN multi_column_rows || ' row(s) span ' || column_blocks || ' column block(s)' END,
  CASE WHEN pitch_cv > 0.35 THEN 'line pitch is irregular' END]) AS finding FROM judged) WHERE finding IS NOT NULL""")
def page_findings(spark, d):
    return C.findings(_judged(spark, d)[0])
