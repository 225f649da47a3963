"""Columns and missed lines: gutters inside rows, blocks of rows that share one, cells, and ink that no row holds.

Ink is a table of rectangles (page, x, y, w, h) that do not overlap: runs of dark
pixels of an image, or drawn shapes.  Boxes are rows (page, row, x, y, w, h).
Everything is joins inside a page and windows over its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.rows import binarize, variation
from folia.sources.settings import Segment

DEFAULT = Segment()


def image_ink(images: DataFrame, block: int = DEFAULT.block_size, c: float = DEFAULT.c) -> DataFrame:
    """Runs of dark pixels, one pixel high, of gray images: rows (page, width, height, pixels), a byte a pixel."""

    def run(batches):
        for b in batches:
            for page, width, height, raw in zip(b.page, b.width, b.height, b.pixels, strict=True):
                dark = binarize(np.frombuffer(raw, dtype=np.uint8).reshape(height, width), block, c).astype(np.int8)
                step = np.diff(np.pad(dark, ((0, 0), (1, 1))), axis=1)
                y, x = np.nonzero(step == 1)
                yield pd.DataFrame({"page": page, "x": x, "y": y, "w": np.nonzero(step == -1)[1] - x, "h": 1})

    return images.mapInPandas(run, "page long, x long, y long, w long, h long")


def inside(boxes: DataFrame, ink: DataFrame, *keys: str) -> DataFrame:
    """(page, keys, x0, y0, x1, y1): the parts of the ink that lie in each box, to whole pixels."""
    box = boxes.select("page", *keys, F.floor("x").alias("_x0"), F.floor("y").alias("_y0"), F.ceil(F.col("x") + F.col("w")).alias("_x1"), F.ceil(F.col("y") + F.col("h")).alias("_y1"))
    spot = ink.select("page", F.col("x").alias("_a"), F.col("y").alias("_b"), (F.col("x") + F.col("w")).alias("_c"), (F.col("y") + F.col("h")).alias("_d"))
    met = box.join(spot, "page").where("_a < _x1 AND _x0 < _c AND _b < _y1 AND _y0 < _d")
    return met.select("page", *keys, F.greatest("_a", "_x0").alias("x0"), F.greatest("_b", "_y0").alias("y0"), F.least("_c", "_x1").alias("x1"), F.least("_d", "_y1").alias("y1"))


def tighten(boxes: DataFrame, ink: DataFrame, *keys: str) -> DataFrame:
    """(page, keys, x, y, w, h): each box shrunk to the ink it holds; one without ink is left out."""
    hull = inside(boxes, ink, *keys).groupBy("page", *keys).agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return hull.select("page", *keys, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def measured(boxes: DataFrame, ink: DataFrame, margin: int = DEFAULT.edge_margin_px) -> DataFrame:
    """The boxes with ``pitch``, the gap above (_from, _to), their ink, the gap's ink and its hull, and their gutter (lo, hi).

    Ink meets a page's boxes once; where boxes and ink are dealt by page, nothing
    is shuffled here nor by windows over a page that follow.
    """
    w = Window.partitionBy("page").orderBy("y", "row")
    centre, end = F.col("y") + F.col("h") / 2, F.col("y") + F.col("h")
    box = boxes.select("page", "row", "x", "y", "w", "h", (centre - F.lag(centre).over(w)).alias("pitch"), F.floor(F.lag(end).over(w)).alias("_from"), F.floor("y").alias("_to"))
    box = box.withColumns({"_x0": F.floor("x"), "_y0": F.floor("y"), "_x1": F.ceil(F.col("x") + F.col("w")), "_y1": F.ceil(end)})
    spot = ink.select(F.col("page").alias("_page"), F.col("x").alias("_a"), F.col("y").alias("_b"), (F.col("x") + F.col("w")).alias("_c"), (F.col("y") + F.col("h")).alias("_d"))
    held, between = F.expr("_a < _x1 AND _x0 < _c AND _b < _y1 AND _y0 < _d"), F.expr("_from < _to AND _b < _to AND _from < _d")
    met = box.join(spot, (F.col("page") == F.col("_page")) & (held | between), "left")
    met = met.withColumns({"_in": F.coalesce(held, F.lit(False)), "_gap": F.coalesce(between, F.lit(False))})
    met = met.withColumns({"x0": F.when(F.col("_in"), F.greatest("_a", "_x0")), "x1": F.when(F.col("_in"), F.least("_c", "_x1"))})
    walk = Window.partitionBy("page", "row").orderBy(F.asc_nulls_last("x0"), "x1")
    reach = met.withColumns({"_upto": F.max("x1").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_next": F.lead("x0").over(walk)})
    free = (F.col("_next") > F.col("_upto")) & (F.col("_upto") - F.col("_x0") > margin) & (F.col("_next") < F.col("_x1") - margin)
    best = F.max_by(F.struct("_upto", "_next"), F.when(free, F.struct(F.col("_next") - F.col("_upto"), -F.col("_upto"))))
    high = lambda top, bottom: F.least("_d", bottom) - F.greatest("_b", top)
    own = [F.first(c).alias(c) for c in ("x", "y", "w", "h", "pitch", "_from", "_to")]
    got = reach.groupBy("page", "row").agg(
        *own, F.coalesce(F.sum(F.when(F.col("_in"), (F.col("x1") - F.col("x0")) * high("_y0", "_y1"))), F.lit(0)).alias("ink"), best.alias("_g"),
        F.sum(F.when(F.col("_gap"), (F.col("_c") - F.col("_a")) * high("_from", "_to"))).alias("_left"), F.min(F.when(F.col("_gap"), F.col("_a"))).alias("_x0"), F.max(F.when(F.col("_gap"), F.col("_c"))).alias("_x1"),
    )
    return got.withColumns({"lo": F.col("_g._upto"), "hi": F.col("_g._next")}).drop("_g")


def gutters(boxes: DataFrame, ink: DataFrame, margin: int = DEFAULT.edge_margin_px) -> DataFrame:
    """(page, row, lo, hi): the widest stretch of each row without ink, away from both ends; equals go to the first."""
    return measured(boxes, ink, margin).where("lo IS NOT NULL").select("page", "row", "lo", "hi")


def _whole() -> Window:
    """All of a page, in the order of its rows: one sort serves this and what goes on row by row."""
    return Window.partitionBy("page").orderBy("y", "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def in_blocks(rows: DataFrame, s: Segment = DEFAULT) -> DataFrame:
    """Adds ``_kept`` to ``measured`` rows: whether a row is of a run that shares a gutter, wide for the page and for its rows; ``_run`` tells the runs apart."""
    w, whole, width = Window.partitionBy("page").orderBy("y", "row"), _whole(), F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    least = F.greatest(s.min_gutter_ratio * F.greatest(F.percentile(width, 0.5).over(whole), F.lit(1.0)), s.min_gutter_frac_of_height * F.percentile("h", 0.5).over(whole))
    enough = F.count(F.lit(1)).over(whole) >= s.min_rows
    marked = rows.withColumn("_ok", enough & F.col("lo").isNotNull() & F.coalesce(width >= least, F.lit(False)))
    shared = F.least(F.col("hi"), F.lag("hi").over(w)) - F.greatest(F.col("lo"), F.lag("lo").over(w))
    goes_on = F.coalesce(F.lag("_ok").over(w), F.lit(False)) & F.coalesce(shared >= s.align_overlap_px, F.lit(False))
    runs = marked.withColumn("_new", F.when(F.col("_ok") & goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.withColumn("_kept", F.col("_ok") & (F.count(F.lit(1)).over(Window.partitionBy("page", "_run")) >= s.min_rows)).drop("_ok", "_new")


def block_rows(rows: DataFrame) -> DataFrame:
    """(page, row, y, h, lo, hi, block) of the rows ``in_blocks`` that are kept."""
    block = F.dense_rank().over(Window.partitionBy("page").orderBy("_run")) - 1
    return rows.where("_kept").select("page", "row", "y", "h", "lo", "hi", block.alias("block"))


def column_rows(boxes: DataFrame, found: DataFrame, s: Segment = DEFAULT) -> DataFrame:
    """``block_rows`` of boxes and the gutters found in them."""
    return block_rows(in_blocks(boxes.select("page", "row", "y", "h").join(found, ["page", "row"], "left"), s))


def column_blocks(rows: DataFrame) -> DataFrame:
    """(page, block, rows, gutter_x, gutter_width, y0, y1): cut at the middle of what all gutters share."""
    hull = rows.groupBy("page", "block").agg(F.count(F.lit(1)).alias("rows"), F.max("lo").alias("_lo"), F.min("hi").alias("_hi"), F.median(F.col("hi") - F.col("lo")).alias("gutter_width"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return hull.select("page", "block", "rows", ((F.col("_lo") + F.col("_hi")) / 2).alias("gutter_x"), "gutter_width", "y0", "y1")


def split_rows(boxes: DataFrame, rows: DataFrame, blocks: DataFrame, ink: DataFrame) -> DataFrame:
    """``split_cells`` of boxes, their ``column_rows`` and blocks."""
    at = rows.select("page", "row", "block").join(blocks.select("page", "block", "gutter_x"), ["page", "block"]).select("page", "row", "gutter_x")
    return split_cells(boxes.select("page", "row", "x", "y", "w", "h").join(at, ["page", "row"], "left"), ink)


def with_gutter(rows: DataFrame) -> DataFrame:
    """Adds ``gutter_x``, the middle of what all gutters of a block share, to rows ``in_blocks``."""
    run = Window.partitionBy("page", "_run")
    return rows.withColumn("gutter_x", F.when(F.col("_kept"), (F.max("lo").over(run) + F.min("hi").over(run)) / 2))


def split_cells(both: DataFrame, ink: DataFrame) -> DataFrame:
    """(page, row, cell, x, y, w, h): boxes with a ``gutter_x`` become two cells, the right one first, each shrunk to its ink; the others stay."""
    g, end = F.col("gutter_x"), F.col("x") + F.col("w")
    cut = F.coalesce((F.col("x") < g) & (g < end), F.lit(False))
    whole = both.where(~cut).select("page", "row", F.lit(0).alias("cell"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    side = lambda k, x0, x1: F.struct(F.lit(k).alias("cell"), x0.cast("double").alias("x"), F.col("y").cast("double").alias("y"), (x1 - x0).cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    cells = both.where(cut).select("page", "row", F.explode(F.array(side(0, g, end), side(1, F.col("x"), g))).alias("c")).select("page", "row", "c.*")
    return whole.unionByName(tighten(cells, ink, "row", "cell").select("page", "row", "cell", *[F.col(c).cast("double").alias(c) for c in "xywh"]))


def _judged(boxes: DataFrame, ink: DataFrame, s: Segment) -> DataFrame:
    """Rows ``in_blocks`` with the measures of their page, their estimates of merged (``_merged``) and missed lines (``_missed``); null where there is no suspicion."""
    whole, p = _whole(), F.percentile
    rows = in_blocks(measured(boxes, ink, s.edge_margin_px), s)
    rows = rows.withColumns({"rows": F.count(F.lit(1)).over(whole), "median_h": p("h", 0.5).over(whole), "median_pitch": F.coalesce(p("pitch", 0.5).over(whole), F.lit(0.0)), "_typical": p("ink", 0.5).over(whole)})
    known, steady = F.col("page").isNotNull(), F.col("median_pitch") > 0
    more = F.bround((F.col("h") - F.col("median_h")) / F.when(steady, F.col("median_pitch"))).cast("long")
    wide = known & steady & (F.col("pitch") > s.gap_factor * F.col("median_pitch")) & (F.col("_to") > F.col("_from"))
    stranded = wide & (F.col("_typical") > 0) & (F.col("_left") > s.stranded_ink_frac * F.col("_typical"))
    steps = F.bround(F.col("pitch") / F.when(steady, F.col("median_pitch"))).cast("long") - 1
    rows = rows.where(F.col("rows") >= s.min_rows_for_assessment)
    return rows.withColumns({"_merged": F.when(known & (F.col("h") > s.tall_factor * F.col("median_h")), F.coalesce(F.greatest(F.lit(0), more), F.lit(0))), "_missed": F.when(stranded, F.greatest(F.lit(1), steps))})


def assess(boxes: DataFrame, ink: DataFrame, s: Segment = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The judgement of each page of enough rows, and its issues (page, kind, x, y, w, h).

    A merged pair leaves a tall box; a missed line leaves a wide gap that holds
    ink.  Estimates round half to even.
    """
    rows = _judged(boxes, ink, s)
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    first = F.coalesce(F.lag("_run").over(Window.partitionBy("page").orderBy("y", "row")) != F.col("_run"), F.lit(True))
    out = rows.withColumn("_first", F.col("_kept") & first).groupBy("page").agg(
        *[F.first(n).alias(n) for n in ("rows", "median_h", "median_pitch")], variation("pitch").alias("pitch_cv"), F.count("_merged").alias("tall_boxes"), total("_merged").alias("merged_lines"),
        F.count("_missed").alias("stranded_gaps"), total("_missed").alias("missed_lines"), F.count_if("_first").alias("column_blocks"), F.count_if("_kept").alias("multi_column_rows"),
    )
    out = out.withColumn("suspect_lines", F.col("merged_lines") + F.col("missed_lines") + F.col("multi_column_rows"))
    spot = lambda name, x, y, w, h: F.struct(F.lit(name).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    c = F.col
    run = Window.partitionBy("page", "_run").orderBy("y", "row")
    every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    block = spot("column_gutter", (F.max("lo").over(every) + F.min("hi").over(every)) / 2 - 1, F.min("y").over(every), F.lit(2.0), F.max(c("y") + c("h")).over(every) - F.min("y").over(every))
    found = rows.withColumn("_block", F.when(c("_kept") & c("page").isNotNull() & (F.row_number().over(run) == 1), block))
    seen = F.array(F.when(c("_merged") > 0, spot("merged_lines", c("x"), c("y"), c("w"), c("h"))), F.when(c("_missed").isNotNull(), spot("missed_line", c("_x0"), c("_from"), c("_x1") - c("_x0"), c("_to") - c("_from"))), c("_block"))
    return out, found.select("page", F.explode(F.array_compact(seen)).alias("i")).select("page", "i.*")


def findings(assessed: DataFrame, s: Segment = DEFAULT) -> DataFrame:
    """(page, finding) in words."""
    n = lambda name: F.col(name).cast("string")
    said = F.array_compact(F.array(
        F.when(F.col("merged_lines") > 0, F.concat(n("merged_lines"), F.lit(" line(s) look merged ("), n("tall_boxes"), F.lit(" tall box(es))"))),
        F.when(F.col("missed_lines") > 0, F.concat(n("missed_lines"), F.lit(" line(s) look missed ("), n("stranded_gaps"), F.lit(" gap(s) hold ink)"))),
        F.when(F.col("multi_column_rows") > 0, F.concat(n("multi_column_rows"), F.lit(" row(s) span "), n("column_blocks"), F.lit(" column block(s)"))),
        F.when(F.col("pitch_cv") > s.max_pitch_cv, F.lit("line pitch is irregular")),
    ))
    return assessed.select("page", F.explode(said).alias("finding"))
