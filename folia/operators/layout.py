"""Reading order from box geometry: bands, gutters, column runs, regions.

A page is the unit; its boxes meet once.  Banding depends on a growing extent
and is a fold over the page's sorted boxes (a higher-order function in the JVM);
all that follows are windows and aggregates over bands and cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bands(cells: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Adds ``band``: cells in (y, -x) order join the running band if they share half of the lower height with it."""
    others = [c for c in cells.columns if c not in ("page", "y", "x")]
    box = F.struct("y", (-F.col("x")).alias("nx"), *others)
    state = "struct<band:int,y0:double,y1:double,out:array<int>>"
    start = F.from_json(F.lit('{"band":-1,"y0":0,"y1":0,"out":[]}'), state)

    def step(acc: Column, b: Column) -> Column:
        top, bottom = b["y"].cast("double"), (b["y"] + b["h"]).cast("double")
        shared = F.least(acc["y1"], bottom) - F.greatest(acc["y0"], top)
        base = F.least(b["h"].cast("double"), acc["y1"] - acc["y0"])
        joins = (acc["band"] >= 0) & (shared / F.when(base == 0, 1.0).otherwise(base) >= overlap)
        band = F.when(joins, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(
            band.alias("band"), F.when(joins, F.least(acc["y0"], top)).otherwise(top).alias("y0"),
            F.when(joins, F.greatest(acc["y1"], bottom)).otherwise(bottom).alias("y1"), F.concat(acc["out"], F.array(band)).alias("out"),
        )

    page = cells.groupBy("page").agg(F.sort_array(F.collect_list(box)).alias("b"))
    marked = page.select("page", "b", F.aggregate("b", start, step)["out"].alias("n"))
    each = marked.select("page", F.explode(F.arrays_zip("b", "n")).alias("z"))
    return each.select("page", (-F.col("z.b.nx")).alias("x"), F.col("z.b.y").alias("y"), *[F.col(f"z.b.{c}").alias(c) for c in others], F.col("z.n").alias("band"))


def with_gutters(held: DataFrame) -> DataFrame:
    """Adds the number of cells and the gaps between them to bands with their cells ``c`` from left to right."""
    n = F.size("c")
    gaps = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((F.element_at("c", i)["x"] + F.element_at("c", i)["w"]).alias("lo"), F.get("c", i)["x"].alias("hi"))))
    clean = ~F.exists(gaps, lambda g: g["hi"] <= g["lo"])
    return held.withColumn("n", n).withColumn("gutters", F.when(clean, gaps)).drop("c")


def gutters(banded: DataFrame) -> DataFrame:
    """(page, band, n, gutters): the gaps between a band's cells from left to right; null if cells overlap or there is one."""
    return with_gutters(banded.groupBy("page", "band").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("c")))


def _fits(align: float) -> Column:
    """Whether a band's gutters line up with those of the band before (``_last``)."""
    pairs = F.zip_with("gutters", "_last", lambda a, b: F.coalesce(F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]) >= align, F.lit(False)))
    return F.coalesce((F.size("gutters") == F.size("_last")) & F.forall(pairs, lambda ok: ok), F.lit(False))


def column_runs(guttered: DataFrame, align: float = 4, min_rows: int = 2) -> DataFrame:
    """(page, band, run, columns) of bands in a column block: neighbours of equal cell count whose gutters line up."""
    w = Window.partitionBy("page").orderBy("band")
    marked = guttered.withColumn("_last", F.lag("gutters").over(w)).withColumn("_new", F.when(F.col("gutters").isNull() | ~_fits(align), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w)).where("gutters is not null")
    long = islands.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("page", "_island"))).where(F.col("_k") >= min_rows)
    return long.select("page", "band", (F.dense_rank().over(Window.partitionBy("page").orderBy("_island")) - 1).alias("run"), F.col("n").alias("columns"))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    s = F.sort_array(values)
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def in_runs(banded: DataFrame, align: float = 4, min_rows: int = 2) -> DataFrame:
    """The cells with run and columns of their band, null outside of column blocks; bands keep their cells, so nothing is joined."""
    others = [c for c in banded.columns if c not in ("page", "band", "x", "w")]
    held = banded.groupBy("page", "band").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("c"), F.collect_list(F.struct("x", "w", *others)).alias("_cells"))
    w = Window.partitionBy("page").orderBy("band")
    guttered = with_gutters(held)
    marked = guttered.withColumn("_last", F.lag("gutters").over(w)).withColumn("_new", F.when(F.col("gutters").isNull() | ~_fits(align), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w))
    size = F.count_if(F.col("gutters").isNotNull()).over(Window.partitionBy("page", "_island"))
    long = islands.withColumn("_long", F.col("gutters").isNotNull() & (size >= min_rows))
    # the islands that are long enough, numbered from 0: one more where a long band's island is not that of the long band before
    before = F.last(F.when(F.col("_long"), F.col("_island")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("_first", F.when(F.col("_long") & ~F.coalesce(before == F.col("_island"), F.lit(False)), 1).otherwise(0))
    ran = long.withColumn("run", F.when(F.col("_long"), F.sum("_first").over(w) - 1).cast("int"))
    return ran.select("page", "band", "run", F.when(F.col("_long"), F.col("n")).alias("columns"), F.explode("_cells").alias("z")).select("page", "band", "run", "columns", "z.*")


def reading_order(banded: DataFrame, runs: DataFrame, order: str = "column_major", note_ratio: float = 0.35) -> DataFrame:
    """``ordered`` of cells and the runs found in them."""
    return ordered(banded.join(runs, ["page", "band"], "left"), order, note_ratio)


def ordered(cells: DataFrame, order: str = "column_major", note_ratio: float = 0.35) -> DataFrame:
    """Each cell, with run and columns, with its region and place: page, region, seq, block, columns, column_index, marginalia.

    Stretches of plain bands are prose regions.  A column block is one region for
    each column from the right (``column_major``), narrow ones last as marginalia,
    or one region as a whole (``row_major``).
    """
    right = Window.partitionBy("page", "band").orderBy(F.desc("x"), "cell")
    cells = cells.withColumn("_c", F.row_number().over(right) - 1)
    # a stretch of plain bands starts where the block of the cell before differs
    page = Window.partitionBy("page").orderBy("band", "_c")
    mark = F.coalesce("run", F.lit(-1))
    cells = cells.withColumn("_mark", mark).withColumn("_new", F.when(F.lag("_mark").over(page).eqNullSafe(F.col("_mark")), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(page))
    if order == "row_major":
        cells = cells.withColumns({"column_index": F.lit(-1), "marginalia": F.lit(False)})
    else:
        cells = cells.withColumn("column_index", F.when(F.col("run").isNotNull(), F.col("_c")).otherwise(-1))
        column, part = Window.partitionBy("page", "_part", "column_index"), Window.partitionBy("page", "_part")
        by_width = column.orderBy("w")
        whole = by_width.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        middle = F.row_number().over(by_width) == F.floor(F.count(F.lit(1)).over(whole) / 2) + 1  # the upper one of two
        cells = cells.withColumn("_mid", F.when(middle, F.col("w"))).withColumn("_mw", F.max("_mid").over(whole)).withColumn("_top", F.max("_mw").over(part))
        share = F.col("_mw") / F.when(F.col("_top") == 0, 1).otherwise(F.col("_top"))
        cells = cells.withColumn("marginalia", (F.col("column_index") >= 0) & (share < note_ratio))
    region = Window.partitionBy("page").orderBy("_part", "marginalia", "column_index")
    place = Window.partitionBy("page", "_part", "column_index").orderBy("band", "_c")
    cells = cells.withColumns({"region": F.dense_rank().over(region) - 1, "seq": F.row_number().over(place) - 1})
    return cells.select("page", "region", "seq", "cell", "x", "y", "w", "h", "lang", "band", F.coalesce("run", F.lit(-1)).alias("block"), F.coalesce("columns", F.lit(1)).alias("columns"), "column_index", "marginalia")


def purity(counts: DataFrame, keys: list[str], lang: str = "lang", n: str = "n") -> DataFrame:
    """Share of the most frequent language, unknown left out; 1 where nothing is tagged."""
    known = F.when(F.col(lang) != "unknown", F.col(n))
    return counts.groupBy(*keys).agg(F.coalesce(F.max(known) / F.sum(known), F.lit(1.0)).alias("purity"))


def regions(ordered: DataFrame) -> DataFrame:
    """One row for each region: id, hull, type, block, columns, purity, number of lines."""
    keys = ["page", "region"]
    hull = ordered.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.count(F.lit(1)).alias("n_lines"), F.first("block").alias("block"), F.first("columns").alias("columns"), F.first("column_index").alias("column_index"), F.first("marginalia").alias("marginalia"),
    )
    tagged = purity(ordered.groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("n")), keys)
    name = F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("r"), F.lpad(F.col("region").cast("string"), 3, "0"))
    name = F.when(F.length(F.col("page").cast("string")) > 3, F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("r"), F.lpad(F.col("region").cast("string"), 3, "0"))).otherwise(name)
    return hull.join(tagged, keys).select("page", "region", name.alias("region_id"), F.when(F.col("marginalia"), "marginalia").otherwise("unknown").alias("region_type"), "x", "y", "w", "h", "block", "columns", "column_index", "n_lines", "purity")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def contains(a: Column, b: Column, tol: float = 2.0) -> Column:
    return (b["x"] >= a["x"] - tol) & (b["y"] >= a["y"] - tol) & (b["x"] + b["w"] <= a["x"] + a["w"] + tol) & (b["y"] + b["h"] <= a["y"] + a["h"] + tol)
