"""Typeset layout: bands of regions, body cells, paragraphs, span tiling, the side-note column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def region_bands(regions: DataFrame) -> DataFrame:
    """Adds ``rband``: neighbouring regions of one block stand side by side, others alone."""
    w = Window.partitionBy("page").orderBy("region")
    same = (F.col("block") >= 0) & F.lag("block").over(w).eqNullSafe(F.col("block"))
    return regions.withColumn("_n", F.when(same, 0).otherwise(1)).withColumn("rband", F.sum("_n").over(w) - 1).drop("_n")


def body_cells(banded: DataFrame) -> DataFrame:
    """Width and leading gap of each body region in per cent of its band's measure, from right to left."""
    body = banded.where("region_type <> 'marginalia'")
    band = Window.partitionBy("page", "rband")
    walk = band.orderBy("column_index", "region")
    left, right = F.min("x").over(band), F.max(F.col("x") + F.col("w")).over(band)
    sized = body.withColumns({"_n": F.count(F.lit(1)).over(band), "_left": left, "_span": F.when(right - left == 0, 1).otherwise(right - left)})
    edge = F.coalesce(F.lag("x").over(walk), F.col("_left") + F.col("_span"))
    gap = F.greatest(F.lit(0), edge - (F.col("x") + F.col("w"))) / F.col("_span") * 100
    sized = sized.withColumn("_gap", gap)
    return sized.select("page", "region", "rband", F.when(F.col("_n") == 1, 100.0).otherwise(F.col("w") / F.col("_span") * 100).alias("width"), F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_gap")).alias("gap"))


def band_spacing(banded: DataFrame, page_height: Column) -> DataFrame:
    """Space above each band in lines: the gap to the band above, times 22, held between 0.3 and 2.2."""
    each = banded.groupBy("page", "rband").agg(F.min(F.col("y") / page_height).alias("top"), F.max((F.col("y") + F.col("h")) / page_height).alias("bottom"))
    last = F.coalesce(F.lag("bottom").over(Window.partitionBy("page").orderBy("rband")), F.lit(0.0))
    return each.withColumn("space", F.greatest(F.lit(0.3), F.least(F.lit(2.2), (F.col("top") - last) * 22)))


def paragraphs(lines: DataFrame, keys: list[str], full: float = 0.8, gap: float = 1.25) -> DataFrame:
    """Adds ``paragraph``: one ends after a short line or before a wide gap.

    ``lines`` has keys, seq, y, w, measure and pitch; a line with ``verse`` true
    stands alone.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    verse = F.col("verse") if "verse" in lines.columns else F.lit(False)
    after = verse | (F.col("w") < full * F.col("measure")) | ((F.col("pitch") > 0) & (F.coalesce(F.lead("y").over(w) - F.col("y"), F.lit(0)) > gap * F.col("pitch")))
    ends = lines.withColumn("_end", after.cast("int")).withColumn("_verse", verse.cast("int"))
    starts = F.greatest(F.coalesce(F.lag("_end").over(w), F.lit(0)), F.col("_verse"))
    return ends.withColumn("_start", starts).withColumn("paragraph", F.sum("_start").over(w)).drop("_end", "_verse", "_start")


def line_pitch(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Median positive distance between neighbouring line tops."""
    step = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("seq"))
    return lines.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("_s") > 0, F.col("_s"))), F.lit(0.0)).alias("pitch"))


def tiles(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, kind): a line as runs without overlap; what no span claims is plain.

    ``spans`` has keys, start, end, kind and the line's length ``n``.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    clipped = spans.withColumn("_e", F.least("end", "n"))
    cursor = F.coalesce(F.greatest(F.lit(0), F.max("_e").over(w)), F.lit(0))
    walked = clipped.withColumn("_c", cursor).withColumn("_s", F.greatest("_c", "start"))
    own = walked.where("_e > _s").select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), "kind")
    gaps = walked.where("least(_s, n) > _c").select(*keys, F.col("_c").alias("start"), F.least("_s", "n").alias("end"), F.lit("plain").alias("kind"))
    rest = clipped.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("_e")).alias("start"), F.first("n").alias("end")).where("start < end").withColumn("kind", F.lit("plain"))
    return own.unionByName(gaps).unionByName(rest)


def side_notes(regions: DataFrame, width: float) -> DataFrame:
    """One row: width and gutter of the reserved margin in per cent, and the side of even pages.

    Medians over the notes and the gaps to the body beside them, held between
    12 and 22 and between 2.5 and 6; 14 and 3.5 without any.
    """
    note = F.col("region_type") == "marginalia"
    notes, body = regions.where(note), regions.where(~note)
    side = notes.groupBy("page").agg((F.median(F.col("x") + F.col("w") / 2) > width / 2).alias("right"))
    votes = side.agg(F.coalesce(F.sum(F.when(F.col("right") == (F.col("page") % 2 == 0), 1).otherwise(-1)), F.lit(0)).alias("votes"))
    widths = notes.agg(F.median(100 * F.col("w") / width).alias("mw"))
    a = notes.join(side, "page").select("page", "right", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("w").alias("nw"), F.col("h").alias("nh"))
    b = body.select("page", "x", "y", "w", "h")
    near = a.join(b, (a.page == b.page) & (b.y < a.ny + a.nh) & (a.ny < b.y + b.h)).select(F.when(F.col("right"), F.col("nx") - (F.col("x") + F.col("w"))).otherwise(F.col("x") - (F.col("nx") + F.col("nw"))).alias("g"))
    gutter = near.where("g > 0").agg(F.median(100 * F.col("g") / width).alias("mg"))
    held = lambda c, lo, hi, other: F.coalesce(F.least(F.lit(hi), F.greatest(F.lit(lo), c)), F.lit(other))
    one = widths.join(gutter, F.lit(True)).join(votes, F.lit(True))  # one row each
    return one.select(held(F.col("mw"), 12.0, 22.0, 14.0).alias("width"), held(F.col("mg"), 2.5, 6.0, 3.5).alias("gutter"), (F.col("votes") >= 0).alias("right_on_even"))


def size_tier(n_lines: Column, height: Column, body: Column, note: Column) -> Column:
    return F.when(note, "small").when(n_lines < 3, "body").when((body > 0) & (height > 0) & (height < 0.7 * body), "small").otherwise("body")


def implausible(lines: DataFrame, keys: list[str], overrun: float = 2.5, least: int = 4) -> DataFrame:
    """Per page the cells whose text is more than ``overrun`` times what their width holds at the page's typical pixels a character."""
    said = lines.withColumn("_n", F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).where("_n > 0")
    ppc = said.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("w") / F.col("_n"))).alias("_p")).where(F.size("_p") >= least)
    typical = ppc.select(*keys, F.element_at("_p", F.floor(F.size("_p") / 2).cast("int") + 1).alias("typical"))
    return said.join(typical, keys).where("typical > 0").groupBy(*keys, "typical").agg(F.count_if(F.col("_n") > overrun * F.col("w") / F.col("typical")).alias("implausible"))
