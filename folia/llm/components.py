"""Distributed connected components by hooking to the smallest neighbour and contracting.

Each round every vertex points at the smaller of itself and its smallest
neighbour, pointers are doubled until all reach a root, and edges are rewritten
to the roots; edges inside one tree vanish.  The minimum of a component always
points at itself, so the last label is the component's smallest vertex.  A hub
of any degree only meets a partially aggregated ``min`` and inner joins that
adaptive execution can split.  The lineage is cut each round by
tables, for a checkpoint passes on the estimated sizes of the joins before it,
whose digits multiply from join to join until planning takes longer than the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import cut, cut_table, drop_table, few


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every vertex of ``edges``; null ends and loops are ignored.

    Vertices may be of any ordered type.  ``component`` is the smallest vertex
    that can be reached.  An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut_table(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels: DataFrame | None = None
    tables = [e]
    rows = e.count()  # each vertex has an edge, and edges only vanish, so no table has more
    kind = e.schema["a"].dataType
    while not e.isEmpty():
        up = cut_table(few(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), rows))
        tables.append(up)
        while True:  # to the roots, in as many steps as the logarithm of the longest path
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = cut_table(few(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), rows))
            tables.append(up)
            if up.where("moved").isEmpty():
                break
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = cut_table(few(e.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), rows))
        tables.append(e)
        if labels is None:
            labels = cut(few(up.select("node", F.col("up").alias("component")), rows))
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
            labels = cut(few(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), rows))
    if labels is None:
        return e.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    drop_table(*tables)
    return labels
