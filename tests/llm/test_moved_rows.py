"""What the near-copy stage moves: few texts."""

import pytest
from pyspark.sql import functions as F

from folia.llm import common, simhash_gray


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 24])
def test_a_sieve_loses_no_row(spark, bits):
    rows = spark.range(3000).select((F.col("id") % 2900).alias("id"), F.lit("x").alias("odd name"))
    names = spark.range(0, 6000, 7).unionByName(spark.range(0, 70, 7))
    inside = [r.id for r in common.sieve(rows, names, ["id"], bits=bits).collect()]
    outside = [r.id for r in common.sieve(rows, names, ["id"], inside=False, bits=bits).collect()]
    assert sorted(inside + outside) == sorted(r.id for r in rows.collect())
    assert not {i for i in outside if i % 7 == 0}
    assert bits < 1 << 24 or not {i for i in inside if i % 7}
    assert common.sieve(rows, names.limit(0), ["id"], inside=False, bits=bits).count() == 3000


def test_only_moves_no_row_that_stays(spark):
    rows = [(i, f"text {i}") for i in range(60)] + [(3, "text 3"), (3, "text 3"), (4, "text 4"), (None, "none"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("an extra", F.lit(1))
    keep = simhash_gray.row_name(docs).where("doc_id is null or doc_id % 3 <> 1").select(*simhash_gray.ROW_NAME).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash_gray.only(docs, keep)
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted({(i, t) for i, t in rows if i is None or i % 3 != 1}, key=str)
    assert out.columns == docs.columns and "Union" in plan


def test_estimated_sizes_stay_small_in_components(spark, monkeypatch):
    from folia.llm import components

    digits = []

    def counted(write):
        def cut(df):
            out = write(df)
            digits.append(len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
            return out

        return cut

    for name in ("cut", "cut_table"):
        monkeypatch.setattr(components, name, counted(getattr(components, name, None)), raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    for _ in range(5):  # as after joins
        edges = edges.join(edges.select("src").withColumnRenamed("src", "s"), F.col("src") == F.col("s")).select("src", "dst")
    assert {r.component for r in components.connected_components(edges).collect()} == {0}
    assert len(digits) > 8 and max(digits) < 40


def test_small_tables_are_written_as_few_files(spark, monkeypatch):
    """Each file starts processes that count for a moment with all memory of the executor."""
    from folia.llm import components, near_copies

    files = []

    def counted(write):
        def cut(df):
            out = write(df)
            files.append(out._jdf.queryExecution().toRdd().getNumPartitions() if write is common.cut else len(out.inputFiles()))
            return out

        return cut

    for module in (components, simhash_gray):
        for name in {"cut", "cut_table"} & set(vars(module)):
            monkeypatch.setattr(module, name, counted(getattr(common, name)))
    cores = spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        ranged = simhash_gray._ranged(spark.range(5000).select((F.col("id") * 7919).alias("fp")), 64, 5000).collect()
        assert len({r.part for r in ranged}) > 60 and sorted(r.fp for r in ranged) == [7919 * i for i in range(5000)]
        edges = spark.range(0, 600).where("id % 100 <> 99").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        got = components.connected_components(edges).collect()
        assert {(r.node, r.component) for r in got} == {(i, i - i % 100) for i in range(600)}
        assert len(files) > 8 and sorted(files)[-2] <= cores  # the edges' first table alone is of unknown size
        del files[:]
        docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
        assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == list(range(90))
        assert len(files) > 2 and max(files) <= cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
