"""What the quality model's fit moves: labelled texts, once."""

import pytest

from folia.llm import ordinal_quality as O

SCHEMA = "doc_id long, text string"


def tables(spark):
    rows = [(i, f"words of text {i} " * (1 + i % 3)) for i in range(400)] + [(7, "another text"), (7, "another text"), (8, None), (None, "of no id")]
    labels = [(i, 1, i % 2) for i in range(0, 400, 10)] + [(7, 0, 0), (7, 1, 0), (8, 1, 0), (9_999, 1, 0), (None, 1, 0), (3, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("marks", [1 << 25, 64])
def test_rows_of_the_fit_are_those_of_a_join(spark, monkeypatch, marks):
    monkeypatch.setattr(O, "MARKS", marks, raising=False)
    rows, docs, labels = tables(spark)
    got = [(r.doc_id, r.grade, r.text) for r in O.training_rows(docs, labels, 10)[0].collect()]
    wanted = {i: 2 - i // 10 * 10 % 2 for i in range(0, 400, 10)} | {7: 0, 8: 2}
    assert sorted(got) == sorted((i, wanted[i], t) for i, t in rows if i in wanted and t is not None)


def test_no_join_moves_the_texts(spark):
    _, docs, labels = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for labels of any size
    try:
        got, shares = O.training_rows(docs, labels, 10)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert shares == 5
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
