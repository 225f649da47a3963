"""What queries shuffle: rows are dealt out once, and larger steps follow where they lie."""

import re

import pytest

from folia import catalog
from folia.operators import rows as R


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", plan)


@pytest.mark.parametrize("name", ["row_profile", "smoothed_profile", "text_rows", "text_rows_of_profile"])
def test_profiles_shuffle_order_lines_only(spark, data, name):
    found = exchanges(catalog.queries()[name](spark, data))
    assert len(found) == 1 and "l_orderkey" in found[0]


@pytest.mark.parametrize("name", ["column_blocks", "split_rows", "page_judgement", "page_issues", "page_findings", "row_gutters"])
def test_rows_and_ink_meet_where_they_were_dealt(spark, data, name):
    found = exchanges(catalog.queries()[name](spark, data))
    assert found and all("l_orderkey" in e for e in found)


@pytest.mark.parametrize("name", ["reading_order", "row_major_order"])
def test_cells_are_ordered_where_they_were_dealt(spark, data, name):
    found = exchanges(catalog.queries()[name](spark, data))
    assert len(found) == 1 and "l_orderkey" in found[0]


@pytest.mark.parametrize("name", ["candidate_votes", "unigram_fallback", "candidate_topk_nms"])
def test_votes_stay_where_their_line_is(spark, data, name):
    found = exchanges(catalog.queries()[name](spark, data))
    assert found and not any("diagonal" in e for e in found)


def test_rectangles_without_height_have_no_ink(spark):
    rects = spark.createDataFrame([(1, 10, 5, 2), (1, 11, 7, 1), (1, 40, 9, 0), (1, 60, 3, 1), (1, 62, 4, 1)], "page long, y long, w long, h long")
    profile = R.rectangle_profile(rects)
    assert sorted(tuple(r) for r in profile.collect()) == [(1, 10, 5), (1, 11, 12), (1, 60, 3), (1, 62, 4)]
    near = {9: 5, 10: 17, 11: 17, 12: 12, 59: 3, 60: 3, 61: 7, 62: 4, 63: 4}
    for got in (R.smooth(profile), R.of_intervals(R.smoothed_intervals(rects))):
        assert {r.y: round(r.value * 3) for r in got.collect()} == near and got.count() == len(near)
