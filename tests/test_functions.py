"""Golden cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from folia.functions import script as S
from folia.functions import unicode as U


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text,mode,expected", [
    ("كتـاب", "loose", "کتاب"), ("بِس", "loose", "بس"), ("بِس", "strict", "بِس"),
    ("١٢۳", "loose", "123"), ("a   b\n\n c", "loose", "a b\nc"), ("", "loose", ""), ("آx", "strict", "آx"), (None, "loose", None),
])
def test_canonical(spark, text, mode, expected):
    assert one(spark, text, lambda c: S.canonical(c, mode)) == expected


def test_measures(spark):
    assert one(spark, "ٹے", S.urdu_affinity) == 1.0
    assert one(spark, "كة", S.urdu_affinity) == -1.0
    assert one(spark, "xyz", S.urdu_affinity) == 0.0
    assert one(spark, "ab بب", S.script_purity) == 0.5
    assert one(spark, "", S.script_purity) == 0.0
    assert one(spark, "بَبَ", S.tashkeel_density) == 1.0
    assert one(spark, "﴾ب", S.ornament_density) == 0.5


def test_routing(spark):
    def route(text):
        return one(spark, text, lambda c: S.route_language(S.route_score(c), S.trimmed(c) == ""))

    assert route("ٹے چ") == "urdu"
    assert route("بَسْمِ") == "arabic"
    assert route("   ") == "unknown"
    assert route("بب") == "mixed"


def test_match_tokens_keep_offsets(spark):
    got = one(spark, "بَس (5) أء", lambda c: U.tokenize("rasm")(c))
    assert [(t.text, t.start, t.end) for t in got] == [("بس", 0, 3), ("ا", 8, 10)]
    assert one(spark, None, lambda c: U.tokenize("latin")(c)) == []


def test_match_form_of_two_typefaces(spark):
    assert U.match_text("كِتَابٌ 12!") == U.match_text("کتاب")
    assert U.match_text("ﻙ") == "ک"


def test_error_rates(spark):
    df = spark.createDataFrame([("abd", "abc"), ("", ""), ("xy", "")], "h string, r string").select(S.error_rate(F.col("h"), F.col("r")).alias("e"), S.similarity(F.col("h"), F.col("r")).alias("s"), U.word_error_rate(F.col("h"), F.col("r")).alias("w"))
    a, b, c = df.collect()
    assert (a.e.edits, a.e.units, round(a.s, 4), a.w.rate) == (1, 3, 0.6667, 1.0)
    assert (b.e.rate, b.s, b.w.rate) == (0.0, 1.0, 0.0)
    assert (c.e.rate, c.e.edits, c.e.units, c.w.rate) == (1.0, 2, 0, 1.0)


def test_repeat_rate(spark):
    assert one(spark, "loop loop it " * 20, lambda c: U.repeat_rate(12)(c)) > 0.25
    assert one(spark, "short", lambda c: U.repeat_rate(12)(c)) == 0.0
