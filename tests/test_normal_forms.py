"""Normal forms and tokens: no text leaves the JVM for its composed form, and tokens are those of ``tokenize``."""

import unicodedata

from pyspark.sql import functions as F

from folia import catalog
from folia.functions import script as S
from folia.functions import unicode as U

TEXTS = [None, "", " ", "é آا ئ", "Å 가 가", "بِسْمِ\x1dٱللّهِ ¨ا", "ﷺ ﻻ xـب", "a\n\tb"]


def test_composed_form_is_that_of_the_standard(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(rows.select("i", U.composed(F.col("t"))).collect())
    assert all(got[i] == unicodedata.normalize("NFC", t or "") for i, t in enumerate(TEXTS))
    assert rows.select(S.canonical(F.col("t"))).first()[0] is None


def test_canonical_forms_start_no_python(spark, data):
    for name in ("canonical_loose", "canonical_strict", "sacred_lines"):
        assert "Python" not in catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_token_text_joins_the_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    both = rows.select(U.token_text("rasm")(F.col("t")).alias("a"), U.tokenize("rasm")(F.col("t")).alias("t")).select("a", F.array_join("t.text", " ").alias("b")).collect()
    assert all(r.a == r.b for r in both) and any(r.a for r in both)
