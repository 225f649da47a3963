"""Readers and writers: corpus files, page images, blobs, nested documents, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h")])
PROVENANCE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("source_ref", T.StringType()), T.StructField("original_text", T.StringType()), T.StructField("score", T.DoubleType())])
SIGNALS = T.MapType(T.StringType(), T.DoubleType())
SPAN = T.StructType([T.StructField("span_id", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("provenance", PROVENANCE), T.StructField("signals", SIGNALS)])
LINE = T.StructType([T.StructField("line_id", T.StringType()), T.StructField("bbox", BOX), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("signals", SIGNALS)])
REGION = T.StructType([T.StructField("region_id", T.StringType()), T.StructField("bbox", BOX), T.StructField("region_type", T.StringType()), T.StructField("lines", T.ArrayType(LINE)), T.StructField("signals", SIGNALS)])
PAGE = T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("width_px", T.IntegerType()), T.StructField("height_px", T.IntegerType()), T.StructField("regions", T.ArrayType(REGION)), T.StructField("reading_order", T.ArrayType(T.StringType())), T.StructField("signals", SIGNALS)])
DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("source_path", T.StringType()), T.StructField("source_sha256", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("pages", T.ArrayType(PAGE))])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, a, b, text) of corpus JSON files ``{name, verses: [[a, b, text], ...]}``."""
    raw = spark.read.schema("name string, verses array<array<string>>").json(path, multiLine=True)
    return raw.select("name", F.explode("verses").alias("v")).select("name", F.get("v", F.lit(0)).cast("int").alias("a"), F.get("v", F.lit(1)).cast("int").alias("b"), F.get("v", F.lit(2)).alias("text"))


def check_corpus(verses: DataFrame, chapters: int | None = None, count: int | None = None) -> None:
    """Raise unless the corpus has the expected chapters and verses and no blank text."""
    got = verses.agg(F.count_distinct("a").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.trim("text") == "").alias("blank")).first()
    if got.blank or chapters not in (None, got.c) or count not in (None, got.n):
        raise ValueError(f"corpus has {got.c} chapters, {got.n} verses, {got.blank} of them blank")


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of page images, content-addressed."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").alias("bytes"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents, one JSON object a line; a malformed one is an error."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_id, region_seq, line_index, line_id, bbox, text, spans) in reading order: listed regions first, then the others."""
    p = documents.select("doc_id", F.explode("pages").alias("p"))
    r = p.select("doc_id", "p.page_no", F.col("p.reading_order").alias("o"), F.posexplode("p.regions").alias("k", "r"))
    listed = F.array_position(F.coalesce("o", F.array()), F.col("r.region_id"))
    r = r.withColumn("region_seq", F.struct((listed == 0).alias("late"), F.when(listed > 0, listed).otherwise(F.col("k")).alias("at")))
    return r.select("doc_id", "page_no", "r.region_id", "region_seq", F.posexplode("r.lines").alias("line_index", "l")).select("doc_id", "page_no", "region_id", "region_seq", "line_index", "l.line_id", "l.bbox", "l.text", "l.spans")


def bad_spans(lines: DataFrame) -> DataFrame:
    """Lines whose spans do not lie inside the text."""
    return lines.where(F.exists("spans", lambda s: (s["char_start"] < 0) | (s["char_end"] < s["char_start"]) | (s["char_end"] > F.length("text"))))


def put_blobs(blobs: DataFrame, path: str) -> int:
    """Append the ``(bytes)`` rows that are not stored under their digest yet; the number added.  Running it again adds nothing."""
    from folia.plans.ledger import new_blobs

    spark = blobs.sparkSession
    try:
        stored = spark.read.schema("sha256 string, bytes binary").parquet(path)
        stored.take(1)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], "sha256 string, bytes binary")
    fresh = new_blobs(blobs, stored)
    n = fresh.count()
    fresh.withColumn("shard", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)
    return n


def data_uri(media: str, content):
    return F.concat(F.lit(f"data:{media};base64,"), F.base64(content))


def html_escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def region_html(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of lines with ``seq``, ``paragraph`` and ``text``: paragraphs of escaped line spans."""
    each = lines.withColumn("_h", F.concat(F.lit('<span class="line">'), html_escape(F.col("text")), F.lit("</span>")))
    para = each.groupBy(*keys, "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "_h"))), lambda x: x["_h"]), " ").alias("_p"))
    block = F.concat(F.lit("<p>"), F.col("_p"), F.lit("</p>"))
    return para.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", block.alias("b")))), lambda x: x["b"]), "\n").alias("html"))
