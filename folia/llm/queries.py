"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import table


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.simhash_gray import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.maxscore import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op4_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.url_alias import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator over redirects that are made from the table: three of four pages lead to the next one."""
    from pyspark.sql import functions as F

    from folia.llm.url_alias import judge_urls

    pages = table(spark, sf_dir, "pages")
    onward = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    redirects = pages.where("page_id % 4 <> 3").select("page_id", F.col("url").alias("src")).join(onward, "page_id").select("src", "dst")
    return judge_urls(pages, redirects).select("page_id", "host", "path", "rule", "verdict", "alias_block")


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's probability and decision."""
    from folia.llm.secret_forest import findings

    return findings(table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail, keep of every document, by a fit on the labelled ones."""
    from folia.llm.ordinal_quality import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.suffix_dedup import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op8_duck_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.duck_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"))


def op9_spaced_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    from folia.llm.spaced_decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.pii_semicrf import find

    return find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_crf": op1_html_crf,
        "op2_simhash_gray": op2_simhash_gray,
        "op3_maxscore": op3_maxscore,
        "op4_url_alias": op4_url_alias,
        "url_alias_chains": url_alias_chains,
        "op5_secret_forest": op5_secret_forest,
        "op6_ordinal_quality": op6_ordinal_quality,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_duck_bpe": op8_duck_bpe,
        "op9_spaced_decontam": op9_spaced_decontam,
        "op10_pii_semicrf": op10_pii_semicrf,
    }


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The driver's pages hold no canonical link or redirect, so the rules decide there; ``url_alias_chains`` has edges.
RULES_SQL = r"""
u AS (
  SELECT page_id, url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)"""
OP4_SQL = f"""WITH {RULES_SQL}
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

#: Names as in the operator: scheme and host in lower case, no fragment; reach is the closure of the redirects both ways.
CHAINS_SQL = rf"""WITH RECURSIVE {RULES_SQL},
n AS (
  SELECT r.*, CASE WHEN instr(url, '://') > 0 THEN lower(substr(url, 1, instr(url, '://') - 1)) || '://' || host || regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)://[^/?]*(.*)$', 1) END AS node FROM r
), e AS (
  SELECT a.node AS x, b.node AS y FROM n a JOIN n b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 <> 3 AND a.node IS NOT NULL AND b.node IS NOT NULL
), ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
hit AS (SELECT DISTINCT reach.x AS node FROM reach JOIN n ON n.node = reach.y WHERE n.rule IN ('net/', 'example.com/de/'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND hit.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND hit.node IS NOT NULL AS alias_block
FROM n LEFT JOIN hit USING (node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore": OP3_SQL, "op4_url_alias": OP4_SQL, "url_alias_chains": CHAINS_SQL}
