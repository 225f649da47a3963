"""Stage contract and verifiers: every stage's output is judged by rules that are queries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import script as S


def stable_hash(value) -> str:
    """SHA-256 of JSON with sorted keys and no blanks; dataclasses count by their fields."""
    plain = asdict(value) if is_dataclass(value) else value
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Verdict:
    passed: bool
    score: float | None = None
    findings: tuple[str, ...] = ()
    metrics: dict[str, float] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "ok" if self.passed else "degraded"


@dataclass(frozen=True)
class Stage:
    """A named step: ``run`` makes an output table, ``verify`` judges it, both declared over DataFrames."""

    name: str
    version: str
    run: Callable[[DataFrame, object], DataFrame]
    verify: Callable[[DataFrame, DataFrame, object], Verdict]
    apply: Callable[[DataFrame, DataFrame], DataFrame] = lambda doc, out: out

    def execute(self, doc: DataFrame, params: object) -> tuple[DataFrame, dict]:
        """The output and its ledger row; the verdict is on the document before the output is applied."""
        began = datetime.now(UTC)
        out = self.run(doc, params)
        verdict = self.verify(doc, out, params)
        row = {"stage": self.name, "stage_version": self.version, "params_hash": stable_hash(params), "status": verdict.status, "passed": verdict.passed, "score": verdict.score, "report": json.dumps({"findings": verdict.findings, "metrics": dict(sorted(verdict.metrics.items()))}), "started_at": began}
        return out, row


def input_hash(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(keys, input_hash): a digest of the rows that a stage reads, in the order of the columns' values."""
    packed = F.to_json(F.sort_array(F.collect_list(F.struct(*columns))))
    return rows.groupBy(*keys).agg(F.sha2(packed, 256).alias("input_hash"))


def parse_lines(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_id, text) for each expected id of ``(keys, body, expected)`` replies.

    The JSON between the first and the last brace is read; a reply that is none
    is taken line by line in the order of the ids.
    """
    inner = F.from_json(F.regexp_extract("body", r"(?s)(\{.*\})", 1), "lines array<struct<id:string,text:string>>")
    read = replies.withColumn("_l", inner["lines"]).select(*keys, "body", "_l", F.posexplode("expected").alias("_i", "line_id"))
    of_id = F.filter("_l", lambda x: x["id"] == F.col("line_id"))
    bare = F.filter(F.split(F.regexp_replace("body", r"(?m)^```\w*\s*$", ""), "\n"), lambda s: F.trim(s) != "")
    text = F.when(F.col("_l").isNotNull(), F.when(F.size(of_id) > 0, F.element_at(of_id, -1)["text"])).otherwise(F.get(bare, F.col("_i")))
    return read.select(*keys, "line_id", F.coalesce(text, F.lit("")).alias("text"))


def extract_verdict(lines: DataFrame, keys: list[str], min_coverage=0.95, max_empty=0.10, min_purity=0.55) -> DataFrame:
    """Per document: coverage of lines, empty lines, mean script purity and whether all pass."""
    said = S.trimmed(F.col("text")) != ""
    m = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("detected"), F.count_if(said).alias("returned"), F.avg(S.script_purity(F.col("text"))).alias("purity"))
    m = m.withColumns({"empty_lines": F.col("detected") - F.col("returned"), "coverage": F.least(F.col("returned") / F.col("detected"), F.lit(1.0))})
    ok = (F.col("coverage") >= min_coverage) & (F.col("empty_lines") <= F.greatest(F.lit(1.0), F.col("detected") * max_empty)) & (F.col("purity") >= min_purity)
    return m.withColumn("passed", ok)


def metric_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of one column a metric; metrics that a document has not are left out."""
    names = sorted(c for c in wide.columns if c not in keys)
    return wide.unpivot(keys, [F.col(f"`{n}`").cast("double").alias(n) for n in names], "metric", "value").where("value IS NOT NULL")


def _percent(x):
    return F.concat(F.format_string("%.0f", F.bround(x * 100, 0)), F.lit("%"))


def _decimal(x, digits: int = 2):
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def extract_metrics(pages: DataFrame, min_coverage=0.95, max_empty=0.10, min_purity=0.55, max_repeat=0.25) -> tuple[DataFrame, DataFrame]:
    """Metrics of each document and findings of its pages.

    ``pages`` has doc_id, page_no, detected, returned, empty, implausible, purity,
    repeat, has_text.  The document's score is the lesser of coverage and purity.
    """
    share = F.when(F.col("detected") > 0, F.col("returned") / F.col("detected")).otherwise(1.0)
    wide = pages.groupBy("doc_id").agg(
        F.avg(F.least(share, F.lit(1.0))).alias("coverage.line_count"), F.avg("purity").alias("lexical.script_purity"), F.max("repeat").alias("degeneracy.repeat_rate"),
        F.sum("implausible").alias("alignment.implausible_cells"), F.count(F.lit(1)).alias("pages"),
    ).withColumn("score", F.least("`coverage.line_count`", "`lexical.script_purity`"))
    page = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "))
    found = F.array_compact(F.array(
        F.when(F.col("implausible") > 0, F.concat(page, F.col("implausible").cast("string"), F.lit(" cell(s) hold more text than they have room for"))),
        F.when((F.col("detected") > 0) & (share < min_coverage), F.concat(page, F.col("returned").cast("string"), F.lit("/"), F.col("detected").cast("string"), F.lit(" lines returned"))),
        F.when(F.col("empty") > F.greatest(F.lit(1.0), F.col("detected") * max_empty), F.concat(page, F.col("empty").cast("string"), F.lit(" lines came back empty"))),
        F.when(F.col("has_text") & (F.col("purity") < min_purity), F.concat(page, F.lit("only "), _percent(F.col("purity")), F.lit(" of characters are of the script"))),
        F.when(F.col("repeat") > max_repeat, F.concat(page, _percent(F.col("repeat")), F.lit(" of the text is one repeated n-gram"))),
    ))
    return metric_rows(wide, ["doc_id"]), pages.select("doc_id", "page_no", F.explode(found).alias("finding"))


def order_metrics(pages: DataFrame, regions: DataFrame, min_purity: float = 0.8, min_lines: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conservation, regions, blocks, mean purity of columns and score; findings of pages that lost lines and columns that mix languages.

    ``pages`` has doc_id, page_no, lines_in, lines_out, blocks; ``regions`` has
    doc_id, page_no, region_id, columns, n_lines, purity.
    """
    flow = pages.groupBy("doc_id").agg(F.sum("lines_in").alias("i"), F.sum("lines_out").alias("o"), F.sum("blocks").alias("order.column_blocks"))
    wide_enough = (F.col("columns") >= 2) & (F.col("n_lines") >= min_lines)
    of_regions = regions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("order.regions"), F.avg(F.when(wide_enough, F.col("purity"))).alias("order.column_purity"))
    both = flow.join(of_regions, "doc_id", "left").withColumn("order.line_conservation", F.when(F.col("i") > 0, F.col("o") / F.col("i")).otherwise(1.0))
    score = F.least("`order.line_conservation`", F.coalesce("`order.column_purity`", F.lit(1.0)))
    wide = both.select("doc_id", "`order.column_blocks`", F.coalesce("`order.regions`", F.lit(0)).alias("order.regions"), "`order.column_purity`", "`order.line_conservation`", score.alias("score"))
    page = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "))
    lost = pages.where("lines_in <> lines_out").select("doc_id", "page_no", F.concat(page, F.lit("grouped "), F.col("lines_out").cast("string"), F.lit(" of "), F.col("lines_in").cast("string"), F.lit(" lines")).alias("finding"))
    mixed = regions.where(wide_enough & (F.col("purity") < min_purity)).select("doc_id", "page_no", F.concat(page, F.lit("column region "), F.col("region_id"), F.lit(" mixes languages ("), _percent(F.col("purity")), F.lit(" agree)")).alias("finding"))
    return metric_rows(wide, ["doc_id"]), lost.unionByName(mixed)


def match_metrics(accepted: DataFrame, lines: DataFrame, min_margin: float = 0.05, shown: int = 8) -> tuple[DataFrame, DataFrame]:
    """Counts, identity, margins and run continuity of each document; findings, of ambiguous matches the first ``shown``.

    ``accepted`` has doc_id, page_no, region_id, line_id, line_index, action, ref,
    identity, margin, corpus_start, corpus_end, candidates; ``lines`` has a row
    for each considered line with ``sacred``.
    """
    vague = F.col("margin") < min_margin
    said = accepted.groupBy("doc_id").agg(
        F.count_if(F.col("action") == "replaced").alias("match.replaced"), F.count_if(F.col("action") == "cited").alias("match.cited"), F.sum("candidates").alias("match.candidates_considered"),
        F.avg("identity").alias("match.identity"), F.min("margin").alias("match.margin_min"), F.count_if(vague).alias("match.ambiguous_citations"),
    )
    keys = ["doc_id", "page_no", "line_id"]
    open_lines = lines.join(accepted.select(*keys), keys, "left_anti").groupBy("doc_id").agg(F.count_if("sacred").alias("match.unresolved"))
    seen = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("match.lines_considered"))
    w = Window.partitionBy("doc_id", "page_no", "region_id").orderBy("line_index")
    pairs = accepted.select("doc_id", (F.col("line_index") - F.lag("line_index").over(w)).alias("apart"), (F.col("corpus_start") - F.lag("corpus_end").over(w)).alias("hop")).where("apart <= 2")
    runs = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("hop").between(0, 3)).alias("good"))
    every = seen.join(said, "doc_id", "left").join(open_lines, "doc_id", "left").join(runs, "doc_id", "left")
    every = every.fillna(0, ["`match.replaced`", "`match.cited`", "`match.candidates_considered`", "`match.unresolved`"]).withColumn("match.run_continuity", F.try_divide("good", "runs"))
    page = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "line_index"))
    unsure = accepted.where(vague).withColumn("_k", first).where(F.col("_k") <= shown)
    unsure = unsure.select("doc_id", F.concat(page, F.col("line_id"), F.lit(" matched "), F.col("ref"), F.lit(" at identity "), _decimal(F.col("identity")), F.lit(" but margin "), _decimal(F.col("margin"))).alias("finding"))
    broken = every.where("good < runs").select("doc_id", F.concat((F.col("runs") - F.col("good")).cast("string"), F.lit(" of "), F.col("runs").cast("string"), F.lit(" neighbouring match pairs do not run on")).alias("finding"))
    left = every.where("`match.unresolved` > 0").select("doc_id", F.concat(F.col("`match.unresolved`").cast("string"), F.lit(" vocalized line(s) matched nothing")).alias("finding"))
    return metric_rows(every.drop("runs", "good"), ["doc_id"]), unsure.unionByName(broken).unionByName(left)


def route_metrics(routed: DataFrame, purities: DataFrame, min_purity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Shares of languages, retagged spans, mean posterior and column purity; the findings are advice only.

    ``routed`` has doc_id, language, posterior, from_corpus, changed; ``purities``
    has doc_id, page_no, region_id, purity.
    """
    n = F.count(F.lit(1))
    share = lambda k: (F.count_if(F.col("language") == k) / n).alias(f"route.{k}_frac")
    spans = routed.groupBy("doc_id").agg(n.alias("route.spans"), F.count_if("from_corpus").alias("route.from_corpus"), F.count_if("changed").alias("route.retagged"), F.avg("posterior").alias("route.mean_posterior"), *[share(k) for k in ("arabic", "urdu", "mixed")])
    columns = purities.groupBy("doc_id").agg(F.avg("purity").alias("route.column_purity"))
    page = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "))
    found = purities.where(F.col("purity") < min_purity).select("doc_id", "page_no", F.concat(page, F.lit("column region "), F.col("region_id"), F.lit(" still mixes languages ("), _percent(F.col("purity")), F.lit(" agree)")).alias("finding"))
    return metric_rows(spans.join(columns, "doc_id", "left"), ["doc_id"]), found


def ingest_metrics(pages: DataFrame, low_dpi: float = 150.0, blank_ink: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """Resolution, blank pages and the share of native images; low resolution and blank pages are reported, not failed.

    ``pages`` has doc_id, dpi (null or 0: unknown), ink (share of dark pixels) and native.
    """
    known = F.when(F.col("dpi") > 0, F.col("dpi"))
    wide = pages.groupBy("doc_id").agg(
        F.min(known).alias("min_source_dpi"), F.avg(known).alias("mean_source_dpi"), F.count_if(F.coalesce("ink", F.lit(0.0)) < blank_ink).alias("blank_pages"), F.count(F.lit(1)).alias("pages"),
        F.avg(F.col("native").cast("int")).alias("native_extraction_ratio"),
    )
    found = F.array_compact(F.array(
        F.when(F.col("min_source_dpi") < low_dpi, F.concat(F.lit("source resolution is low (min "), F.format_string("%.0f", F.bround(F.col("min_source_dpi").cast("double"), 0)), F.lit(" DPI)"))),
        F.when(F.col("blank_pages") > 0, F.concat(F.col("blank_pages").cast("string"), F.lit(" page(s) appear blank"))),
    ))
    return metric_rows(wide, ["doc_id"]), wide.select("doc_id", F.explode(found).alias("finding"))
