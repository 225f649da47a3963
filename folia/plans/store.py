"""A document store of append-only tables under one folder, and the runner that takes a stage through it.

Nothing is rewritten: a document's newest version, a run's number and a cached
reply are read off what was appended.  The folder may be on any file system that
Spark writes to.
"""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans import ledger as G
from folia.plans.verify import Stage, input_hash, stable_hash

# Fixed values. The columns of the ledger.
SCHEMAS = {
    "docs": "doc_id string, source_path string, source_sha256 string, state_sha256 string, updated_at timestamp",
    "runs": "run_id long, doc_id string, stage string, stage_version string, params_hash string, input_hash string, output_hash string, status string, passed boolean, score double, report string, started_at timestamp, duration_s double",
    "history": "doc_id string, stage string, version string, params_hash string, at timestamp, passed boolean, note string",
    "blobs": "sha256 string, bytes binary, shard string",
    "responses": "key string, body string, stored_at timestamp",
}


class Store:
    """Tables of ``SCHEMAS`` and one table of states a stage, in ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # a union that counts as dealt by its inputs' keys may meet a side of another number of partitions
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; one that nothing was written to yet is empty."""
        schema = schema or SCHEMAS[name]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def put_blobs(self, blobs: DataFrame) -> None:
        """Add the ``(bytes)`` that are not there yet; again adds nothing."""
        fresh = G.new_blobs(blobs, self.read("blobs")).withColumn("shard", F.substring("sha256", 1, 2))
        self.append("blobs", fresh.select("sha256", "bytes", "shard"))

    def blobs(self, wanted: DataFrame) -> DataFrame:
        """(sha256, bytes) of the wanted digests; null where there is none."""
        return wanted.select("sha256").distinct().join(self.read("blobs").select("sha256", "bytes"), "sha256", "left")

    def put_replies(self, replies: DataFrame) -> None:
        self.append("responses", replies.select("key", "body", F.current_timestamp().alias("stored_at")))

    def replies(self, keys: DataFrame) -> DataFrame:
        return G.replies(self.read("responses"), keys)

    def documents(self) -> DataFrame:
        """The newest version of each document; source fields are those of the first."""
        return G.upsert_documents(self.read("docs"), self.spark.createDataFrame([], SCHEMAS["docs"]))

    def runs(self, doc_id: str) -> DataFrame:
        return G.runs_for(self.read("runs"), doc_id)

    def save(self, state: DataFrame, sources: DataFrame) -> DataFrame:
        """Append a version of each document of ``state`` (doc_id and columns); (doc_id, state_sha256)."""
        digest = input_hash(state, ["doc_id"], *[c for c in state.columns if c != "doc_id"]).withColumnRenamed("input_hash", "state_sha256")
        rows = digest.join(sources.select("doc_id", "source_path", "source_sha256"), "doc_id", "left")
        self.append("docs", rows.select("doc_id", "source_path", "source_sha256", "state_sha256", F.current_timestamp().alias("updated_at")))
        return digest


def summary(stage: str, status: str, counts: dict[str, int], score: float | None, passed: bool) -> str:
    """One line about a run."""
    parts = [f"{stage} {status}"]
    if counts:
        parts.append(" ".join(f"{k}={v}" for k, v in counts.items()))
    if score is not None:
        parts.append(f"score={score:.3f}")
    return " | ".join(parts if passed else [*parts, "VERIFY-FAILED"])


def report_text(row: dict, as_json: bool = False) -> str:
    """A run's report: JSON, or its summary, findings and metrics by name."""
    report = json.loads(row["report"])
    if as_json:
        return json.dumps(report, ensure_ascii=False, sort_keys=True)
    lines = [summary(row["stage"], row["status"], report.get("counts", {}), row["score"], row["passed"])]
    lines += [f"  - {x}" for x in report["findings"]]
    return "\n".join([*lines, *(f"  {k} = {v:g}" for k, v in sorted(report["metrics"].items()))])


def execute(store: Store, stage: Stage, doc: DataFrame, params: object, sources: DataFrame, counts: dict[str, int] | None = None) -> tuple[DataFrame, list[dict]]:
    """Run a stage over the documents of ``doc``, judge it, apply it, and record version, history and run.

    Documents whose run with the same input is in the ledger keep their recorded
    result: the stage only runs over the others.  The verdict is on the document
    before the result is applied.  The rows that were recorded are returned with
    the document after it.
    """
    spark, began, at = store.spark, time.perf_counter(), datetime.now(UTC)
    params_hash = stable_hash(params)
    columns = [c for c in doc.columns if c != "doc_id"]
    hashes = input_hash(doc, ["doc_id"], *columns)
    probe = hashes.select("doc_id", F.lit(stage.name).alias("stage"), F.lit(stage.version).alias("stage_version"), F.lit(params_hash).alias("params_hash"), "input_hash")
    known = G.cached_run(store.read("runs"), probe).where("run_id IS NOT NULL").select("doc_id", "output_hash")
    where = f"state_{stage.name}"
    kept = None
    if not known.isEmpty():
        old = store.read(where, ", ".join(f"{n} {t}" for n, t in [*doc.dtypes, ("_state", "string")]))
        kept = old.join(known.select("doc_id", F.col("output_hash").alias("_state")), ["doc_id", "_state"], "left_semi").drop("_state")
    fresh = doc.join(known, "doc_id", "left_anti")
    if fresh.isEmpty():
        return (kept if kept is not None else doc), []
    result = stage.run(fresh, params)
    verdict = stage.verify(fresh, result, params)
    after = stage.apply(fresh, result)
    states = store.save(after, sources)
    store.append(where, after.join(states.withColumnRenamed("state_sha256", "_state"), "doc_id").select(*[c for c in doc.columns], "_state"))
    took = time.perf_counter() - began
    report = {"findings": list(verdict.findings), "metrics": dict(sorted(verdict.metrics.items())), "counts": counts or {}, "wall_seconds": took}
    fixed = {"stage": stage.name, "stage_version": stage.version, "params_hash": params_hash, "status": verdict.status, "passed": verdict.passed, "score": verdict.score, "report": json.dumps(report, ensure_ascii=False)}
    new = states.join(hashes, "doc_id").select("doc_id", "input_hash", F.col("state_sha256").alias("output_hash"), F.lit(at).cast("timestamp").alias("started_at"), F.lit(took).alias("duration_s"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    kinds = {f.split()[0]: f.split()[1] for f in SCHEMAS["runs"].split(", ")}
    rows = G.numbered(store.read("runs"), new).select(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()])
    store.append("runs", rows)
    note = "; ".join(verdict.findings) or None
    store.append("history", states.select("doc_id", F.lit(stage.name).alias("stage"), F.lit(stage.version).alias("version"), F.lit(params_hash).alias("params_hash"), F.lit(at).cast("timestamp").alias("at"), F.lit(verdict.passed).alias("passed"), F.lit(note).cast("string").alias("note")))
    done = reduce(DataFrame.unionByName, [x for x in (after.select(*doc.columns), kept) if x is not None])
    return done, [fixed]
