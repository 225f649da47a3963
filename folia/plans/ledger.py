"""The run ledger as append-only tables: upsert, versions, cache probe, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents after saving ``new`` versions: state and time are the latest, source fields stay the first."""
    every = old.unionByName(new)
    order = F.struct("updated_at", "state_sha256")
    return every.groupBy("doc_id").agg(F.min_by("source_path", order).alias("source_path"), F.min_by("source_sha256", order).alias("source_sha256"), F.max_by("state_sha256", order).alias("state_sha256"), F.max("updated_at").alias("updated_at"))


def in_order(rows: DataFrame, place: str, *ties: str, name: str = "_k", ranges: int = 64) -> DataFrame:
    """``rows`` with their number from 1 by ``place`` (a number or time) and ``ties``: ranges of like sizes are numbered by themselves."""
    timed = dict(rows.dtypes)[place].startswith(("timestamp", "date"))
    key = (F.unix_micros(F.col(place).cast("timestamp")) if timed else F.col(place)).cast("double")
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    part = F.lit(0)
    for i, c in enumerate(cuts):
        part = F.when(key > c, i + 1).otherwise(part)
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    before, base = 0, F.lit(0).cast("long")
    for i in range(len(cuts)):
        before += sizes.get(i, 0)
        base = F.when(key > cuts[i], F.lit(before).cast("long")).otherwise(base)
    w = Window.partitionBy("_part").orderBy(place, *ties)
    return rows.withColumn("_part", part).withColumn(name, base + F.row_number().over(w)).drop("_part")


def numbered(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` runs with run_id going on from the ledger's last, in order of start."""
    last = ledger.agg(F.max("run_id")).first()[0] or 0
    return in_order(new, "started_at", "doc_id", "stage").withColumn("run_id", F.lit(last) + F.col("_k")).drop("_k")


def cached_run(ledger: DataFrame, probes: DataFrame) -> DataFrame:
    """For each (stage, stage_version, params_hash, input_hash) probe the newest good run, if any."""
    keys = ["stage", "stage_version", "params_hash", "input_hash"]
    best = ledger.where("status = 'ok'").groupBy(*keys).agg(F.max_by(F.struct("run_id", "output_hash"), "run_id").alias("r"))
    return probes.join(best, keys, "left").select(*probes.columns, F.col("r.run_id").alias("run_id"), F.col("r.output_hash").alias("output_hash"))


def listing(documents: DataFrame) -> DataFrame:
    """(doc_id, source_path, updated_at), the latest first."""
    return documents.select("doc_id", "source_path", "updated_at").orderBy(F.desc("updated_at"), "doc_id")


def state_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, state_sha256) of the wanted ids; null where there is no such document."""
    return wanted.select("doc_id").join(documents.select("doc_id", "state_sha256"), "doc_id", "left")


def replies(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, body) of each wanted key, null where none is cached; of several bodies the last stored."""
    last = cache.groupBy("key").agg(F.max_by("body", "stored_at").alias("body"))
    return keys.select("key").distinct().join(last, "key", "left")


def runs_for(ledger: DataFrame, doc_id: str) -> DataFrame:
    return ledger.where(F.col("doc_id") == doc_id).orderBy("run_id")


def resolve(documents: DataFrame, prefix: str) -> str:
    """The one id with a prefix; no or more than one is an error.  ``%``, ``_`` and ``\\`` are taken literally."""
    found = [r.doc_id for r in documents.where(F.startswith("doc_id", F.lit(prefix))).select("doc_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise KeyError(f"{'no' if not found else 'more than one'} document starts with {prefix!r}")
    return found[0]


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed put: distinct ``(sha256, bytes)`` that are not stored yet."""
    named = incoming.select(F.sha2("bytes", 256).alias("sha256"), "bytes")
    return named.join(stored.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def costs(ledger: DataFrame) -> DataFrame:
    """Summed cost of each document from the reports' JSON."""
    cost = F.from_json("report", "input_tokens long, output_tokens long, provider_calls long, wall_seconds double")
    return ledger.select("doc_id", cost.alias("c")).groupBy("doc_id").agg(*[F.sum(f"c.{n}").alias(n) for n in ("input_tokens", "output_tokens", "provider_calls", "wall_seconds")])
