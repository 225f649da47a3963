"""Shared plumbing of the training-data operators: tables and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a sieve, a power of two.
SIEVE_BITS = 1 << 24
#: Rows of a few numbers each that fill a file.
FILL_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where none is set, a local folder for a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="folia-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed columnar table under the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    where = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows of a few numbers at most, in no more partitions than these fill, but one for each core.

    To be written: each file of a local file system starts two processes of the
    executor, which count for a moment with all its memory. No row is moved.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILL_ROWS)))


def sieve(rows: DataFrame, names: DataFrame, columns: list[str], inside: bool = True, bits: int = SIEVE_BITS) -> DataFrame:
    """The rows that may be among ``names`` by ``columns``: all that are, and some by chance; not ``inside``: the others, which surely are not.

    Nothing is shuffled but the words of a bitmap, whose size is the same for any
    table; an exact join may follow on the few rows that are left.
    """
    mark = F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(bits)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), mark.bitwiseAND(F.lit(63)))
    words = names.select(F.shiftright(mark, 6).alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    met = rows.withColumn("_word", F.shiftright(mark, 6)).join(F.broadcast(words), "_word", "inner" if inside else "left")
    on = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.where(on if inside else ~on).select(*[f"`{c}`" for c in rows.columns])


def trim() -> None:
    """Called by a stage's task: the worker it runs in returns the memory that tasks before it have freed."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """As ``trim``, after the worker has dropped what the encoder's tasks before it kept."""
    encoder = sys.modules.get("folia.llm.duck_bpe")
    if encoder is not None:
        encoder.vocabulary.cache_clear()
    trim()


def drop_table(*tables: DataFrame) -> None:
    """Remove tables of ``cut_table`` that nothing reads any more, and the shuffle files that nothing refers to."""
    spark = tables[0].sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for where in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let shuffle files and broadcasts go that nothing refers to any more, and with them memory of the driver."""
    gc.collect()
    spark._jvm.System.gc()
