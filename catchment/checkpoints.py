"""Cuts the lineage of iterative plans with files that outlive a lost executor; and tables of bits that tell absent keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of materialized results that still exist.
_KEPT: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Shuffle files go as soon as the write is done, and events hold the head of a plan alone (literals may be long).
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}


def materialize(df: DataFrame, lean: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet under the shared checkpoint folder and reads it back; ``lean``: under LEAN."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    before = {k: spark.conf.get(k) for k in LEAN} if lean else {}
    try:
        for k in before:
            spark.conf.set(k, LEAN[k])
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new path under the shared checkpoint folder, deleted at exit."""
    path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}{suffix}"
    _KEPT[path] = spark
    return path


def release(*results: DataFrame | None, collect: bool = False) -> None:
    """Deletes the files of superseded results of ``materialize``; with ``collect`` Spark's cleaner also drops the shuffle files of finished jobs now."""
    for df in results:
        if df is not None and df.kept_at in _KEPT:
            spark = _KEPT.pop(df.kept_at)
            _remove(spark, df.kept_at)
            if collect:
                spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for path, spark in _KEPT.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


#: Slots of a bit table; its size never depends on the data.
SLOTS = 1 << 16


def _pattern(h: Column) -> Column:
    """Two of 64 bits, chosen by a hash."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(32).bitwiseOR(bit(48))


def marks(keys: DataFrame, *columns: str) -> DataFrame:
    """slot, bits: a table of at most SLOTS rows in which each key sets two of the 64 bits of a slot."""
    h = F.xxhash64(*columns)
    return keys.select(h.bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), _pattern(h).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def with_seen(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``df`` with seen: whether the key may be among those of ``marks``. No shuffle of ``df``; true for some others, false for none of them."""
    h = F.xxhash64(*columns)
    joined = df.withColumn("slot", h.bitwiseAND(F.lit(SLOTS - 1))).join(F.broadcast(table), "slot", "left")
    return joined.select(*df.columns, F.coalesce(F.col("bits").bitwiseAND(_pattern(h)) == _pattern(h), F.lit(False)).alias("seen"))


def seen_in(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``marks``."""
    return with_seen(df, table, *columns).filter("seen").drop("seen")
