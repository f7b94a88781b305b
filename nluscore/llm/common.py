"""Shared helpers: written tables in the shared scratch folder, files on any store, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nluscore.session import checkpoint_dir

#: ASCII white space of the contracts: space and tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``; dropped when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a :func:`stored` table that nothing reads any more."""
    spark = table.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of stages whose results are written: Spark drops them once the driver's
    JVM has noticed that no plan refers to them any more. It holds on to the last job until another ran."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """A map over Arrow batches that gives memory back to the system before and after it: Python workers live on
    after a task, and what a stage left in their pools would count against the next."""
    def give_back() -> None:
        import ctypes

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass

    def tidied(batches):
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def filesystem(uri: str):
    """(pyarrow file system, path on it) for a URI or plain path; used inside tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``: extra columns, whatever their names, take no further part."""
    return df.select(*(df[c] for c in columns))


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node.

    Alternating large-star and small-star steps. Each round is two partially aggregated minima and
    two equi-joins over edges, written to the shared folder; a hub is only ever reduced by ``min``.
    Nodes without an edge don't appear. Ends when the edge set stops changing.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where("u != v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("n")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = stored(large, "large")
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("n"))
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        roots = low.select(F.col("n").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(roots).distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
