"""Tables written to the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so that the loss of an executor
costs a task and not the history of the loop. The folder is ``spark.checkpoint.dir`` of the session; only where
that is unset in a local session (tests, a laptop) does a temporary folder take its place; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verdigris-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/verdigris/{tag}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than half the cores is dealt over all of them; larger ones come as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores // 2 else df


#: Tables of at most so many rows are broadcast by ``bounded``.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint if it was counted and is small; larger tables are left to the optimiser."""
    held = materialise(df, "bounded")
    return F.broadcast(held) if held.count() <= rows else held


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back. ``path_of`` gives its place for ``discard``."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._verdigris_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing will read again."""
    path = getattr(df, "_verdigris_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    if not path_exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]
