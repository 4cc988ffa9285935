"""Writing tables, with receipts that can be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdigris.operators.sampling import sharded
from verdigris.storage import path_exists


def write_sharded(df: DataFrame, folder: str, key: str, order: Column, shards: int) -> DataFrame:
    """JSON lines in folders ``shard=i``, each key's rows dealt in turn, a stable order within a shard. Returns the receipt."""
    dealt = sharded(df, key, order, shards).withColumn("__o", order)
    dealt.repartition(shards, "shard").sortWithinPartitions("shard", "__o").drop("__o").write.mode("errorifexists").partitionBy("shard").json(folder)
    return receipt(df.sparkSession, folder)


def receipt(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder. A file is read whole by one task, so files must fit one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_replace("path", r"^.*?" + folder.rstrip("/").rpartition("/")[2] + "/", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """path, problem for files that are missing, new or different from a receipt; no rows if all is as it was."""
    now = receipt(spark, folder).select("path", F.col("sha256").alias("found"))
    joined = expected.select("path", "sha256").join(now, "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "differs")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def write_run(df: DataFrame, folder: str, manifest: dict[str, str]) -> None:
    """A run directory that must not exist yet: predictions, manifest, and last the receipt, whose presence means that all is there."""
    spark = df.sparkSession
    if path_exists(spark, folder):
        raise FileExistsError(folder)
    df.write.mode("errorifexists").json(f"{folder}/predictions")
    spark.createDataFrame(sorted(manifest.items()), "key string, value string").coalesce(1).write.json(f"{folder}/manifest")
    receipt(spark, f"{folder}/predictions").coalesce(1).write.json(f"{folder}/receipt")


def verify_run(spark: SparkSession, folder: str) -> DataFrame:
    expected = spark.read.schema("path string, bytes long, sha256 string").json(f"{folder}/receipt")
    return verify(spark, f"{folder}/predictions", expected)


def write_verdicts(df: DataFrame, raw: str, verdict: str, folder: str) -> None:
    """Kept rows exactly as they were read, and the others aside by verdict, from one pass: the raw line is the only column written."""
    df.select(F.col(verdict).alias("verdict"), F.col(raw).alias("value")).write.mode("errorifexists").partitionBy("verdict").text(folder)
