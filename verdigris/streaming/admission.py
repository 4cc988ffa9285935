"""Admission of flagged rows to a queue: quotas by key, a global cap, held-out rows first, and waiting rows tried again.

The state is three tables in a folder of the shared store: ``queue`` (admitted rows), ``waiting`` (rows seen but not admitted)
and ``commits`` (one row a batch). Each micro-batch writes its own part of the queue and the whole of what waits, then its
commit; readers take committed parts only. So a batch that is repeated after a failure overwrites what it wrote and admits
nothing twice, and an id that is in the queue or waits is never taken again.

Quotas and exclusions are read anew for every batch, so a raised quota admits rows that waited.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from verdigris.storage import delete_path, path_exists

ROW = "id string, quota_key string, priority double, heldout boolean"
QUEUED = f"{ROW}, position long"


@dataclass(frozen=True)
class Quotas:
    """Rows a key may have (None: no bound), the quota of keys that aren't listed, the cap on expected calls, the calls that a row
    of a key is expected to cost, and the cap on held-out rows."""

    by_key: dict[str, int | None]
    default: int | None
    cap: float
    calls: dict[str, float]
    heldout_cap: int
    stopped: bool = False  # the consumer reported that nothing more can be taken


class AdmissionState:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[int]:
        if not path_exists(self.spark, f"{self.folder}/commits"):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("done int, batch long").parquet(f"{self.folder}/commits").select("batch").distinct().collect())  # a row a batch

    def queue(self, before: int | None = None) -> DataFrame:
        found = [b for b in self._batches() if before is None or b < before]
        paths = [f"{self.folder}/queue/batch={b}" for b in found]
        return self.spark.read.schema(QUEUED).parquet(*paths) if paths else self.spark.createDataFrame([], QUEUED)

    def waiting(self, before: int | None = None) -> DataFrame:
        found = [b for b in self._batches() if before is None or b < before]
        return self.spark.read.schema(ROW).parquet(f"{self.folder}/waiting/batch={found[-1]}") if found else self.spark.createDataFrame([], ROW)

    def admit(self, rows: DataFrame, batch: int, quotas: Quotas, excluded: DataFrame | None = None) -> None:
        """Take one batch of ``rows`` (id, quota_key, priority, heldout)."""
        if batch in self._batches():
            return
        queue, waiting = self.queue(batch), self.waiting(batch)
        new = rows.select(*[c.split()[0] for c in ROW.split(", ")]).where("id is not null").groupBy("id").agg(F.max_by(F.struct("quota_key", "priority", "heldout"), F.struct("priority", "quota_key")).alias("r")).select("id", "r.*")
        new = new.join(queue.select("id"), "id", "left_anti").join(waiting.select("id"), "id", "left_anti")
        open_ = waiting.unionByName(new)
        if excluded is not None:
            open_ = open_.join(excluded.select("id").distinct(), "id", "left_anti")
        for kind in ("queue", "waiting", "commits"):
            delete_path(self.spark, f"{self.folder}/{kind}/batch={batch}")
        taken = admitted(open_, queue, quotas)
        taken.write.parquet(f"{self.folder}/queue/batch={batch}")
        done = self.spark.read.schema(QUEUED).parquet(f"{self.folder}/queue/batch={batch}")
        open_.join(done.select("id"), "id", "left_anti").write.parquet(f"{self.folder}/waiting/batch={batch}")
        self.spark.range(1).select(F.lit(1).alias("done")).coalesce(1).write.parquet(f"{self.folder}/commits/batch={batch}")


def admitted(open_: DataFrame, queue: DataFrame, quotas: Quotas) -> DataFrame:
    """The rows of ``open_`` that go to the queue now, with their positions.

    Held-out rows come first, by id, up to their cap. The others are ranked by falling priority, then id: within a key up to
    what its quota leaves, then over all keys up to what the cap leaves. The global rank orders only candidates that the
    quotas leave, and no more of them than the cap can hold."""
    spark = open_.sparkSession
    if quotas.stopped:
        return spark.createDataFrame([], QUEUED)
    used = queue.groupBy("heldout", "quota_key").agg(F.count("*").alias("n")).collect()  # two rows a key
    by_key = {}
    for r in used:
        if not r["heldout"]:
            by_key[r["quota_key"]] = r["n"]
    cost = lambda key: quotas.calls.get(key, 1.0)
    spent, position = sum(r["n"] * cost(r["quota_key"]) for r in used), sum(r["n"] for r in used)
    heldout_left = max(0, quotas.heldout_cap - sum(r["n"] for r in used if r["heldout"]))
    held = open_.where("heldout").orderBy("id").limit(heldout_left)
    held = held.withColumn("place", F.row_number().over(Window.orderBy("id")))  # within the cap
    held_costs = {r["quota_key"]: r["n"] for r in held.groupBy("quota_key").agg(F.count("*").alias("n")).collect()}
    spent += sum(n * cost(k) for k, n in held_costs.items())
    listed = {k: v for k, v in quotas.by_key.items()}
    left_rows = [(k, None if q is None else max(0, q - by_key.get(k, 0))) for k, q in listed.items()]
    left_rows += [(k, None if quotas.default is None else max(0, quotas.default - n)) for k, n in by_key.items() if k not in listed]
    left = spark.createDataFrame(left_rows, "quota_key string, left_ long") if left_rows else spark.createDataFrame([], "quota_key string, left_ long")
    known = left.withColumn("listed", F.lit(True))
    order = [F.desc("priority"), F.col("id")]
    others = open_.where(~F.col("heldout")).join(F.broadcast(known), "quota_key", "left")  # a row a key of the quota file or the queue
    bound = F.when(F.col("listed"), F.col("left_")).otherwise(F.lit(quotas.default).cast("long"))
    ranked = others.withColumn("k", F.row_number().over(Window.partitionBy("quota_key").orderBy(*order))).where(bound.isNull() | (F.col("k") <= bound))
    least = min([1.0, *quotas.calls.values()])
    room = max(0, int((quotas.cap - spent) / least + 1e-9)) if least > 0 else 0
    costs = F.create_map(*[F.lit(x) for kv in quotas.calls.items() for x in kv]) if quotas.calls else None
    calls = F.coalesce(F.try_element_at(costs, F.col("quota_key")), F.lit(1.0)) if costs is not None else F.lit(1.0)
    fits = ranked.orderBy(*order).limit(room).withColumn("calls", calls)
    whole = Window.orderBy(*order)
    fits = fits.withColumn("total", F.sum("calls").over(whole.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(whole)).where(F.col("total") <= quotas.cap - spent)
    n_held = sum(held_costs.values())
    names = [c.split()[0] for c in ROW.split(", ")]
    return held.select(*names, (F.lit(position) + F.col("place")).cast("long").alias("position")).unionAll(fits.select(*names, (F.lit(position + n_held) + F.col("place")).cast("long").alias("position")))


def run_admission(stream: DataFrame, state: AdmissionState, checkpoint: str, quotas: Callable[[], Quotas], excluded: Callable[[], DataFrame | None] = lambda: None):
    """Start a streaming query that feeds micro-batches to the state; it ends when all files there are have been read."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: state.admit(rows, batch, quotas(), excluded()))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def file_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """Complete JSON-lines files of a folder as a stream. Files must appear whole (written elsewhere, then renamed)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def all_done(spark: SparkSession, folder: str, shards: list[str]) -> bool:
    """Whether every shard has left its ``.done`` mark."""
    return all(path_exists(spark, f"{folder.rstrip('/')}/{s}.done") for s in shards)
