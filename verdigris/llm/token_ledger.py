"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder. It holds, in buckets of documents, the row of each (document, version) that counts now, and the
totals. A batch turns changes into signed rows: an insert weighs 1, a delete -1, a revised count does both; an insert of
a document and version that the ledger holds replaces the held row, so it is a revision and never counts twice. The
batch reads and rewrites only the buckets that it touches, adds the sums of its signed rows to the totals, and commits by
writing one head that names the newest table of every bucket and of the totals. Nothing reads the documents again, and
no work grows with the number of batches before but the listing of their names.

A batch id that is committed is left alone, and a batch that broke off before its head left tables that nothing names:
applying a batch twice, in whole or in part, is applying it once. Batches take effect in the order of their commits: a delete or
revision of what the ledger doesn't hold (yet) does nothing. Within a batch deletes come first, then inserts, then
revisions; of repeated rows of a document and version the one with the largest count is taken. Rows without a document id, and inserts and
revisions with a null count, are refused, and their number is committed with the batch (``refused``); null versions, sources and languages are values of their own. An empty batch commits and changes nothing.

All files go through Spark's writers, so the folder can be in any store that the cluster shares. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.storage import delete_path, list_names, path_exists

KEY = ("doc_id", "version")
ROW = "doc_id long, source string, lang string, version string, tokens long"
SIGNED = f"{ROW}, weight int"
SUMS = "source string, lang string, version string, documents long, tokens long"
HEAD = "kind string, bucket int, path string"


class TokenLedger:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        """``buckets`` is fixed when the first batch is committed; a bucket should hold some million documents."""
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _names(self) -> list[str]:
        """Names of complete heads, oldest first: a number and the batch's id."""
        return [n for n in sorted(list_names(self.spark, f"{self.folder}/heads")) if path_exists(self.spark, f"{self.folder}/heads/{n}/_SUCCESS")]

    def committed(self, batch: str) -> bool:
        return any(n.partition("-")[2] == batch for n in self._names())

    def refused(self, batch: str) -> int | None:
        """How many rows of a committed batch were refused; None if it isn't committed."""
        names = [n for n in self._names() if n.partition("-")[2] == batch]
        if not names:
            return None
        rows = self.spark.read.schema(HEAD).parquet(f"{self.folder}/heads/{names[-1]}").where("kind = 'refused'").collect()
        return int(rows[0]["path"]) if rows else 0

    def _head(self) -> dict[tuple[str, int], str]:
        """(kind, bucket): path of its newest table. A row a bucket."""
        names = self._names()
        rows = self.spark.read.schema(HEAD).parquet(f"{self.folder}/heads/{names[-1]}").collect() if names else []
        return {(r["kind"], r["bucket"]): r["path"] for r in rows}

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The rows that the ledger holds now."""
        return self._read([p for (kind, _), p in self._head().items() if kind == "held"], ROW)

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens."""
        return self._read([p for (kind, _), p in self._head().items() if kind == "totals"], SUMS).where("documents <> 0")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commit one batch; False if it was committed before. ``inserts``: doc_id, source, lang, version, tokens.
        ``deletes``: doc_id, version. ``revised``: doc_id, version, tokens."""
        if self.committed(batch):
            return False
        spark, head = self.spark, self._head()
        buckets = 1 + max((b for kind, b in head if kind == "held"), default=self.buckets - 1)
        own = f"tables/{uuid.uuid4().hex}"
        fields = [c.split()[0] for c in ROW.split(", ")]
        parts = []
        if deletes is not None:
            parts.append(deletes.select(*KEY, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("tokens"), F.lit("gone").alias("how")))
        if inserts is not None:
            parts.append(inserts.select(*fields).withColumn("how", F.lit("new")))
        if revised is not None:
            parts.append(revised.select(*KEY, "tokens").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "how": F.lit("count")}))
        asked = spark.createDataFrame([], f"{ROW}, how string")
        for p in parts:
            asked = asked.unionByName(p.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ROW.split(", ")], "how"))
        bad = F.col("doc_id").isNull() | ((F.col("how") != "gone") & F.col("tokens").isNull())
        row = lambda how: F.max(F.when((F.col("how") == how) & ~bad, F.struct("tokens", "source", "lang"))).alias(how)
        # one row a document and version, partial before it moves
        wanted = asked.groupBy(*KEY).agg(row("gone"), row("new"), row("count"), F.count_if(bad).alias("refused")).withColumn("bucket", self._bucket(buckets))
        wanted.write.parquet(f"{self.folder}/{own}/asked")
        wanted = spark.read.parquet(f"{self.folder}/{own}/asked")
        live = F.coalesce("gone", "new", "count").isNotNull()
        told = wanted.groupBy("bucket").agg(F.max(live).alias("live"), F.sum("refused").alias("refused")).collect()  # a row a bucket
        touched, refused = [r["bucket"] for r in told if r["live"]], sum(r["refused"] for r in told)
        wanted = wanted.where(live)
        held = self._read([head["held", b] for b in touched if ("held", b) in head], ROW).select(*KEY, F.struct("tokens", "source", "lang").alias("old"))
        w, h = wanted.alias("w"), held.alias("h")
        both = h.join(w, (F.col("h.doc_id") == F.col("w.doc_id")) & F.col("h.version").eqNullSafe(F.col("w.version")), "full_outer")
        base = F.when(F.col("new").isNotNull(), F.col("new")).when(F.col("gone").isNull(), F.col("old"))
        now = F.when(base.isNotNull() & F.col("count").isNotNull(), F.struct(F.col("count.tokens").alias("tokens"), base["source"].alias("source"), base["lang"].alias("lang"))).otherwise(base)
        doc = F.coalesce("h.doc_id", "w.doc_id").alias("doc_id")
        version = F.when(F.col("h.doc_id").isNotNull(), F.col("h.version")).otherwise(F.col("w.version")).alias("version")
        after = both.select(doc, version, "old", now.alias("now"))
        moved = after.where("not (old <=> now)")
        signed = moved.select("doc_id", "version", "old.*", F.lit(-1).alias("weight")).where("tokens is not null").unionByName(moved.select("doc_id", "version", "now.*", F.lit(1).alias("weight")).where("tokens is not null"))
        signed.select(*[c.split()[0] for c in SIGNED.split(", ")]).write.parquet(f"{self.folder}/{own}/changes")
        changes = spark.read.schema(SIGNED).parquet(f"{self.folder}/{own}/changes")
        stays = after.where("now is not null").select("doc_id", "now.source", "now.lang", "version", "now.tokens").withColumn("bucket", self._bucket(buckets))
        if touched:
            stays.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{own}/held")
        sums = changes.groupBy("source", "lang", "version").agg(F.sum("weight").alias("documents"), F.sum(F.col("weight") * F.col("tokens")).alias("tokens"))
        before = self._read([p for (kind, _), p in head.items() if kind == "totals"], SUMS)
        total = before.unionByName(sums).groupBy("source", "lang", "version").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        total.coalesce(1).write.parquet(f"{self.folder}/{own}/totals")
        there = {int(n.partition("=")[2]) for n in list_names(spark, f"{self.folder}/{own}/held") if n.startswith("bucket=")}
        following = {k: p for k, p in head.items() if k[0] == "held" and k[1] not in touched} | {("held", b): f"{own}/held/bucket={b}" for b in there} | {("totals", 0): f"{own}/totals", ("refused", 0): str(refused)}
        if ("held", buckets - 1) not in following:  # the number of buckets is read off the head
            spark.createDataFrame([], ROW).write.mode("overwrite").parquet(f"{self.folder}/{own}/none")
            following["held", buckets - 1] = f"{own}/none"
        number = 1 + int(([*self._names()] or ["0-"])[-1].partition("-")[0])
        spark.createDataFrame([(kind, b, p) for (kind, b), p in sorted(following.items())], HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/{number:012d}-{batch}")
        return True

    def vacuum(self) -> None:
        """Delete the tables that the newest head doesn't name: those that were replaced, and what broken batches left."""
        keep = {p.split("/")[1] for (kind, _), p in self._head().items() if kind != "refused"}
        for n in list_names(self.spark, f"{self.folder}/tables"):
            if n not in keep:
                delete_path(self.spark, f"{self.folder}/tables/{n}")
