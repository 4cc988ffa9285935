"""From documents to packed sequences: toxicity, near-duplicates, secrets, packing.

Every stage keeps the columns it was given, of whatever name, and takes null and empty texts, null ids, repeated rows, texts of any length and
empty tables: a null text scores like an empty one, null and empty texts are copies of each other, a null text has no secret and stays null, and
packs as its end mark alone. Rows that repeat an id stay or go together; a repeated row that stays does so as often as it occurs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.llm import packing, secret_scan, shingle_sets, toxicity
from verdigris.llm.queries import HELD_OUT
from verdigris.session import ship_package
from verdigris.storage import discard, materialise


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The classifier is trained on the labelled documents of ``sf_dir``."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(f"not ({HELD_OUT})")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(texts, labels)
    name = _unused(docs, "toxicity")
    scored = toxicity.with_score(docs, model, out=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents join where their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Of each group the one with the
    smallest id stays; documents without an id stay."""
    ship_package(spark)
    groups = shingle_sets.shingle_components(docs, words=5, least=0.8)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay, with n_chars of what they are now."""
    ship_package(spark)
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    name = _unused(docs, "scan")
    scanned = secret_scan.scan(docs, forest, out=name)
    return scanned.withColumn("text", F.col(f"{name}.redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Subword embeddings and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # nothing but the documents themselves is read again
    return STAGES[-1][1](spark, docs, sf_dir)
