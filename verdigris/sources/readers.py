"""Reading tables of records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines of a given schema. Strict: a blank line, a line that is no object (a list of objects too), one with more than an
    object, or one with NaN or infinity fails the read; white space around the object is fine. Otherwise such lines come out with their text in ``_corrupt_record``, and blank lines are skipped."""
    if strict:
        fields = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        lines = spark.read.text(path)
        refused = F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80)))
        options = {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}
        # the line as the only element of a list and as the only value of an object: whatever follows its object breaks one of them
        listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{fields.simpleString()}>", options)
        only = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), "struct<x:string>", options)["x"].isNotNull()
        whole = F.when(F.col("value").rlike(r"^[ \t\r]*\{") & only & (F.size(listed) == 1), F.get(listed, F.lit(0))).otherwise(refused.cast(fields))
        return lines.select(whole.alias("r")).select("r.*")
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    if "_corrupt_record" not in kind.names:
        kind = StructType([*kind.fields]).add("_corrupt_record", "string")
    return spark.read.schema(kind).option("mode", "PERMISSIVE").option("allowNonNumericNumbers", "false").json(path)


def read_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """By suffix: jsonl and ndjson, json (a list, or an object with ``data`` or ``rows``), csv with a header, parquet, orc."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, schema)
    if suffix == "json":
        kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        one = StructType([f for f in kind.fields]).simpleString()
        whole = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", f"array<{one}>")
        wrapped = F.from_json("value", f"struct<data:array<{one}>,rows:array<{one}>>")
        rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(wrapped["data"], wrapped["rows"]))
        return whole.select(F.explode(rows).alias("r")).select("r.*")
    if suffix == "csv":
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if suffix in ("parquet", "orc"):
        return spark.read.schema(schema).format(suffix).load(path)
    raise ValueError(f"no reader for .{suffix}")


def expand_fields(df: DataFrame, fields: str, keep: list[str]) -> DataFrame:
    """One row per question of a multi-question record, with its place."""
    return df.select(*keep, F.posexplode(fields).alias("field_at", "field"))


def json_leaves(df: DataFrame, column: str, out: str = "leaves", skip: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the strings and numbers at the leaves of a JSON text, in order; those below skipped keys are left out.
    Nesting is free, so this walks in Python; text that is no JSON is its own only leaf."""
    def walk(x) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                if k not in skip:
                    yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)
        elif isinstance(x, bool) or x is None:
            return
        else:
            yield str(x)

    @F.pandas_udf("array<string>")
    def leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for x in column.array:
                try:
                    out.append([] if x is None else list(walk(json.loads(x))))
                except ValueError:
                    out.append([x])
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, leaves(F.col(column)))
