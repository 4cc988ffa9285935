"""Soft targets under aliases, and responses shaped and read back."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import targets as T


@pytest.mark.parametrize(
    "soft, choices, want",
    [
        ({"a": 1.0, "b": 3.0}, ["a", "b", "__unknown__"], ([0.25, 0.75, 0.0], None, [])),
        ({"True": 1.0, "null": 1.0}, ["true", "false", "__unknown__"], ([0.5, 0.0, 0.5], None, [])),
        ({"true": 1.0, "True": 1.0}, ["true", "false"], (None, None, ["duplicate_aliases"])),
        ({"unknown": 1.0, "__unknown__": 0.0}, ["a", "__unknown__"], (None, None, ["duplicate_aliases"])),
        ({"z": 1.0, "c": 0.0, "a": 1.0}, ["a"], (None, ["c", "z"], ["unknown_keys"])),
        ({"a": -1.0, "b": 2.0}, ["a", "b"], (None, None, ["invalid"])),
        ({"a": None}, ["a"], (None, None, ["invalid"])),
        ({"a": float("nan")}, ["a"], (None, None, ["invalid"])),
        ({"a": float("inf")}, ["a"], (None, None, ["invalid"])),
        ({"a": 0.0}, ["a"], (None, None, ["invalid"])),
        ({}, ["a"], (None, None, ["invalid"])),
        (None, ["a"], (None, None, ["missing"])),
        ({"a": 1.0}, None, (None, None, ["missing"])),
        ({"q": -1.0}, ["a"], (None, ["q"], ["unknown_keys", "invalid"])),
    ],
)
def test_soft_weights(spark, soft, choices, want):
    df = spark.createDataFrame([(soft, choices)], "s map<string,double>, c array<string>")
    assert tuple(df.select(T.soft_weights(F.col("s"), F.col("c")).alias("x")).first()["x"]) == want


def test_soft_gold(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.1, 0.8],)], "w array<double>")
    assert [r[0] for r in df.select(T.soft_gold(F.col("w"), F.array(*map(F.lit, ("a", "b", "__unknown__"))))).collect()] == ["a", None]


R = "f string, n int, r struct<type:string,noul:double,probabilities:array<double>,choice:int,score:double,unknown:double,abstained:boolean>"


@pytest.mark.parametrize(
    "f, n, r, want",
    [
        ("boolean", 2, ("noul", 0.6, None, None, None, 0.2, False), ("answered", 0, [0.5, 0.3, 0.2], [])),
        ("boolean", 2, ("noul", 0.6, None, None, None, 0.2, True), ("abstained", None, [0.5, 0.3, 0.2], [])),
        ("boolean", 2, ("choice", 0.6, None, None, None, 0.2, False), (None, None, None, ["type"])),
        ("boolean", 2, ("noul", 0.05, None, None, None, 0.2, False), (None, None, None, ["distribution"])),
        ("boolean", 2, ("noul", None, None, None, None, 0.2, False), (None, None, None, ["number"])),
        ("boolean", 2, ("noul", 0.5, None, None, None, 0.2, None), (None, None, None, ["abstention"])),
        ("choice", 2, ("choice", None, [0.75, 0.25], 0, None, 0.2, False), ("answered", 0, [0.6, 0.2, 0.2], [])),
        ("choice", 2, ("choice", None, [0.75, 0.25], 1, None, 0.2, False), (None, None, None, ["choice"])),
        ("choice", 2, ("choice", None, [0.75, 0.25], 1, None, 0.2, True), ("abstained", None, [0.6, 0.2, 0.2], [])),
        ("choice", 2, ("choice", None, [0.75, 0.25], 5, None, 0.2, True), (None, None, None, ["choice"])),
        ("choice", 3, ("choice", None, [0.75, 0.25], 0, None, 0.2, False), (None, None, None, ["keys"])),
        ("choice", 2, ("choice", None, [0.75, 0.35], 0, None, 0.2, False), (None, None, None, ["distribution"])),
        ("ordinal", 3, ("score", None, [0.5, 0.0, 0.5], None, 1.0, 0.0, False), ("answered", 0, [0.5, 0.0, 0.5, 0.0], [])),
        ("ordinal", 3, ("score", None, [0.5, 0.0, 0.5], None, 1.1, 0.0, False), (None, None, None, ["score"])),
        ("ordinal", 1, ("score", None, [float("nan")], None, 0.0, 0.0, False), (None, None, None, ["number", "score"])),
        ("other", 2, ("choice", None, [0.75, 0.25], 0, None, 0.2, False), (None, None, None, ["type"])),
    ],
)
def test_decoded(spark, f, n, r, want):
    x = spark.createDataFrame([(f, n, r)], R).select(T.decoded(F.col("f"), F.col("n"), F.col("r")).alias("x")).first()["x"]
    got = (x["status"], x["value"], None if x["probabilities"] is None else pytest.approx(x["probabilities"]), x["problems"])
    assert got == want
