"""Temperatures per bucket: fitted, chosen from a grid, and applied."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verdigris.functions.distributions import argmax, nll, softmax, with_unknown_offset

#: The range of log-temperatures and the least probability whose logarithm is taken.
LOW, HIGH, FLOOR = math.log(0.01), math.log(100.0), 1e-300


def _losses(z: np.ndarray, target: np.ndarray, log_t: float) -> np.ndarray:
    s = z / math.exp(log_t)
    s = s - s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p = p[np.arange(len(p)), target] / p.sum(axis=1)
    return -np.log(np.maximum(p, FLOOR))


def best_temperature(z: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> float:
    """The temperature of least mean loss of one table in memory, within the range of ``fit_temperatures``.

    The loss is convex in the inverse temperature b: its slope is the mean of the expected logit under softmax(b z) less the target's logit. So
    the range of log b is halved by the sign of the slope until it is narrower than ``tolerance``. 1 is kept where nothing is better."""
    own = z[np.arange(len(z)), target]

    def slope(b: float) -> float:
        p = np.exp(b * (z - z.max(axis=1, keepdims=True)))
        return float(((p * z).sum(axis=1) / p.sum(axis=1) - own).mean())

    below, above = -HIGH, -LOW
    while above - below > tolerance:
        mid = (below + above) / 2
        below, above = (below, mid) if slope(math.exp(mid)) > 0 else (mid, above)
    found = -(below + above) / 2
    return math.exp(found) if _losses(z, target, found).mean() < _losses(z, target, 0.0).mean() else 1.0


def fit_temperatures(df: DataFrame, key: str, logits: str, target: str, points: int = 32, rounds: int = 7) -> DataFrame:
    """key, n, temperature of least mean loss over all rows of each key; 1 is kept where the search finds nothing better.

    Each round sums the losses at evenly spaced log-temperatures and goes on between the neighbours of the best, which narrows a key's
    range to 2 / ``points``. Equal rows are counted once with their weight; sums are partial before they move. A key's rows may have
    logits of any number. Rows without logits, with a null or non-finite one, or whose target is null or no place among them take no
    part; a null key is a key; a key without usable rows has none in the result."""
    from verdigris.session import ship_package
    from verdigris.storage import discard, materialise

    ship_package(df.sparkSession)
    z, y = F.transform(F.col(logits), lambda x: x.cast("double")), F.col(target).cast("int")
    usable = (y >= 0) & (y < F.size(z)) & F.forall(z, lambda x: F.coalesce(x * 0 == 0, F.lit(False)))
    labelled = df.where(usable).select(F.col(key).alias("key"), F.to_json(F.struct(F.col(key).alias("k"))).alias("at"), z.alias("z"), y.alias("y"))
    rows = materialise(labelled.groupBy("key", "at", "z", "y").agg(F.count("*").alias("w")), "weighted")
    counted = rows.groupBy("at").agg(F.first("key").alias("key"), F.sum("w").alias("n"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for (k, _), group in batch.groupby(["at", batch.z.map(len)], sort=False):
                z, y, w = np.array(group.z.tolist(), dtype=np.float64), group.y.to_numpy(), group.w.to_numpy()
                a, b = group.a.iloc[0], group.b.iloc[0]
                # -1 is temperature 1, which wins ties
                for i in range(-1, points + 1):
                    sums.append((k, i, _losses(z, y, a + (b - a) * i / points if i >= 0 else 0.0) @ w))
            yield pd.DataFrame(sums, columns=["at", "i", "total"])

    at = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / points
    bounds = counted.select("at", F.lit(LOW).alias("a"), F.lit(HIGH).alias("b"))
    for _ in range(rounds):
        losses = rows.select("at", "z", "y", "w").join(bounds.select("at", "a", "b"), "at").mapInPandas(partial, "at string, i int, total double").groupBy("at", "i").agg(F.sum("total").alias("total"))
        best = losses.groupBy("at").agg(F.min_by("i", F.struct(F.when(F.col("i") >= 0, F.col("total")).otherwise(float("inf")), "i")).alias("i"), F.min_by("i", F.struct("total", "i")).alias("any"))
        following = materialise(bounds.join(best, "at").select("at", at(F.greatest(F.col("i") - 1, F.lit(0))).alias("a"), at(F.least(F.col("i") + 1, F.lit(points))).alias("b"), F.when(F.col("any") < 0, 0.0).otherwise(at(F.col("i"))).alias("t")), "bounds")
        discard(bounds)
        bounds = following
    return counted.join(bounds, "at").select(F.col("key").alias(key), "n", F.exp("t").alias("temperature"))


def fit_by_type(df: DataFrame, key: str, logits: str, target: str, least: int = 50, lowest: float = 1.0) -> DataFrame:
    """key, n, pooled, temperature: each key's own fit where it has ``least`` usable rows, else that of all rows together, whose
    logits may differ in number; never below ``lowest``."""
    own = fit_temperatures(df, key, logits, target)
    whole = fit_temperatures(df.withColumn("__all", F.lit("all")), "__all", logits, target).select(F.col("temperature").alias("__t"))
    pooled = F.col("n") < least
    joined = own.join(F.broadcast(whole), F.lit(True))  # one row
    return joined.select(key, "n", pooled.alias("pooled"), F.greatest(F.lit(lowest), F.when(pooled, F.col("__t")).otherwise(F.col("temperature"))).alias("temperature"))


def grid_temperatures(df: DataFrame, key: str, logits: str, target: str, grid: list[float], offsets: list[float] | None = None) -> DataFrame:
    """key, temperature, unknown_offset, loss: the grid point of least mean loss, native. A row is read once; the grid is an array per row that
    explodes to sums by (key, point), which are partial before they move. A later offset must win by 1e-9."""
    points = [(t, o) for o in (offsets or [0.0]) for t in grid]
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(o).alias("o")) for i, (t, o) in enumerate(points)])
    rows = df.where(F.col(target).isNotNull()).select(F.col(key).alias("key"), F.col(logits).alias("z"), F.col(target).cast("int").alias("y"), F.explode(at).alias("x"))
    p = F.get(softmax(with_unknown_offset(F.col("z"), F.col("x.o")), F.col("x.t")), F.col("y"))
    losses = rows.select("key", "x", nll(p).alias("l")).groupBy("key", "x").agg(F.avg("l").alias("loss"))
    best = losses.groupBy("key").agg(F.min_by(F.struct("x.t", "x.o", "loss"), F.struct(F.round("loss", 9), "x.i")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.t").alias("temperature"), F.col("b.o").alias("unknown_offset"), "b.loss")


def apply_temperatures(df: DataFrame, table: DataFrame, key: str, logits: str) -> DataFrame:
    """``df`` with p (probabilities) and pred; keys that the table lacks keep temperature 1. The argmax can only move where an
    offset applies. ``table``: key, temperature and perhaps unknown_offset; a row a bucket."""
    offset = F.coalesce("__o", F.lit(0.0))
    small = table.select(F.col(key), F.col("temperature").alias("__t"), (F.col("unknown_offset") if "unknown_offset" in table.columns else F.lit(0.0)).alias("__o"))
    joined = df.join(F.broadcast(small), key, "left")
    p = softmax(with_unknown_offset(F.col(logits), offset), F.coalesce("__t", F.lit(1.0)))
    return joined.withColumn("p", p).withColumn("pred", F.when(offset == 0, argmax(F.col(logits))).otherwise(argmax(F.col("p")))).drop("__t", "__o")


def choose_calibration(public: DataFrame, per_type: DataFrame | None, authored: float | None, key: str, logits: str, target: str, rule: str = "closed_right_10", most_ece: float = 0.03) -> DataFrame:
    """key, temperature, source, pooled_ece: which of two fits ships. ``per_type`` (key, temperature) does if, applied to the public rows, it
    leaves their pooled ECE at ``most_ece`` or below; else the one temperature of the authored rows does, for every key; without
    that, ``per_type`` again. The sources are ``per_type``, ``authored`` and ``none``: with neither fit, the public rows' keys at temperature 1."""
    from verdigris.operators.metrics import expected_calibration_error

    if per_type is None:
        keys = public.select(key).distinct()
        source, t = ("none", 1.0) if authored is None else ("authored", authored)
        return keys.select(key, F.lit(t).cast("double").alias("temperature"), F.lit(source).alias("source"), F.lit(None).cast("double").alias("pooled_ece"))
    shown = apply_temperatures(public, per_type, key, logits)
    judged = expected_calibration_error(shown.select(F.array_max("p").alias("conf"), (F.col("pred") == F.col(target)).alias("correct")), [], "conf", "correct", rule)
    kept = F.lit(True) if authored is None else F.coalesce(F.col("ece") <= most_ece, F.lit(False))
    told = per_type.select(key, "temperature").join(F.broadcast(judged.select("ece")))  # one row
    return told.select(key, F.when(kept, F.col("temperature")).otherwise(F.lit(authored)).alias("temperature"), F.when(kept, "per_type").otherwise("authored").alias("source"), F.col("ece").alias("pooled_ece"))


def average_orders(df: DataFrame, id: str, log_probabilities: Column, realign: Column) -> DataFrame:
    """id, p: mean log-probability of each candidate over the rows of an id, each read back to candidate order, then softmax."""
    at = df.select(id, F.posexplode(F.transform(realign, lambda i: F.get(log_probabilities, i))).alias("candidate", "lp"))
    means = at.groupBy(id, "candidate").agg(F.avg("lp").alias("lp"))
    listed = means.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate", "lp"))), lambda x: x["lp"]).alias("lp"))
    return listed.select(id, softmax(F.col("lp")).alias("p"))
