"""Metrics over rows of predictions. Every function is one or two aggregations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.functions.distributions import ece_bin


def accuracy_by(df: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def classification(df: DataFrame, keys: list[str], gold: str, predicted: str, correct: str = "correct") -> DataFrame:
    """keys, n, accuracy, balanced_accuracy, macro_f1. Classes are the golds that occur; predictions of other classes
    count as errors but have no F1 of their own."""
    by_gold = df.groupBy(*keys, F.col(gold).alias("c")).agg(F.count("*").alias("support"), F.sum(F.col(correct).cast("int")).alias("tp"))
    wrong = df.where(~F.col(correct) & F.col(predicted).isNotNull()).groupBy(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(predicted).alias("pc")).agg(F.count("*").alias("fp"))
    on = F.col("c").eqNullSafe(F.col("pc"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    classes = by_gold.join(wrong, on, "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("support") - F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("support") - F.col("tp"))).otherwise(0.0)
    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.col("tp") / F.col("support")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1")
    )


def macro_scores(df: DataFrame, track: str, family: str, correct: str = "correct", tracks: int = 3) -> DataFrame:
    """level, name, score: 100 x mean of family accuracies per track, and their mean over all if every track is present."""
    per_family = df.groupBy(track, family).agg(F.avg(F.col(correct).cast("double")).alias("a"))
    per_track = per_family.groupBy(F.col(track).cast("string").alias("name")).agg((100 * F.avg("a")).alias("score"))
    overall = per_track.agg(F.lit("overall").alias("level"), F.lit("all").alias("name"), F.when(F.count("*") == tracks, F.avg("score")).alias("score"))
    return per_track.select(F.lit("track").alias("level"), "name", "score").unionAll(overall)


def group_all_correct(df: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    return df.groupBy(group).agg(F.bool_and(correct).alias("all_correct"))


def expected_calibration_error(df: DataFrame, keys: list[str], confidence: str, correct: str, rule: str) -> DataFrame:
    """keys, n, ece."""
    bins = df.withColumn("bin", ece_bin(F.col(confidence), rule)).groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    gap = F.when(F.col("bin").isNotNull(), F.col("m") * F.abs(F.col("acc") - F.col("conf")))
    return bins.groupBy(*keys).agg(F.sum("m").alias("n"), (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("m")).alias("ece"))


def risk_coverage(df: DataFrame, confidence: str, correct: str, answerable: Column | str = "answerable") -> DataFrame:
    """confidence, n, errors, coverage, risk: a step for each distinct confidence, from the highest down. Rows with a null
    confidence aren't ranked; ``answerable`` rows are the denominator.

    Ties are summed first, so what is ordered globally is one row a distinct confidence. The running sums are taken in
    two levels: within 1,024 ranges of confidence, each in a task of its own, and over the ranges' totals."""
    told = df.agg(F.sum(F.col(answerable).cast("long")).alias("all"))
    steps = df.where(F.col(confidence).isNotNull() & F.col(answerable)).groupBy(F.col(confidence).alias("confidence")).agg(F.count("*").alias("m"), F.sum((~F.col(correct)).cast("long")).alias("e"))
    steps = steps.withColumn("range", F.least(F.floor(F.col("confidence") * 1024), F.lit(1023)).cast("int"))
    own = Window.partitionBy("range").orderBy(F.desc("confidence"))
    totals = steps.groupBy("range").agg(F.sum("m").alias("rm"), F.sum("e").alias("re"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most 1,024 rows
    before = totals.select("range", F.coalesce(F.sum("rm").over(above), F.lit(0)).alias("bm"), F.coalesce(F.sum("re").over(above), F.lit(0)).alias("be"))
    ran = steps.select("confidence", "range", "m", F.sum("m").over(own).alias("om"), F.sum("e").over(own).alias("oe"))
    joined = ran.join(F.broadcast(before), "range").join(F.broadcast(told))  # 1,024 rows, and one
    n, errors = F.col("om") + F.col("bm"), F.col("oe") + F.col("be")
    return joined.select("confidence", F.col("m").alias("tied"), n.alias("n"), errors.alias("errors"), (n / F.col("all")).alias("coverage"), (errors / n).alias("risk"), F.col("all").alias("answerable"))


def aurc(curve: DataFrame) -> DataFrame:
    """partial_aurc, coverage, aurc (null unless every answerable row is ranked)."""
    part = F.sum(F.col("risk") * F.col("tied") / F.col("answerable"))
    return curve.agg(part.alias("partial_aurc"), F.max("coverage").alias("coverage"), F.when(F.max("n") == F.max("answerable"), part).alias("aurc"))


def auto_accept(df: DataFrame, keys: list[str], confidence: str, correct: str, unknown: str, threshold: float) -> DataFrame:
    """Share and precision of rows at or above a threshold whose prediction isn't unknown."""
    taken = (F.col(confidence) >= threshold) & ~F.col(unknown)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(taken.cast("long")).alias("accepted"), F.avg(taken.cast("double")).alias("coverage"), F.avg(F.when(taken, F.col(correct).cast("double"))).alias("precision")
    )


def efficiency(df: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """Linear-interpolated and nearest-rank quantiles, sum and mean; null throughout where any row lacks its value."""
    whole = F.count(latency) == F.count("*")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(whole, F.percentile(latency, 0.5)).alias("p50"),
        F.when(whole, F.percentile(latency, 0.95)).alias("p95"),
        F.when(whole, F.expr(f"percentile_disc(0.95) within group (order by {latency})")).alias("p95_nearest"),
        F.when(whole, F.sum(latency)).alias("total"),
    )
