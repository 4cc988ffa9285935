"""Agreement, keep rules and the merging of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_rule(agree: Column, p_best: Column, is_unknown: Column) -> Column:
    """``kept`` or the reason against: all orders agree, and p >= .6, or p >= .5 for unknown."""
    return F.when(~agree, "orders_disagree").when(is_unknown & (p_best >= 0.5), "kept").when(~is_unknown & (p_best >= 0.6), "kept").otherwise("low_confidence")


def consensus(df: DataFrame, id: str, provider: str, value: str) -> DataFrame:
    """id, providers, consensus: the value that at least two providers share, if they all do."""
    g = df.groupBy(id).agg(F.count_distinct(provider).alias("providers"), F.count_distinct(value).alias("values"), F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("v"))
    return g.select(id, "providers", F.when((F.col("providers") >= 2) & (F.col("values") == 1) & (F.col("missing") == 0), F.col("v")).alias("consensus"))


def agreement(df: DataFrame, id: str, value: str, parsed: str, unknown: str, hedged: str) -> DataFrame:
    """id, strict, relaxed. Strict: every answer parsed and equal. Relaxed: one says unknown and none gives an unhedged value."""
    return df.groupBy(id).agg(
        (F.bool_and(parsed) & (F.count_distinct(value) == 1)).alias("strict"),
        (F.bool_or(F.col(value) == F.col(unknown)) & ~F.bool_or((F.col(value) != F.col(unknown)) & ~F.col(hedged))).alias("relaxed"),
    )


def teacher_keep(df: DataFrame, id: str = "id") -> DataFrame:
    """id, keep, reason from solve rows (id, source, gold_kind, gold, ok, pred, p_unknown, unknown_variant).

    Unknown variants need more than half of the mass on unknown in every solve. Constructed gold needs one solve that
    matches; of source A a mismatch is kept for review. All others need two solves that agree, and match the gold if there is one."""
    g = df.where("ok").groupBy(id, "source", "gold_kind", "gold", "unknown_variant").agg(
        F.count("*").alias("n"), F.bool_or(F.col("pred").eqNullSafe(F.col("gold"))).alias("hit"), F.count_distinct("pred").alias("kinds"), F.min("pred").alias("one"), F.min("p_unknown").alias("least_unknown")
    )
    reason = (
        F.when(F.col("unknown_variant"), F.when(F.col("least_unknown") > 0.5, "kept").otherwise("not_unknown"))
        .when(F.col("gold_kind") == "constructed", F.when(F.col("hit"), "kept").when(F.col("source") == "A", "review_first").otherwise("mismatch"))
        .when(F.col("n") < 2, "one_solve")
        .when(F.col("kinds") > 1, "solves_disagree")
        .when(F.col("gold").isNotNull() & (F.col("one") != F.col("gold")), "mismatch")
        .otherwise("kept")
    )
    out = df.select(id).distinct().join(g.select(id, reason.alias("reason")), id, "left").withColumn("reason", F.coalesce("reason", F.lit("no_solve")))
    return out.select(id, F.col("reason").isin("kept", "review_first").alias("keep"), "reason")


def merge_solves(df: DataFrame, id: str, distribution: str) -> DataFrame:
    """id, label, p: the mean of the rows' maps of label to probability, made to sum to 1."""
    flat = df.select(id, F.explode(distribution).alias("label", "v"))
    sums = flat.groupBy(id, "label").agg(F.sum("v").alias("s"))
    all_ = sums.groupBy(id).agg(F.sum("s").alias("t"))
    return sums.join(all_, id).select(id, "label", (F.col("s") / F.col("t")).alias("p"))


def mining_flags(gold: Column, pred: Column, p_gold: Column, p_pred: Column, rotated: Column, order_checked: Column, low: float = 0.6) -> tuple[Column, Column]:
    """(flags, priority) of a scored row; unflagged rows have an empty list and priority 0."""
    wrong, low_conf = gold.isNotNull() & (pred != gold), gold.isNotNull() & (pred == gold) & (p_gold < low)
    unsure, flip = gold.isNull() & (p_pred < low), order_checked & (rotated != pred)
    flags = F.array_compact(F.array(F.when(wrong, "wrong"), F.when(low_conf, "low_conf"), F.when(unsure, "unsure"), F.when(flip, "order_flip")))
    priority = F.when(wrong, 2 + p_pred).when(low_conf, 1 + (low - p_gold)).when(flip, 0.5).when(unsure, 0.25 + (low - p_pred) / 4).otherwise(0.0)
    return flags, priority


def merge_reviews(reviews: DataFrame, required: int = 2) -> DataFrame:
    """id, state, value from (id, reviewer, value, seq, adjudicated): ``adjudicated``, ``agreed`` (enough reviewers, one value),
    ``escalated`` (they differ) or ``pending``. A reviewer's last word counts."""
    last = reviews.groupBy("id", "reviewer").agg(F.max_by(F.struct("value", "adjudicated"), "seq").alias("r"))
    g = last.groupBy("id").agg(
        F.count("*").alias("n"), F.count_distinct("r.value").alias("kinds"), F.min("r.value").alias("v"), F.max(F.when(F.col("r.adjudicated"), F.col("r.value"))).alias("final")
    )
    state = F.when(F.col("final").isNotNull(), "adjudicated").when(F.col("n") < required, "pending").when(F.col("kinds") == 1, "agreed").otherwise("escalated")
    return g.select("id", state.alias("state"), F.when(state == "adjudicated", F.col("final")).when(state == "agreed", F.col("v")).alias("value"))
