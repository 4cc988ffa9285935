"""Validation, cascades, audits and gates. A rule is a named condition; a report is a union of small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def problems(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds; conditions that are null don't hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


def first_failing(*rules: tuple[str, Column]) -> Column:
    """The first rule whose condition holds, or ``kept``."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules], F.lit("kept"))


def cascade(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """step, rule, dropped, left: rows that each rule takes of what the rules before it left."""
    names = [n for n, _ in rules]
    counted = df.groupBy(first_failing(*rules).alias("rule")).agg(F.count("*").alias("dropped"))
    steps = reduce(DataFrame.unionAll, [df.sparkSession.range(1).select(F.lit(i + 1).alias("step"), F.lit(n).alias("rule")) for i, n in enumerate(names)])
    joined = steps.join(F.broadcast(counted), "rule", "left").select("step", "rule", F.coalesce("dropped", F.lit(0)).alias("dropped"))
    total = df.agg(F.count("*").alias("all"))
    gone = F.sum("dropped").over(Window.orderBy("step"))  # a row a rule
    return joined.join(F.broadcast(total)).select("step", "rule", "dropped", (F.col("all") - gone).alias("left"))


def spans_several(df: DataFrame, key: str, within: str) -> DataFrame:
    """key, values: keys that occur under more than one value of ``within``, such as an image in two splits."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(within).alias("values")).where("values > 1")


def majority_baseline(df: DataFrame, family: str, gold: str) -> DataFrame:
    counts = df.where(F.col(gold).isNotNull()).groupBy(family, gold).agg(F.count("*").alias("c"))
    return counts.groupBy(family).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("baseline"))


def status(value: Column, warn: float, fail: float | None = None) -> Column:
    s = F.when(value > fail, "fail") if fail is not None else None
    return (s.when(value > warn, "warn") if s is not None else F.when(value > warn, "warn")).otherwise("pass")


def cue_gap(df: DataFrame, cue: Column, hit: Column) -> DataFrame:
    """with_cue, without_cue, gap, status: the rate of ``hit`` among rows with a cue and without."""
    a, b = F.avg(F.when(cue, hit.cast("double"))), F.avg(F.when(~cue, hit.cast("double")))
    return df.agg(a.alias("with_cue"), b.alias("without_cue")).withColumn("gap", F.abs(F.col("with_cue") - F.col("without_cue"))).withColumn("status", status(F.col("gap"), 0.10, 0.25))


def share_in_band(df: DataFrame, condition: Column, low: float, high: float) -> DataFrame:
    out = df.agg(F.count("*").alias("n"), F.avg(condition.cast("double")).alias("share"))
    return out.withColumn("status", F.when((F.col("share") >= low) & (F.col("share") <= high), "pass").otherwise("warn"))


def gates(rows: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """gate, passed, detail from one-row tables: (name, table, condition, detail)."""
    return reduce(DataFrame.unionAll, [t.select(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed"), d.cast("string").alias("detail")) for n, t, c, d in rows])


def poststratified(df: DataFrame, task: str, correct: str, full_counts: DataFrame, count: str) -> DataFrame:
    """primary, macro, poststratified: accuracy over rows, over tasks, and over tasks weighted by their full size."""
    per = df.groupBy(task).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("k")).join(F.broadcast(full_counts), task)
    a = F.col("k") / F.col("n")
    return per.agg((F.sum("k") / F.sum("n")).alias("primary"), F.avg(a).alias("macro"), (F.sum(a * F.col(count)) / F.sum(count)).alias("poststratified"))


def mixture_statistics(df: DataFrame, source: str, decisions: Column, gold: str) -> DataFrame:
    """source, rows, decisions, unknown_share."""
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.sum(decisions).alias("decisions"), F.avg(F.col(gold).isNull().cast("double")).alias("unknown_share"))


def unknown_mass(df: DataFrame, keys: list[str], p_unknown: str, gold: str) -> DataFrame:
    """keys, n, mean mass on unknown where the gold is known and where it isn't, and the share of known rows with most mass on it."""
    known = F.col(gold).isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(known, F.col(p_unknown))).alias("mass_known"), F.avg(F.when(~known, F.col(p_unknown))).alias("mass_unknown"), F.avg(F.when(known, (F.col(p_unknown) > 0.5).cast("double"))).alias("over_half")
    )


def pilot(df: DataFrame, source: str, status: str, kept: str, cost: str) -> DataFrame:
    """source, n, parse_error, truncated, keep_rate, cost_per_kept; the cost is null where nothing was kept."""
    share = lambda v: F.avg((F.col(status) == v).cast("double"))
    return df.groupBy(source).agg(
        F.count("*").alias("n"), share("parse_error").alias("parse_error"), share("truncated").alias("truncated"), F.avg(F.col(kept).cast("double")).alias("keep_rate"), F.try_divide(F.sum(cost), F.count_if(F.col(kept))).alias("cost_per_kept")
    )


def reviewer_comparison(df: DataFrame, id: str, reviewer: str, value: str, truth: str, reviewers: list[str]) -> DataFrame:
    """id, one column a reviewer, all_match: whether every reviewer gave the constructed truth; a missing review doesn't match."""
    wide = df.groupBy(id).agg(F.max(truth).alias("__t"), *[F.max(F.when(F.col(reviewer) == r, F.col(value))).alias(r) for r in reviewers])
    return wide.select(id, *reviewers, F.coalesce(F.forall(F.array(*reviewers), lambda x: x.eqNullSafe(F.col("__t"))), F.lit(False)).alias("all_match"))


def share_capped(df: DataFrame, id: str, condition: Column, keep_of_100: int, salt: str) -> DataFrame:
    """Rows that meet a condition are kept only for a share of the ids, by hash; the others all stay."""
    from verdigris.functions.hashing import percent

    return df.where(~F.coalesce(condition, F.lit(False)) | (percent(salt, F.col(id)) < keep_of_100))
