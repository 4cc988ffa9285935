"""Cluster-aware statistics. Rows are first summed by cluster; only clusters are resampled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FEWEST_CLUSTERS = 10


def cluster_sums(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("k"))


def cluster_accuracy(df: DataFrame, cluster: str, correct: str) -> DataFrame:
    c = cluster_sums(df, cluster, correct)
    return c.agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("accuracy"))


#: The modulus of the hash from which a unit's weights come, and where a Poisson variable of mean 1 passes 1, 2, 3, ...
#: when that hash, uniform below the modulus, is read as a probability. Beyond 12 lies less than one step of the hash.
MODULUS = 2**31 - 1
PASSES = [math.ceil(MODULUS * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k))) for k in range(1, 13)]
#: Units whose weights are drawn at once in a task.
UNIT_ROWS = 256


def resampled(units: DataFrame, unit: str, sums: list[str], replicates: int, seed: str) -> DataFrame:
    """replicate (from 1) and, by name, the weighted sums of ``units``, a table of one row a unit with columns to be summed.

    A unit's weight in a replicate is a Poisson variable of mean 1, so that units are drawn independently of each other and of
    where they lie. It is read off ``(a * replicate + b) mod MODULUS``, with a and b from the unit's SHA-256: the weights
    of two units are independent, those of two replicates pairwise. A task adds up one array of all replicates for each sum and sends
    nothing else, so neither rows nor the shuffle grow with units times replicates. Null sums count as 0; a null unit is a unit."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(unit).cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring("__h", i, 8), 16, 10).cast("long") % F.lit(MODULUS)
    hashed = units.withColumn("__h", digest).select(part(1).alias("a"), part(9).alias("b"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(sums)])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((len(sums), replicates)), np.arange(1, replicates + 1)
        for batch in batches:
            a, b, *values = (c.to_numpy() for c in batch.columns)
            for i in range(0, len(a), UNIT_ROWS):
                own = slice(i, i + UNIT_ROWS)
                weight = np.searchsorted(PASSES, (a[own, None] * at + b[own, None]) % MODULUS, side="right")
                total += np.array([v[own] for v in values]) @ weight
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(len(sums))])

    arrays = hashed.mapInArrow(weighed, ", ".join(f"s{i} array<double>" for i in range(len(sums))))
    zipped = arrays.select(F.posexplode(F.arrays_zip(*arrays.columns)).alias("i", "x"))
    return zipped.groupBy((F.col("i") + 1).alias("replicate")).agg(*[F.sum(f"x.s{i}").alias(c) for i, c in enumerate(sums)])


def cluster_bootstrap(df: DataFrame, cluster: str, correct: str, replicates: int = 4000, seed: str = "bootstrap") -> DataFrame:
    """clusters, accuracy, low, high: percentile interval of the accuracy over resampled clusters. Fewer than ten clusters
    give no interval. Draws come from hashes, so every run has the same."""
    clusters = cluster_sums(df, cluster, correct)
    size = clusters.agg(F.count("*").alias("clusters"), (F.sum("k") / F.sum("n")).alias("accuracy"))
    means = resampled(clusters, "cluster", ["n", "k"], replicates, seed).select(F.try_divide("k", "n").alias("mean"))
    bounds = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    enough = F.col("clusters") >= FEWEST_CLUSTERS
    return size.join(F.broadcast(bounds)).select("clusters", "accuracy", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def _refused(out: Column, *cases: tuple[Column, str]) -> Column:
    """``out``, unless one of the conditions holds, which then fails the query with its words."""
    for condition, words in cases:
        out = F.when(condition, F.raise_error(F.lit(words)).cast("double")).otherwise(out)
    return out


def _interval(means: DataFrame, column: str) -> DataFrame:
    """low, high: the replicates at 2.5 and 97.5 % of their order, the lower of two neighbours."""
    ordered = F.sort_array(F.collect_list(column))  # a number a replicate
    at = lambda q: F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(q) * F.size(ordered))).cast("int"))
    return means.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def paired_family_bootstrap(left: DataFrame, right: DataFrame, id: str, family: str, correct: str, replicates: int = 10_000, seed: str = "families") -> DataFrame:
    """delta (accuracy of ``right`` less that of ``left``), low, high, families: the interval resamples whole families.

    Both must hold the same ids once each, and an id the same family in both; anything else fails the query when it runs."""
    side = lambda df, n: df.select(F.col(id).alias("id"), F.col(family).cast("string").alias(f"f{n}"), F.col(correct).cast("double").alias(f"c{n}"), F.lit(1).alias(f"there{n}"))
    both = side(left, 0).join(side(right, 1), "id", "full")
    per = both.groupBy("f0").agg(
        F.count("*").alias("n"), F.sum(F.col("c1") - F.col("c0")).alias("d"), F.count_distinct("id").alias("ids"),
        F.count_if(F.col("there0").isNull() | F.col("there1").isNull()).alias("alone"), F.count_if(~F.col("f0").eqNullSafe(F.col("f1"))).alias("moved"),
    )
    told = per.agg((F.sum("d") / F.sum("n")).alias("delta"), F.count("*").alias("families"), F.sum("alone").alias("alone"), F.sum("moved").alias("moved"), F.sum(F.col("n") - F.col("ids")).alias("twice"))
    bounds = _interval(resampled(per, "f0", ["n", "d"], replicates, seed).select(F.try_divide("d", "n").alias("m")), "m")
    checked = _refused(F.col("delta"), (F.col("moved") > 0, "paired rows must have matching families"), ((F.col("alone") > 0) | (F.col("twice") > 0), "a paired bootstrap needs the same ids once each on both sides"))
    return told.join(F.broadcast(bounds)).select(checked.alias("delta"), "low", "high", "families")


def paired_irrelevance_delta(df: DataFrame, id: str, pair: str, variant: str, correct: str, partition: str, replicates: int = 10_000, seed: str = "pairs") -> DataFrame:
    """irrelevant_image_delta, low, high, pairs, text_only_accuracy, irrelevant_image_accuracy over complete pairs of controls.

    Each pair has one row of variant ``text_only`` and one of ``irrelevant_image``, all ids differ, all rows are of partition ``test`` and
    say whether they are correct; anything else fails the query when it runs."""
    is_ = lambda v: F.col(variant) == v
    right = F.col(correct).cast("double")
    per = df.groupBy(F.col(pair).alias("pair")).agg(
        F.count("*").alias("rows"), F.count_if(is_("text_only")).alias("t"), F.count_if(is_("irrelevant_image")).alias("i"), F.count_if(F.col(correct).isNull() | (~F.col(partition).eqNullSafe(F.lit("test")))).alias("bad"),
        F.sum(F.when(is_("text_only"), right)).alias("text"), F.sum(F.when(is_("irrelevant_image"), right)).alias("image"),
    ).withColumns({"n": F.lit(1), "d": F.col("image") - F.col("text")})
    told = per.agg(
        F.avg("d").alias("delta"), F.count("*").alias("pairs"), F.avg("text").alias("text"), F.avg("image").alias("image"), F.sum("bad").alias("bad"),
        F.count_if((F.col("t") != 1) | (F.col("i") != 1) | (F.col("rows") != 2) | F.coalesce(F.col("pair").cast("string") == "", F.lit(True))).alias("odd"),
    )
    ids = df.groupBy(id).agg(F.count("*").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0)).alias("most"))
    bounds = _interval(resampled(per, "pair", ["n", "d"], replicates, seed).select(F.try_divide("d", "n").alias("m")), "m")
    checked = _refused(F.col("delta"), (F.col("bad") > 0, "every control row is of partition test and says whether it is correct"), (F.col("odd") > 0, "every pair needs one text_only and one irrelevant_image row"), (F.col("most") > 1, "control ids must differ"))
    return told.join(F.broadcast(bounds)).join(F.broadcast(ids)).select(checked.alias("irrelevant_image_delta"), "low", "high", "pairs", F.col("text").alias("text_only_accuracy"), F.col("image").alias("irrelevant_image_accuracy"))


def paired_comparison(df: DataFrame, cluster: str, a: str, b: str, exact_most: int = 16, samples: int = 10_000, replicates: int = 4000, seed: str = "paired") -> DataFrame:
    """difference (accuracy of a less b), records, clusters, discordant_clusters, a_only_correct, b_only_correct, p_value, low, high:
    ``paired_signflip`` with the counts of one-sided rows and an interval over resampled clusters, null below ten of them."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(x.cast("int") - y.cast("int")).alias("d"), F.count_if(x & ~y).alias("a"), F.count_if(~x & y).alias("b"))
    counts = per.agg(F.sum("n").alias("records"), F.sum("a").alias("a_only_correct"), F.sum("b").alias("b_only_correct"))
    bounds = resampled(per, "cluster", ["n", "d"], replicates, seed).select(F.try_divide("d", "n").alias("m")).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    test = paired_signflip(df, cluster, a, b, exact_most, samples)
    enough = F.col("clusters") >= FEWEST_CLUSTERS
    joined = test.join(F.broadcast(counts)).join(F.broadcast(bounds))
    return joined.select("difference", "records", "clusters", F.col("discordant").alias("discordant_clusters"), "a_only_correct", "b_only_correct", "p_value", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def paired_signflip(df: DataFrame, cluster: str, a: str, b: str, exact_most: int = 16, samples: int = 10_000, seed: str = "signflip") -> DataFrame:
    """clusters, discordant, difference, p_value of the paired test that flips the sign of each cluster's difference.

    Exact over all sign vectors for up to ``exact_most`` clusters that differ, else (extreme + 1) / (samples + 1) over
    hashed flips. The exact branch sees at most that many rows; the sampled one groups by sample."""
    d = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    told = d.agg(F.count("*").alias("clusters"), F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).alias("discordant"), (F.sum("d") / F.sum("n")).alias("difference"), F.abs(F.sum("d")).alias("observed"))
    moved = d.where("d <> 0").join(F.broadcast(told.select("discordant", "observed")))
    few = moved.where(F.col("discordant") <= exact_most).withColumn("bit", F.row_number().over(Window.partitionBy("discordant").orderBy("cluster")) - 1)
    signs = few.select("d", "bit", "observed", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(discordant as int)) - 1"))).alias("s"))
    flip = F.when(F.expr("shiftright(s, bit) & 1") == 1, -F.col("d")).otherwise(F.col("d"))
    exact = signs.groupBy("s").agg(F.abs(F.sum(flip)).alias("t"), F.first("observed").alias("observed")).agg(F.avg((F.col("t") >= F.col("observed") - 1e-12).cast("double")).alias("p"))
    many = moved.where(F.col("discordant") > exact_most).select("cluster", "d", "observed", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s"))
    coin = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("s").cast("string"), F.col("cluster").cast("string")), 256), 1, 1), 16, 10).cast("int") % 2
    sampled = many.groupBy("s").agg(F.abs(F.sum(F.when(coin == 1, -F.col("d")).otherwise(F.col("d")))).alias("t"), F.first("observed").alias("observed"))
    sampled = sampled.agg(((F.sum((F.col("t") >= F.col("observed") - 1e-12).cast("long")) + 1) / (samples + 1)).alias("q"))
    return told.join(F.broadcast(exact)).join(F.broadcast(sampled)).select("clusters", "discordant", "difference", F.when(F.col("discordant") == 0, 1.0).otherwise(F.coalesce("p", "q")).alias("p_value"))


def intraclass_correlation(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way ANOVA estimate, floored at 0; null with fewer than two clusters, no repeats, or no spread."""
    v = F.col(value).cast("double")
    c = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = c.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("w"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    between, within = (F.col("w") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), (F.col("q") - F.col("w")) / (F.col("n") - F.col("k"))
    m0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("k") - 1)
    t = t.where("true").select("k", "n", F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), F.struct(between.alias("b"), within.alias("w"), m0.alias("m"))).alias("x"))
    spread = F.col("x.b") + (F.col("x.m") - 1) * F.col("x.w")
    return t.select(F.col("k").alias("clusters"), "n", F.when(spread > 0, F.greatest(F.lit(0.0), (F.col("x.b") - F.col("x.w")) / spread)).alias("icc"))


def kappa(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """n, agreement, kappa of two raters; 1 where chance agreement is 1."""
    keys = keys or []
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = both.groupBy(*keys, "a", "b").agg(F.count("*").alias("m"))
    n = cells.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("m").alias("ra")), cells.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("m").alias("rb"))
    chance = left.join(right, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("ra") * F.col("rb")).alias("x"))
    joined = n.join(chance, keys, "left") if keys else n.join(F.broadcast(chance))
    pe, po = F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return joined.select(*keys, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def wilson_upper(errors: Column, n: Column, z: float = 1.959964) -> Column:
    """Upper Wilson bound of an error rate; null for no rows."""
    p = errors / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) + half) / (1 + z * z / n))


def required_clusters(delta: float, discordance: float, icc: float, mean_size: float, power: float = 0.8, alpha: float = 0.05) -> tuple[int, int]:
    """(items, clusters) that a paired comparison needs to see a difference ``delta``, with the design effect of clusters."""
    normal = NormalDist()
    z = normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power)
    items = z * z * (discordance - delta * delta) / (delta * delta) * (1 + (mean_size - 1) * icc)
    return math.ceil(items), math.ceil(items / mean_size)
