"""Held-out selection, repair of partitions, audits of clusters, mixtures and batch plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.functions.hashing import stable_order
from verdigris.operators.sampling import take_per_stratum
from verdigris.storage import materialise


def resolve_held_out(groups: DataFrame, links: DataFrame, targets: dict[str, int], max_links: int, salt: str = "held-out") -> DataFrame:
    """(group, state): whole groups to hold out, by family. ``groups``: (group, family, rows), one row a group; ``links``: (a, b), either way round.

    A group costs the rows of the other groups that are linked to it. Per family, groups go in order of (cost, salted hash) until the family's
    target of rows is met, so a family is beyond it by less than its last group; groups that cost more than ``max_links`` are never
    held out, and families without a target hold nothing out. Groups linked to a held-out one are ``removed`` unless they are held out themselves; the rest is
    ``kept``, without a link to any held-out group: one pass settles it, as a held-out group is never given up."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    cost = both.join(groups.select(F.col("group").alias("b"), "rows"), "b").groupBy(F.col("a").alias("group")).agg(F.sum("rows").alias("cost"))
    wanted = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]) if targets else F.create_map().cast("map<string,int>")
    priced = groups.join(cost, "group", "left").select("group", "family", "rows", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce(F.try_element_at(wanted, F.col("family")), F.lit(0)).alias("want")).where(F.col("cost") <= max_links)
    order = [F.col("cost"), stable_order(F.lit(salt), F.col("group"))]
    # a group has a row at least, so no more groups than rows are wanted can matter; the limit is applied before the exchange
    first = priced.withColumn("at", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where(F.col("at") <= max([1, *targets.values()]))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("family").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = materialise(first.withColumn("before", before).where("before < want").select("group"), "held")
    touched = both.join(held.select(F.col("group").alias("a")), "a", "left_semi").select(F.col("b").alias("group")).distinct()
    state = F.when(F.col("h").isNotNull(), "held_out").when(F.col("r").isNotNull(), "removed").otherwise("kept")
    joined = groups.join(held.withColumn("h", F.lit(1)), "group", "left").join(touched.withColumn("r", F.lit(1)), "group", "left")
    return joined.select("group", state.alias("state"))


def take_by_cost(df: DataFrame, stratum: str, n: str, cost: list[Column]) -> DataFrame:
    """The first rows of each stratum in order of cost, as many as its column ``n`` says (the same in all rows of a stratum)."""
    most = df.agg(F.max(n)).first()[0] or 0
    ranked = df.withColumn("__at", F.row_number().over(Window.partitionBy(stratum).orderBy(*cost))).where(F.col("__at") <= int(most))
    return ranked.where(F.col("__at") <= F.col(n)).drop("__at")


def extract_flagged(df: DataFrame, id: str, flagged: Column, bucket: str, most: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """(extracted, exclusions): of the flagged rows, the first ``most`` of each bucket by salted hash, and the ids that training must leave out: all flagged ones."""
    rows = df.where(F.coalesce(flagged, F.lit(False)))
    kept = rows.withColumn("__at", F.row_number().over(Window.partitionBy(bucket).orderBy(stable_order(F.lit(salt), F.col(id))))).where(F.col("__at") <= most)
    return kept.drop("__at"), rows.select(id).distinct()


def replay_manifest(new: DataFrame, old: DataFrame, held: DataFrame, id: str, replay: float, salt: str) -> DataFrame:
    """(id, origin): all new rows and a share ``replay`` of as many old ones, by salted hash. Ids of ``held`` fail the job; old rows that are new ones again are not replayed."""
    rows = new.select(id, F.lit("new").alias("origin"))
    supply = old.select(id).join(new.select(id), id, "left_anti").distinct()
    n = int(new.count() * replay + 0.5)
    again = supply.orderBy(stable_order(F.lit(salt), F.col(id))).limit(n).select(id, F.lit("replay").alias("origin"))
    told = rows.unionAll(again).join(held.select(id).distinct().withColumn("__h", F.lit(True)), id, "left")
    bad = F.raise_error(F.concat(F.lit("held-out id "), F.col(id).cast("string"))).cast("string")
    return told.select(id, F.when(F.col("__h"), bad).otherwise(F.col("origin")).alias("origin"))


def repair_partitions(df: DataFrame, id: str, group: str, partition: str) -> DataFrame:
    """(id, partition, action): groups in train and dev move to train; groups in test and anything else are dropped."""
    seen = df.groupBy(group).agg(F.collect_set(partition).alias("__s"))
    s = F.col("__s")
    action = F.when(F.size(s) == 1, "kept").when(F.array_contains(s, "test"), "dropped").when(F.col(partition) == "dev", "moved").otherwise("kept")
    joined = df.join(seen, group)
    return joined.select(id, F.when(action == "moved", "train").otherwise(F.col(partition)).alias("partition"), action.alias("action"))


def audit_sample(df: DataFrame, cluster: str, share: float, salt: str) -> DataFrame:
    """Whole clusters: the first round(n * share) by salted hash. The ranked table is a row a cluster, cut by its limit."""
    clusters = df.select(F.col(cluster)).distinct()
    n = clusters.count()
    return clusters.orderBy(stable_order(salt, F.col(cluster))).limit(int(n * share + 0.5))


def review_error(df: DataFrame, group: str, disagree: str, reviewed: str, wrong: str, least: int, miss_rate: float) -> DataFrame:
    """(group, n, precision, error_rate): disagreements times their precision (own where enough were reviewed, else pooled), and
    agreements times a miss rate."""
    g = df.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.col(disagree).cast("long")).alias("d"), F.sum((F.col(disagree) & F.col(reviewed)).cast("long")).alias("r"), F.sum((F.col(disagree) & F.col(reviewed) & F.col(wrong)).cast("long")).alias("w")
    )
    pooled = g.agg((F.sum("w") / F.sum("r")).alias("pooled"))
    p = F.when(F.col("r") >= least, F.col("w") / F.col("r")).otherwise(F.col("pooled"))
    return g.join(F.broadcast(pooled)).select(group, "n", p.alias("precision"), ((F.col("d") * p + (F.col("n") - F.col("d")) * miss_rate) / F.col("n")).alias("error_rate"))


def select_checkpoint(df: DataFrame, step: str, a: str, b: str, n_a: int, n_b: int) -> DataFrame:
    """The latest step whose mean of two accuracies is within sqrt(2) standard errors of the best."""
    m = (F.col(a) + F.col(b)) / 2
    se = F.sqrt(F.col(a) * (1 - F.col(a)) / n_a + F.col(b) * (1 - F.col(b)) / n_b) / 2
    scored = df.select(step, m.alias("mean"), se.alias("se"))
    best = scored.agg(F.max_by(F.struct("mean", "se"), F.struct("mean", step)).alias("best"))
    band = scored.join(F.broadcast(best)).where(F.col("mean") >= F.col("best.mean") - F.sqrt(F.lit(2.0)) * F.col("best.se"))
    return band.agg(F.max(step).alias(step), F.max_by("mean", step).alias("mean"))


def completeness(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, expected, seen, complete) against a table of expected counts."""
    seen = rows.groupBy(key).agg(F.count("*").alias("seen"))
    j = expected.join(seen, key, "full_outer")
    return j.select(key, "expected", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce(F.col("expected") == F.col("seen"), F.lit(False)).alias("complete"))


def blind_prior(train: DataFrame, test: DataFrame, question: str, gold: str) -> DataFrame:
    """n, known, accuracy: how far the most frequent answer that training gave to a question's text answers the test."""
    top = train.where(F.col(gold).isNotNull()).groupBy(question, gold).agg(F.count("*").alias("c")).groupBy(question).agg(F.max_by(gold, F.struct("c", gold)).alias("__g"))
    j = test.join(top, question, "left")
    return j.agg(F.count("*").alias("n"), F.count("__g").alias("known"), F.avg(F.coalesce((F.col("__g") == F.col(gold)).cast("double"), F.lit(0.0))).alias("accuracy"))


def mixture(df: DataFrame, source: str, shares: dict[str, float], must_keep: Column, salt: str) -> DataFrame:
    """Rows of a mixture: as many as the scarcest source's supply allows at the given shares; rows that must be kept come first."""
    sizes = {r[source]: r["n"] for r in df.where(F.col(source).isin(*shares)).groupBy(source).agg(F.count("*").alias("n")).collect()}  # a row a source
    total = min((sizes.get(s, 0) / v for s, v in shares.items() if v > 0), default=0)
    take = df.sparkSession.createDataFrame([(s, int(total * v + 1e-9)) for s, v in shares.items()], f"{source} string, take long")
    return take_per_stratum(df, take, source, [F.desc(F.coalesce(must_keep, F.lit(False)).cast("int")), stable_order(salt, F.col(df.columns[0]))])


def batch_plan(df: DataFrame, id: str, tokens: str, budget: int, chunk: int = 4096) -> DataFrame:
    """(id, chunk, batch): rows dealt to chunks by hash, sorted by length within each, and cut into batches whose padded size
    (rows times the longest) stays within a budget; a row over the budget is a batch of its own. Greedy, so folded in Python, a chunk at a time."""
    n = max(1, -(-df.count() // chunk))
    dealt = df.select(F.col(id).alias("id"), F.col(tokens).cast("long").alias("tokens"), F.pmod(F.conv(F.substring(F.sha2(F.col(id).cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int").alias("chunk"))
    kind = dealt.schema["id"].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "id"])
        batch, size, out = 0, 0, []
        for t in rows.tokens:
            if size and (size + 1) * t > budget:
                batch, size = batch + 1, 0
            size += 1
            out.append(batch)
        return pd.DataFrame({"id": rows.id, "chunk": rows.chunk, "batch": out})

    return dealt.groupBy("chunk").applyInPandas(cut, f"id {kind}, chunk int, batch int").withColumnRenamed("id", id)


def last_mean(df: DataFrame, key: str, order: str, value: str, n: int = 2) -> DataFrame:
    """(key, entries, mean) over the last n entries of each key."""
    last = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(f"__n <= {n}")
    return last.groupBy(key).agg(F.count("*").alias("entries"), F.avg(value).alias("mean"))


def teacher_records(df: DataFrame, id: str, rules: list[tuple[str, Column]], near: DataFrame, contaminated: DataFrame) -> DataFrame:
    """(id, reason): ``kept``, or the first of the given rules, ``near_duplicate`` (in ``near``) and ``contaminated`` that speaks against a record."""
    from verdigris.operators.quality import first_failing

    flagged = df.join(near.select(id).distinct().withColumn("__near", F.lit(True)), id, "left").join(contaminated.select(id).distinct().withColumn("__hit", F.lit(True)), id, "left")
    return flagged.select(id, first_failing(*rules, ("near_duplicate", F.col("__near")), ("contaminated", F.col("__hit"))).alias("reason"))


def lanes(df: DataFrame, options: str, limits: dict[str, int]) -> DataFrame:
    """``df`` once for each lane whose limit its largest option count keeps within, as ``lane``."""
    fits = F.array_compact(F.array(*[F.when(F.col(options) <= n, F.lit(name)) for name, n in sorted(limits.items())]))
    return df.withColumn("lane", F.explode(fits))


def allowed(df: DataFrame, receipts: DataFrame, key: str, licences: list[str]) -> DataFrame:
    """Rows with a receipt of an allowed licence."""
    good = receipts.where(F.lower("licence").isin(*[x.lower() for x in licences])).select(key).distinct()
    return df.join(good, key, "left_semi")


def bundle_hits(df: DataFrame, id: str, text: str, benchmark: DataFrame, bench_text: str, least: int = 20) -> DataFrame:
    """(id, hits): lines whose normalised text has the fingerprint of a benchmark line, of at least ``least`` characters."""
    def prints(t: DataFrame, column: str, *keep: str) -> DataFrame:
        line = F.trim(F.regexp_replace(F.lower(F.col("line")), r"\s+", " "))
        cut = t.select(*keep, F.explode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("line")).select(*keep, line.alias("line"))
        return cut.where(F.length("line") >= least).select(*keep, F.sha1(F.col("line").cast("binary")).alias("print")).distinct()

    return prints(df, text, id).join(prints(benchmark, bench_text), "print", "left_semi").groupBy(id).agg(F.count("*").alias("hits"))


def evaluation_summary(df: DataFrame, model: str, track: str, stratum: str, correct: str) -> DataFrame:
    """Accuracy per model, model and track, and model, track and stratum in one pass over grouping sets."""
    g = df.groupingSets([[F.col(model)], [F.col(model), F.col(track)], [F.col(model), F.col(track), F.col(stratum)]], model, track, stratum)
    return g.agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
