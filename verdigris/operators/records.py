"""Requests, answers, soft labels and record-level joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def compile_request(df: DataFrame, id: str, questions: str) -> DataFrame:
    """(id, name, at, label, type, question): one field per question of map<name, struct<kind, question, criteria>>. A question of kind
    ``multi`` fans out to a boolean field for each criterion; noul is boolean, score is ordinal."""
    asked = df.select(id, F.explode(questions).alias("name", "q"))
    kind = F.when(F.col("q.kind") == "noul", "boolean").when(F.col("q.kind") == "score", "ordinal").when(F.col("q.kind") == "multi", "boolean").otherwise(F.col("q.kind"))
    parts = F.when(F.col("q.kind") == "multi", F.col("q.criteria")).otherwise(F.array(F.lit(None).cast("string")))
    return asked.select(id, "name", kind.alias("type"), F.col("q.question").alias("question"), F.posexplode(parts).alias("at", "label")).select(id, "name", "at", "label", "type", "question")


def fold_multi(answers: DataFrame, id: str, threshold: float = 0.5) -> DataFrame:
    """(id, name, selected, abstained) from (id, name, at, label, p, abstained): labels above the threshold, strictly, in order;
    the question abstains if all its labels do."""
    g = answers.groupBy(id, "name").agg(F.array_sort(F.collect_list(F.struct("at", "label", "p", "abstained"))).alias("l"))
    chosen = F.transform(F.filter("l", lambda x: ~x["abstained"] & (x["p"] > threshold + 1e-9)), lambda x: x["label"])
    return g.select(id, "name", chosen.alias("selected"), F.forall("l", lambda x: x["abstained"]).alias("abstained"))


def project_probabilities(df: DataFrame, id: str, probabilities: str, labels: str, digits: int = 6) -> DataFrame:
    """(id, p): a map of probabilities kept to a field's labels and made to sum to 1, in the labels' order; null if none is left."""
    own = F.transform(labels, lambda k: F.greatest(F.coalesce(F.try_element_at(probabilities, k), F.lit(0.0)), F.lit(0.0)))
    sized = df.select(id, F.col(labels).alias("k"), own.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return sized.select(id, F.when(total > 0, F.map_from_arrays("k", F.transform("v", lambda x: F.round(x / total, digits)))).alias("p"))


def attach_soft_labels(records: DataFrame, rows: DataFrame, id: str, usable: Column, order: str, keep: list[str]) -> DataFrame:
    """``records`` with the columns ``keep`` of their last usable row; a later failure doesn't replace an earlier usable one."""
    best = rows.groupBy(id).agg(F.max_by(F.struct(*keep, usable.alias("__ok")), F.struct(usable.cast("int"), F.col(order))).alias("__b"))
    return records.join(best.where("__b.__ok"), id, "left").select(*records.columns, *[F.col(f"__b.{k}").alias(k) for k in keep])


def first_source_wins(rows: DataFrame, id: str, rank: str, order: str) -> DataFrame:
    """Of each id the row of the lowest-ranked source, and of its rows the first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(id).orderBy(rank, order))).where("__n = 1").drop("__n")


def donors(df: DataFrame, id: str, order: Column, keep: list[str], salt: str = "donor", ranges: int = 256) -> DataFrame:
    """``df`` with the columns ``keep`` of another row, as ``donor_*``: the one at hash(id) mod (n - 1) of the others in a stable
    order. Rows are numbered in two levels, so no task sees them all."""
    h = df.withColumn("__o", order).withColumn("__r", F.substring("__o", 1, 2))
    sizes = h.groupBy("__r").agg(F.count("*").alias("m"))
    before = sizes.select("__r", F.coalesce(F.sum("m").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("m").over(Window.partitionBy()).alias("n"))  # a row a range
    at = F.row_number().over(Window.partitionBy("__r").orderBy("__o", id)) - 1
    numbered = h.join(F.broadcast(before), "__r").withColumn("__i", at + F.col("b")).drop("__r", "b", "__o")
    jump = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(salt), F.col(id).cast("string")), 256), 1, 12), 16, 10).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(1)))
    wanted = numbered.withColumn("__w", F.when(F.col("n") > 1, F.pmod(F.col("__i") + 1 + jump, F.col("n"))))
    giving = numbered.select(F.col("__i").alias("__w"), *[F.col(k).alias(f"donor_{k}") for k in keep])
    return wanted.join(giving, "__w", "left").select(*df.columns, *[f"donor_{k}" for k in keep])


def without_keys(df: DataFrame, keys: list[str], excluded: DataFrame) -> DataFrame:
    """Rows none of whose key columns holds an excluded ``key``; null keys exclude nothing."""
    out = df
    gone = excluded.select("key").where("key is not null").distinct()
    for k in keys:
        out = out.join(gone.select(F.col("key").alias(k)), k, "left_anti")
    return out.select(*df.columns)


def triplets(df: DataFrame, group: str, role: str, correct: str) -> DataFrame:
    """(group, base, flip, invariant): correctness by role of groups that have all three roles."""
    p = df.groupBy(group).agg(*[F.max(F.when(F.col(role) == r, F.col(correct))).alias(r) for r in ("base", "flip", "invariant")])
    return p.where("base is not null and flip is not null and invariant is not null")


def ablations(df: DataFrame, image: str, state: str) -> DataFrame:
    """Each record as it is, without its image and without its state, by ``condition``."""
    kinds = F.explode(F.array(F.lit("full"), F.lit("no_image"), F.lit("no_state")))
    out = df.withColumn("condition", kinds)
    return out.withColumns({image: F.when(F.col("condition") != "no_image", F.col(image)), state: F.when(F.col("condition") != "no_state", F.col(state))})


def expected_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): ok, missing, unexpected, size or digest, for two tables of (path, bytes, sha256)."""
    e = expected.select("path", F.col("bytes").alias("eb"), F.col("sha256").alias("es"))
    j = e.join(found.select("path", "bytes", "sha256"), "path", "full_outer")
    s = F.when(F.col("sha256").isNull(), "missing").when(F.col("es").isNull(), "unexpected").when(F.col("eb") != F.col("bytes"), "size").when(F.col("es") != F.col("sha256"), "digest").otherwise("ok")
    return j.select("path", s.alias("status"))


def certain_answers(worlds: DataFrame, id: str, answer: str) -> DataFrame:
    """(id, worlds, answer): the answer that every completion of the withheld facts gives, else null for unknown."""
    g = worlds.groupBy(id).agg(F.count("*").alias("worlds"), F.count_distinct(answer).alias("__k"), F.count_if(F.col(answer).isNull()).alias("__u"), F.min(answer).alias("__a"))
    return g.select(id, "worlds", F.when((F.col("__k") == 1) & (F.col("__u") == 0), F.col("__a")).alias("answer"))


def attach_with_fallback(df: DataFrame, table: DataFrame, id: str, key: str, value: str) -> DataFrame:
    """``df`` with ``value`` looked up by id, else by what is before the id's last colon."""
    whole = table.select(F.col(key).alias(id), F.col(value).alias("__v"))
    base = table.select(F.col(key).alias("__b"), F.col(value).alias("__w"))
    cut = df.withColumn("__b", F.regexp_replace(F.col(id), r":[^:]*$", ""))
    return cut.join(whole, id, "left").join(base, "__b", "left").select(*df.columns, F.coalesce("__v", "__w").alias(value))


def walk(edges: DataFrame, starts: DataFrame, hops: list[str]) -> DataFrame:
    """(start, node): where a chain of named relations leads. ``edges``: (source, relation, target); ``starts``: (node)."""
    now = starts.select(F.col("node").alias("start"), "node")
    for h in hops:
        step = edges.where(F.col("relation") == h).select(F.col("source").alias("node"), "target")
        now = now.join(step, "node").select("start", F.col("target").alias("node"))
    return now.distinct()


def union_checked(tables: list[DataFrame], id: str) -> DataFrame:
    """The union by name of tables whose ids must not repeat; a repeated id fails when the rows are read."""
    from functools import reduce

    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    twice = out.groupBy(id).agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(id).cast("string")))).otherwise(F.lit(True))
    return out.join(twice, id).where(ok).select(*out.columns)


def permuted(options: Column, seed: Column) -> Column:
    """The options in the order of a hash of seed and place."""
    keyed = F.transform(options, lambda x, i: F.struct(F.sha2(F.concat_ws("\0", seed.cast("string"), i.cast("string")), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def presentation_mix(df: DataFrame, id: str, variants: list[tuple[str, float]], salt: str) -> DataFrame:
    """``df`` with ``variant``: a share of the ids by hash for each named variant, the rest ``plain``."""
    from verdigris.functions.hashing import unit

    u, at, out = unit(salt, F.col(id)), 0.0, F.lit(None).cast("string")
    for name, share in variants:
        out = F.coalesce(out, F.when((u >= at) & (u < at + share), name))
        at += share
    return df.withColumn("variant", F.coalesce(out, F.lit("plain")))


def parse_reply(text: Column, domain: Column) -> Column:
    """struct<status, answer, confidence> of a reply with a JSON object: ``answer`` read as text in lower case and kept if the
    domain has it, confidence clipped to [0, 1]."""
    from verdigris.functions.text import first_json_object

    raw = F.try_parse_json(first_json_object(text))
    said = F.lower(F.trim(F.try_variant_get(raw, "$.answer", "string")))
    sure = F.try_variant_get(raw, "$.confidence", "double")
    status = F.when(raw.isNull(), "unparsed").when(said.isNull(), "no_answer").when(~F.array_contains(domain, said), "out_of_domain").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", said).alias("answer"), F.when(status == "ok", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"))


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by all names that both sides have; without one, an error instead of a cross join."""
    both = [c for c in a.columns if c in b.columns]
    if not both:
        raise ValueError("no column in common")
    return a.join(b, both, how)
