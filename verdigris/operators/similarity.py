"""Shared n-grams between records and benchmark items, and between records of different sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.functions.text import hashed_ngrams, tokens
from verdigris.storage import bounded, materialise


def gram_table(df: DataFrame, id: str, text: str, n: int, *extra: str) -> DataFrame:
    """(id, units, gram): one row per distinct n-gram of a record, as a hash; ``units`` is how many the record has."""
    words = df.select(F.col(id).alias("id"), *extra, tokens(F.col(text)).alias("words"))  # a projection of its own, so that texts are cut once
    grams = words.select("id", *extra, hashed_ngrams(F.col("words"), n).alias("grams"))
    # outer, then filtered: the filter that a plain explode infers would repeat the whole expression at the scan
    return grams.select("id", *extra, F.size("grams").alias("units"), F.explode_outer("grams").alias("gram")).where("gram is not null")


def _shares(records: DataFrame, items: DataFrame) -> DataFrame:
    """(id, bench, shared, share) from two gram tables, the second of which is broadcast if it is small."""
    pairs = records.join(bounded(items.select(F.col("id").alias("bench"), F.col("units").alias("bench_units"), "gram")), "gram")
    counted = pairs.groupBy("id", "bench").agg(F.count("*").alias("shared"), F.first("units").alias("u"), F.first("bench_units").alias("v"))
    return counted.select("id", "bench", "shared", F.greatest(F.col("shared") / F.col("u"), F.col("shared") / F.col("v")).alias("share"))


def containment(records: DataFrame, benchmark: DataFrame, n: int = 13, *, id: str, text: str, bench_id: str, bench_text: str) -> DataFrame:
    """(id, bench_id, shared, share) of every pair with a common n-gram; share is the larger of both containments."""
    return _shares(gram_table(records, id, text, n), gram_table(benchmark, bench_id, bench_text, n)).withColumnsRenamed({"id": id, "bench": bench_id})


def sequence_match(records: DataFrame, benchmark: DataFrame, least: int, *, id: str, text: str, bench_id: str, bench_text: str) -> DataFrame:
    """(id, bench_id): records whose whole token sequence, of at least ``least`` tokens, is that of an item."""
    def key(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.col(name), tokens(F.col(column)).alias("w")).where(F.size("w") >= least).select(name, F.sha2(F.array_join("w", " "), 256).alias("key"))

    return key(records, id, text).join(bounded(key(benchmark, bench_id, bench_text)), "key").select(id, bench_id)


def line_match(records: DataFrame, benchmark: DataFrame, least: int = 6, template_rows: int = 50, *, id: str, text: str, bench_id: str, bench_text: str) -> DataFrame:
    """(id, bench_id, template): records with a line that is a whole line of an item, of at least ``least`` tokens. A line that many
    items hold is a template."""
    def lines(df: DataFrame, name: str, column: str) -> DataFrame:
        cut = df.select(F.col(name), F.explode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("line")).select(name, tokens(F.col("line")).alias("w"))
        return cut.where(F.size("w") >= least).select(name, F.sha2(F.array_join("w", " "), 256).alias("key")).distinct()

    items = lines(benchmark, bench_id, bench_text)
    often = items.groupBy("key").agg((F.count("*") >= template_rows).alias("template"))
    return lines(records, id, text).join(bounded(items.join(often, "key")), "key").groupBy(id, bench_id).agg(F.bool_and("template").alias("template"))


#: Kinds of keys that a record and an item can have in common; the last two tell of a record alone, whichever item it is.
GRAM, LINE, WHOLE, UPSTREAM, LINT, SHORT = range(6)


def _keys(df: DataFrame, id: str, text: str, n: int, line_least: int, whole_least: int, upstream: str | None, grams: bool = True, lint: int = 0) -> tuple[DataFrame, list[Column]]:
    """(id, units, ...) and, for each kind, the array of its keys: the distinct n-grams, lines and whole token sequence of each text, its upstream
    item and, with ``lint``, the n-grams of so many words and the lines of 3 to 5. Texts are cut once, line by line: no token spans a line's end. The
    kind is part of a key, so that keys alone have to meet."""
    none = F.array().cast("array<bigint>")
    cut = df.select(F.col(id).alias("id"), F.col(upstream).alias("upstream") if upstream else F.lit(None).cast("string").alias("upstream"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), tokens).alias("lines"))

    def lines(kind: int, kept: Callable[[Column], Column]) -> Column:
        return F.array_distinct(F.transform(F.filter("lines", kept), lambda w: F.xxhash64(w, F.lit(kind))))

    words = cut.select("id", "upstream", lines(LINE, lambda w: F.size(w) >= line_least).alias("lines"), (lines(SHORT, lambda w: F.size(w).between(3, 5)) if lint else none).alias("short"), F.flatten("lines").alias("words"))
    alone = lambda known, c, kind: F.array_compact(F.array(F.when(known, F.xxhash64(c, F.lit(kind)))))
    linted = F.transform(hashed_ngrams(F.col("words"), lint), F.bitwise_not) if lint else none
    hashed = words.select("id", (hashed_ngrams(F.col("words"), n) if grams else none).alias("grams"), "lines", alone(F.size("words") >= whole_least, "words", WHOLE).alias("whole"), alone(F.col("upstream").isNotNull(), "upstream", UPSTREAM).alias("upstream"), linted.alias("linted"), "short")
    return hashed.withColumn("units", F.size("grams")), [F.col(c) for c in ("grams", "lines", "whole", "upstream", "linted", "short")]


def benchmark_links(records: DataFrame, benchmark: DataFrame, n: int = 13, line_least: int = 6, whole_least: int = 3, template_rows: int = 50, *, id: str, text: str, bench_id: str, bench_text: str, upstream: str | None = None, weak: bool = True, lint: int = 0) -> DataFrame:
    """(id, bench_id, shared, share, reason): one row for each way in which a record and an item are linked. Reasons: ``near_dup`` (more than
    half of either's n-grams), ``shared_gram``, ``field`` (a whole line), ``template`` (one that ``template_rows`` items hold), ``state`` (the whole
    sequence) and, where ``upstream`` names a column of both, ``upstream``. Records are read and cut once; the items' keys are broadcast
    if they are few, else both sides meet by key. Not ``weak``: templates and n-grams are left out before anything meets by them.

    With ``lint``, two more reasons, each with one row a record and no item: ``lint`` (``shared`` n-grams of so many words of any items) and
    ``short_line`` (lines of 3 to 5 words)."""
    held, kinds = _keys(benchmark, bench_id, bench_text, n, line_least, whole_least, upstream, weak, lint)
    of = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    named = F.concat(*[F.transform(keys, of(kind)) for kind, keys in enumerate(kinds)])
    items = held.select("id", "units", F.explode_outer(named).alias("k")).where("k is not null").select("id", "units", "k.kind", "k.key")
    often = items.where(f"kind = {LINE}").groupBy("kind", "key").agg((F.count("*") >= template_rows).alias("template"))
    told = items.join(often, ["kind", "key"], "left").where(F.col("kind") < LINT).select("kind", "key", F.col("id").alias("bench"), F.col("units").alias("bench_units"), F.coalesce("template", F.lit(False)).alias("template"))
    if not weak:
        told = told.where("not template")
    if lint:
        told = told.unionByName(items.where(F.col("kind") >= LINT).select("kind", "key").distinct().withColumn("template", F.lit(False)), allowMissingColumns=True)
    own, kinds = _keys(records, id, text, n, line_least, whole_least, upstream, weak, lint)
    met = own.select("id", "units", F.explode_outer(F.concat(*kinds)).alias("key")).where("key is not null").join(bounded(told), "key")
    counted = met.groupBy("id", "bench", "kind").agg(F.count("*").alias("shared"), F.first("units").alias("u"), F.first("bench_units").alias("v"), F.bool_and("template").alias("template"))
    share = F.when(F.col("kind") == GRAM, F.greatest(F.col("shared") / F.col("u"), F.col("shared") / F.col("v")))
    reason = F.when(F.col("kind") == GRAM, F.when(share > 0.5, "near_dup").otherwise("shared_gram")).when(F.col("kind") == LINE, F.when(F.col("template"), "template").otherwise("field")).when(F.col("kind") == WHOLE, "state").when(F.col("kind") == LINT, "lint").when(F.col("kind") == SHORT, "short_line").otherwise("upstream")
    return counted.select(F.col("id").alias(id), F.col("bench").alias(bench_id), "shared", share.alias("share"), reason.alias("reason"))


DROPS = ("near_dup", "field", "state", "upstream")


def decontaminate(records: DataFrame, benchmark: DataFrame, n: int = 13, **names: str) -> DataFrame:
    """(id, verdict, reasons): ``drop`` where a near-duplicate, an exact line that is no template, an exact text or the same upstream item is
    found, ``flag`` for any other shared n-gram or template, else ``keep``. ``names`` as in ``benchmark_links``."""
    id = names["id"]
    found = benchmark_links(records, benchmark, n, **names).groupBy(id).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    verdict = F.when(F.col("reasons").isNull(), "keep").when(F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in DROPS])), "drop").otherwise("flag")
    return records.select(id).join(found, id, "left").select(id, verdict.alias("verdict"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))


def leakage(train: DataFrame, held: DataFrame, family: str, n: int = 13, *, id: str, text: str, upstream: str | None = None) -> DataFrame:
    """(id, held_id, reason) of every link between training and held-out rows: ``same_id``, ``family`` (the same root), or one of the dropping
    reasons of ``benchmark_links``. A gate passes where there is none.

    Near-duplicates are those of ``near_duplicate_pairs`` between both sides, so that an n-gram which many rows hold is looked up by few, and copies
    meet as classes; only the links that are returned are written out by row."""
    by_id = train.select(F.col(id).alias("a")).join(held.select(F.col(id).alias("b")), F.col("a") == F.col("b")).select("a", "b", F.lit("same_id").alias("reason"))
    roots = held.where(F.col(family).isNotNull()).groupBy(F.col(family).alias("root")).agg(F.min(id).alias("b"))
    by_family = train.select(F.col(id).alias("a"), F.col(family).alias("root")).join(roots, "root").select("a", "b", F.lit("family").alias("reason"))
    other = held.select(F.col(id).alias("__held"), F.col(text).alias("__text"), *([upstream] if upstream else []))
    texts = benchmark_links(train, other, n, id=id, text=text, bench_id="__held", bench_text="__text", upstream=upstream, weak=False)
    by_text = texts.where(F.col("reason").isin(*DROPS)).select(F.col(id).alias("a"), F.col("__held").alias("b"), "reason")
    sided = lambda df, side: df.select(F.struct(F.lit(side).alias("side"), F.col(id).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.col(text).alias("text"), F.lit(side).alias("side"))
    pairs, members = near_duplicate_pairs(sided(train, 0).unionAll(sided(held, 1)), n, id="key", text="text", source="side")
    of = lambda side, name: members.where(F.col("side") == side).select("rep", F.col("id.id").alias(name)).distinct()
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(pairs.where("a <> b").select("b", "a"))
    by_grams = both.join(of(0, "a").withColumnRenamed("rep", "x"), "x").join(of(1, "b").withColumnRenamed("rep", "y"), "y").select("a", "b", F.lit("near_dup").alias("reason"))
    return by_id.unionAll(by_family).unionAll(by_text).unionAll(by_grams).distinct().select(F.col("a").alias(id), F.col("b").alias("held_id"), "reason")


def gram_members(df: DataFrame, n: int, *, id: str, text: str, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, rep, units). Records of equal sets of n-grams (and of equal ``by``, which are among ``keep``) are one class, named by its
    smallest id; ``units`` is how many n-grams it has. Records without an n-gram are in no class. No n-gram is written or moved, only two digests of each set."""
    words = df.select(F.col(id).alias("id"), *keep, tokens(F.col(text)).alias("words"))
    grams = words.select("id", *keep, F.sort_array(hashed_ngrams(F.col("words"), n)).alias("grams"))
    held = materialise(grams.select("id", *keep, F.xxhash64(F.lit(1), "grams").alias("h"), F.xxhash64(F.lit(2), "grams").alias("i"), F.size("grams").alias("units")), "gram-sets")
    held = held.where("units > 0")  # of the written table: at the scan the filter would repeat the whole expression
    same = ["h", "i", "units", *by]
    return materialise(held.join(held.groupBy(*same).agg(F.min("id").alias("rep")), same).select("id", *keep, "rep", "units"), "gram-members")


def gram_bundles(df: DataFrame, members: DataFrame, n: int, *, id: str, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(rep, gram, weight, m, first): what classes of ``gram_members`` share. N-grams with the same holders are one bundle, named by its least: ``weight``
    n-grams that ``m`` classes hold, of which ``first`` is the smallest. N-grams of one class alone are left out.

    Texts are cut anew, so that n-grams move once, with their class and nothing else: what they share is seen where they arrive, and most end there."""
    if not members.groupBy("id").count().where("count > 1").isEmpty():  # a record that comes twice must not meet itself
        df = df.dropDuplicates([id])
    copies = bounded(members.where("id <> rep").select(F.col("id").alias("rep")))
    cut = df.select(F.col(id).alias("rep"), *by, F.col(text).alias("__text")).join(copies, "rep", "left_anti")
    words = cut.select("rep", *by, tokens(F.col("__text")).alias("words"))
    held = words.select("rep", *by, F.explode_outer(hashed_ngrams(F.col("words"), n)).alias("gram")).where("gram is not null")
    over = lambda c: c.over(Window.partitionBy("gram", *by))
    told = held.select("rep", *by, "gram", over(F.count("*")).alias("m"), over(F.min("rep")).alias("first"), over(F.bit_xor(F.xxhash64("rep"))).alias("h"), over(F.bit_xor(F.xxhash64("rep", F.lit(1)))).alias("i")).where("m > 1")
    laid = told.groupBy("rep", *by, "m", "first", "h", "i").agg(F.count("*").cast("int").alias("weight"), F.min("gram").alias("gram"))
    return materialise(laid.select("rep", "gram", "weight", "m", "first"), "bundles")


def _common(pairs: DataFrame, bundles: DataFrame) -> DataFrame:
    """(x, y, shared): how many n-grams the classes of each pair share, by the weights of their common bundles."""
    # the weight is part of the name: sets of strings meet in linear time, and a map would be searched from its front for each weight
    named = F.concat(F.col("gram").cast("string"), F.lit(":"), F.col("weight").cast("string"))
    held = bundles.groupBy("rep").agg(F.collect_list(named).alias("held"))
    both = pairs.join(held.withColumnsRenamed({"rep": "x", "held": "hx"}), "x").join(held.withColumnsRenamed({"rep": "y", "held": "hy"}), "y")
    weight = lambda g: F.substring_index(g, ":", -1).cast("long")
    return both.select("x", "y", F.aggregate(F.array_intersect("hx", "hy"), F.lit(0).cast("long"), lambda s, g: s + weight(g)).alias("shared"))


def _differing(pairs: DataFrame, members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``pairs`` (a, b of classes) with links: how many pairs of records lie between them that differ in every key. Counted from the
    members' counts by inclusion and exclusion, so no pair of records is made."""
    total = None
    for size in range(len(keys) + 1):
        for same in combinations(keys, size):
            counts = members.groupBy("rep", *same).agg(F.count("*").alias("c"))
            x, y = counts.withColumnsRenamed({"rep": "a", "c": "ca"}), counts.withColumnsRenamed({"rep": "b", "c": "cb"})
            met = pairs.select("a", "b").join(x, "a").join(y, ["b", *same])
            part = met.select("a", "b", ((-1) ** size * F.col("ca") * F.col("cb")).alias("m"))
            total = part if total is None else total.unionAll(part)
    links = total.groupBy("a", "b").agg(F.sum("m").alias("m"))
    return pairs.join(links, ["a", "b"]).withColumn("links", F.when(F.col("a") == F.col("b"), F.col("m") / 2).otherwise(F.col("m")).cast("long")).drop("m").where("links > 0")


def near_duplicate_pairs(df: DataFrame, n: int = 13, *, id: str, text: str, source: str, least: float = 0.5, group: str | None = None, alike: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): records of different sources that share more than ``least`` of the distinct n-grams of either.

    ``members`` (id, source, rep) gives each record the smallest record with the same n-grams; ``pairs`` (a, b, shared, share, links),
    a <= b, are between these, and ``links`` counts the pairs of records between both classes, so copies are never written out as pairs. With ``group``,
    records of one group make no pair either; with ``alike`` (such as a modality), only records of one value do.

    Exact for any frequency of an n-gram. The record with fewer n-grams must share one of its rarest ``units - floor(least * units)``
    with the other, so only the bundles of these look for partners; what meets is verified on all that both share with anyone. An n-gram that many
    records hold is therefore looked up only by those to which it is among their rarer half."""
    keys, by = (source, *([group] if group else [])), ((alike,) if alike else ())
    members = gram_members(df, n, id=id, text=text, keep=(*keys, *by), by=by)
    bundles = gram_bundles(df, members, n, id=id, text=text, by=by)
    spread = materialise(members.groupBy("rep").agg(F.first("units").alias("units"), F.min(source).alias("lo"), F.max(source).alias("hi")), "gram-spread")
    held = bundles.join(spread, "rep")
    several = held.groupBy("gram").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("gram")
    kept = materialise(held.join(several, "gram").select("rep", "gram", "weight", "m", "units", "lo", "hi"), "gram-postings")
    # what others hold of a record from this bundle on, the rarer before it looked up already
    rest = F.sum("weight").over(Window.partitionBy("rep").orderBy("m", "gram").rowsBetween(0, Window.unboundedFollowing))
    rare = kept.withColumn("rest", rest).where(F.col("rest") > F.floor(F.col("units") * least)).select("gram", F.col("rep").alias("x"), F.col("units").alias("u"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"))
    met = rare.join(kept.select("gram", F.col("rep").alias("y"), F.col("units").alias("v"), "lo", "hi"), "gram").where("(u < v or (u = v and x < y)) and least(lo, lo_x) <> greatest(hi, hi_x)").select("x", "y").distinct()
    # x has the smaller set
    told = _common(met, kept).join(spread.select(F.col("rep").alias("x"), "units"), "x")
    shared = told.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", (F.col("shared") / F.col("units")).alias("share"))
    within = spread.where("lo <> hi").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("units").cast("long").alias("shared"), F.lit(1.0).alias("share"))
    found = shared.where(F.col("share") > least).unionByName(within)
    members = members.select("id", *keys, "rep")
    return _differing(materialise(found, "gram-pairs"), members, keys), members


def near_duplicate_survivors(df: DataFrame, n: int = 13, *, id: str, text: str, source: str, score: Column, least: float = 0.5, group: str | None = None, alike: str | None = None) -> DataFrame:
    """``df`` without the losers of its ``near_duplicate_pairs``, see ``survivors``; records without n-grams stay.

    Records of equal n-grams, source and group have the same partners at the same shares, and the best of them is settled first, so all share its
    fate: the rounds run over these nodes, of which a class has one a source (and group), however many copies it holds."""
    pairs, members = near_duplicate_pairs(df, n, id=id, text=text, source=source, least=least, group=group, alike=alike)
    keys = (source, *([group] if group else []))
    scored = materialise(members.join(df.select(F.col(id).alias("id"), score.alias("s")), "id"), "scored")
    nodes = scored.groupBy("rep", *keys).agg(F.max_by(F.struct("id", "s"), F.struct("s", -F.col("id"))).alias("best")).select("rep", *keys, F.col("best.id").alias("node"), F.col("best.s").alias("s"))
    nodes = materialise(nodes, "nodes")
    x = nodes.select(F.col("rep").alias("a"), F.col("node").alias("x"), *[F.col(k).alias(f"{k}_x") for k in keys])
    y = nodes.select(F.col("rep").alias("b"), F.col("node").alias("y"), *[F.col(k).alias(f"{k}_y") for k in keys])
    apart = reduce(lambda p, k: p & (F.col(f"{k}_x") != F.col(f"{k}_y")), keys, F.lit(True))
    between = pairs.select("a", "b", "share").join(x, "a").join(y, "b").where(apart & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    stay = survivors(nodes, between.select(F.col("x").alias("a"), F.col("y").alias("b"), "share"), "node", F.col("s"))
    lost = nodes.join(stay.select("node"), "node", "left_anti").select("rep", *keys)
    gone = members.join(lost, ["rep", *keys], "left_semi").select(F.col("id").alias(id)).distinct()
    return df.join(gone, id, "left_anti")


#: Pairs of a component that one task settles in their order; beyond it the component is settled in rounds.
COMPONENT_PAIRS = 1_000_000
#: Rounds before components are looked for.
FIRST_ROUNDS = 3


def survivors(records: DataFrame, pairs: DataFrame, id: str, score: Column, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """``records`` without the losers of their pairs. Pairs are settled by descending share, then by their winner and their loser, the better
    first; the record of smaller score, then of larger id, loses, unless the winner has lost before (a loser cannot eliminate).

    A few rounds (``_settled``) settle most pairs, and all where chains are short. Components of what is left don't touch each other: those of
    at most ``component_pairs`` pairs are each run through in order by one task, which remembers losers only, so a chain of any length
    takes no rounds but those that find the components. Larger ones go on in rounds. A pair of a record with itself, or without a share, is refused."""
    from verdigris.operators.graph import connected_components
    from verdigris.session import ship_package
    from verdigris.storage import discard

    ship_package(records.sparkSession)
    scored = records.select(F.col(id).alias("x"), score.alias("s"))
    p = pairs.join(scored.withColumnsRenamed({"x": "a", "s": "s_a"}), "a").join(scored.withColumnsRenamed({"x": "b", "s": "s_b"}), "b")
    a_wins = (F.col("s_a") > F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.col("a") < F.col("b")))
    w, loser = F.when(a_wins, F.col("a")).otherwise(F.col("b")), F.when(a_wins, F.col("b")).otherwise(F.col("a"))
    rank = F.struct((-F.col("share")).alias("r"), (-F.greatest("s_a", "s_b")).alias("s"), w.alias("x"), (-F.least("s_a", "s_b")).alias("t"), loser.alias("y"))
    ranked = materialise(p.select(w.alias("w"), loser.alias("l"), rank.alias("rank")), "pairs")
    if not ranked.where("w = l or rank.r is null").isEmpty():
        raise ValueError("a record is paired with itself, or a share is null")
    early, open_ = _settled(ranked, FIRST_ROUNDS)
    if open_ is None:
        return records.join(early.select(F.col("l").alias(id)), id, "left_anti") if early is not None else records
    named = open_.join(connected_components(open_, "w", "l"), F.col("w") == F.col("node")).drop("node")
    sized = materialise(named.join(named.groupBy("component").agg(F.count("*").alias("n")), "component"), "sized")
    discard(open_)

    def run_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, lost = None, set()
        for batch in batches:
            out = []
            for component, winner, loser in zip(batch.component, batch.w, batch.l):
                if component != own:
                    own, lost = component, set()
                if winner not in lost and loser not in lost:
                    lost.add(loser)
                    out.append(loser)
            yield pd.DataFrame({"l": pd.Series(out, dtype=batch.l.dtype)})

    small = sized.where(F.col("n") <= component_pairs).repartition("component").sortWithinPartitions("component", "rank").select("component", "w", "l")
    lost = early.unionAll(materialise(small.mapInPandas(run_through, f"l {records.schema[id].dataType.simpleString()}"), "lost"))
    large = sized.where(F.col("n") > component_pairs).select("w", "l", "rank")
    if not large.isEmpty():
        lost = lost.unionAll(_settled(materialise(large, "pairs"))[0])
    return records.join(lost.select(F.col("l").alias(id)), id, "left_anti")


def _settled(left: DataFrame, rounds: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(l), the losers of pairs (w, l, rank), and the pairs that ``rounds`` leave open, None for none. Found in rounds: a pair is settled once no undecided pair that ranks before it can take its
    winner, so each round settles the first pair at least; the pair table is written between rounds, until none is left."""
    from verdigris.storage import discard

    lost, parts = None, 0
    while not left.isEmpty():
        if parts == rounds:
            return lost, left
        # the first undecided pair in which a record would lose: its winner's fate is open before that
        threat = left.groupBy("l").agg(F.min("rank").alias("first"))
        marked = left.join(threat.select(F.col("l").alias("w"), "first"), "w", "left")
        settled = marked.where(F.col("first").isNull() | (F.col("first") > F.col("rank")))
        out = materialise(settled.groupBy("l").agg(F.min("rank").alias("at")), "lost")
        lost, parts = out.select("l") if lost is None else lost.unionAll(out.select("l")), parts + 1
        if parts % 20 == 0:  # a plan of few tables, however long the chain
            lost = materialise(lost, "lost")
        # a loser can't eliminate from its loss on, nor lose again; its pairs of lower rank stay open
        known = left.join(out, "l", "left").where("at is null or rank < at").select("w", "l", "rank")
        following = known.join(out.withColumnsRenamed({"l": "w"}), "w", "left").where("at is null or rank < at")
        following = materialise(following.select("w", "l", "rank"), "pairs")
        discard(left)
        left = following
    return lost, None


#: Holders of a bundle that ``earlier_duplicates`` looks at in its first round.
FIRST_HOLDERS = 8


def earlier_duplicates(df: DataFrame, n: int = 8, least: int = 5, *, id: str, text: str) -> DataFrame:
    """(id, earlier, shared): each record that shares at least ``least`` n-grams with an earlier one (smaller id), with the first such record.

    Only one record of each set of n-grams takes part; its copies have the first of them, or an earlier one that it found. N-grams with the same holders
    are one bundle of that weight. Holders of a bundle as heavy as ``least`` are linked to its first holder, without meeting each other, however
    many there are. Of lighter bundles a record looks up its rarest, so many that those left out weigh less than ``least`` together, and in rounds: the
    first ``FIRST_HOLDERS`` of a bundle, then eight times as many, as long as the next holder is before the best that the record has found."""
    members = gram_members(df, n, id=id, text=text)
    bundles = gram_bundles(df, members, n, id=id, text=text)
    heavy = bundles.where((F.col("weight") >= least) & (F.col("rep") > F.col("first"))).groupBy(F.col("rep").alias("x")).agg(F.min("first").alias("y"))
    best = materialise(_common(heavy, bundles), "found")
    rest = F.sum("weight").over(Window.partitionBy("rep").orderBy("m", "gram").rowsBetween(0, Window.unboundedFollowing))
    at = F.row_number().over(Window.partitionBy("gram").orderBy("rep"))
    light = materialise(bundles.where(F.col("weight") < least).select("gram", "rep", (rest >= least).alias("asks"), at.alias("at")), "light-bundles")
    asking, seen, upto = light.where("asks").select("gram", F.col("rep").alias("x"), "at"), 0, FIRST_HOLDERS
    while True:
        following = light.where(F.col("at") == seen + 1).select("gram", F.col("rep").alias("next"))
        open_ = asking.where(F.col("at") > seen + 1).join(following, "gram").join(best.select("x", F.col("y").alias("known")), "x", "left")
        asking = materialise(open_.where("known is null or next < known").select("gram", "x", "at", "known"), "asking")
        if asking.isEmpty():
            break
        holders = light.where(F.col("at").between(seen + 1, upto)).select("gram", F.col("rep").alias("y"), F.col("at").alias("place"))
        met = asking.join(holders, "gram").where("place < at and (known is null or y < known)").select("x", "y").distinct()
        found = best.unionAll(_common(met, bundles).where(F.col("shared") >= least))
        best = materialise(found.groupBy("x").agg(F.min(F.struct("y", "shared")).alias("b")).select("x", "b.y", "b.shared"), "found")
        asking, seen, upto = asking.drop("known"), upto, upto * 8
    found = best.select(F.col("x").alias("rep"), F.struct("y", "shared").alias("best"))
    told = members.join(found, "rep", "left")
    own = F.when((F.col("id") > F.col("rep")) & (F.col("units") >= least), F.struct(F.col("rep").alias("y"), F.col("units").cast("long").alias("shared")))
    return told.select(F.col("id").alias(id), F.coalesce("best", own).alias("e")).where("e is not null").select(id, F.col("e.y").alias("earlier"), "e.shared")


def bit_codes(df: DataFrame, id: str, text: str, n: int = 3, bits: int = 60) -> DataFrame:
    """(id, code): a similarity-preserving code of each whole text: a bit is set where it is set in the digests of more than half of the
    n-grams of words, repeats included. Sums of bits are partial before they move; a text of fewer words has code 0."""
    words = df.select(F.col(id).alias("id"), tokens(F.col(text)).alias("words"))
    at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
    grams = words.select("id", F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " ")).alias("grams"))
    # outer: short texts keep a row
    hashed = grams.select("id", F.explode_outer("grams").alias("g")).select("id", F.conv(F.substring(F.sha2("g", 256), 1, bits // 4), 16, 10).cast("long").alias("h"))
    sums = [F.sum(F.shiftright("h", b).bitwiseAND(1)).alias(f"b{b}") for b in range(bits)]
    summed = hashed.groupBy("id").agg(F.count("h").alias("n"), *sums)
    code = reduce(lambda c, b: c.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long")), range(bits), F.lit(0).cast("long"))
    return summed.select(F.col("id").alias(id), code.alias("code"))


def hamming_pairs(df: DataFrame, id: str, code: str, bits: int = 6, agree: int = 3, width: int = 64) -> DataFrame:
    """(a, b, distance, copies_a, copies_b): distinct codes that differ in at most ``bits`` bits, each named by its smallest id, a < b, with the
    number of records that have it. A code of several records is a row with itself (distance 0), so every near pair of records is told and
    no copies are paired.

    A code is cut into ``bits + agree`` blocks; a near pair agrees on ``agree`` whole blocks at least, so codes meet by these together (at 6 bits:
    84 keys of some 21 bits each), and a pair is kept at the first blocks it agrees on only."""
    blocks = bits + agree
    cuts = [width * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) & ((1 << 64) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    codes = materialise(df.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("long").alias("c")).agg(F.min(id).alias("id"), F.count("*").alias("n")), "codes")
    chosen = list(combinations(range(blocks), agree))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("c").bitwiseAND(F.lit(signed(sum(masks[i] for i in own))).cast("long")).alias("v")) for k, own in enumerate(chosen)])
    dealt = codes.select("id", "c", "n", F.explode(keys).alias("key")).select("id", "c", "n", "key.k", "key.v")
    # merged: the optimiser takes the keys for as small as the table of codes that they are made of, and would gather them on the driver to broadcast them
    met = dealt.withColumnsRenamed({"id": "a", "c": "ca", "n": "copies_a"}).join(dealt.withColumnsRenamed({"id": "b", "c": "cb", "n": "copies_b"}).hint("merge"), ["k", "v"]).where("a < b")
    x = F.col("ca").bitwiseXOR(F.col("cb"))
    near = met.withColumn("x", x).where(F.bit_count("x") <= bits)
    same = F.array_compact(F.array(*[F.when(F.col("x").bitwiseAND(F.lit(signed(m)).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)]))
    first = F.array_position(F.array(*[F.array(*[F.lit(i) for i in own]) for own in chosen]), F.slice(same, 1, agree)) - 1
    kept = near.where(first == F.col("k")).select("a", "b", F.bit_count("x").alias("distance"), "copies_a", "copies_b")
    return kept.unionAll(codes.where("n > 1").select("id", "id", F.lit(0), "n", "n"))


def jaccard_pairs(records: DataFrame, benchmark: DataFrame, least: float, *, id: str, text: str, bench_id: str, bench_text: str) -> DataFrame:
    """(id, bench_id, jaccard) of the pairs whose sets of words have a Jaccard similarity of at least ``least``, above 0. A record's
    rarest words alone look for partners: a pair as alike as that shares one of the first ``units - ceil(least * units) + 1``."""
    def words(df: DataFrame, name: str, column: str) -> DataFrame:
        cut = df.select(F.col(name).alias("id"), F.array_distinct(tokens(F.col(column))).alias("w"))
        return cut.select("id", F.size("w").alias("units"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))

    held, items = materialise(words(records, id, text), "record-words").where("units > 0"), materialise(words(benchmark, bench_id, bench_text), "item-words").where("units > 0")
    counts = items.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    rare = items.select("id", "units", F.explode("w").alias("t")).join(counts, "t").withColumn("place", place).where(F.col("place") <= F.col("units") - F.ceil(F.col("units") * least) + 1)
    looked = held.select("id", "units", F.explode_outer("w").alias("t")).join(bounded(rare.select(F.col("id").alias("item"), F.col("units").alias("v"), "t")), "t")
    met = looked.where(F.least("units", "v") >= least * F.greatest("units", "v")).select("id", "item").distinct()
    both = met.join(held, "id").join(bounded(items.select(F.col("id").alias("item"), F.col("units").alias("v"), F.col("w").alias("x"))), "item")
    shared = both.select("id", "item", "units", "v", F.size(F.array_intersect("w", "x")).alias("s"))
    alike = shared.select(F.col("id").alias(id), F.col("item").alias(bench_id), (F.col("s") / (F.col("units") + F.col("v") - F.col("s"))).alias("jaccard"))
    return alike.where(F.col("jaccard") >= least)


def contamination(records: DataFrame, benchmark: DataFrame, task: list[str], n: int = 13, lint: int = 8, *, id: str, text: str, bench_id: str, bench_text: str) -> DataFrame:
    """By ``task``: records, and how many of them have any n-gram of an item, are a near-duplicate, have two or more shared grams of ``lint``
    words, an exact line or text, or a short line (3 to 5 words) of an item."""
    names = {"id": id, "text": text, "bench_id": bench_id, "bench_text": bench_text}
    reason = F.col("reason")
    said = {"any_gram": reason.isin("near_dup", "shared_gram"), "near_dup": reason == "near_dup", "two_8grams": (reason == "lint") & (F.col("shared") >= 2), "exact": reason.isin("field", "template", "state"), "short_line": reason == "short_line"}
    told = benchmark_links(records, benchmark, n, **names, lint=lint).groupBy(id).agg(*[F.bool_or(x).alias(k) for k, x in said.items()])
    joined = records.select(id, *task).join(told, id, "left")
    flags = ("any_gram", "near_dup", "two_8grams", "exact", "short_line")
    return joined.groupBy(*task).agg(F.count("*").alias("records"), *[F.count_if(F.coalesce(F.col(x), F.lit(False))).alias(x) for x in flags])


def partition_priority(df: DataFrame, key: Column, priority: Column) -> DataFrame:
    """Rows of the highest priority among those with their key. The maximum is a partial aggregate and joins back by key."""
    keyed = df.withColumns({"__k": key, "__p": priority})
    top = keyed.groupBy("__k").agg(F.max("__p").alias("__m"))
    return keyed.join(top, "__k").where("__p = __m").drop("__k", "__p", "__m")


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The rank limit is applied before the exchange as well, so a frequent key moves a row a task."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
