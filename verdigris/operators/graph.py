"""Connected components and family roots over edge tables, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdigris.storage import discard, materialise


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step. The minimum of a node's neighbours is a partial aggregate; the join
    back to the edges is left to the optimiser, which can split a hub's rows."""
    pairs = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = pairs.join(low, F.col("a") == F.col("k"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b < a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder, so lineage
    stays short. Self-loops give components of one; null ends are ignored; repeated edges count once.
    """
    clean = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = materialise(clean.where("a = b").select(F.col("a").alias("node")).distinct(), "loops")
    current = materialise(clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        following = materialise(_star(_star(current, True), False), "edges")
        discard(current)
        current, after = following, _signature(following)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    linked = found.unionAll(roots.select("node", F.col("node").alias("component")))
    alone = nodes.join(linked.select("node"), "node", "left_anti")
    return linked.unionAll(alone.select("node", F.col("node").alias("component")))


def family_roots(df: DataFrame, id: str, parent: str, max_rounds: int = 40) -> DataFrame:
    """(id, root, depth): the end of each row's chain of parents, by pointer doubling, so a chain of n parents takes log n rounds.

    A parent that is no row ends a chain. Rows on a cycle, and those that lead into one, get a null root."""
    rows = df.select(F.col(id).alias("id"), F.col(parent).alias("up")).where("id is not null")
    known = rows.select(F.col("id").alias("k")).distinct()
    start = rows.join(known, F.col("up") == F.col("k"), "left").select("id", F.coalesce("k", "id").alias("at"), F.col("k").isNotNull().cast("long").alias("depth"))
    current = materialise(start, "roots")
    ends = current.where("at = id").select(F.col("id").alias("k"))  # the only true roots: on a cycle a pointer can come back to its own row
    longest = current.count()
    first = current
    for _ in range(max_rounds):
        ahead = current.select(F.col("id").alias("k"), F.col("at").alias("at2"), F.col("depth").alias("d2"))
        following = materialise(current.join(ahead, F.col("at") == F.col("k")).select("id", F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("at2") != F.col("at")).alias("moved")), "roots")
        if current is not first:
            discard(current)
        current = following
        if following.where(f"moved and depth <= {longest}").isEmpty():  # a longer chain than there are rows is a cycle
            break
    out = current.join(ends, F.col("at") == F.col("k"), "left")
    return out.select(F.col("id").alias(id), F.col("k").alias("root"), F.when(F.col("k").isNotNull(), F.col("depth")).alias("depth"))
