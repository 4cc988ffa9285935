"""Wrong answers drawn from a large pool: k different ones for each row, by seed, never one that could be taken for the row's own.

The cleaned pool is numbered. A row walks over the numbers from a start of its own in steps of its own, modulo the smallest
prime that isn't below the pool's size, and so meets every entry once, in an order that only the seed and its id decide. A walk
is a join on the number; a few steps do for most rows, and those that lack draws after them go on with twice as many. So no
row meets the whole pool unless nearly all of it is barred, and a row gets fewer than k only if the pool has no more for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.storage import discard, materialise

#: How long an entry may be, and the one that stands for unknown.
LONGEST, UNKNOWN = 128, "__unknown__"


def norm(text: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-cased text, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def conflicts(a: Column, b: Column) -> Column:
    """Whether two normalised texts can be taken for each other: one says nothing, they are equal, one is within the other, or one's words are all the other's."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (a == "") | (b == "") | a.contains(b) | b.contains(a) | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def clean_pool(pool: DataFrame, text: str) -> DataFrame:
    """(text, n): usable entries, of those with the same normalised text n the smallest; trimmed, not empty, of at most 128 characters."""
    trimmed = pool.select(F.trim(F.col(text).cast("string")).alias("text"))
    kept = trimmed.where((F.length("text") > 0) & (F.length("text") <= LONGEST) & (F.col("text") != UNKNOWN)).withColumn("n", norm(F.col("text")))
    return kept.where("n <> ''").groupBy("n").agg(F.min("text").alias("text")).select("text", "n")


def numbered_pool(pool: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(number, text, n) in the order of the SHA-256 of n, and how many there are. Ranges of the digest are numbered apart."""
    hashed = materialise(clean_pool(pool, text).withColumn("h", F.sha2("n", 256)).withColumn("r", F.substring("h", 1, 3)), "pool")
    sizes = hashed.groupBy("r").agg(F.count("*").alias("m"))  # at most 4,096 rows
    before = sizes.select("r", (F.sum("m").over(Window.orderBy("r")) - F.col("m")).alias("b"))
    out = hashed.join(F.broadcast(before), "r").select((F.col("b") + F.row_number().over(Window.partitionBy("r").orderBy("h")) - 1).alias("number"), "text", "n")
    return materialise(out, "numbered"), hashed.count()


def _prime(n: int) -> int:
    """The smallest prime from n on, 2 at least."""
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def _hashed(seed: str, what: str, id: Column, modulus: int) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(what), id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus


def draw(rows: DataFrame, id: str, gold: str | None, pool: DataFrame, text: str, k: int, seed: str = "pool") -> DataFrame:
    """(id, place, distractor): up to k entries for each row of ``rows``, places from 1.

    None conflicts with the row's gold (see ``conflicts``) and none comes twice in a row, by normalised text. A null gold bars nothing; a
    gold without letters or figures bars all. Ids must differ; null ids have no draws. An empty pool gives none."""
    entries, size = numbered_pool(pool, text)
    prime = _prime(size)
    own = F.lit(None).cast("string") if gold is None else norm(F.col(gold))
    start, step = _hashed(seed, "start", F.col(id), prime), _hashed(seed, "step", F.col(id), prime - 1) + 1
    open_ = materialise(rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), own.alias("own"), start.alias("start"), step.alias("step"), F.lit(0).alias("have")), "open")
    found, at, steps = None, 0, 2 * k + 4
    while size and at < prime:
        to = min(prime, at + steps)
        walk = open_.select("*", F.explode(F.sequence(F.lit(at), F.lit(to - 1))).alias("attempt"))
        met = walk.withColumn("number", (F.col("start") + F.col("step") * F.col("attempt")) % prime).join(entries, "number")
        free = met.where(F.col("own").isNull() | ~conflicts(F.col("own"), F.col("n")))
        placed = free.withColumn("place", F.col("have") + F.row_number().over(Window.partitionBy("id").orderBy("attempt"))).where(F.col("place") <= k)
        drawn = materialise(placed.select("id", "place", F.col("text").alias("distractor")), "drawn")
        found = drawn if found is None else found.unionAll(drawn)
        got = drawn.groupBy("id").agg(F.count("*").alias("more"))
        following = materialise(open_.join(got, "id", "left").withColumn("have", F.col("have") + F.coalesce("more", F.lit(0)).cast("int")).drop("more").where(F.col("have") < k), "open")
        discard(open_)
        open_, at, steps = following, to, 2 * steps
        if open_.isEmpty():
            break
    if found is None:
        found = open_.select("id", F.lit(0).alias("place"), F.lit("").alias("distractor")).limit(0)
    return found.select(F.col("id").alias(id), F.col("place").cast("int").alias("place"), "distractor")
