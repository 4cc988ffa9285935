"""How far the sources of a language differ in their words, and which words make them differ.

Terms are counted by (language, source, term), on the bytes of the texts in batches of Arrow; a term's counts are then pivoted into one array with a place for every
source of its language, in the order of ``sources``. Every array carries the whole language for its term, so what two
sources contribute to their distance is a higher-order function over it: no row meets another. The contributions are
exploded and summed in the same stage, so an executor sends one row a pair of sources and task, and terms never meet
in one place.

Shares are whole numbers: ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, worked out by long division in two steps,
exact up to 9 * 10^13 occurrences.

Cases. Null texts, languages and sources count as ''. A text without terms still makes its group appear. A language
that keeps no term (V = 0) gives its pairs the value 0 and no terms. A language with one source has no pairs. Repeated
rows are documents of their own, ids aren't read. An empty table gives an empty result. Other columns are ignored.

What grows: a pivoted row with the sources of its language, the result with their square, as it lists every pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from verdigris.llm.workers import claim
from verdigris.storage import bounded, materialise

SCALE, PRIOR = 1_000_000_000, 5
#: SCALE as a product of the two steps of the division.
STEP_1, STEP_2 = 100_000, 10_000
#: Terms are runs of ASCII letters and of everything beyond ASCII, in UTF-8 [^\x00-\x40\x5B-\x60\x7B-\x7F]+: A-Z become a-z, other ASCII a blank.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: Distinct (language, source, term) that a task holds before it sends their counts on.
HELD_TERMS = 400_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    claim("divergence")

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            columns = [pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(docs.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            words = text.as_buffer().to_pybytes().translate(FOLD).split()
            if not words:
                continue
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(dict.fromkeys(words, 1).keys())  # in the order in which n got its keys
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents of the group that hold the term. Each task sums its
    own rows first, so a frequent term is a few rows a task."""
    source = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    each = source.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, divisor: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / divisor)."""
    top = (count + PRIOR) * STEP_1
    return (1 + F.call_function("div", top, divisor) * STEP_2 + F.call_function("div", (top % divisor) * STEP_2, divisor)).cast("long")


def _dense(entries: Column, width: Column) -> Column:
    """[n, 0, n, ...] of length ``width`` from entries (place, n) in ascending order of place."""
    parts = F.transform(entries, lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), x["place"] - F.coalesce(F.get(entries, i - 1)["place"], F.lit(-1)) - 1), F.array(x["n"])))
    return F.concat(F.flatten(parts), F.array_repeat(F.lit(0).cast("long"), width - 1 - F.element_at(entries, -1)["place"]))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank, as the module says; ``top`` terms a source, all pairs."""
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    groups = clean.select("lang", "source").distinct()
    places = materialise(groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")), "places")
    counts = term_counts(clean).join(bounded(places), ["lang", "source"])
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("entries"))
    kept = materialise(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "entries"), "terms")

    totals = kept.select("lang", F.explode("entries").alias("x")).groupBy("lang", F.col("x.place").alias("place")).agg(F.sum("x.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    wide = (
        places.join(totals, ["lang", "place"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
        .join(sizes, "lang", "left")
        .select("lang", F.col("x.source").alias("sources"), F.coalesce("v", F.lit(0)).alias("v"), F.transform("x", lambda x: x["n"] + PRIOR * F.coalesce("v", F.lit(0))).alias("divisors"), F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))
    )
    langs = bounded(wide)

    pivoted = kept.join(langs, "lang").select("lang", "term", "v", "n", "divisors", _dense(F.col("entries"), F.size("divisors")).alias("counts"))
    vectors = materialise(
        pivoted.select(
            "lang", "term", "counts",
            F.transform("counts", lambda c, i: share(c, F.get("divisors", i))).alias("p"),
            share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.col("n") + PRIOR * F.col("v")).alias("q"),
        ),
        "vectors",
    )

    # a term's contributions, one source's row of pairs after the other; summed before anything is sent
    rows = vectors.select("lang", "p", F.posexplode("p").alias("i", "own"))
    others = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x, k: F.struct((F.col("i") + 1 + k).alias("j"), F.abs(x - F.col("own")).alias("f")))
    sums = rows.select("lang", "i", F.explode(others).alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    apart = langs.where("v = 0").select("lang", F.posexplode("sources").alias("i", "s"), F.size("sources").alias("m"))
    none = apart.where("i + 1 < m").select("lang", "i", F.explode(F.sequence(F.col("i") + 1, F.col("m") - 1)).alias("j"), F.lit(0).cast("long").alias("value"))
    half = sums.unionAll(none)
    both = half.select("lang", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("x"), "value")
    pairs = both.join(langs.select("lang", "sources"), "lang").select("lang", F.get("sources", "x.own").alias("source"), F.lit("pair").alias("part"), F.get("sources", "x.other").alias("item"), "value")

    over = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), (x - F.col("q")).alias("f"), F.get("counts", i).alias("c"))), lambda x: (x["c"] > 0) & (x["f"] > 0))
    more = vectors.select("lang", "term", F.explode(over).alias("x")).join(langs.select("lang", "sources"), "lang")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = more.select("lang", F.get("sources", "x.i").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.f").alias("value"))
    told = told.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(told)
