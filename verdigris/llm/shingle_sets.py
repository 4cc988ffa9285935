"""Near-duplicates by the exact Jaccard similarity of word-shingle sets.

Words are those of ``simhash``. Texts of equal shingle sets are one class. Candidates are classes whose SimHash fingerprints
differ in few bits, and classes that agree on one of ``BANDS`` bands of ``ROWS`` minimums each; a band is missed with
probability 1 - s ** ROWS at similarity s, all of them in 6 of 10,000 pairs at 0.8 and 3 of a million at 0.85. Candidates only
say which pairs are compared; the sets themselves decide, and only pairs of at least the asked similarity join.

Each class first meets one leader of its buckets, then, where a bucket is still open, the leaders of all of them; so a group of
copies that are all alike costs in proportion to its size. What is still open then is compared in blocks: the members of a bucket
are dealt to chunks of bounded size, each pair of chunks is a block of its own, and a task works out all intersections of a block
at once, as products of 0/1 matrices over the shingles that both chunks have. No row stands for a pair: a block emits a spanning
forest of the components it joins. The work is the square of a bucket that never closes, the rows that are moved its size times
its number of chunks. Buckets of equal members are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdigris.llm.simhash import _roots, near_duplicate_links, shingle_hashes, vote
from verdigris.llm.workers import claim
from verdigris.operators.graph import connected_components
from verdigris.storage import bounded, discard, materialise

BANDS, ROWS = 40, 8
#: Shingles whose minimums are taken at once.
AT_ONCE = 1024
#: Members and shingles of a chunk of a bucket, about; columns of a matrix of 0 and 1, and meetings of rare shingles, handled at once.
CHUNK_ROWS, CHUNK_SHINGLES, COLUMNS, MEETINGS = 2048, 1 << 20, 2048, 2_000_000
#: Rows that meet one copy of a leader's set; a leader of more is copied.
FOLLOWERS = 500


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def band_keys(shingles: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A signed 64-bit key of each band of a set of shingle hashes."""
    import xxhash

    odd, other = mixers
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), AT_ONCE):
        np.minimum(least, ((short[at : at + AT_ONCE] ^ other) * odd).min(axis=1), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[i * 4 * ROWS : (i + 1) * 4 * ROWS], i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _digest(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sets, of ``sets`` (digest, shingles), have a Jaccard similarity of ``least`` or more.

    A ``b`` of many rows is copied, so that its rows are compared in several tasks."""
    counted = pairs.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("copies")).where("copies > 1")
    many = bounded(counted)
    copies = F.coalesce("copies", F.lit(1))
    left = pairs.join(many, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), copies).cast("int")).drop("copies")
    led = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")).join(pairs.select("b").distinct(), "b", "left_semi")
    right = led.join(many, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    met = left.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a").join(right, ["b", "part"])
    compared = met.withColumn("both", F.size(F.array_intersect("x", "y")))
    return compared.where(F.col("both") / (F.size("x") + F.size("y") - F.col("both")) >= least).select(*pairs.columns)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each set of ``left`` shares with each of ``right``; a set's elements are distinct.

    Elements that many sets hold are columns of matrices that are multiplied; each meeting of the rarer ones is counted."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows, cols = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    held, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = at[: len(a)], at[len(a) :]
    often_a, often_b = np.bincount(in_a, minlength=len(held)), np.bincount(in_b, minlength=len(held))
    both = np.zeros((len(left), len(right)))
    dense = np.flatnonzero(often_a * often_b * 16 > both.size)
    column = np.full(len(held), -1)
    column[dense] = np.arange(len(dense))
    for start in range(0, len(dense), COLUMNS):
        sides = []
        for n, of, places in ((len(left), rows, column[in_a]), (len(right), cols, column[in_b])):
            some = (places >= start) & (places < start + COLUMNS)
            side = np.zeros((n, min(COLUMNS, len(dense) - start)), dtype=np.float32)
            side[of[some], places[some] - start] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    rare = np.where(column < 0, often_b, 0)
    own, other = rare[in_a] > 0, rare[in_b] > 0
    rows, in_a = rows[own], in_a[own]
    cols = cols[other][np.argsort(in_b[other], kind="stable")]
    first, width = (np.cumsum(rare) - rare)[in_a], rare[in_a]
    meetings = np.cumsum(width)
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(meetings, meetings[low] - width[low] + MEETINGS, "right")))
        w = width[low:high]
        met = np.repeat(first[low:high] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        both += np.bincount(np.repeat(rows[low:high], w) * len(right) + cols[met], minlength=both.size).reshape(both.shape)
        low = high
    return both


def _block_links(frame: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """A spanning forest (ca, cb) of the components that similar sets of each block join. ``frame`` is sorted by block; side 0 is
    compared with side 1, and side 2 with itself."""
    blocks, parts, sides, sets = (frame[c].to_numpy() for c in ("block", "component", "side", "shingles"))
    cuts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)]
    for low, high in zip(cuts, cuts[1:]):
        left, right = low + np.flatnonzero(sides[low:high] != 1), low + np.flatnonzero(sides[low:high] != 0)
        if not len(left) or not len(right) or (parts[low:high] == parts[low]).all():
            continue
        both = intersections([sets[i] for i in left], [sets[i] for i in right])
        sizes = [np.array([len(sets[i]) for i in side]) for side in (left, right)]
        i, j = np.nonzero(both / np.maximum(sizes[0][:, None] + sizes[1] - both, 1) >= least)
        known, place = np.unique(parts[low:high], return_inverse=True)
        root = _roots(len(known), iter([(place[left[i] - low], place[right[j] - low])]))
        some = np.flatnonzero(root != np.arange(len(known)))
        if len(some):
            yield pd.DataFrame({"ca": known[some], "cb": known[root[some]]})


def block_links(open_members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(ca, cb): links between the components of ``open_members`` (key, loose, digest, component, parts), whose closure is that of
    all pairs of a bucket with a Jaccard similarity of ``least`` or more."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("shingles")
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ended = int(np.searchsorted(held.block.to_numpy(), held.block.iloc[-1]))
            yield from _block_links(held.iloc[:ended], least)
            rest = held.iloc[ended:]
        if rest is not None:
            yield from _block_links(rest, least)

    chunk = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    dealt = open_members.withColumn("chunk", chunk).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("chunk") == F.col("with"), 2).when(F.col("chunk") < F.col("with"), 0).otherwise(1)
    block = F.xxhash64("key", "loose", F.least("chunk", "with"), F.greatest("chunk", "with"))
    met = dealt.select("digest", "component", side.alias("side"), block.alias("block")).join(sets, "digest")
    sorted_blocks = met.select("block", "side", "component", "shingles").repartition("block").sortWithinPartitions("block")
    return sorted_blocks.mapInPandas(compared, "ca long, cb long")


def _joined(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(digest, component) of the members of buckets, over all candidate pairs of similarity ``least`` or more."""

    def merge(components: DataFrame, links: DataFrame) -> DataFrame:
        """Components after those that ``links`` (ca, cb) names are joined."""
        links = materialise(links, "links")
        if links.isEmpty():
            return components
        found = connected_components(links, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("smallest"))
        after = materialise(components.join(found, "component", "left").select("digest", F.coalesce("smallest", "component").alias("component")), "joined")
        for used in (links, components):
            discard(used)
        return after

    def met(components: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        after = merge(components, similar_pairs(pairs, sets, least).select("ca", "cb").distinct())
        discard(pairs)
        return after

    def still_open(components: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets that hold several components, with those, and a row of each such bucket."""
        now = members.join(components, "digest")
        told = [F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor("digest").alias("x"), F.sum(F.pmod(F.xxhash64("digest"), F.lit(1 << 40))).alias("s")]
        led = F.max(F.when(F.col("digest") == F.col("leader"), F.col("component"))).alias("cb")
        return now, now.groupBy("key", "loose").agg(F.min("component").alias("one"), F.max("component").alias("other"), led, *told).where("one < other")

    components = materialise(members.select("digest", F.col("digest").alias("component")).distinct(), "joined")
    first = members.where("digest <> leader").groupBy(F.col("digest").alias("a")).agg(F.min("leader").alias("b"))
    components = met(components, first.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    now, apart = still_open(components)
    led = now.join(bounded(apart.select("key", "loose", "cb")), ["key", "loose"]).where("component <> cb")
    components = met(components, led.select(F.col("digest").alias("a"), F.col("leader").alias("b"), F.col("component").alias("ca"), "cb").distinct())
    now, apart = still_open(components)
    # buckets of equal members are one
    once = apart.groupBy("m", "total", "x", "s").agg(F.min(F.struct("key", "loose")).alias("of"))
    parts = F.greatest(F.ceil(F.col("m") / CHUNK_ROWS), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    blocks = bounded(once.select("of.key", "of.loose", parts.alias("parts")))
    return merge(components, block_links(now.join(blocks, ["key", "loose"]), sets, least).distinct())


def shingle_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest id reachable over pairs whose sets of ``words``-word shingles have a
    Jaccard similarity of ``least`` or more. Texts of fewer words are one shingle; those of none are all equal.

    Null ids take no part in naming: their component is that of their set, or null if no row has an id there."""
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("shingles")
        mixers = _mixers()
        for batch in batches:
            digests, prints, bands, sizes = [], [], [], []
            for x in batch.text.array:
                hashes = shingle_hashes(x, words)
                distinct = np.unique(hashes)
                digests.append(_digest(distinct))
                prints.append(vote(hashes))
                bands.append(band_keys(distinct, mixers))
                sizes.append(len(distinct))
            yield pd.DataFrame({"doc_id": batch.doc_id, "digest": digests, "n": sizes, "fp": np.array(prints, dtype=np.uint64).view(np.int64), "bands": bands})

    kind = source.schema["doc_id"].dataType.simpleString()
    sketches = materialise(source.mapInPandas(sketched, f"doc_id {kind}, digest long, n long, fp long, bands array<long>"), "sketches")
    known = sketches.where("doc_id is not null")
    firsts_of = [F.first(c).alias(c) for c in ("n", "fp", "bands")]
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), *firsts_of), "classes")

    # the buckets: a band's key, and the fingerprints that are linked to each other
    firsts = classes.groupBy("fp").agg(F.min("digest").alias("rep"))
    linked = connected_components(near_duplicate_links(firsts, bits)).withColumnsRenamed({"node": "rep"})
    by_print = firsts.join(linked, "rep", "left").select("fp", F.coalesce("component", "rep").alias("key"))
    banded = classes.select("digest", "n", F.explode("bands").alias("key"), F.lit(False).alias("loose"))
    keyed = banded.unionByName(classes.join(by_print, "fp").select("digest", "n", "key", F.lit(True).alias("loose")))
    shared = keyed.groupBy("key", "loose").agg(F.count("*").alias("m"), F.min("digest").alias("leader")).where("m > 1").drop("m")
    members = materialise(keyed.join(shared, ["key", "loose"]), "members")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("shingles")
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, words)) for x in batch.text.array]
            # an id that was given twice brings a text of another class along
            own = [i for i, (s, d) in enumerate(zip(sets, batch.digest.array)) if _digest(s) == d]
            yield pd.DataFrame({"digest": batch.digest.iloc[own].to_numpy(), "shingles": [sets[i].view(np.int64) for i in own]})

    wanted = classes.join(members.select("digest").distinct(), "digest").select("digest", F.col("rep").alias("doc_id"))
    texts = source.join(wanted, "doc_id").select("digest", "text")
    sets = materialise(texts.mapInPandas(gathered, "digest long, shingles array<long>").dropDuplicates(["digest"]), "sets")
    found = _joined(members, sets, least)
    least_id = found.join(classes.select("digest", "rep"), "digest").groupBy("component").agg(F.min("rep").alias("smallest"))
    ends = found.join(least_id, "component").select("digest", "smallest")
    named = materialise(classes.select("digest", "rep").join(ends, "digest", "left").select("digest", F.coalesce("smallest", "rep").alias("component_id")), "components")
    for used in (members, sets, classes, found):
        discard(used)
    return sketches.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "component_id")
