"""Document fingerprints by randomised edit embedding, and duplicates by bit-sampled bands of them.

A walk reads a text's code points one by one and stays on each for a number of steps that shared random bits give for
(step, character). Two texts walk together until they differ; after an edit their walks meet again soon, so few edits
change few steps: edit distance becomes Hamming distance between the strings of visited characters. As an unlucky edit can
keep a walk apart for long, there are several walks with random bits of their own, and a long text is walked in segments, cut
where its characters say so, each of which starts at a step of its own: after an edit the next segment is walked as before. Per walk the fingerprint keeps a sample of the steps, those whose shared random rank is
lowest among the steps the walk took: so a text of another length samples mostly the same steps. Per sampled step it holds a byte
of the characters from there on.

``likeness`` compares two fingerprints walk by walk, over the lowest ranks of both, corrects for bytes that agree by chance, and
takes the walk that agrees most. Equal texts have equal fingerprints. Empty and null texts take no step and have the empty sample; two of
these have likeness 1, and one with any other text 0.

Segments of many texts advance together in numpy; texts of any length are walked whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verdigris.llm.workers import claim
from verdigris.operators.graph import connected_components
from verdigris.storage import materialise

#: Walks, sampled steps of each, characters hashed at each, kinds of characters that stay differently long, and the period of the shared bits.
WALKS, SAMPLES, SPAN, KINDS, PERIOD = 4, 64, 4, 16, 1 << 14
#: Characters that decide on a cut, characters before a text's first cut at least, from cut to cut on average and at most, and the
#: grid of steps that segments start at.
WINDOW, LEAST, APART, LONGEST, CELL = 16, 4096, 8192, 32_768, 8192
#: Steps of lowest rank within a power of two that bands choose from; walks of up to four times the power sample nearly all of them.
POOL = 12
#: Code points walked together in a worker.
PORTION = 4_000_000


def shared_bits(walk: int) -> np.ndarray:
    """bits[kind, step % PERIOD]: whether this walk moves on after this step on a character of this kind."""
    bits = np.random.Generator(np.random.PCG64(20 + walk)).integers(0, 2, (KINDS, PERIOD), dtype=np.uint8)
    bits[:, 0] = 1
    return bits


def _stays(walk: int) -> np.ndarray:
    """stay[kind * PERIOD + step % PERIOD]: steps until the walk moves on."""
    bits = shared_bits(walk)
    twice = np.concatenate([bits, bits], axis=1)
    ahead = np.zeros((KINDS, 2 * PERIOD), dtype=np.uint16)
    at = np.full(KINDS, 2 * PERIOD)
    for step in range(2 * PERIOD - 1, -1, -1):
        at = np.where(twice[:, step] == 1, step, at)
        ahead[:, step] = at - step + 1
    return ahead[:, :PERIOD].ravel().copy()


def kind_of(codes: np.ndarray) -> np.ndarray:
    """The kind of each code point."""
    return ((codes.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.int32)


def segments(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, origin, room) of the segments that texts are walked in, in the order of ``codes``: where each lies, the step that its
    walk starts at, and the steps before the next one's.

    A text is cut where a hash of the ``WINDOW`` characters before says so, so that the cuts after an edit stay at the same characters.
    A segment starts at the first multiple of ``CELL`` steps from its position on; so when an edit moves it by some characters it nearly always
    starts at the same step. Of the cuts of one cell the first counts, none does in the first ``LEAST`` characters, and what would be longer than ``LONGEST`` is cut there too."""
    hashed, width = codes.astype(np.uint32), 1
    while width < WINDOW:
        before = np.r_[np.zeros(min(width, len(hashed)), np.uint32), hashed[:-width]]
        hashed = hashed * np.uint32(0x85EBCA6B) + before * np.uint32(0xC2B2AE35) + np.uint32(width)
        width *= 2
    hashed = (hashed ^ (hashed >> np.uint32(16))) * np.uint32(0x2C1B3C6D)
    last = np.flatnonzero(hashed < np.uint32((1 << 32) // APART))  # the last character before a cut
    text = np.searchsorted(starts + sizes, last, side="right")
    place = last + 1 - starts[text]
    inside = (place >= LEAST) & (place < sizes[text])
    text, place = text[inside], place[inside]
    cell = _origin(place)
    new = np.r_[True, (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])][: len(text)]
    full = np.flatnonzero(sizes)
    text, place = np.r_[full, text[new]], np.r_[np.zeros(len(full), np.int64), place[new]]
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    ends = np.where(np.r_[text[1:] == text[:-1], False][: len(text)], np.r_[place[1:], 0][: len(text)], sizes[text])
    parts = -(-(ends - place) // LONGEST)
    of = np.repeat(np.arange(len(text)), parts)
    place = place[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
    text, ends = text[of], ends[of]
    origin = _origin(place)
    # a part that was cut for its length may start in the cell of the cut that follows; it has no room then
    after = np.r_[text[1:] == text[:-1], False][: len(text)]
    room = np.where(after, np.r_[origin[1:], 0][: len(text)] - origin, np.int64(1) << 31)
    return starts[text] + place, np.minimum(ends - place, LONGEST), origin, room


def _origin(place: np.ndarray) -> np.ndarray:
    """The first multiple of CELL from 17/8 steps a character on: a character takes two on average."""
    return -(-(place * 17) // (8 * CELL)) * CELL


#: (steps, sampled bytes) of each walk.
Fingerprint = list[tuple[int, np.ndarray]]


class Walker:
    """Walks batches of texts. One per worker."""

    def __init__(self) -> None:
        self.stays = [_stays(w) for w in range(WALKS)]
        self.prefixes: dict[tuple[int, int], np.ndarray] = {}
        self.sampled: dict[tuple[int, int], np.ndarray] = {}

    def steps(self, steps: int, walk: int) -> np.ndarray:
        """The sampled steps of a walk of this many steps, ascending. Ranks are a fixed mix of the step's number, and
        lowest ranks are taken among power-of-two prefixes first, so no more than a few samples' worth is ranked."""
        if steps <= SAMPLES:
            return np.arange(steps)
        known = self.sampled.get((steps, walk))
        if known is not None:
            return known
        size = 1 << (int(steps) - 1).bit_length()
        if (size, walk) not in self.prefixes:
            ranks = _rank(np.arange(size, dtype=np.uint64), walk)
            low = np.argpartition(ranks, min(size - 1, 12 * SAMPLES))[: 12 * SAMPLES + 1]
            self.prefixes[size, walk] = low[np.argsort(ranks[low], kind="stable")]
        near = self.prefixes[size, walk]
        if len(self.sampled) > 100_000:
            self.sampled.clear()
        self.sampled[steps, walk] = found = np.sort(near[near < steps][:SAMPLES])
        return found

    def walk(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """For each walk the step at which each code point is left; texts lie one after another in ``codes``."""
        begin, size, origin, room = segments(codes, starts, sizes)
        order = np.argsort(-size, kind="stable")
        begin, size, origin, room = begin[order], size[order], origin[order], room[order]
        # laid by turn: the k-th characters of all segments that have one lie side by side
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        turns = np.r_[0, np.cumsum(alive)]
        lane = np.repeat(np.arange(len(size)), size)
        turn = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        source, laid = begin[lane] + turn, turns[turn] + lane
        kinds = np.empty(len(codes), np.int32)
        kinds[laid] = kind_of(codes)[source] * PERIOD
        first = (origin % PERIOD).astype(np.int32)
        # all walks take a turn together: their tables lie one after another
        tables = np.concatenate(self.stays)
        table = (np.arange(WALKS, dtype=np.int32) * (KINDS * PERIOD))[:, None]
        now, left, seat = np.tile(first, (WALKS, 1)), np.empty((WALKS, len(codes)), np.int32), np.empty((WALKS, len(size)), np.int32)
        for at, n in zip(turns.tolist(), alive.tolist()):
            step, look = now[:, :n], seat[:, :n]
            np.bitwise_and(step, PERIOD - 1, out=look)
            look += kinds[at : at + n]
            look += table
            step += tables[look]
            left[:, at : at + n] = step
        out = []
        for walked in left:
            own = np.empty(len(codes), np.int64)
            own[source] = np.minimum(walked[laid] - first[lane], room[lane] - 1) + origin[lane]
            out.append(own)
        return out

    def fingerprints(self, texts: list[str]) -> Iterator[Fingerprint]:
        raw = [x.encode("utf-32-le", "surrogatepass") for x in texts]
        sizes = np.array([len(x) // 4 for x in raw], dtype=np.int64)
        codes = np.frombuffer(b"".join(raw), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        walks = self.walk(codes, starts, sizes)
        hashed = np.zeros(len(codes), dtype=np.uint32)
        for k in range(SPAN):
            hashed = hashed * np.uint32(0x01000193) + np.r_[codes[k:], np.zeros(min(k, len(codes)), codes.dtype)].astype(np.uint32) + np.uint32(1)
        hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(24)).astype(np.uint8)
        # at a text's end the hash would read into the next text
        ends = starts + sizes
        for i in np.flatnonzero(sizes).tolist():
            for j in range(max(int(starts[i]), int(ends[i]) - SPAN + 1), int(ends[i])):
                hashed[j] = hashlib.blake2b(codes[j : ends[i]].tobytes(), digest_size=1).digest()[0]
        for a, b in zip(starts.tolist(), ends.tolist()):
            own = []
            for w, left in enumerate(walks):
                steps = int(left[b - 1]) if b > a else 0
                own.append((steps, hashed[a + np.searchsorted(left[a:b], self.steps(steps, w), side="right")]))
            yield own


def _rank(step: np.ndarray, walk: int) -> np.ndarray:
    x = (step * np.uint64(WALKS) + np.uint64(walk + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WALKER: list[Walker] = []


def walker() -> Walker:
    claim("edit", _WALKER.clear)
    if not _WALKER:
        _WALKER.append(Walker())
    return _WALKER[0]


def render(own: Fingerprint) -> str:
    """A fingerprint as text: for each walk its steps in 8 hex digits, then two for each sampled step; a full stop between walks."""
    return ".".join(f"{steps:08x}{sampled.tobytes().hex()}" for steps, sampled in own)


def _parse(fingerprint: str) -> Fingerprint:
    return [(int(x[:8], 16), np.frombuffer(bytes.fromhex(x[8:]), np.uint8)) for x in fingerprint.split(".")]


def _agreement(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal bytes over the steps that either sample holds with a rank below both samples' bounds; x and y are the samples' steps."""
    if a[0] == b[0]:
        return float((a[1] == b[1]).sum()) / len(a[1])
    if a[0] > b[0]:
        a, b, x, y = b, a, y, x
    # the longer walk's sample within the shorter walk is part of the shorter walk's sample
    inside = y < a[0]
    return float((a[1][np.searchsorted(x, y[inside])] == b[1][inside]).sum()) / len(y)


def likeness(a: Fingerprint, b: Fingerprint, steps_of) -> float:
    """0 to 1: the agreement of the walk that agrees most, without what agrees by chance."""
    if not a[0][0] or not b[0][0]:
        return float(a[0][0] == b[0][0])
    share = max(_agreement(p, q, steps_of(p[0], w), steps_of(q[0], w)) for w, (p, q) in enumerate(zip(a, b)))
    return max(0.0, min(1.0, (share - 1 / 256) / (1 - 1 / 256)))


def _portions(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += size(row)
        if total >= PORTION:
            yield part
            part, total = [], 0
    if part:
        yield part


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    @F.pandas_udf("string")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            found: list[str] = []
            for part in _portions((("" if x is None else x,) for x in column.array), lambda r: len(r[0])):
                found += [render(f) for f in walker().fingerprints([x for (x,) in part])]
            yield pd.Series(found, dtype=object)

    return df.withColumn(out, fingerprint(F.col(text)))


def edit_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 24, width: int = 5) -> DataFrame:
    """(doc_id, class_id, links): documents joined where a band of bit-sampled fingerprint bytes agrees and the whole
    fingerprints' likeness is at least ``least``. Equal fingerprints form one class first. In a band's bucket a row is measured against
    each group of joined rows until one of its members is like it, so no join within a bucket is lost, and a bucket of rows that
    are all alike costs in proportion to its size. A bucket's distinct fingerprints, some 500 bytes each, are held by one task.
    ``links`` counts the links that were used to join."""
    prints = materialise(with_fingerprint(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fingerprint"), "edit-prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = np.random.Generator(np.random.PCG64(11))
        # each band looks at other steps of a walk's pool
        picks = np.array([draw.permutation(POOL)[:width] for _ in range(bands)])
        pools: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = []
            for rep, fp in zip(batch.rep.array, batch.fingerprint.array):
                for w, (steps, own) in enumerate(_parse(fp)):
                    if not steps:
                        rows.append((w, "", rep, fp))
                        break
                    sampled = walker().steps(steps, w)
                    # walks of up to twice the length share the lower of their classes, and in it the steps looked at
                    longest = steps.bit_length() - 1
                    for size in range(max(0, longest - 1), longest + 1):
                        if (size, w) not in pools:
                            near = walker().steps(1 << size, w)
                            pools[size, w] = near[np.argsort(_rank(near.astype(np.uint64), w), kind="stable")][:POOL]
                        pool = pools[size, w]
                        at = np.minimum(np.searchsorted(sampled, pool), len(sampled) - 1)
                        seen = np.where(sampled[at] == pool, own[at], 0).astype(np.uint8)
                        for band in range(w, bands, WALKS):
                            rows.append((band, f"{size:02x}{seen[picks[band] % len(pool)].tobytes().hex()}", rep, fp))
            yield pd.DataFrame(rows, columns=["band", "key", "rep", "fingerprint"])

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, joined = None, []
        for batch in batches:
            rows = []
            for band, key, rep, fp in zip(batch.band.array, batch.key.array, batch.rep.array, batch.fingerprint.array):
                if (band, key) != bucket:
                    bucket, joined = (band, key), []
                own, before, apart = (int(rep), _parse(fp)), [], []
                for group in joined:
                    met = next((m for m in group if likeness(own[1], m[1], walker().steps) >= least), None)
                    if met:
                        rows.append((int(rep), met[0]))
                        before = before + group
                    else:
                        apart.append(group)
                joined = [*apart, [*before, own]]
            yield pd.DataFrame(rows, columns=["a", "b"])

    keyed = classes.where("rep is not null").mapInPandas(banded, "band int, key string, rep long, fingerprint string")
    edges = keyed.repartition("band", "key").sortWithinPartitions("band", "key", "fingerprint").mapInPandas(verified, "a long, b long").distinct()
    edges = materialise(edges, "edit-edges")
    joined = connected_components(edges).withColumnsRenamed({"node": "rep", "component": "joined"})
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = classes.join(joined, "rep", "left").join(degree, "rep", "left").select("fingerprint", F.coalesce("joined", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return prints.join(named, "fingerprint").select("doc_id", "class_id", "links")


def _ranges(source: DataFrame, parts: int) -> tuple[Column, Column, list[int]]:
    """(bucket, place within it) for (doc_id, tie): ranges of ids with about as many rows each. An id that spans several ranges is dealt to
    as many by its tie. Cuts lie in blocks, so that a row looks at the square root of their number."""
    cuts = sorted(int(x) for x in source.approxQuantile("known", [i / parts for i in range(1, parts)], 0.2 / parts))
    block = max(1, math.isqrt(len(cuts)))
    low, every = F.from_json(F.lit(str(cuts[::block])), "array<bigint>"), F.from_json(F.lit(str(cuts)), "array<bigint>")

    def count(below) -> Column:
        whole = F.greatest(F.size(F.filter(low, below)) - 1, F.lit(0)) * block
        return whole + F.size(F.filter(F.slice(every, whole + 1, block), below))

    under, upto = count(lambda c: c < F.col("known")), count(lambda c: c <= F.col("known"))
    tie = F.pmod(F.col("tie"), F.lit(1 << 31)) / float(1 << 31)
    own = F.when(upto - under <= 1, upto).otherwise(under + 1 + F.floor(tie * (upto - under)).cast("int"))
    return (own if cuts else F.lit(0)).cast("int").alias("bucket"), F.pmod(F.col("tie"), F.lit(1 << 31)).alias("tie"), cuts


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document beside its edited text and its successor.

    Documents are dealt to ranges of their id, once and with their text; the first document of each range also goes to
    the range before it, so that every row meets its successor. The last document's successor is the first one. Null
    ids come first, and rows of one id are ordered by a hash of their text, so that a frequent id is dealt to several ranges; repeated rows are
    each other's successors. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = source.withColumns({"known": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    bucket, tie, cuts = _ranges(keyed, parts)
    placed = keyed.select("doc_id", "text", "known", bucket, tie)
    # the first row of every range that has one: at most `parts` rows
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("known", "tie")).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], OUT)
    before = {r["bucket"]: (r["first"]["known"], r["first"]["tie"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
    told = F.from_json(F.lit(str([list(before.get(b, (0, -1, 0))) for b in range(len(cuts) + 1)])), "array<array<bigint>>")
    own = F.get(told, F.col("bucket"))
    leads = (F.get(own, F.lit(0)) == F.col("known")) & (F.get(own, F.lit(1)) == F.col("tie"))
    home = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    homes = F.when(leads, F.array(home(F.col("bucket"), 0), home(F.get(own, F.lit(2)), 1))).otherwise(F.array(home(F.col("bucket"), 0)))
    dealt = placed.select("doc_id", "text", "tie", F.explode(homes).alias("home")).select("doc_id", "text", "tie", "home.bucket", "home.guest")
    laid = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return laid.select("doc_id", "text", "bucket", "guest").mapInPandas(_compare, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def pairs() -> Iterator[tuple]:
        """(doc_id, text, successor's text); a range's guests are the candidates for its last row's successor, the first of them in order."""
        held = None
        for batch in batches:
            for bucket, guest, doc, x in zip(batch.bucket.array, batch.guest.array, batch.doc_id.array, batch.text.array):
                if held and held[0] == bucket:
                    yield held[1], held[2], x
                held = None if guest else (bucket, doc, x)

    for part in _portions(pairs(), lambda r: 2 * len(r[1])):
        texts, edited = [], []
        for _, x, follower in part:
            half = len(x) // 2
            texts.append(x)
            edited.append(x[: len(x) - half] + follower[:half])
        both = list(walker().fingerprints(texts + edited))
        own, other = both[: len(texts)], both[len(texts) :]
        after = own[1:] + list(walker().fingerprints([part[-1][2]]))
        breaks = [i for i in range(len(part) - 1) if part[i][2] is not part[i + 1][1] and part[i][2] != part[i + 1][1]]
        for i in breaks:
            after[i] = next(walker().fingerprints([part[i][2]]))
        yield pd.DataFrame(
            {
                "doc_id": pd.array([None if d is None or d != d else int(d) for d, _, _ in part], dtype="Int64"),
                "n_chars": [len(x) for x in texts],
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": [render(f) for f in own],
                "edited_fingerprint": [render(f) for f in other],
                "near_edited": [likeness(a, b, walker().steps) for a, b in zip(own, other)],
                "near_next": [likeness(a, b, walker().steps) for a, b in zip(own, after)],
            }
        )
