"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words are lower-cased (A-Z only), cut at ASCII white space and joined to shingles; each shingle's XXH64
(seed 42) votes on 64 bits. Texts with fewer words than a shingle are one shingle; texts with no word, and null texts,
have fingerprint zero and link like any other.

Links: two fingerprints link if at most ``bits`` of their 64 bits differ. The search works on distinct fingerprints,
each standing for its documents by the smallest id, so copies cost nothing. By the pigeonhole rule a linked pair
agrees on one of ``bits + 1`` blocks of the fingerprint; rows are dealt by (block, its value). Within a dealt group
the fingerprints are sorted by Gray rank, and runs of neighbours become the nodes of a hierarchy: a node keeps the
mask of bits that all below it share, and their pattern. A query walks down, adding at each level only the
differences on bits that its ancestors did not share; above the limit the whole group is pruned, and where even the
unshared bits cannot exceed the limit the whole group is linked at once. What leaves a task is a spanning forest of
its links, never all pairs; components are then found by star contraction over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdigris.llm.workers import claim
from verdigris.operators.graph import connected_components
from verdigris.storage import materialise

#: Children of a node of the index, and (query, node) pairs examined at once in a worker.
FANOUT, CHUNK = 8, 400_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, in order; none where it has no word."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(tokens), len(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], dtype=np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_text(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    return vote(shingle_hashes(text, words))


def with_fingerprint(df: DataFrame, text: str, words: int = 4, out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("simhash")
        for column in batches:
            yield pd.Series(np.array([fingerprint_text(x, words) for x in column.array], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, fingerprint(F.col(text)))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies of masked patterns, one over each group of codes. ``group`` must be non-decreasing."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[self.order], group[self.order]
        #: levels[0] are the codes themselves; each level: mask, pattern, first child, end of children
        n = len(codes)
        first = np.arange(n, dtype=np.int64)
        levels = [(np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), self.codes, first, first + 1)]
        owner = self.group
        while True:
            mask, pattern = levels[-1][:2]
            m = len(mask)
            starts_group = np.r_[True, owner[1:] != owner[:-1]]
            if starts_group.all():
                break
            group_at = np.maximum.accumulate(np.where(starts_group, np.arange(m), 0))
            cut = np.flatnonzero((np.arange(m) - group_at) % FANOUT == 0)
            ends = np.r_[cut[1:], m]
            low, high = np.bitwise_and.reduceat(pattern, cut), np.bitwise_or.reduceat(pattern, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~(low ^ high)
            levels.append((shared, low & shared, cut, ends))
            owner = owner[cut]
        self.levels, self.roots = levels, owner
        #: the first and last code below a node of each level
        self.first = [np.arange(n)]
        for _, _, a, _ in levels[1:]:
            self.first.append(self.first[-1][a])

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (in index order) whose closure under 'is linked to' is that of all links within groups.

        Where a whole node links to a query and the node's codes are certain to link to each other, only its first
        code is paired with the query; such nodes are chained once.
        """
        n, top = len(self.codes), len(self.levels) - 1
        chained = []
        for level in range(1, top + 1):
            mask, _, a, b = self.levels[level]
            dense = np.flatnonzero(np.bitwise_count(~mask) <= bits)
            for c in range(1, FANOUT):
                some = dense[a[dense] + c < b[dense]]
                chained.append((self.first[level][some], self.first[level - 1][a[some] + c]))
        yield from chained
        root_of = np.searchsorted(self.roots, self.group)
        for at in range(0, n, 20_000):
            query = np.arange(at, min(n, at + 20_000))
            yield from self._descend(query, root_of[query], np.zeros(len(query), np.uint8), top, np.zeros(len(query), np.uint64), bits)

    def _descend(self, query, node, so_far, level, above, bits):
        stack = [(query, node, so_far, level, above)]
        while stack:
            query, node, so_far, level, above = stack.pop()
            if len(query) > CHUNK:
                half = len(query) // 2
                stack += [(query[s], node[s], so_far[s], level, above[s]) for s in (slice(None, half), slice(half, None))]
                continue
            mask, pattern, a, b = self.levels[level]
            own = mask[node]
            so_far = so_far + np.bitwise_count((self.codes[query] ^ pattern[node]) & own & ~above)
            keep = so_far <= bits
            query, node, so_far, own = query[keep], node[keep], so_far[keep], own[keep]
            free = np.bitwise_count(~own)
            whole = (so_far + free <= bits) & (free <= bits)
            yield query[whole], self.first[level][node[whole]]
            if level == 0:
                continue
            rest = ~whole
            # only codes that stand at or before the query are looked at: a link is found from its later end
            query, node, so_far, own = query[rest], node[rest], so_far[rest], own[rest]
            width = b[node] - a[node]
            child = np.repeat(a[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            query, so_far, own = np.repeat(query, width), np.repeat(so_far, width), np.repeat(own, width)
            before = self.first[level - 1][child] <= query
            stack.append((query[before], child[before], so_far[before], level - 1, own[before]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each of n positions, keeping only the forest while pairs stream by."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            some = x != y
            a, b, x, y = a[some], b[some], x[some], y[some]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root = jumped
    return root


def _forest(bits: int, blocks: int):
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One edge from each fingerprint's document to its local root, over all groups dealt to this partition."""
        parts = [(x.fp.to_numpy(), x.rep.to_numpy(), x.block.to_numpy()) for x in batches if len(x)]
        if not parts:
            return
        fp, rep, block = (np.concatenate(c) for c in zip(*parts))
        codes = fp.view(np.uint64)
        value = (codes >> _shift(blocks)[block]) & _width(blocks)[block]
        order = np.lexsort((value, block))
        codes, rep, block, value = codes[order], rep[order], block[order], value[order]
        group = np.cumsum(np.r_[False, (block[1:] != block[:-1]) | (value[1:] != value[:-1])])
        index = GrayIndex(codes, group)
        ids = rep[index.order]
        root = _roots(len(ids), index.links(bits))
        some = np.flatnonzero(root != np.arange(len(ids)))
        yield pd.DataFrame({"a": ids[some], "b": ids[root[some]]})

    return forest


def _bounds(blocks: int) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def _shift(blocks: int) -> np.ndarray:
    return np.array(_bounds(blocks)[:-1], dtype=np.uint64)


def _width(blocks: int) -> np.ndarray:
    at = _bounds(blocks)
    return np.array([(1 << (b - a)) - 1 for a, b in zip(at, at[1:])], dtype=np.uint64)


def near_duplicate_links(classes: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) between class representatives (``rep``) whose closure joins all fingerprints (``fp``) that differ in
    at most ``bits`` bits. ``classes`` has one row per distinct fingerprint."""
    blocks = bits + 1
    at = _bounds(blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", at[i]).bitwiseAND((1 << (at[i + 1] - at[i])) - 1).alias("value")) for i in range(blocks)])
    dealt = classes.select("fp", "rep", F.explode(keys).alias("key")).select("fp", "rep", "key.block", "key.value")
    return dealt.repartition("block", "value").select("fp", "rep", "block").mapInPandas(_forest(bits, blocks), "a long, b long")


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null ids take no part in naming: their component is that of their fingerprint, or null if no row has an id there.
    Repeated rows come out as often as they went in. An empty table gives an empty table.
    """
    prints = materialise(with_fingerprint(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", words).select("doc_id", "fp"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(near_duplicate_links(classes.where("rep is not null"), bits)).withColumnsRenamed({"node": "rep", "component": "joined"})
    named = classes.join(found, "rep", "left").select("fp", F.coalesce("joined", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
