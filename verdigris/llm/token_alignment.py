"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) cover the same bytes as which pieces of another (B).

A text (with a blank before it) is cut into chunks where both tokenizers are certain to cut: before a blank or a line
break that follows something visible. What happens in a chunk depends on nothing outside it, so tokens, groups and
links are worked out once for each distinct chunk of a batch and remembered for a while; a text sums its chunks.

The chunks of a batch lie behind each other as one run of bytes, on which packed bitsets mark where A's and B's tokens
end. Their AND holds the shared cuts, whose popcounts are the groups; ranks in either set (popcounts before a place)
turn cuts into token ranges. Their OR holds the ends of the stretches covered by one token of each, and every stretch
is a link: the rank of its last byte in either set names its two tokens.

Counts over the corpus: each document sends its distinct linked id pairs. Their document counts are partial aggregates; the
table of counts has at most size(A) * size(B) rows, is broadcast if it is counted as small (``STAT_ROWS``) and joined by
the optimiser beyond that. Sums by document are aggregated where the document lies, so one row a document is sent.

Cases. Null and empty texts, and texts whose joined bytes of A's or B's tokens aren't the text (a literal U+2581, for
one), have no tokens: zeros, groups ''. Texts of any length are taken whole; chunks above ``LONG`` characters aren't
remembered. Repeated rows are documents of their own, null ids stay null. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from verdigris.llm.workers import claim
from verdigris.storage import bounded, materialise

#: Chunks remembered by a worker, characters of the longest one remembered, characters of text handled at once.
MEMORY_CHUNKS, LONG, PORTION = 300_000, 200, 2_000_000
#: Id pairs whose counts are broadcast at most: 24 bytes each.
STAT_ROWS = 3_000_000
#: A chunk goes on over blanks and line breaks that follow anything that might be white space to either tokenizer.
CHUNK = re.compile("[ \n][^ \n]*(?:(?<=[\\s\\x00-\\x1f\\x7f-\\xa0\\xad\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff])[ \n][^ \n]*)*")


def chunks(text: str) -> list[str]:
    """The chunks of blank + text; together they are it."""
    return CHUNK.findall(" " + text)


def _unicode_of_bytes() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes its bytes: printable ones stand for themselves, others for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size // 64 + 1) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many marks lie before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all marks, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligner:
    """Aligned chunks of two vocabularies in one worker process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _unicode_of_bytes()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if any("▁" in x.lstrip("▁") or "\n" in x for x in pieces):
            raise ValueError("a piece holds a blank after something else, or a line break: texts can't be cut into chunks")
        self.blank = self.b.piece_to_id("▁")
        self.bytes_a, self.bytes_b = np.array(self.bytes_a, object), np.array(self.bytes_b, object)
        self.length_a, self.length_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.size_b = len(self.bytes_b)
        self.named_a, self.last_a, self.named_b, self.last_b = (np.array([f"{i}{mark}" for i in range(len(x))], object) for x, mark in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";")))
        self.forget()

    def forget(self) -> None:
        #: chunk: its number. By number: tokens of A and B, groups, links; whether its bytes are the tokens', where its keys begin, its groups as text
        self.known: dict[str, int] = {}
        self.n = np.zeros((0, 4), np.int64)
        self.kept = np.zeros(0, bool)
        self.starts = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.texts: list[str] = []

    def _ids_b(self, new: list[str]) -> list[list[int]]:
        """B's ids: the blank at the front of a chunk is the one that B adds; before a line break it goes."""
        got = self.b.encode([x[1:] if x[0] == " " else x for x in new], num_threads=1)
        return [[self.blank] if x == " " else ids[1:] if x[0] == "\n" else ids for x, ids in zip(new, got)]

    @staticmethod
    def _whole(flat: np.ndarray, per: np.ndarray, table: np.ndarray, length: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of each chunk's tokens are the chunk."""
        joined = b"".join(table[flat].tolist())
        ends = np.concatenate([[0], np.cumsum(length[flat])])[np.cumsum(per)]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        if joined == b"".join(raw) and (ends == np.cumsum(lengths)).all():
            return np.ones(len(raw), bool)
        return np.array([joined[a:b] == r for a, b, r in zip([0, *ends[:-1].tolist()], ends.tolist(), raw)], bool)

    def learn(self, new: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self._ids_b(new)
        raw = [x.encode() for x in new]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        kept = self._whole(flat_a, n_a, self.bytes_a, self.length_a, raw) & self._whole(flat_b, n_b, self.bytes_b, self.length_b, raw)
        flat_a, flat_b = flat_a[np.repeat(kept, n_a)], flat_b[np.repeat(kept, n_b)]
        n_a, n_b = np.where(kept, n_a, 0), np.where(kept, n_b, 0)
        bounds = np.concatenate([[0], np.cumsum(np.where(kept, np.fromiter(map(len, raw), np.int64, len(raw)), 0))])
        size = int(bounds[-1])
        ends_a = Bits.at(np.cumsum(self.length_a[flat_a]) - 1, size)
        ends_b = Bits.at(np.cumsum(self.length_b[flat_b]) - 1, size)
        shared, either = ends_a & ends_b, ends_a | ends_b
        cuts, ends = shared.select(), either.select()
        to_a, to_b = ends_a.rank(cuts + 1), ends_b.rank(cuts + 1)  # a group's tokens end here
        keys = flat_a[ends_a.rank(ends)] * self.size_b + flat_b[ends_b.rank(ends)]
        groups, links = shared.rank(bounds), either.rank(bounds)
        # A's tokens of group g stand to_b[g - 1] places further behind, B's to_a[g]; a group's last ones end with | and ;
        told = np.empty(len(flat_a) + len(flat_b), object)
        per_a, per_b = np.diff(np.r_[0, to_a]), np.diff(np.r_[0, to_b])
        told[np.arange(len(flat_a)) + np.repeat(np.r_[0, to_b[:-1]], per_a) if len(cuts) else []] = self.named_a[flat_a]
        told[np.arange(len(flat_b)) + np.repeat(to_a, per_b)] = self.named_b[flat_b]
        if len(cuts):
            told[to_a + np.r_[0, to_b[:-1]] - 1] = self.last_a[flat_a[to_a - 1]]
            told[to_a + to_b - 1] = self.last_b[flat_b[to_b - 1]]
        told = told.tolist()
        at = np.cumsum(n_a + n_b).tolist()
        self.texts += ["".join(told[x:y]) for x, y in zip([0, *at], at)]
        self.known.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))
        self.starts = np.concatenate([self.starts, links[:-1] + len(self.keys)])
        self.keys = np.concatenate([self.keys, keys])
        self.kept = np.concatenate([self.kept, kept])
        self.n = np.concatenate([self.n, np.stack([n_a, n_b, np.diff(groups), np.diff(links)], axis=1)])

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links; its groups_sha256; how many distinct keys it links; then all texts'
        distinct keys, ascending within a text, and how often each is linked."""
        cut = [chunks(x) if x else [] for x in texts]
        wanted = set(chain.from_iterable(cut))
        new = [c for c in wanted if c not in self.known]
        if len(self.known) + len(new) > MEMORY_CHUNKS:
            self.forget()
            new = list(wanted)
        if new:
            self.learn(new)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(many.sum()))
        text = np.repeat(np.arange(len(cut)), many)
        good = many > 0
        good[text[~self.kept[codes]]] = False
        codes, text = codes[good[text]], text[good[text]]
        n = np.zeros((len(cut), 4), np.int64)
        np.add.at(n, text, self.n[codes])
        digests, at = [""] * len(cut), 0
        own = codes.tolist()
        for k in np.flatnonzero(good).tolist():
            digests[k] = hashlib.sha256("".join([self.texts[i] for i in own[at : at + many[k]]])[:-1].encode()).hexdigest()
            at += many[k]
        links = self.n[codes, 3]
        place = np.repeat(self.starts[codes] - np.cumsum(links) + links, links) + np.arange(links.sum())
        span = len(self.bytes_a) * self.size_b
        told = np.sort(np.repeat(text, links) * span + self.keys[place])
        first = np.flatnonzero(np.r_[True, told[1:] != told[:-1]][: len(told)])
        times = np.diff(np.r_[first, len(told)])
        distinct = np.bincount(told[first] // span, minlength=len(cut))
        if any(len(x) > LONG for x in new):
            self.forget()
        return n, digests, distinct, told[first] % span, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    claim("alignment", _ALIGNERS.clear)
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (distinct keys a * size(B) + b), times (of each key)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(batch):
                size, to = 0, at
                while to < len(batch) and size < PORTION:
                    size += len(texts[to].as_py() or "")
                    to += 1
                n, digests, distinct, keys, times = aligner(path_a, path_b).aligned([x or "" for x in texts.slice(at, to - at).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((keys, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *(pa.array(x) for x in n.T.copy()), pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])
                at = to

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>")


def link_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(key, a, b, n, best): in how many documents an id pair is linked, and whether that is the most of its A id."""
    counts = aligned.select(F.explode("links").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    own = counts.withColumn("a", F.expr(f"key div {size_b}")).withColumn("b", F.expr(f"key % {size_b}"))
    return own.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # an A id has at most size(B) rows


def align_corpus(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", stat_rows: int = STAT_ROWS) -> DataFrame:
    """One row per row of ``docs``, as the module says."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    held = materialise(align(docs, path_a, path_b, id, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    stats = bounded(link_counts(held, size_b).select("key", "n", F.col("best").cast("int").alias("best")), stat_rows)
    each = held.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("key"), F.col("x.times").cast("long").alias("times"))
    sums = each.join(stats, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return held.drop("links", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
