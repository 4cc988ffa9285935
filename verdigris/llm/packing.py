"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Only a piece's length matters to packing, and lengths are at most the capacity, so the corpus reduces to a histogram
of at most ``capacity`` rows whatever its size. The planner works on that histogram: it fills a bin greedily with the
longest piece that fits, then tries to replace the bin's smallest piece by two unpacked pieces that fill the expanded
gap more tightly, and repeats the resulting recipe as often as the histogram allows. The plan is a list of
(recipe, repetitions); pieces are numbered within their length in two distributed steps and find their slot in the
plan by that number. Texts are tokenised where they lie and never shuffled.

Null and empty texts are one piece holding the end id alone. Repeated rows are packed as often as they occur. An
empty table gives an empty plan and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from verdigris.llm.workers import claim
from verdigris.storage import materialise

#: White-space separated chunks remembered by a worker with their ids, and pieces of a length numbered in one task, about.
MEMORY_CHUNKS, PART_ROWS = 1_600_000, 1_000_000


#: The normalisers and the cut of tokenizers that work chunk by chunk, as their files state them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class ChunkTokenizer:
    """Ids of whole texts. A tokenizer that drops white space and never looks across it gives a text the ids of its
    ASCII-white-space separated chunks; whether the file at hand states such rules (NORMALIZERS, CUT) is looked at when it is loaded, and any
    other tokenizer gets whole texts. Special tokens in a text are what the library makes of them: ids of their own."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        first, *_ = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.special = [x["content"].lower().encode() for x in rules.get("added_tokens", [])]
        plain = all(x["content"].isascii() and not x["normalized"] and not x["lstrip"] and not x["rstrip"] and len(x["content"].split()) == 1 for x in rules.get("added_tokens", []))
        self.by_chunk = plain and (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": CUT}, "Removed", True)
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), PORTION):
            if not self.by_chunk:
                for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts[at : at + PORTION]], add_special_tokens=False):
                    yield struct.pack(f"<{len(e)}I", *e.ids)
                continue
            cut = [x.split() for x in texts[at : at + PORTION]]
            chunks: set[bytes] = set()
            for x in cut:
                chunks.update(x)
            self._learn(chunks)
            find = self.known.__getitem__
            for x in cut:
                yield b"".join(map(find, x))

    def _learn(self, chunks: set[bytes]) -> None:
        """Remember the ids of chunks. An ASCII chunk is looked up in lower case and, as a letter and a comma or full
        stop never share a token, without that mark; so fewer distinct ones are tokenised."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > MEMORY_CHUNKS:
            known.clear()
            new = list(chunks)
        cores = {c: self._core(c) for c in new}
        ask = list({core for core, _ in cores.values() if core not in known} | {mark for _, mark in cores.values() if mark and mark not in known})
        for c, e in zip(ask, self.tokenizer.encode_batch_fast([c.decode() for c in ask], add_special_tokens=False), strict=True):
            known[c] = struct.pack(f"<{len(e)}I", *e.ids)
        for c, (core, mark) in cores.items():
            known[c] = known[core] + known[mark] if mark else known[core]

    def _core(self, chunk: bytes) -> tuple[bytes, bytes]:
        low = chunk.lower()
        if not chunk.isascii() or any(x in low for x in self.special):
            return chunk, b""  # a special token is one in its own case only
        return (low[:-1], low[-1:]) if len(low) > 1 and low[-1] in b".," and 97 <= low[-2] <= 122 else (low, b"")


#: Texts cut at once in a worker.
PORTION = 500

_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    claim("packing", _TOKENIZERS.clear)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of at most ``capacity`` tokens; only longer documents are cut."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = [b"" if x is None else x for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer(path).encode(texts)):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, number of such bins)] that use up the histogram {length: pieces}."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        left[length] += n
    out: list[tuple[list[int], int]] = []

    def longest(most: int) -> int:
        some = np.flatnonzero(left[: most + 1])
        return int(some[-1]) if len(some) else 0

    while longest(capacity):
        own: list[int] = []
        gap = capacity
        while gap and (x := longest(gap)):
            own.append(x)
            left[x] -= 1
            gap -= x
        if gap and len(own) > 1:
            small = own[-1]
            room = gap + small
            pair = _best_two(left, room)
            if pair and room - sum(pair) < gap:
                left[small] += 1
                own[-1:] = pair
                for x in pair:
                    left[x] -= 1
        need = np.bincount(own, minlength=capacity + 1)
        used = np.flatnonzero(need)
        more = int((left[used] // need[used]).min())
        left[used] -= more * need[used]
        out.append((own, 1 + more))
    return out


def _best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two lengths on hand with the largest sum of at most ``room``; of equal sums, that with the longest piece."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1
    first, second = have[at >= 0], at[at >= 0]
    same = (second >= 0) & (have[second] == first) & (left[first] < 2)
    second = np.where(same, second - 1, second)
    first, second = first[second >= 0], second[second >= 0]
    if not len(first):
        return None
    total = first + have[second]
    best = np.lexsort((np.maximum(first, have[second]), total))[-1]
    return sorted((int(first[best]), int(have[second][best])), reverse=True)


def slots(recipes: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """length: rows (first number, first sequence, place of the piece in the bin), ascending, for pieces numbered from 0 within their length."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for own, times in recipes:
        offset = 0
        for x in own:
            out.setdefault(x, []).append((taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """``cut`` (see ``pieces``; read more than once, so a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    parts = max(4, -(-sum(histogram.values()) // PART_ROWS))  # one length may hold most pieces
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    sizes = cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    told = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            number = batch.pop("number").to_numpy()
            for length, rows in batch.groupby("length").indices.items():
                runs = told.value[int(length)]
                at = np.searchsorted(runs[:, 0], number[rows], side="right") - 1
                sequence[rows] = runs[at, 1] + number[rows] - runs[at, 0]
                offset[rows] = runs[at, 2]
            yield batch.assign(sequence_id=sequence, offset=offset)

    numbered = (
        cut.withColumn("part", part)
        .withColumn("within", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")))
        .join(before, ["length", "part"])  # dealt as the window is
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("number"))
    )
    return numbered.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(materialise(pieces(docs, path, capacity, end_id, id, text), "pieces"), capacity)
