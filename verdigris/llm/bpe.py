"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

A text is cut into pieces by the vocabulary's pattern. The distinct pieces of a batch become token-position rows
(piece, position, token). A recursive query joins neighbouring tokens to the merge table, contracts each piece's
leftmost pair of minimum rank, and ends when no piece has a pair left. Decoding joins the ids to the vocabulary's
bytes and aggregates them in order. Both run in the Python worker of the task, on batches of bounded size; nothing is
shuffled, and a lost task is simply run again.

Null texts count as empty: no tokens, empty id list, digest of the empty string. Texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdigris.llm.workers import claim

#: Characters of text handled at once in a worker, pieces per DuckDB query, and pieces remembered by a worker.
BATCH_CHARS, QUERY_PIECES, MEMORY_PIECES = 4_000_000, 40_000, 500_000
#: Rows that the recursion of one query may keep: a piece of n bytes has n at most in each of fewer than n steps. So a query stays within
#: memory, and nothing is written to a local folder.
QUERY_ROWS = 4_000_000
#: Bytes above which a piece is contracted by repeated queries over a replaced table: the recursion keeps every
#: step's rows, which is quadratic in the piece's length. One such piece fills a query (QUERY_ROWS).
LONG_PIECE = 2000

#: A row carries the position and token of its right neighbour, so that a step is joins and an aggregate by piece:
#: find each piece's best pair (smallest rank, then leftmost), look up the row it swallows, and rewrite the piece's rows.
ENCODE = """
with recursive s(w, p, t, pn, tn, n) as (
  select w, p, t, lead(p) over win, lead(t) over win, 0 from toks window win as (partition by w order by p)
  union all (
    with best as materialized (
      select s.w, min(m.m::bigint * 4294967296 + s.p) as k, arg_min(s.pn, m.m::bigint * 4294967296 + s.p) as gone
      from s join merges m on m.l = s.t and m.r = s.tn group by s.w),
    merge as materialized (
      select b.w, b.k & 4294967295 as at, (b.k >> 32)::int as m, b.gone, s.pn, s.tn from best b join s on s.w = b.w and s.p = b.gone)
    select s.w, s.p, case when s.p = c.at then c.m else s.t end,
           case when s.p = c.at then c.pn else s.pn end,
           case when s.p = c.at then c.tn when s.pn = c.at then c.m else s.tn end, s.n + 1
    from s join merge c on c.w = s.w where s.p <> c.gone))
select s.w, s.p, s.t from s join (select w, max(n) as n from s group by w) z on z.w = s.w and z.n = s.n
"""

#: A step of a long piece: the occurrences of its minimum-rank pair, from the left and not overlapping (pairs that touch
#: form a run; every other one of a run counts), are contracted up to the first whose result makes a pair of smaller
#: rank with a neighbour. That one comes first in the next step, as it would contracting one pair at a time.
LONG_STEP = """
with pairs as materialized (
  select q.*, m.m from (select *, lead(t) over (partition by w order by p) as t2,
                               row_number() over (partition by w order by p) as i from {source}) q
  left join merges m on m.l = q.t and m.r = q.t2),
hits as (
  select w, i, m, i - row_number() over (partition by w order by i) as run
  from (select w, i, m from pairs where m is not null qualify m = min(m) over (partition by w))),
touching as materialized (
  select w, i, m from hits qualify row_number() over (partition by w, m, run order by i) % 2 = 1),
beside as (
  select k.w, k.i, k.m, case when b.i is null then a.t else k.m end as lt, c.t as rt from touching k
  left join pairs a on a.w = k.w and a.i = k.i - 1 left join touching b on b.w = k.w and b.i = k.i - 2
  left join pairs c on c.w = k.w and c.i = k.i + 2),
halt as (
  select z.w, min(z.i) as i from beside z left join merges x on x.l = z.lt and x.r = z.m left join merges y on y.l = z.m and y.r = z.rt
  where x.m < z.m or y.m < z.m group by z.w),
taken as materialized (
  select k.w, k.i, k.m from touching k left join halt h on h.w = k.w where h.i is null or k.i <= h.i)
select a.w, a.p, coalesce(b.m, a.t)::int as t from pairs a
left join taken b on b.w = a.w and b.i = a.i left join taken c on c.w = a.w and c.i = a.i - 1 where c.i is null
"""

RENDER = "select w, count(*) as n, string_agg(t::varchar, ' ' order by p) as ids from coded group by w order by w"
DECODE = "select x.w, string_agg(v.hex, '' order by x.p) as hex from coded x join vocab v on v.id = x.t group by x.w order by x.w"


class BytePairCoder:
    """Encoder and decoder of one vocabulary in one worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        splits = [(a, b, v) for k, v in self.ranks.items() for i in range(1, len(k)) if (a := self.ranks.get(k[:i])) is not None and (b := self.ranks.get(k[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._put("merge_rows", {n: pa.array(c, pa.int32()) for n, c in zip("lrm", zip(*splits))})
        self.db.execute("create table merges as select * from merge_rows")
        self._put("vocab_rows", {"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [k.hex() for k in self.ranks]})
        self.db.execute("create table vocab as select * from vocab_rows")
        #: piece: (ids in decimal joined by spaces, number of ids, bytes decoded from these ids)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _put(self, name: str, columns: dict) -> None:
        import pyarrow as pa

        self.db.register(name, pa.table(columns))

    def _rows(self, pieces: list[bytes]) -> dict:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        return {"w": np.repeat(np.arange(len(pieces), dtype=np.int64), lengths), "p": np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths), "t": self.byte_ids[raw]}

    def _encode(self, pieces: list[bytes]) -> None:
        """Fill table ``coded`` (w, p, t) with the ids of non-empty pieces; w is a piece's place in the list."""
        rows = self._rows(pieces)
        short = np.array([len(x) <= LONG_PIECE for x in pieces])
        self._put("toks", {c: v[short[rows["w"]]] for c, v in rows.items()})
        self.db.execute("create or replace table coded as " + ENCODE)
        for i in np.flatnonzero(~short):
            self._put("toks", {c: v[rows["w"] == i] for c, v in rows.items()})
            self.db.execute("create or replace table state as select * from toks")
            size, now = -1, len(pieces[i])
            while size != now:
                self.db.execute("create or replace table state as " + LONG_STEP.format(source="state"))
                size, now = now, self.db.sql("select count(*) from state").fetchall()[0][0]
            self.db.execute("insert into coded select w, p, t from state")

    def _decoded(self, n: int) -> list[bytes]:
        """The bytes of each of n id sequences in table ``coded``, by an ordered aggregation."""
        found = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * n
        for w, h in zip(found["w"].to_pylist(), found["hex"].to_pylist()):
            out[w] = bytes.fromhex(h)
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(lengths.sum()))
        self._put("given", {"w": np.repeat(np.arange(len(ids)), lengths), "p": np.arange(len(flat)), "t": flat})
        self.db.execute("create or replace table coded as select * from given")
        return self._decoded(len(ids))

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet and decode them from their ids."""
        new = sorted(p for p in pieces if p not in self.known)
        if len(self.known) + len(new) > MEMORY_PIECES:
            self.known.clear()
            new = sorted(pieces)
        for part in _queries(new):
            self._encode([x.encode() for x in part])
            shown = self.db.sql(RENDER).to_arrow_table()
            self.known.update(zip(part, zip(shown["ids"].to_pylist(), shown["n"].to_pylist(), self._decoded(len(part))), strict=True))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded bytes) of each text."""
        for part in _portions(texts):
            cut = [self.pattern.findall(x) for x in part]
            self.learn({p for pieces in cut for p in pieces})
            for pieces in cut:
                own = [self.known[p] for p in pieces]
                yield (
                    sum(n for _, n, _ in own),
                    hashlib.sha256(" ".join([s for s, _, _ in own]).encode()).hexdigest(),
                    hashlib.sha256(b"".join([raw for _, _, raw in own])).hexdigest(),
                )

    def counts(self, texts: list[str]) -> Iterator[int]:
        for part in _portions(texts):
            cut = [self.pattern.findall(x) for x in part]
            self.learn({p for pieces in cut for p in pieces})
            for pieces in cut:
                yield sum(self.known[p][1] for p in pieces)

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        for part in _portions(texts):
            cut = [self.pattern.findall(x) for x in part]
            self.learn({p for pieces in cut for p in pieces})
            for pieces in cut:
                yield [int(t) for p in pieces for t in self.known[p][0].split()]


def _queries(pieces: list[str]) -> Iterator[list[str]]:
    """The pieces in lists for one query each, bounded by their number and by the rows that a recursion over them keeps."""
    part, rows = [], 0
    for x in pieces:
        own = min(len(x.encode()), LONG_PIECE) ** 2
        if part and (len(part) == QUERY_PIECES or rows + own > QUERY_ROWS):
            yield part
            part, rows = [], 0
        part.append(x)
        rows += own
    if part:
        yield part


def _portions(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


_CODERS: dict[tuple[str, str], BytePairCoder] = {}


def coder(path: str, pattern: str) -> BytePairCoder:
    """The worker's coder of a vocabulary; workers are reused from task to task."""
    claim("bpe", _CODERS.clear)
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairCoder(path, pattern)
    return _CODERS[path, pattern]


def _texts(column: pd.Series) -> list[str]:
    return ["" if x is None else x for x in column.array]


def encode_digests(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """``df`` with a struct column ``coded``: n_tokens, ids_sha256, decoded_sha256 of the whole text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield pd.DataFrame(list(coder(path, pattern).digests(_texts(column))), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn("coded", coded(F.col(text)))


def encode_ids(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``df`` with an array<int> column of token ids."""

    @F.pandas_udf("array<int>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(list(coder(path, pattern).ids(_texts(column))), dtype=object)

    return df.withColumn(out, coded(F.col(text)))


def decode_ids(df: DataFrame, ids: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that the ids stand for; null ids count as none."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            rows = [[] if x is None else [int(t) for t in x] for x in column.array]
            found: list[bytes] = []
            for at in range(0, len(rows), 500):
                found += coder(path, pattern).decode(rows[at : at + 500])
            yield pd.Series(found, dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def count_tokens(df: DataFrame, text: str, path: str, pattern: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(list(coder(path, pattern).counts(_texts(column))), dtype="int64")

    return df.withColumn(out, counted(F.col(text)))
