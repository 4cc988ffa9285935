"""WARC archives in Zstandard: written with a shared dictionary, read one record at a time.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary. After it, each record
is one frame, compressed with that dictionary. The reader loads the dictionary from the leading frame, decodes frame by
frame, and checks of every record its version line, its required headers, Content-Length against the block, the
end mark, and the block and payload digests. A record is all that is held in memory at once.

Each attempt of a task writes one archive under a name of its own and returns the name; only what the tasks that Spark counts
returned is listed, so a lost executor leaves at most a file that nothing reads. Payloads that are equal
are stored once: the row of smallest id is the response, others are revisits that point to it.

The reader takes archives of others too: header names in any case, no block digest, digests of other kinds (left unchecked), records of other types
(returned by ``read_archive``, passed over by ``read_archives``), and archives without a dictionary frame.

Null payloads count as empty. Rows that repeat an id and its payload are the same capture: each is a response if its
id is the smallest. A null id is never referred to: where all ids of a payload are null, all its rows are responses.
An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verdigris.storage import bounded, materialise, scratch_path

SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Bytes of a dictionary, of payload it is trained on (the head of the archive's rows: a matter of size only), and read at once.
DICTIONARY_BYTES, TRAIN_BYTES, READ_BYTES = 32_768, 2_000_000, 1 << 16
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
LONGEST_HEADER = 1 << 16


class WarcError(ValueError):
    """An archive or record that isn't well formed."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(kind: str, page: int | None, refers: int | None, payload: bytes, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record. The block of a revisit is empty; its headers keep the digest and length of the payload."""
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}:{kind}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}:response>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one decoded record, or WarcError."""
    end = record.find(b"\r\n\r\n", 0, LONGEST_HEADER)
    if end < 0:
        raise WarcError("no end of the headers")
    first, *lines = record[:end].decode("utf-8", "replace").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version line {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [x for x in REQUIRED if x not in headers]
    if missing:
        raise WarcError(f"no {', '.join(missing)}")
    length = _number(headers, "content-length")
    block, mark = record[end + 4 : end + 4 + length], record[end + 4 + length :]
    if len(block) != length or mark != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}; the frame holds {len(record) - end - 8} bytes of block")
    if not _agrees(headers.get("warc-block-digest"), block):
        raise WarcError("the block's digest differs")
    return headers, block


def _number(headers: dict[str, str], name: str) -> int:
    said = headers[name]
    if not said.isascii() or not said.isdigit():
        raise WarcError(f"{name} {said[:40]!r}")
    return int(said)


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether a labelled digest is that of the data; without one, or of another kind than SHA-1 in base 32, nothing speaks against it."""
    kind, _, value = (said or "").partition(":")
    return kind.lower() != "sha1" or len(value) != 32 or value.upper() == digest(data)


def write_archive(out: BinaryIO, records: Iterator[tuple[str, int | None, int | None, bytes]], level: int = 3) -> int:
    """Write (type, page, refers to, payload) rows; the number of records."""
    import zstandard

    head, size = [], 0
    for row in records:
        head.append(row)
        size += len(row[3])
        if size >= TRAIN_BYTES:
            break
    samples = [render(*r)[:32_768] for r in head]
    try:
        table = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=level).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to train on
        table = b""
    out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(table) if table else None)
    n = 0
    for rows in (head, records):
        for row in rows:
            out.write(packer.compress(render(*row)))
            n += 1
    return n


def read_archive(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, one frame decoded at a time."""
    import zstandard

    start, table = source.read(8), b""
    if len(start) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", start)
    if magic == SKIPPABLE:
        start, table = b"", source.read(size)
        if len(table) != size:
            raise WarcError("the dictionary is cut short")
    elif start[:4] != FRAME:
        raise WarcError(f"the leading frame's magic is {magic:#x}")
    if table[:4] == FRAME:  # it may be compressed itself
        table = zstandard.ZstdDecompressor().decompress(table, max_output_size=1 << 26)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(table) if table else None)
    held = start
    while True:
        if not held:
            held = source.read(READ_BYTES)
            if not held:
                return
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not held:
                held = source.read(READ_BYTES)
                if not held:
                    raise WarcError("the last frame is cut short")
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from None
            held = frame.unused_data if frame.eof else b""
        yield parse(b"".join(parts))


def _filesystem(uri: str):
    """(file system, path): the folder all executors share, by whatever scheme it has."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def payload_table(pages: DataFrame, id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """page_id, payload (binary), record_type, refers_to.

    The smallest id of each payload is a partial aggregate over digests. The rows that revisit another are told by (id, digest), which no
    frequent payload makes hot; few of them are broadcast after a count, so that payloads stay where they are, and many meet the rows by that key.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    keys = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha")).where(F.length("payload") >= least)
    groups = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    # a payload's ids are counted once each before they meet its first
    again = keys.groupBy("page_id", "sha").agg(F.count("*").alias("n")).join(groups, "sha").where("not (page_id <=> first)")
    told = bounded(again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "first"))
    joined = rows.join(told, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.unhex(F.sha1("payload")) == F.col("again_sha")), "left")
    return joined.select("page_id", "payload", F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"))


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """One archive per partition of ``captures`` (see ``payload_table``) under ``folder``: (path, records, bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        def rows() -> Iterator[tuple]:
            for b in batches:
                for page, payload, kind, refers in zip(b.page_id.array, b.payload.array, b.record_type.array, b.refers_to.array):
                    yield kind, None if pd.isna(page) else int(page), None if pd.isna(refers) else int(refers), bytes(payload)

        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            n = write_archive(out, rows())
        if n:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n], "bytes": [files.get_file_info(f"{root}/{name}").size]})

    return captures.mapInPandas(write, "path string, records long, bytes long")


def read_archives(archives: DataFrame, path: str = "path") -> DataFrame:
    """The records of the archives that ``archives`` lists: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Of a response the payload's own length and digest are returned, having been checked against its headers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch[path].array:
                files, at = _filesystem(uri)
                rows = []
                with files.open_input_stream(at, compression=None) as source:
                    for headers, block in read_archive(source):
                        if headers["warc-type"] in ("response", "resource", "revisit"):
                            rows.append(_row(headers, block))
                        if len(rows) == 5_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return archives.select(path).mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """Ids of pages are those of this module's archives: records of others have none, and a revisit's target is null then."""
    page, kind = int(headers["x-page-id"]) if "x-page-id" in headers else None, headers["warc-type"]
    said = headers.get("warc-payload-digest")
    if kind == "revisit":
        target = headers.get("warc-refers-to", "").strip("<>").split(":")
        own = int(target[2]) if target[:2] == ["urn", "page"] and target[2].lstrip("-").isdigit() else None
        return page, _number(headers, "x-payload-length") if "x-payload-length" in headers else None, said.partition(":")[2] if said else None, kind, own
    if page is not None and not _agrees(said, block):
        raise WarcError("the payload's digest differs")
    return page, len(block), digest(block), kind, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def archive_and_read(pages: DataFrame, id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    archives = materialise(write_archives(payload_table(pages, id, payload, least), scratch_path(spark, "warc")), "warc-list")
    return read_archives(archives.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path"))
