"""Files that others still append to, read as a stream of complete lines; every line once, also over restarts.

``tail_lines`` is a streaming source whose offset is a byte position for each file: how much of it has been handed out, always
just behind a line break. What follows the last line break of a file is left until its line is complete, so a line torn
by a writer that stopped halfway is never read in part. The positions lie in the query's checkpoint; a batch that is
repeated reads the same bytes again. A file's new bytes are read in ranges by different tasks; a range owns the lines that
begin in it.

``repair_tails`` is the writer's side: cut what follows the last line break from files of one's own before appending again.

Cases: files may appear at any time and in any number (an offset has an entry for each, so thousands are fine, millions
aren't); names may hold any character; an empty file has no lines; blank lines are lines to ``tail_lines`` and skipped by
``tail_json``; a carriage return before a line break goes. A file that is shorter than what was read of it was rewritten: the query fails.
A file that is gone keeps its entry and gives nothing more, once its new bytes were read; if they weren't, the batch fails.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from verdigris.session import ship_package

#: Bytes read at once when looking for a line break, and of a range that one task reads.
BLOCK, RANGE = 1 << 16, 32 << 20
NAME = "verdigris_tail"
SCHEMA = "path string, at long, line string"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def last_line_end(f, low: int, high: int) -> int:
    """The place behind the last line break in [low, high) of an open file, or low."""
    while high > low:
        at = max(low, high - BLOCK)
        f.seek(at)
        found = f.read(high - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def lines_of(f, low: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end). ``low`` is where a line is known to begin; end may lie in a line."""
    at = start
    if start > low:  # the line that reaches into this range belongs to the range before
        f.seek(start - 1)
        block = f.read(BLOCK)
        at = start - 1
        while block and b"\n" not in block:
            at += len(block)
            block = f.read(BLOCK)
        at += block.find(b"\n") + 1 if block else 0
        if not block:
            return
    f.seek(at)
    rest = b""
    while at < end:
        block = f.read(BLOCK)
        if not block:
            return
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1


class _Range(InputPartition):
    def __init__(self, path: str, low: int, start: int, end: int):
        self.path, self.low, self.start, self.end = path, low, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix
        self.known: dict[str, int] = {}  # saves looking through bytes again; correct without it

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, path = _store(self.folder)
        found = dict(self.known)
        for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                if info.size < self.known.get(info.path, 0):
                    raise ValueError(f"{info.path} is shorter than what was read of it")
                with store.open_input_file(info.path) as f:
                    found[info.path] = last_line_end(f, self.known.get(info.path, 0), info.size)
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            if high < low:
                raise ValueError(f"{path} is shorter than what was read of it")
            out += [_Range(path, low, at, min(at + RANGE, high)) for at in range(low, high, RANGE)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as f:
            for at, line in lines_of(f, partition.low, partition.start, partition.end):
                yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ""))


def tail_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """(path, at, line): complete lines of the files of a folder, and where in its file each begins, as a stream."""
    ship_package(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("suffix", suffix).load(folder)


def tail_json(spark: SparkSession, folder: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """The objects of ``schema`` in the lines, with path and at, and in ``_corrupt_record`` the text of a line that is none."""
    lines = tail_lines(spark, folder, suffix).where(F.length(F.trim(F.translate("line", "\t\r", "  "))) > 0)
    kind = spark.createDataFrame([], schema).schema.add("_corrupt_record", "string")
    parsed = F.from_json("line", kind, {"columnNameOfCorruptRecord": "_corrupt_record", "allowNonNumericNumbers": "false"})
    return lines.select("path", "at", parsed.alias("r")).select("path", "at", "r.*")


def repair_tails(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> dict[str, int]:
    """Cut off what follows the last line break of each file of a folder; {path: bytes that went} of those that were torn.

    For the files' own writer, when it starts again. Only stores whose files can be cut short allow it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    store, path = _store(folder)
    from pyarrow import fs

    torn = {}
    for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and info.path.endswith(suffix):
            with store.open_input_file(info.path) as f:
                end = last_line_end(f, 0, info.size)
            if end < info.size:
                scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
                where = jvm.org.apache.hadoop.fs.Path(scheme + info.path if scheme == "file://" else folder.rstrip("/") + info.path.removeprefix(path.rstrip("/")))
                target = where.getFileSystem(conf)
                target = target.getRawFileSystem() if scheme == "file://" else target  # sums kept beside local files can't be cut
                target.truncate(where, end)
                torn[info.path] = info.size - end
    return torn
