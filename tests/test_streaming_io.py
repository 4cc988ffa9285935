"""Admission, windows over streams, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from verdigris.sources import inventory, readers, sinks
from verdigris.streaming import windows
from verdigris.streaming.admission import AdmissionState, Quotas, ROW, all_done, file_stream, run_admission


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("id", "quota_key", "priority", "heldout"), r))) + "\n" for r in rows))


def queued(state):
    return [r["id"] for r in state.queue().orderBy("position").collect()]


def test_admission_quota_cap_waiting_and_restart(spark, tmp_path):
    state = AdmissionState(spark, f"file://{tmp_path}/state")
    put(tmp_path / "in", "a.json", [("a1", "a", 1.0, False), ("a2", "a", 3.0, False), ("a3", "a", 2.0, False), ("h1", "a", 0.1, True), ("b1", "b", 0.5, False), ("x1", "b", 9.0, False)])
    quotas = {"now": Quotas({"a": 2}, None, 4, {}, 1)}
    gone = spark.createDataFrame([("x1",)], "id string")

    def go():
        stream = file_stream(spark, f"file://{tmp_path}/in", ROW)
        run_admission(stream, state, f"file://{tmp_path}/check", lambda: quotas["now"], lambda: gone).awaitTermination(120)

    go()
    assert queued(state) == ["h1", "a2", "a3", "b1"]  # held-out first; a1 is over the quota
    assert [r["id"] for r in state.waiting().collect()] == ["a1"]
    go()  # nothing new: nothing happens
    assert len(queued(state)) == 4
    quotas["now"] = Quotas({"a": 5}, None, 6, {}, 1)
    put(tmp_path / "in", "b.json", [("b1", "b", 8.0, False), ("b2", "b", 8.0, False), ("b3", "b", 7.0, False)])
    go()  # b1 is known; a1 waited and ranks behind both new rows, and the cap leaves two
    assert queued(state) == ["h1", "a2", "a3", "b1", "b2", "b3"]
    state.admit(spark.createDataFrame([("z", "z", 1.0, False)], ROW), 1, quotas["now"])  # a repeated batch is left alone
    assert len(queued(state)) == 6
    state.admit(spark.createDataFrame([("z", "z", 1.0, False)], ROW), 9, Quotas({}, None, 99, {}, 1, stopped=True))
    assert len(queued(state)) == 6 and state.waiting().count() == 2


@pytest.mark.parametrize("line", ['{"a": 1}{"a": 2}', '{"a": 1} junk', '{"a": 1}, {"a": 2}', '{"a": 1}], [{"a": 2}', '{"a": 1}} junk', '{"a": 1}, "y": {}', "[1]", "", "1", '{"a": NaN}', '{"a": 1'])
def test_strict_lines_hold_one_object(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text('\t{"a": 1, "b": "}] {"} \r\n' + line + "\n" + '{"a": 3}\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int, b string").collect()


def test_strict_lines_with_white_space_around(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('\t{"a": 1, "b": "}] {"} \r\n  {"a": 2, "c": [1]}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int, b string").collect()] == [(1, "}] {"), (2, None)]


def test_done_marks(spark, tmp_path):
    (tmp_path / "s1.done").write_text("")
    assert not all_done(spark, f"file://{tmp_path}", ["s1", "s2"])
    (tmp_path / "s2.done").write_text("")
    assert all_done(spark, f"file://{tmp_path}", ["s1", "s2"])


def test_stream_windows_equal_table_windows(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, 0, i, 0, 0) ts, cast(i % 3 as string) k, double(i) v from range(48) t(i)")
    rows.write.parquet(f"{tmp_path}/t")
    stream = windows.with_lateness(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/t"), "ts", "1 hour")
    q = windows.tumbling(stream, "ts", "6 hours", "k", "v").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windows.tumbling(rows, "ts", "6 hours", "k", "v")
    assert spark.table("w").exceptAll(want).isEmpty() and spark.table("w").count() == want.count()


def test_strict_and_lenient_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()
    assert sorted((r["a"], r["_corrupt_record"]) for r in readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", strict=False).collect() if r["a"]) == [(1, None)]


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d.json").write_text('{"rows": [{"a": 3}]}')
    (tmp_path / "c.csv").write_text("a\n4\n")
    got = [[r["a"] for r in readers.read_any(spark, f"{tmp_path}/{n}", "a int").collect()] for n in ("l.json", "d.json", "c.csv")]
    assert got == [[1, 2], [3], [4]]
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.xls", "a int")


def test_leaves(spark):
    df = spark.createDataFrame([('{"a": ["x", 1, true, null], "skip": "no", "b": {"c": "y"}}',), ("plain",), (None,)], "s string")
    assert [r["leaves"] for r in readers.json_leaves(df, "s", skip=("skip",)).collect()] == [["x", "1", "y"], ["plain"], []]


def test_shards_and_receipts(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 3).cast("string").alias("k"))
    got = sinks.write_sharded(df, f"{tmp_path}/out", "k", F.sha2(F.col("id").cast("string"), 256), 4).collect()
    assert len(got) == 4
    sizes = [r["count"] for r in spark.read.json(f"{tmp_path}/out").groupBy("shard").count().collect()]
    assert sum(sizes) == 40 and max(sizes) - min(sizes) <= 3
    with pytest.raises(Exception):
        sinks.write_sharded(df, f"{tmp_path}/out", "k", F.col("id"), 4)


def test_runs_are_written_once_and_verified(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    sinks.write_run(spark.range(5), folder, {"model": "m"})
    assert sinks.verify_run(spark, folder).isEmpty()
    with pytest.raises(FileExistsError):
        sinks.write_run(spark.range(5), folder, {})
    part = next((tmp_path / "run/predictions").glob("part-*"))
    part.write_text(part.read_text() + "{}\n")
    for crc in (tmp_path / "run/predictions").glob(".*.crc"):
        crc.unlink()
    assert [r["problem"] for r in sinks.verify_run(spark, folder).collect()] == ["differs"]


def test_stride_is_exact_over_gaps(spark):
    ids = [0, 1, 5, 6, 1000, 1001, 1002, 5_000_000]
    assert [r["id"] for r in inventory.strided(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 3).orderBy("id").collect()] == [0, 6, 1002]
