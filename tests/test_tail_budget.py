"""Growing and torn files, and a spend cap with reservations, over restarts and against brute force."""

import json
import random
from datetime import datetime, timedelta

import pytest

from verdigris.sources import tail
from verdigris.streaming import budget


def run(stream, check, out, **options):
    q = stream.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_every_line_once_over_growth_tears_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    folder, want = tmp_path / "in", {}
    (folder / "deep").mkdir(parents=True)
    names = ["a.jsonl", "b c.jsonl", "deep/d=1.jsonl", "empty.jsonl"]
    torn = dict.fromkeys(names, b"")
    for k in range(4):
        for n in names[:3]:
            lines = [json.dumps({"id": f"{n}{k}{i}", "x": "é" * rng.randint(0, 50)}, ensure_ascii=False).encode() for i in range(rng.randint(1, 400))]
            text = b"".join(x + rng.choice([b"\n", b"\r\n"]) for x in lines)
            cut = len(text) - rng.randint(1, 30)  # a writer that stopped in the middle of its last line
            with open(folder / n, "ab") as f:
                f.write(torn[n] + (text[:cut] if k < 3 else text))
            torn[n] = text[cut:]
            want.setdefault(n, []).extend(json.loads(x)["id"] for x in lines)
        (folder / "empty.jsonl").touch()
        (folder / "other.txt").write_text("no\n")
        run(tail.tail_json(spark, f"file://{folder}", "id string, x string"), str(tmp_path / "check"), str(tmp_path / "out"))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == got.select("path", "at").distinct().count()
    seen = {}
    for r in got.orderBy("path", "at").collect():
        seen.setdefault(r["path"].removeprefix(f"{folder}/"), []).append(r["id"])
    assert seen == want and got.where("_corrupt_record is not null").count() == 0


def test_lines_that_are_no_objects_and_rewritten_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b'{"id": "1"}\n\n  \n{"id": \n[1]\n\xff\n{"id": "2"}\n{"id": "3"}')
    stream = lambda: tail.tail_json(spark, f"file://{tmp_path}/in", "id string")
    run(stream(), str(tmp_path / "check"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()
    assert [r["id"] for r in got if r["_corrupt_record"] is None] == ["1", "2"] and len(got) == 5
    (tmp_path / "in" / "a.jsonl").write_bytes(b"{}\n")
    with pytest.raises(Exception, match="shorter"):
        run(stream(), str(tmp_path / "check"), str(tmp_path / "out"))


def test_ranges_own_the_lines_that_begin_in_them(tmp_path):
    rng = random.Random(2)
    for size in (1, 7, 100_000):
        lines = [b"x" * rng.choice([0, 1, 5, size]) for _ in range(200 if size < 1000 else 9)]
        path = tmp_path / "f"
        path.write_bytes(b"".join(x + b"\n" for x in lines) + b"torn")
        with open(path, "rb") as f:
            whole = path.stat().st_size
            end = tail.last_line_end(f, 0, whole)
            assert end == whole - 4 and tail.last_line_end(f, end, whole) == end
            cuts = [0, *sorted(rng.sample(range(1, end), min(12, end - 1))), end]
            got = [x for a, b in zip(cuts, cuts[1:]) for x in tail.lines_of(f, 0, a, b)]
        assert [x for _, x in got] == lines and len({a for a, _ in got}) == len(lines)


def test_torn_tails_are_cut(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"1\n22\n333")
    (tmp_path / "b.jsonl").write_bytes(b"1\n")
    (tmp_path / "c.jsonl").write_bytes(b"y" * 200_000)
    assert tail.repair_tails(spark, f"file://{tmp_path}") == {f"{tmp_path}/a.jsonl": 3, f"{tmp_path}/c.jsonl": 200_000}
    assert [(tmp_path / n).read_bytes() for n in ("a.jsonl", "b.jsonl", "c.jsonl")] == [b"1\n22\n", b"1\n", b""]


START, TTL, KEPT, LATE, CAP = datetime(2025, 1, 1), timedelta(minutes=15), timedelta(hours=2), timedelta(minutes=10), 1000


def by_hand(batches):
    """Verdicts of each batch by a plain model: the watermark moves after a batch, timers fire in the batch after."""
    state, out, mark, latest = {}, [], None, None
    for batch in batches:
        told = []
        for b, rid, ts, kind, amount in sorted(batch, key=lambda r: (r[0], r[2], r[3] != "settle", r[1])):
            s = state.setdefault(b, {"spent": 0, "open": {}, "known": {}})
            known = s["known"].get(rid)
            if kind == "reserve":
                if known:
                    verdict = "refused" if known[0] == "refused" else "granted"
                elif s["spent"] + sum(s["open"].values()) + amount > CAP:
                    verdict, s["known"][rid] = "refused", ("refused", amount, ts + TTL)
                else:
                    verdict, s["known"][rid] = "granted", ("open", amount, ts + TTL)
                    s["open"][rid] = amount
            elif not known or known[0] == "refused":
                verdict = "unknown"
            elif known[0] == "settled":
                verdict = "repeated"
            else:
                verdict = "settled" if known[0] == "open" else "late"
                s["spent"] += amount - (0 if known[0] == "open" else known[1])
                s["open"].pop(rid, None)
                s["known"][rid] = ("settled", *known[1:])
            told.append((b, rid, verdict))
        out.append((told, mark))
        latest = max([latest or START, *(r[2] for r in batch)])
        mark = latest - LATE
        for b, s in state.items():
            for rid, (what, amount, deadline) in list(s["known"].items()):
                if what == "open" and deadline <= mark:
                    s["spent"] += s["open"].pop(rid)
                    s["known"][rid] = ("expired", amount, deadline)
                    told.append((b, rid, "expired"))
                if deadline + KEPT <= mark:
                    del s["known"][rid]
    return [t for told, _ in out for t in told], {b: s["spent"] + sum(s["open"].values()) for b, s in state.items()}


def test_the_cap_holds_over_random_orders_expiry_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    batches, open_, clock, n = [], [], START, 0
    for _ in range(6):
        batch = []
        for _ in range(60):
            clock += timedelta(seconds=rng.randint(1, 40))
            if open_ and rng.random() < 0.5:
                b, rid, amount = open_[rng.randrange(len(open_))] if rng.random() < 0.2 else open_.pop(rng.randrange(len(open_)))
                batch.append((b, rid, clock, "settle", rng.randint(0, amount)))
            else:
                n += 1
                b, amount = f"b{rng.randint(0, 2)}", rng.randint(1, 150)
                batch.append((b, f"r{n}", clock, "reserve", amount))
                if rng.random() < 0.1:
                    batch.append((b, f"r{n}", clock + timedelta(seconds=1), "reserve", amount))
                if rng.random() < 0.8:
                    open_.append((b, f"r{n}", amount))
        batches.append(batch)
    schema = "budget string, request_id string, ts timestamp, kind string, amount long"
    for k, batch in enumerate(batches):  # one batch a run, so that the query starts again each time
        bad = [("b0", None, clock, "reserve", 1), ("b0", f"bad{k}", clock, "spend", 1), ("b0", f"neg{k}", clock, "reserve", -5)]
        spark.createDataFrame(batch + bad, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run(budget.with_reservations(stream, CAP, TTL, KEPT, "10 minutes"), f"{tmp_path}/check", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want, held = by_hand(batches)
    decided = sorted((r["budget"], r["request_id"], r["verdict"]) for r in got if r["verdict"] != "invalid")
    assert decided == sorted(want)
    assert all(r["spent"] + r["reserved"] <= CAP and r["reserved"] >= 0 for r in got if r["verdict"] != "invalid")
    assert {"granted", "refused", "settled", "late", "repeated", "unknown", "expired"} <= {r["verdict"] for r in got}
    assert sum(r["verdict"] == "invalid" for r in got) == 18 and max(held.values()) <= CAP
