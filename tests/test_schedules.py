"""Recurrences, wall time and merged intervals against plain models, and on odd rows."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from verdigris.operators import schedules as S

RULE = "rule_id long, start timestamp, freq string, every int, weekdays array<int>, count int, until timestamp"
LAST = "2027-12-31 23:59:59"


def times(spark, rules, **more):
    out = S.occurrences(spark.createDataFrame(rules, RULE), F.lit(LAST).cast("timestamp"), **more).select("rule_id", "n", F.date_format("local", "yyyy-MM-dd HH:mm").alias("t")).collect()
    return sorted((r["rule_id"], r["n"], r["t"]) for r in out)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def test_rules(spark):
    monthly = (1, at("2024-01-31T09:30"), "monthly", 1, None, 4, None)
    assert [t for _, _, t in times(spark, [monthly])] == ["2024-01-31 09:30", "2024-03-31 09:30", "2024-05-31 09:30", "2024-07-31 09:30"]
    assert [t for _, _, t in times(spark, [monthly], clamp=True)] == ["2024-01-31 09:30", "2024-02-29 09:30", "2024-03-31 09:30", "2024-04-30 09:30"]
    assert [t[:10] for _, _, t in times(spark, [(1, at("2020-02-29T00:00"), "yearly", 1, None, None, None)])] == ["2020-02-29", "2024-02-29"]
    # Thursday the 4th on, every second week, on Mondays and Thursdays: the Monday before the start isn't one
    weekly = (1, at("2024-01-04T23:00"), "weekly", 2, [3, 0, 3, None, 9], None, at("2024-01-29T23:00"))
    assert [t[:10] for _, _, t in times(spark, [weekly])] == ["2024-01-04", "2024-01-15", "2024-01-18", "2024-01-29"]


def test_exceptions_keep_numbers_and_odd_rules_have_none(spark):
    daily = (1, at("2024-01-01T08:00"), "daily", 2, None, 3, None)
    gone = spark.createDataFrame([(1, dt.date(2024, 1, 3)), (1, dt.date(2024, 1, 3)), (1, None), (None, dt.date(2024, 1, 1))], "rule_id long, day date")
    assert times(spark, [daily, daily], exceptions=gone) == [(1, 1, "2024-01-01 08:00")] * 2 + [(1, 3, "2024-01-05 08:00")] * 2
    odd = [(2, None, "daily", 1, None, 2, None), (3, at("2024-01-01T08:00"), "daily", 0, None, 2, None), (4, at("2024-01-01T08:00"), "hourly", 1, None, 2, None), (5, at("2024-01-01T08:00"), None, 1, None, 2, None)]
    odd += [(6, at("2024-01-01T08:00"), "daily", 1, None, 0, None), (7, at("2024-01-02T08:00"), "daily", 1, None, None, at("2024-01-01T08:00")), (8, at("2030-01-01T00:00"), "weekly", 1, None, None, None), (9, at("2024-01-01T08:00"), "weekly", 1, [], None, None)]
    assert times(spark, odd) == []
    assert times(spark, []) == []


def test_wall_time_against_the_zones(spark):
    """All half hours around changes of the clock, half an hour's among them, and random moments."""
    rng, rows = random.Random(3), []
    for zone, day in [("America/New_York", "2024-03-10"), ("America/New_York", "2024-11-03"), ("Europe/Berlin", "2024-03-31"), ("Europe/Berlin", "2024-10-27"), ("Australia/Lord_Howe", "2024-04-07"), ("Australia/Lord_Howe", "2024-10-06"), ("Asia/Kolkata", "2024-06-01")]:
        rows += [(zone, at(day) + dt.timedelta(minutes=15 * k)) for k in range(24)]
        rows += [(zone, at("2024-01-01") + dt.timedelta(minutes=rng.randrange(500_000))) for _ in range(20)]
    df = spark.createDataFrame([*rows, (None, at("2024-01-01")), ("UTC", None)], "zone string, local timestamp")
    out = df.select("zone", F.date_format("local", "yyyy-MM-dd HH:mm").alias("l"), *[F.date_format(S.to_utc(F.col("local"), F.col("zone"), later)["utc"], "yyyy-MM-dd HH:mm").alias(f"u{int(later)}") for later in (False, True)], S.to_utc(F.col("local"), F.col("zone"))["state"].alias("state")).collect()
    for r in out:
        if r["zone"] is None or r["l"] is None:
            assert r["u0"] is r["u1"] is r["state"] is None
            continue
        zone, wall = ZoneInfo(r["zone"]), dt.datetime.fromisoformat(r["l"])
        both = [wall.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc) for f in (0, 1)]
        back = [u.astimezone(zone).replace(tzinfo=None) == wall for u in both]
        state = "gap" if not any(back) else "twice" if both[0] != both[1] else "plain"
        late = both[1] if state == "twice" else both[0]
        assert (r["state"], r["u0"], r["u1"]) == (state, both[0].strftime("%Y-%m-%d %H:%M"), late.strftime("%Y-%m-%d %H:%M")), r
    assert {r["state"] for r in out} == {None, "gap", "twice", "plain"}


def test_merged_intervals_against_a_sweep(spark):
    rng, rows = random.Random(8), []
    for _ in range(600):  # a third in one key, some reaching over many buckets, some without length, some that touch
        s = rng.randrange(0, 40_000)
        rows.append((rng.choice([1, 1, 2, 3, None]), s, s + rng.choice([0, 1, 20, 60, 60, 5_000 if rng.random() < 0.05 else 5])))
    rows += [(1, 40_000, 40_010), (1, 40_010, 40_020), (9, None, 5), (9, 5, None), (9, 7, 6)]
    df = spark.createDataFrame(rows, "k long, s long, e long").select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"), F.lit("x").alias("intervals"))
    want = set()
    for k in {r[0] for r in rows}:
        open_ = None
        for s, e in sorted((s, e) for key, s, e in rows if key == k and s is not None and e is not None and s <= e):
            if open_ and s <= open_[1]:
                open_ = (open_[0], max(open_[1], e), open_[2] + 1)
            else:
                want |= {(k, *open_)} if open_ else set()
                open_ = (s, e, 1)
        want |= {(k, *open_)} if open_ else set()
    for bucket in (1, 700, 86_400):
        out = S.merged_intervals(df, "k", "s", "e", bucket).collect()
        got = [(r["k"], int(r["s"].timestamp()), int(r["e"].timestamp()), r["intervals"]) for r in out]
        assert len(got) == len(set(got)) and set(got) == want
    assert S.merged_intervals(df.limit(0), "k", "s", "e").count() == 0


def test_occurrences_are_not_shuffled_and_end_with_their_count(spark):
    rule = (1, at("2024-01-29T08:00"), "monthly", 1, None, 3, None)
    rules = spark.createDataFrame([rule, (2, at("2024-01-01T08:00"), "daily", 1, None, 2, None)], RULE).withColumn("zone", F.lit("UTC"))
    gone = spark.createDataFrame([(2, dt.date(2024, 1, 1))], "rule_id long, day date").hint("merge")
    out = S.occurrences(rules, F.lit("4000-01-01").cast("timestamp"), gone, keep=("zone",))
    got = sorted((r["rule_id"], r["n"], str(r["local"])[:10], r["zone"]) for r in out.collect())
    assert got == [(1, 1, "2024-01-29", "UTC"), (1, 2, "2024-02-29", "UTC"), (1, 3, "2024-03-29", "UTC"), (2, 2, "2024-01-02", "UTC")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # joined below what makes occurrences
