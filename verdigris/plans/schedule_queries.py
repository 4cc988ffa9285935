"""Recurrences, cut-offs in time zones and merged intervals over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import schedules as S
from verdigris.plans.registry import query, table
from verdigris.storage import spread

ZONES = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney"]
#: Events moved over the year, so that clocks change on some days, with a zone.
MOVED = f"select event_id, date_trunc('second', ts) + to_days((event_id % 330)::int) s, ({ZONES})[1 + user_id % 4] z from events"
#: The moments whose wall time ``d`` is in zone ``z``, as ``hit``, beside the one that the engine takes, ``u``.
MOMENTS = "(select *, [x for x in [u + to_minutes(m) for m in [-120, -60, -30, 0, 30, 60, 120]] if timezone(z, timezone('UTC', x)) = d] hit from (select *, timezone('UTC', timezone(z, d)) u from {}))"


def _moved(spark, sf_dir):
    at = F.date_trunc("second", "ts").cast("timestamp")
    moved = F.timestamp_add("DAY", (F.col("event_id") % 330).cast("int"), at).alias("start")
    return table(spark, sf_dir, "events").select("event_id", moved, F.element_at(F.array(*map(F.lit, ZONES)), (1 + F.col("user_id") % 4).cast("int")).alias("zone"))


@query(
    f"""with r as ({MOVED}), i as (select *, event_id % 4 f, unnest(range(case event_id % 4 when 0 then 25 when 1 then 61 when 2 then 400 else 1830 end)) k from r), c as (select *, s + to_days(k::int) d from i),
o as (select *, row_number() over (partition by event_id order by d) n from c where case f when 0 then k % 3 = 0 when 1 then isodow(d) in (1, 4) and datediff('day', date_trunc('week', s), date_trunc('week', d)) % 14 = 0
when 2 then day(d) = day(s) else day(d) = day(s) and month(d) = month(s) and d <= timestamp '2028-12-31' end qualify f <> 2 or n <= 6),
l as (select * from o where not (event_id % 5 = 0 and d::date - s::date in (3, 7)))
select event_id as rule_id, n::int as n, d as "local", coalesce(list_min(hit), u) as utc, case len(hit) when 0 then 'gap' when 1 then 'plain' else 'twice' end as state from {MOMENTS.format("l")}"""
)
def recurring_occurrences(spark, sf_dir):
    """A rule an event: every three days nine times, Mondays and Thursdays of every second week for 60 days, six months, or years to the end
    of 2028; a fifth of them leave days out. With the moment in the event's zone."""
    moved, kind = _moved(spark, sf_dir), F.col("event_id") % 4
    rules = moved.select(
        F.col("event_id").alias("rule_id"),
        "start",
        "zone",
        F.element_at(F.array(*map(F.lit, ["daily", "weekly", "monthly", "yearly"])), (1 + kind).cast("int")).alias("freq"),
        F.when(kind == 0, 3).when(kind == 1, 2).otherwise(1).alias("every"),
        F.when(kind == 1, F.array(F.lit(3), F.lit(0))).alias("weekdays"),
        F.when(kind == 0, 9).when(kind == 2, 6).alias("count"),
        F.when(kind == 1, F.timestamp_add("DAY", F.lit(60), F.col("start"))).alias("until"),
    )
    out_days = rules.where("rule_id % 5 = 0").select("rule_id", F.explode(F.array(*[F.date_add(F.to_date("start"), n) for n in (3, 7)])).alias("day"))
    found = S.occurrences(spread(rules), F.lit("2028-12-31").cast("timestamp"), out_days, keep=("zone",))
    return found.select("rule_id", "n", "local", S.to_utc(F.col("local"), F.col("zone")).alias("at")).select("rule_id", "n", "local", "at.*")


@query(
    f"""with m as (select event_id, s, z, date_trunc('day', s) + to_minutes((event_id * 7 % 1440)::int) d from ({MOVED})), h as (select *, coalesce(list_max(hit), u) c from {MOMENTS.format("m")})
select event_id, s <= c as on_time, epoch(c) - epoch(s) as margin from h"""
)
def zone_cutoffs(spark, sf_dir):
    on_time, margin = S.cut_off(F.col("start"), F.to_date("start"), F.col("event_id") * 7 % 1440, F.col("zone"))
    return _moved(spark, sf_dir).select("event_id", on_time.alias("on_time"), margin.alias("margin"))


@query(
    """with i as (select user_id, ts s, ts + to_seconds((value * 600)::int) e from events), f as (select *, coalesce(s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding), true) n from i where s <= e),
g as (select *, sum(n::int) over (partition by user_id order by s, e rows unbounded preceding) k from f) select user_id, min(s) as "start", max(e) as "end", count(*) as intervals from g group by user_id, k"""
)
def merged_intervals(spark, sf_dir):
    """How long each user is busy, if an event takes ten minutes for each unit of its value."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("start"), F.timestamp_add("SECOND", F.round(F.col("value") * 600).cast("int"), F.col("ts").cast("timestamp")).alias("end"))
    return S.merged_intervals(rows, "user_id", "start", "end")
