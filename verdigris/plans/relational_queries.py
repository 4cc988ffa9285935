"""Time-aware queries and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import finance as X
from verdigris.operators import timeseries as T
from verdigris.plans.registry import query, table
from verdigris.streaming import windows as S

HOLIDAYS = ["1995-12-25", "1996-01-01", "1996-12-25"]


@query("with o as (select *, lead(ts, 1, timestamp '2024-02-01') over (partition by user_id order by ts) n from (select user_id, ts, max(value) v from events group by all)) select user_id, round(sum(v * epoch(n - ts)) / 3600, 4) as hours from o group by user_id")
def step_integral(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = T.step_integral(rows, "user_id", "ts", "value", F.lit("2024-02-01").cast("timestamp"))
    return out.withColumn("hours", F.round("hours", 4))


@query(
    """with q as (select o_custkey % 100 k, o_orderdate d, max(o_totalprice) v from orders group by all), l as (select l_orderkey, l_linenumber, l_suppkey % 100 k, l_shipdate d from lineitem)
select l_orderkey, l_linenumber, case when date_diff('day', q.d, l.d) <= 30 then round(q.v, 2) end rate from l asof left join q on l.k = q.k and l.d >= q.d"""
)
def asof_rate(spark, sf_dir):
    quotes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("rate"))
    lookups = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("k"), F.col("l_shipdate").alias("d"))
    return T.as_of(lookups, quotes, "k", "d", "d", "rate").select("l_orderkey", "l_linenumber", F.round("rate", 2).alias("rate"))


CALENDAR = "cal as (select d::date d, (isodow(d) < 6 and d::date not in (date '1995-12-25', date '1996-01-01', date '1996-12-25')) b from range(date '1990-01-01', date '2026-12-31', interval 1 day) t(d)), num as (select d, b, sum(b::int) over (order by d) n from cal)"


@query(f"with {CALENDAR} select o_orderkey, e.d due from orders join num s on s.d = o_orderdate::date left join num e on e.b and e.n = s.n + 5")
def business_day_add(spark, sf_dir):
    days = T.calendar(spark, "1990-01-01", "2026-12-30", HOLIDAYS)
    return T.add_business_days(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 5, days).select("o_orderkey", "due")


@query("select o_orderkey, (o_orderdate::date + interval 1 month)::date renewal from orders")
def month_add(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.add_months_clamped(F.to_date("o_orderdate"), 1).alias("renewal"))


@query("with f as (select distinct date_trunc('month', o_orderdate)::date f from orders), g as (select f, f + ((1 - (isodow(f) - 1) + 7) % 7)::int + 28 d from f) select f \"month\", case when date_trunc('month', d) = f then d end fifth_tuesday from g")
def nth_weekday(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return months.select("month", T.nth_weekday(F.col("month"), 1, 5).alias("fifth_tuesday"))


@query(
    f"""with {CALENDAR}, o as (select event_id, ts, s.b, s.n - s.b::int dn, hour(ts) * 60 + minute(ts) m from events join num s on s.d = ts::date),
w as (select event_id, dn * 480 + (case when b then greatest(0, least(m, 1020) - 540) else 0 end) + 600 t from o), e as (select event_id, t, ceil(t / 480)::bigint k from w)
select event_id, num.d::timestamp + to_minutes((t - (k - 1) * 480 + 540)::int) due from e join num on num.b and num.n = k"""
)
def sla_due(spark, sf_dir):
    """600 working minutes from 9 to 17 on business days."""
    days = T.calendar(spark, "1990-01-01", "2026-12-30", HOLIDAYS)
    return T.working_minutes_due(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 600, 540, 1020, days).select("event_id", "due")


@query(
    """with y as (select o_custkey, year(o_orderdate) y, sum(o_totalprice) s from orders group by all), l as (select *, lag(s) over (partition by o_custkey order by y) p from y)
select o_custkey, y "year", round(s, 2) total, round((s - p) / p, 6) growth from l"""
)
def yearly_growth(spark, sf_dir):
    from pyspark.sql import Window

    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("s"))
    before = F.lag("s").over(Window.partitionBy("o_custkey").orderBy("year"))
    return y.select("o_custkey", "year", F.round("s", 2).alias("total"), F.round(X.growth(F.col("s"), before), 6).alias("growth"))


@query(
    """select p_partkey, ceil(10000 / (p_retailprice - 0.6 * p_retailprice))::bigint break_even, round(p_retailprice * 0.9 * 0.95, 4) discounted, round(p_retailprice / 1.2, 4) net, round(10 * (p_size / 100.0) ** 3 * (1 - p_size / 100.0) ** 2, 6) binomial,
round(0.01 * 0.95 / (0.01 * 0.95 + 0.99 * p_size / 100.0), 6) posterior from part"""
)
def unit_economics(spark, sf_dir):
    price, p = F.col("p_retailprice"), F.col("p_size") / 100
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.break_even(F.lit(10000), price, 0.6 * price).alias("break_even"),
        F.round(X.stacked_discounts(price, F.lit(0.1), F.lit(0.05)), 4).alias("discounted"),
        F.round(X.net_of_tax(price, F.lit(0.2)), 4).alias("net"),
        F.round(X.binomial(F.lit(5), F.lit(3), p), 6).alias("binomial"),
        F.round(X.bayes(F.lit(0.01), F.lit(0.95), p), 6).alias("posterior"),
    )


@query("select n_name, c_mktsegment, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, c_mktsegment)")
def rollup_report(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select time_bucket(interval 6 hours, ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def tumbling_counts(spark, sf_dir):
    return S.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type", "value").withColumn("total", F.round("total", 4))


@query(
    """with g as (select *, (ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes) s from events), k as (select *, sum(case when coalesce(s, false) then 0 else 1 end) over (partition by user_id order by ts, event_id) c from g)
select user_id, min(ts) session_start, max(ts) + interval 30 minutes session_end, count(*) n from k group by user_id, c"""
)
def session_counts(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@query(
    """select c_name, o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' group by all order by sum(l_extendedprice * (1 - l_discount)) desc, o_orderkey limit 20"""
)
def star_join_topk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = joined.groupBy("c_name", "o_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return revenue.orderBy(F.desc("r"), "o_orderkey").limit(20).select("c_name", "o_orderkey", F.round("r", 2).alias("revenue"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """with s as (select event_id, epoch(ts) s, epoch(date_trunc('day', ts)) d, epoch(date_trunc('day', ts)) + (event_id * 37 % 1440) * 60 e0, event_id % 45 b from events),
e as (select *, case when e0 > s then e0 else e0 + 86400 end e from s), p as (select *, greatest(0, (e - s) / 3600 - b / 60) paid from e)
select event_id, round(paid, 6) paid, round(greatest(0, paid - 8), 6) overtime,
round((greatest(0, least(e, d - 86400 + 86400 + 21600) - greatest(s, d - 86400 + 79200)) + greatest(0, least(e, d + 86400 + 21600) - greatest(s, d + 79200)) + greatest(0, least(e, d + 172800 + 21600) - greatest(s, d + 86400 + 79200))) / 3600, 6) night from p"""
)
def shift_pay(spark, sf_dir):
    """Shifts from an event's time to a minute of the day, breaks off, with overtime and night hours."""
    end = F.timestamp_add("MINUTE", (F.col("event_id") * 37 % 1440).cast("int"), F.date_trunc("day", F.col("ts").cast("timestamp")))
    paid, overtime, night = T.shift_hours(F.col("ts"), end, F.col("event_id") % 45)
    return table(spark, sf_dir, "events").select("event_id", F.round(paid, 6).alias("paid"), F.round(overtime, 6).alias("overtime"), F.round(night, 6).alias("night"))
