"""Recurrences with exceptions, wall time across changes of the clock, cut-offs, and merged intervals.

Wall times and UTC moments are both timestamps of a session in UTC, as elsewhere in this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.functions.passages import bound

#: What clocks are put back by anywhere since 1970, in minutes.
SET_BACK = (30, 60, 120)


def to_utc(local: Column, zone: Column, later: bool = False) -> Column:
    """(utc, state) of a wall time. ``plain``: it occurs once. ``gap``: clocks skip it; it's read with the offset before the change. ``twice``: clocks
    are put back over it; the earlier moment, or the later one if asked for. Null for a null wall time or zone."""
    # a zone that differs by row is looked up anew at each conversion, so one is made where it will do: clocks change no two times within SET_BACK's most
    after = lambda moment, minutes: moment + F.expr(f"interval '{minutes}' minute")
    wall = lambda moment: F.from_utc_timestamp(moment, zone)

    def told(first: Column) -> Column:
        again = F.coalesce(*[F.when(wall(after(first, m)) == local, after(first, m)) for m in SET_BACK])
        again = F.when(wall(after(first, max(SET_BACK))) != after(local, max(SET_BACK)), again)
        one = lambda moment, state: F.struct(moment.alias("utc"), F.lit(state).alias("state"))
        back = bound(again, lambda x: F.when(x.isNull(), one(first, "plain")).otherwise(one(x if later else first, "twice")))
        return F.when(first.isNotNull(), F.when(wall(first) != local, one(first, "gap")).otherwise(back))

    return bound(F.to_utc_timestamp(local, zone), told)


def cut_off(received: Column, day: Column, minute: Column, zone: Column) -> tuple[Column, Column]:
    """(on_time, margin): whether a UTC moment is no later than a minute of a day in a zone, and the seconds left (negative: late). A
    cut-off that occurs twice is the later one."""
    at = F.timestamp_add("MINUTE", minute.cast("int"), day.cast("date").cast("timestamp"))
    closes = to_utc(at, zone, later=True)["utc"]
    return received <= closes, closes.cast("double") - received.cast("double")


def occurrences(rules: DataFrame, last: Column, exceptions: DataFrame | None = None, clamp: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rule_id, *keep, n, local): when rules recur, numbered from 1 by time; ``keep`` names further columns of the rules.

    ``rules``: rule_id, start (wall time), freq (daily, weekly, monthly or yearly), every, weekdays (an array from 0, Monday; null: the
    start's own), count, until (both may be null). Nothing recurs after ``last``. A month without the start's day is passed over, or
    gives its last day with ``clamp``. As in calendars, an exception (rule_id, day) takes an occurrence out but not its number, so that it uses up
    ``count``. A rule with another frequency, without a start or with ``every`` below 1 has none. Repeated rules recur each.

    A rule's times are one array worked out on its own row, of no more than ``count`` steps where each step gives a time, so nothing is shuffled; a
    rule's exceptions are one array of days, joined to the rule, so that occurrences aren't shuffled either."""
    rules = rules.where("start is not null and every >= 1 and freq in ('daily', 'weekly', 'monthly', 'yearly')")
    day, end = F.to_date("start"), F.least(last, F.coalesce("until", last))
    month, step = F.trunc(day, "month"), F.col("every").cast("int")
    monday = F.date_sub(day, F.weekday(day))
    months = F.when(F.col("freq") == "yearly", step * 12).otherwise(step)

    def upto(span: Column, by: Column, sure: Column = F.lit(False)) -> Column:
        """0, 1, ... as long as so many times ``by`` lie within the span; up to ``count`` where each is ``sure`` to give a time."""
        most = F.when(sure, F.greatest("count", F.lit(1)).cast("int") - 1)  # the least of what isn't null
        return F.when(span >= 0, F.sequence(F.lit(0), F.least(F.floor(span / by).cast("int"), F.when(F.col("count").isNotNull(), most)))).otherwise(F.array().cast("array<int>"))

    def in_month(k: Column) -> Column:
        # of the last day's month: the start's day, or the last one if the month is shorter
        own = F.add_months(day, k * months)
        return own if clamp else F.when(F.dayofmonth(own) == F.dayofmonth(day), own)

    named = F.coalesce(F.array_sort(F.array_distinct(F.filter("weekdays", lambda d: d.between(0, 6)))), F.array(F.weekday(day)))
    daily = F.transform(upto(F.datediff(end, day), step, F.lit(True)), lambda k: F.date_add(day, k * step))
    weekly = F.flatten(F.transform(upto(F.datediff(end, monday), step * 7), lambda k: F.transform("__named", lambda d: F.date_add(monday, k * step * 7 + d.cast("int")))))
    monthly = F.transform(upto((F.year(end) - F.year(month)) * 12 + F.month(end) - F.month(month), months, F.lit(True) if clamp else F.dayofmonth(day) <= 28), in_month)
    days = F.when(F.col("freq") == "daily", daily).when(F.col("freq") == "weekly", weekly).when(F.col("freq").isin("monthly", "yearly"), monthly)
    clock = F.col("start").cast("timestamp") - day.cast("timestamp")
    gone: list[str] = []
    if exceptions is not None:
        out_days = exceptions.where("rule_id is not null and day is not null").groupBy(F.col("rule_id").alias("__r")).agg(F.collect_set(F.col("day").cast("date")).alias("__gone"))
        rules, gone = rules.join(out_days, F.col("rule_id") == F.col("__r"), "left"), ["__gone"]
    # projections of their own: an expression that is used several times, or in a lambda, is worked out once
    held = ["rule_id", *keep, *gone]
    own = rules.withColumn("__named", named).select(*held, "start", "count", end.alias("__end"), clock.alias("__clock"), days.alias("__days"))
    timed = own.select(*held, "count", F.filter(F.transform("__days", lambda d: d.cast("timestamp") + F.col("__clock")), lambda t: (t >= F.col("start")) & (t <= F.col("__end"))).alias("__times"))
    limited = F.when(F.col("count").isNull(), F.col("__times")).otherwise(F.slice("__times", F.lit(1), F.greatest(F.col("count"), F.lit(0))))
    out = timed.select(*held, F.posexplode_outer(limited).alias("n", "local")).where("local is not null")
    if gone:
        out = out.where(~F.coalesce(F.array_contains("__gone", F.to_date("local")), F.lit(False)))
    return out.select("rule_id", *keep, (F.col("n") + 1).alias("n"), "local")


def merged_intervals(df: DataFrame, key: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """(key, start, end, intervals): intervals of a key that overlap or touch, as one, with their number.

    Rows without a start or an end, or that end before they start, take no part; an interval of no length does, a null key is
    a key, and repeated rows count each. A key's rows are sorted in buckets of time, and buckets tell the next ones how far intervals reach and where the
    open one began, so a key of any size is spread over as many tasks as it has buckets."""
    s, e = F.col("__s"), F.col("__e")
    rows = df.select(F.col(key).alias("__k"), F.col(start).cast("timestamp").alias("__s"), F.col(end).cast("timestamp").alias("__e")).where(s <= e)
    # equal starts first become one row
    rows = rows.groupBy("__k", "__s").agg(F.max("__e").alias("__e"), F.count("*").alias("__n"))
    rows = rows.withColumn("__b", F.floor(s.cast("double") / bucket_seconds))
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(parts: DataFrame, what: str) -> DataFrame:
        """Each bucket with the most of ``what`` in the buckets before. A row a key and bucket."""
        return parts.select(F.col("__k").alias("__ck"), F.col("__b").alias("__cb"), F.max(what).over(earlier).alias("__before"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, F.col("__k").eqNullSafe(F.col("__ck")) & (F.col("__b") == F.col("__cb")), "left").drop("__ck", "__cb")

    reach = carried(rows.groupBy("__k", "__b").agg(F.max("__e").alias("__far")), "__far")
    inside = Window.partitionBy("__k", "__b").orderBy("__s")
    so_far = F.greatest(F.max("__e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    opened = beside(rows, reach).withColumn("__open", F.when(so_far.isNull() | (s > so_far), s)).drop("__before")
    begun = carried(opened.groupBy("__k", "__b").agg(F.max("__open").alias("__open")), "__open")
    own = F.coalesce(F.max("__open").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    found = beside(opened, begun).withColumn("__first", own).groupBy("__k", "__first").agg(F.max("__e").alias("__e"), F.sum("__n").alias("__n"))
    return found.select(F.col("__k").alias(key), F.col("__first").alias(start), F.col("__e").alias(end), F.col("__n").alias("intervals"))
