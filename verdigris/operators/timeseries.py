"""Time-aware lookups, step functions and business calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, quoted: str, value: str, within_days: int = 30) -> DataFrame:
    """``left`` with the most recent ``value`` of its key quoted on or before ``at``, if at most ``within_days`` old.

    One pass over both sides sorted by key and time: quotes come before lookups of the same moment, and of several quotes
    of one moment the largest counts."""
    quotes = right.groupBy(F.col(key).alias("__k"), F.col(quoted).alias("__t")).agg(F.max(value).alias("__v"))
    lookups = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    both = quotes.select("__k", "__t", F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")).alias("__q")).unionByName(lookups, allowMissingColumns=True)
    frame = Window.partitionBy("__k").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__q", ignorenulls=True).over(frame)).where("__row is not null")
    fresh = F.datediff(F.col("__t"), F.col("__last.t")) <= within_days
    return seen.select("__row.*", F.when(fresh, F.col("__last.v")).alias(value), F.when(fresh, F.col("__last.t")).alias("quoted_at"))


def step_integral(df: DataFrame, pool: str, at: str, level: str, until: Column) -> DataFrame:
    """pool, hours: the integral of a level that holds from each event to the next, the last one until a given moment."""
    w = Window.partitionBy(pool).orderBy(at)
    now = F.col(at).cast("timestamp").cast("double")
    seconds = F.coalesce(F.lead(now).over(w), until.cast("timestamp").cast("double")) - now
    return df.withColumn("__s", F.greatest(seconds, F.lit(0.0)) * F.col(level)).groupBy(pool).agg((F.sum("__s") / 3600).alias("hours"))


def is_business_day(day: Column, holidays: list[str]) -> Column:
    off = day.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return (F.weekday(day) < 5) & ~off


def calendar(spark, first: str, last: str, holidays: list[str]) -> DataFrame:
    """day, business, number: a row a day; ``number`` counts business days up to and including the day."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day").withColumn("business", is_business_day(F.col("day"), holidays))
    return days.withColumn("number", F.sum(F.col("business").cast("int")).over(Window.orderBy("day")))  # a row a day


def add_business_days(df: DataFrame, day: str, n: int, days: DataFrame, out: str = "due") -> DataFrame:
    """The n-th business day after a day, by number; the calendar is small and read twice."""
    start = days.select(F.col("day").alias("__d"), F.col("number").alias("__n"))
    end = days.where("business").select((F.col("number") - n).alias("__n"), F.col("day").alias(out))
    return df.join(F.broadcast(start), F.to_date(day) == F.col("__d"), "left").join(F.broadcast(end), "__n", "left").drop("__d", "__n")


def nth_weekday(month: Column, weekday: int, n: int) -> Column:
    """The n-th weekday (0 Monday) of a month, null where the month has fewer."""
    first = F.trunc(month, "month")
    day = F.date_add(first, ((F.lit(weekday) - F.weekday(first) + 7) % 7) + 7 * (n - 1))
    return F.when(F.trunc(day, "month") == first, day)


def add_months_clamped(day: Column, n: int) -> Column:
    return F.add_months(day, n)


def working_minutes_due(df: DataFrame, start: str, minutes: int, open_minute: int, close_minute: int, days: DataFrame, out: str = "due") -> DataFrame:
    """When so many working minutes after ``start`` are used up, with opening hours on business days. Worked out on business-day
    numbers, not minute by minute."""
    span = close_minute - open_minute
    at = F.hour(start) * 60 + F.minute(start)
    base = days.select(F.col("day").alias("__d"), F.col("number").alias("__n"), F.col("business").alias("__b"))
    used = F.when(F.col("__b"), F.greatest(F.lit(0), F.least(at, F.lit(close_minute)) - open_minute)).otherwise(F.lit(0))
    done = F.col("__n") - F.col("__b").cast("int")  # business days wholly before the start's day
    joined = df.join(F.broadcast(base), F.to_date(start) == F.col("__d"), "left").withColumn("__m", done * span + used + minutes)
    joined = joined.withColumn("__e", F.ceil(F.col("__m") / span).cast("long"))
    end = days.where("business").select(F.col("number").alias("__e"), F.col("day").alias("__x"))
    rest = F.col("__m") - (F.col("__e") - 1) * span + open_minute
    return joined.join(F.broadcast(end), "__e", "left").withColumn(out, F.timestamp_add("MINUTE", rest.cast("int"), F.col("__x").cast("timestamp"))).drop("__d", "__n", "__b", "__m", "__e", "__x")


def shift_hours(start: Column, end: Column, break_minutes: Column, night_from: int = 22, night_to: int = 6, regular: float = 8.0) -> tuple[Column, Column, Column]:
    """(paid, overtime, night) hours of a shift that may pass midnight once: an end that isn't after the start is on the next day. Night
    hours are those between ``night_from`` and ``night_to``; breaks come off the paid hours."""
    s = start.cast("timestamp").cast("double")
    e = F.when(end.cast("timestamp").cast("double") > s, end.cast("timestamp").cast("double")).otherwise(end.cast("timestamp").cast("double") + 86_400)
    paid = F.greatest(F.lit(0.0), (e - s) / 3600 - break_minutes / 60)
    day = F.date_trunc("day", start.cast("timestamp")).cast("double")
    night = F.lit(0.0)
    for d in (-1, 0, 1):  # the nights that begin on the day before, the day itself, and the next
        low, high = day + d * 86_400 + night_from * 3600, day + (d + 1) * 86_400 + night_to * 3600
        night = night + F.greatest(F.lit(0.0), F.least(e, high) - F.greatest(s, low)) / 3600
    return paid, F.greatest(F.lit(0.0), paid - regular), night


def in_zone(moment: Column, zone: str) -> Column:
    """A UTC moment as local wall time."""
    return F.from_utc_timestamp(moment.cast("timestamp"), zone)
