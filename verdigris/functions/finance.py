"""Exact rational arithmetic over columns: growth, compounding, margins, and probabilities of draws. Amounts are decimals; results round half up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def growth(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / before)


def cagr(first: Column, last: Column, periods: Column | int) -> Column:
    n = F.lit(periods) if isinstance(periods, int) else periods
    return F.when((first > 0) & (n > 0), F.pow(last / first, 1 / n) - 1)


def compound(principal: Column, rate: Column, periods: Column) -> Column:
    return principal * F.pow(1 + rate, periods)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def break_even(fixed: Column, price: Column, variable: Column) -> Column:
    """The least whole number of units that covers the fixed cost; null where a unit earns nothing."""
    return F.when(price > variable, F.ceil(fixed / (price - variable)))


def proration(amount: Column, used: Column, whole: Column) -> Column:
    return F.round(amount * used / whole, 2)


def stacked_discounts(price: Column, *rates: Column) -> Column:
    out = price
    for r in rates:
        out = out * (1 - r)
    return out


def net_of_tax(gross: Column, rate: Column) -> Column:
    return gross / (1 + rate)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double, multiplied out so that no factorial overflows."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).otherwise(value)


def binomial(n: Column, k: Column, p: Column) -> Column:
    return choose(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def hypergeometric(total: Column, good: Column, drawn: Column, hits: Column) -> Column:
    return choose(good, hits) * choose(total - good, drawn - hits) / choose(total, drawn)


def bayes(prior: Column, hit: Column, false_alarm: Column) -> Column:
    return prior * hit / (prior * hit + (1 - prior) * false_alarm)


def overlap_hours(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Hours of [start, end] within [low, high]."""
    s = F.least(end, high).cast("double") - F.greatest(start, low).cast("double")
    return F.greatest(s, F.lit(0.0)) / 3600
