"""Arrays of logits and probabilities: softmax, offsets, rotations and what is read from them. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def bound(x: Column, use) -> Column:
    """``use(x)`` with x worked out once a row, not once for every element of the arrays that ``use`` goes through."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    powers = bound(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp((v - m) / t)))
    return bound(powers, lambda e: bound(total(e), lambda s: F.transform(e, lambda v: v / s)))


def normalised(weights: Column) -> Column:
    """Shares of the sum; uniform where the sum is 0."""
    return bound(weights, lambda w: bound(total(w), lambda s: F.transform(w, lambda v: F.when(s > 0, v / s).otherwise(F.lit(1.0) / F.size(w)))))


def retempered(p: Column, temperature: float) -> Column:
    return normalised(F.transform(p, lambda v: F.pow(v, F.lit(1.0 / temperature))))


def with_unknown_offset(z: Column, offset: Column | float) -> Column:
    """Logits with an offset on the last one, which stands for unknown."""
    o = F.lit(offset) if isinstance(offset, (int, float)) else offset
    return F.transform(z, lambda v, i: F.when(i == F.size(z) - 1, v + o).otherwise(v))


def argmax(p: Column) -> Column:
    """Index from 0 of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def rotated(x: Column, offset: Column | int) -> Column:
    """The array read from ``offset`` on, cyclically."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    return F.transform(x, lambda _, i: F.get(x, ((i + o) % F.size(x)).cast("int")))


def realigned(x: Column, offset: Column | int) -> Column:
    """Undo ``rotated``."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    return F.transform(x, lambda _, i: F.get(x, F.pmod(i - o, F.size(x)).cast("int")))


def cyclic_offsets(n: Column, k: int) -> Column:
    """k evenly spaced offsets below n."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / k).cast("int"))


def concentration(p: Column) -> Column:
    n = F.size(p)
    return F.greatest(F.lit(0.0), (n * F.array_max(p) - 1) / (n - 1))


def brier(p: Column, gold: Column) -> Column:
    return total(F.transform(p, lambda v, i: F.pow(v - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2))))


def nll(p_gold: Column, floor: float = 1e-15) -> Column:
    return -F.log(F.greatest(p_gold, F.lit(floor)))


def earth_mover(p: Column, q: Column) -> Column:
    """Sum of absolute differences of the prefix sums of two distributions over ordered levels."""
    walk = F.aggregate(
        F.zip_with(p, q, lambda a, b: a - b),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("cost")),
        lambda s, d: F.struct((s["sum"] + d).alias("sum"), (s["cost"] + F.abs(s["sum"] + d)).alias("cost")),
    )
    return walk["cost"]


def tempered_blend(model: Column, label: Column, alpha: float) -> Column:
    return normalised(F.zip_with(model, label, lambda a, b: a * alpha + b * (1 - alpha)))


def agreement(a: Column, b: Column) -> Column:
    """One minus the total variation distance."""
    return 1 - total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2


def shaped_boolean(p_true: Column, p_false: Column, unknown: Column) -> Column:
    """p(true) + unknown / 2, over the whole mass."""
    return p_true / (p_true + p_false + unknown) + unknown / (p_true + p_false + unknown) / 2


def expected_level(p: Column, levels: Column) -> Column:
    """Expected level given that one of the levels holds: the mass is renormalised over ``p``."""
    return total(F.zip_with(normalised(p), levels, lambda a, v: a * v))


ECE_RULES = {
    "closed_left_10": (10, "left"),
    "closed_left_15": (15, "left"),
    "closed_right_10": (10, "right"),
    "closed_right_15": (15, "right_open_zero"),
    "closed_right_15_zero": (15, "right"),
}


def ece_bin(confidence: Column, rule: str) -> Column:
    """The bin of a confidence under a named rule. Left: [lo, hi), the last closed. Right: (lo, hi] with 0 in bin 0, or,
    under ``closed_right_15``, in no bin (null), though it still counts in the number of rows."""
    bins, side = ECE_RULES[rule]
    if side == "left":
        return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    at = F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)).cast("int")
    return at if side == "right" else F.when(confidence > 0, at)


def calibration_bucket(options: Column) -> Column:
    """Bucket of the number of options without unknown."""
    return F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").when(options <= 25, "11-25").otherwise("26-254")


def calibration_key(type_: Column, options: Column) -> Column:
    named = F.when(type_ == "noul", "boolean").when(type_ == "score", "ordinal").otherwise(type_)
    return F.concat_ws(":", named, calibration_bucket(options))
