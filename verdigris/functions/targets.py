"""Distributions as others write them: soft targets under aliases, and shaped responses read back. What is wrong with a row is
told in a column of codes instead of ending the job; the distribution is null where a code is told.

Unknown is the last outcome and has the key ``__unknown__``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdigris.functions.distributions import argmax, total

#: The key of unknown and its aliases in exports, and how far a sum of probabilities may be off, or a single one outside [0, 1].
UNKNOWN, UNKNOWN_ALIASES = "__unknown__", ["__unknown__", "unknown", "null"]
OFF_SUM, OFF_ONE = 1e-6, 1e-8


def _finite(x: Column) -> Column:
    return F.coalesce(x * 0 == 0, F.lit(False))


def _codes(*cases: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in cases]))


def aliases_of(choice: Column) -> Column:
    """The keys under which a soft target may give a choice's weight: itself, of true and false also with a capital, of unknown its names."""
    truth = F.array(F.initcap(choice), choice)
    return F.when(choice == UNKNOWN, F.array(*map(F.lit, UNKNOWN_ALIASES))).when(choice.isin("true", "false"), truth).otherwise(F.array(choice))


def soft_weights(soft: Column, choices: Column) -> Column:
    """struct<weights, unknown_keys, problems> of a map from key to weight over rendered choices (array<string>).

    weights: in the order of the choices, normalised; a choice without a key has 0. Problems: ``unknown_keys`` (named in their column, sorted),
    ``duplicate_aliases`` (two keys of one choice), ``invalid`` (a weight negative, null or not finite, or no mass), ``missing`` (no map or no choices)."""
    keys = F.map_keys(soft)
    known = F.flatten(F.transform(choices, aliases_of))
    held = F.transform(choices, lambda c: F.filter(aliases_of(c), lambda a: F.array_contains(keys, a)))
    weight = F.transform(held, lambda h: total(F.transform(h, lambda a: F.try_element_at(soft, a))))
    strange = F.sort_array(F.array_except(keys, known))
    mass = total(weight)
    problems = _codes(
        ("missing", soft.isNull() | choices.isNull() | (F.size(choices) == 0)),
        ("unknown_keys", soft.isNotNull() & choices.isNotNull() & (F.size(strange) > 0)),
        ("duplicate_aliases", soft.isNotNull() & choices.isNotNull() & F.exists(held, lambda h: F.size(h) > 1)),
        ("invalid", soft.isNotNull() & choices.isNotNull() & ~(F.forall(weight, lambda w: _finite(w) & F.coalesce(w >= 0, F.lit(False))) & F.coalesce(mass > 0, F.lit(False)))),
    )
    good = F.size(problems) == 0
    return F.struct(F.when(good, F.transform(weight, lambda w: w / mass)).alias("weights"), F.when(F.size(strange) > 0, strange).alias("unknown_keys"), problems.alias("problems"))


def soft_gold(weights: Column, choices: Column) -> Column:
    """The choice of most weight, the first of equals; null for unknown."""
    found = F.get(choices, argmax(weights))
    return F.when(found != UNKNOWN, found)


def shaped(kind: Column, p: Column) -> Column:
    """A response (see ``decoded``) of a distribution p over a field's outcomes with unknown last, not abstained."""
    known, u = F.slice(p, F.lit(1), F.size(p) - 1), F.get(p, F.size(p) - 1)
    wire = F.transform(known, lambda x: F.try_divide(x, total(known)))
    score = total(F.transform(wire, lambda x, i: x * i))
    return F.struct(kind.alias("type"), F.when(kind == "noul", F.get(p, F.lit(0)) + u / 2).alias("noul"), F.when(kind != "noul", wire).alias("probabilities"), F.when(kind == "choice", argmax(known)).alias("choice"), F.when(kind == "score", score).alias("score"), u.alias("unknown"), F.lit(False).alias("abstained"))


def decoded(field_type: Column, outcomes: Column, r: Column) -> Column:
    """struct<status, value, probabilities, problems> of a response r to a field of ``outcomes`` known outcomes.

    r: struct<type, noul, probabilities, choice, score, unknown, abstained>; ``probabilities`` (in the field's order) are those given
    that the answer is known, ``noul`` is p(true) + unknown / 2, ``choice`` the place of the declared option, ``score`` the expected place.
    probabilities come back over all outcomes, unknown last, clamped where rounding left [0, 1]. value is the place of the most probable
    known outcome, null for an abstention. Problems: ``type`` (not the field's), ``abstention`` (unknown outside [0, 1] or no truth value),
    ``number`` (a probability null or not finite), ``keys`` (not as many as outcomes), ``distribution`` (outside [0, 1] or not summing to 1),
    ``choice`` (none of the options, or not the most probable), ``score`` (not the expected place)."""
    boolean = field_type == "boolean"
    wanted = F.when(boolean, "noul").when(field_type == "choice", "choice").when(field_type == "ordinal", "score")
    u = r["unknown"]
    binary = F.array(r["noul"] - u / 2, 1 - u - (r["noul"] - u / 2))
    p = F.concat(F.when(boolean, binary).otherwise(F.transform(r["probabilities"], lambda x: x * (1 - u))), F.array(u))
    value = argmax(F.slice(p, F.lit(1), F.size(p) - 1))
    sound = F.coalesce(F.forall(p, _finite), F.lit(False))
    inside = F.forall(p, lambda x: (x >= -OFF_ONE) & (x <= 1 + OFF_ONE)) & (F.abs(total(p) - 1) <= OFF_SUM)
    score = total(F.transform(r["probabilities"], lambda x, i: x * i))
    problems = _codes(
        ("type", ~(r["type"] == wanted)), ("abstention", ~((u >= 0) & (u <= 1) & r["abstained"].isNotNull())), ("number", ~sound),
        ("keys", ~boolean & ~F.coalesce(F.size(r["probabilities"]) == outcomes, F.lit(False))), ("distribution", sound & ~F.coalesce(inside, F.lit(False))),
        ("choice", (field_type == "choice") & ~F.coalesce((r["choice"] >= 0) & (r["choice"] < outcomes) & (r["abstained"] | (r["choice"] == value)), F.lit(False))),
        ("score", (field_type == "ordinal") & ~F.coalesce(F.abs(r["score"] - score) <= OFF_SUM, F.lit(False))),
    )
    good = F.size(problems) == 0
    return F.struct(
        F.when(good, F.when(r["abstained"], "abstained").otherwise("answered")).alias("status"), F.when(good & ~r["abstained"], value).alias("value"),
        F.when(good, F.transform(p, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))).alias("probabilities"), problems.alias("problems"),
    )
