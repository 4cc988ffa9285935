"""Typed values. True, 1 and "1" are three answers; a null gold means unknown and only an abstention meets it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "__unknown__"


def typed(kind: Column | str, key: Column) -> Column:
    """struct<kind, key>; a null key has kind ``unknown``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.when(key.isNull(), "unknown").otherwise(kind).alias("kind"), F.coalesce(key.cast("string"), F.lit(UNKNOWN)).alias("key"))


def candidate_keys(type_: Column, options: Column, levels: Column) -> Column:
    """Keys of a field in order, the unknown key last. ``options``: array<string>; ``levels``: array<int>."""
    own = F.when(type_ == "boolean", F.array(F.lit("true"), F.lit("false"))).when(type_ == "choice", options).when(type_ == "ordinal", F.transform(levels, lambda x: x.cast("string")))
    return F.concat(own, F.array(F.lit(UNKNOWN)))


def correct(gold: Column, status: Column, value: Column) -> Column:
    """Right where the gold is null and the row abstained without a value, or where an answer equals the gold in kind and
    key. Missing, failed and malformed rows are wrong."""
    known = (status == "answered") & value.isNotNull() & gold.eqNullSafe(value)
    return F.coalesce(F.when(gold.isNull(), (status == "abstained") & value.isNull()).otherwise(known), F.lit(False))


def malformed(status: Column, value: Column, keys: Column) -> Column:
    return F.coalesce(
        ~status.isin("answered", "abstained", "error") | ((status == "answered") & (value.isNull() | ~F.array_contains(keys, value))) | ((status == "abstained") & value.isNotNull()),
        F.lit(True),
    )


def vector_state(status_ok: Column, probabilities: Column, keys: Column) -> Column:
    """``missing``, ``invalid`` or ``valid`` for a map of key to probability."""
    values = F.map_values(probabilities)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    same = (F.size(F.array_except(F.map_keys(probabilities), keys)) == 0) & (F.size(F.array_except(keys, F.map_keys(probabilities))) == 0)
    return F.when(probabilities.isNull(), "missing").when(~F.coalesce(status_ok, F.lit(False)) | ~same | bad | (F.abs(total - 1) > 1e-6), "invalid").otherwise("valid")


ALIASES = {"yes": "true", "y": "true", "no": "false", "n": "false"}


def label_alias(label: Column, type_: Column) -> Column:
    """Trimmed label; of booleans in lower case, with yes and no read as true and false."""
    low = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(type_ == "boolean", F.coalesce(F.try_element_at(table, low), low)).otherwise(F.trim(label))
