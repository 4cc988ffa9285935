"""Text functions: tokens, n-grams and normalised keys, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams joined by spaces; fewer than n words have none. (``sequence`` counts down when its end is below its start.)"""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def hashed_ngrams(words: Column, n: int) -> Column:
    """``ngrams`` as 64-bit hashes: a tenth of the bytes to move, and distinct in linear time, which Spark has for numbers only.

    Words are hashed once each; the hash of a longer run is that of the two runs, of half its length or overlapping, that make it."""
    def longer(runs: Column, width: int) -> Column:
        if width == n:  # behind the last whole run are ones that go beyond the end
            return F.array_distinct(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - (n - 1), F.lit(0))))
        by = min(width, n - width)
        return _let(F.zip_with(runs, F.slice(runs, F.lit(by + 1), F.size(runs)), lambda x, y: F.xxhash64(x, y)), lambda r: longer(r, width + by))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda r: longer(r, 1))


def state_key(text: Column) -> Column:
    """Digest of the text in lower case with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 256)


def slug(text: Column, longest: int = 48) -> Column:
    """Snake-case key of at most ``longest`` characters; text without letters or digits gives ``option``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    cut = F.regexp_replace(F.substring(s, 1, longest), r"_+$", "")
    return F.when(cut == "", "option").otherwise(cut)


def unique_slugs(texts: Column, longest: int = 48) -> Column:
    """Slugs of an array of texts; one that came before gets its place among its equals as a suffix."""
    plain = F.transform(texts, lambda t: slug(t, longest))

    def numbered(x: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda y: y == x))
        return F.when(seen > 1, F.concat(x, F.lit("_"), seen.cast("string"))).otherwise(x)

    return F.transform(plain, numbered)


def upstream_key(dataset: Column, id: Column) -> Column:
    """Join key of an upstream item: the dataset's name in lower case without punctuation, and the id; a bare number isn't
    enough without its split, so it has none."""
    name = F.regexp_replace(F.lower(dataset), r"[^a-z0-9]+", "")
    return F.when(id.rlike(r"^\d+$"), None).otherwise(F.concat_ws(":", name, F.lower(F.trim(id))))


HEDGES = r"\b(?:cannot|can't|could not|not (?:enough|sufficient|clear|stated|given|shown|specified)|unclear|unknown|insufficient|impossible to (?:tell|say|know)|no way to)\b"


def hedged(text: Column) -> Column:
    """Whether a rationale says that the answer can't be known; null says nothing."""
    return F.coalesce(F.lower(text).rlike(HEDGES), F.lit(False))


def numbers(text: Column) -> Column:
    """Numbers of a text as doubles: thousands separators, decimals and a sign; a trailing percent sign divides by 100."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|-?\d+(?:\.\d+)?%?"), F.lit(0))
    value = lambda x: F.regexp_replace(x, "[,%]", "").try_cast("double")
    return F.transform(found, lambda x: F.when(x.endswith("%"), value(x) / 100).otherwise(value(x)))


def first_json_object(text: Column) -> Column:
    """The text from the first brace to the last, if that is JSON, else null."""
    cut = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(cut).isNotNull() & (cut != ""), cut)


def canonical_digest(json_text: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and no spaces; null where it is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(json_text)), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.2).cast("int")


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the distinct items of ``a`` that ``b`` has too; 0 for none."""
    d = F.array_distinct(a)
    return F.when(F.size(d) > 0, F.size(F.array_intersect(d, b)) / F.size(d)).otherwise(0.0)
