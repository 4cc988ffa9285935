"""What can be asked about a passage: its names, numbers and clauses, with the code points where they stand. No Python runs.

``spans`` finds the matches of a pattern from the left, none overlapping, by cutting the text at the pattern: a match
begins where the gaps and matches before it end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Runs of up to three capitalised words, and words that begin no name.
NAME = r"(?U)\b([A-Z][a-zA-Z'’-]{2,}(?:\s+(?:of|the|de|van|and|&)?\s*[A-Z][a-zA-Z'’-]{2,}){0,2})"
NO_NAME = (
    "The This That There These Those When What Where Which While However Although Because Since After Before Also Then They Their "
    "You Your Yes No But For And It If In On As At So My We Our His Her Its One Some Any All Thanks Hi Hello User System Assistant Edit Note Answer Question"
).split()
#: Amounts of money, percentages and measures, and what a measure's unit counts.
MONEY = r"(?U)([$£€])\s?(\d[\d,]*(?:\.\d+)?)"
PERCENT = r"(?U)(\d[\d,]*(?:\.\d+)?)\s?(?:%|per cent|percent)"
UNITS = "kg|kilograms?|g|grams?|lbs?|pounds?|oz|ounces?|km|kilometres?|kilometers?|miles?|metres?|meters?|cm|mm|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|litres?|liters?|ml|watts?|volts?"
MEASURE = rf"(?Ui)(\d[\d,]*(?:\.\d+)?)\s?({UNITS})\b"
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR"}
QUANTITIES = {
    "weight in kilograms": ["kg", "kilogram"], "weight in grams": ["g", "gram"], "weight in pounds": ["lb", "pound"], "weight in ounces": ["oz", "ounce"],
    "distance in kilometres": ["km", "kilometre", "kilometer"], "distance in miles": ["mile"], "length in metres": ["metre", "meter"], "length in centimetres": ["cm"], "length in millimetres": ["mm"],
    "duration in minutes": ["minute", "min"], "duration in hours": ["hour", "hr"], "number of days": ["day"], "number of weeks": ["week"], "number of months": ["month"], "number of years": ["year"],
    "volume in litres": ["litre", "liter"], "volume in millilitres": ["ml"], "power in watts": ["watt"], "voltage in volts": ["volt"],
}
#: Where sentences end, how long a clause is, who is speaking where none is.
SENTENCE, SHORTEST, LONGEST, SPEAKERS = r"(?U)(?<=[.!?])\s+", 40, 180, ["User:", "System:", "Assistant:"]

BLANK = r"(?U)\s+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda an expression is worked out again wherever it is written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, length, text>>: the non-empty matches from the left; start counts code points from 0. Null for null."""
    return bound(text, lambda t: _spans(t, pattern))


def _spans(text: Column, pattern: str) -> Column:
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    place = F.zip_with(found, gaps, lambda x, g: F.struct(x.alias("x"), F.length(g).alias("gap")))
    place = F.filter(place, lambda x: x["x"].isNotNull())  # there is a gap more than matches
    none = F.array().cast("array<struct<start:int,length:int,text:string>>")
    begun = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def put(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        own = F.struct(start.alias("start"), F.length(x["x"]).alias("length"), x["x"].alias("text"))
        return F.struct((start + F.length(x["x"])).alias("at"), F.array_append(acc["out"], own).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(place, begun, put, lambda acc: acc["out"]))


def apart(found: Column) -> Column:
    """Of spans that overlap, that which begins first, the longest of those; in order."""
    none = F.array().cast("array<struct<start:int,length:int,text:string>>")
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["length"]).alias("short"), x["text"].alias("text"))))

    def put(acc: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), (-x["short"]).alias("length"), x["text"].alias("text"))
        free = x["start"] >= acc["end"]
        return F.struct(F.when(free, x["start"] - x["short"]).otherwise(acc["end"]).alias("end"), F.when(free, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("end"), none.alias("out")), put, lambda acc: acc["out"])


def _first_each(items: Column, key: str, most: int, fields: str) -> Column:
    """The first ``most`` items whose key, a field, no earlier item has; ``fields`` are theirs. One pass that remembers what it returns."""
    none = F.array().cast(f"array<struct<{fields}>>")
    new = lambda out, x: (F.size(out) < most) & ~F.exists(out, lambda y: y[key] == x[key])
    return F.aggregate(items, none, lambda out, x: F.when(new(out, x), F.array_append(out, x)).otherwise(out))


def names(text: Column, title: Column | None = None, most: int = 12) -> Column:
    """array<struct<start, text>>: capitalised names in order of appearance, each once, ``most`` at most; a title of several words comes
    first with start null. Not names: what begins with a common word, capitals of up to three letters, a single word that begins a sentence."""
    body = F.coalesce(text, F.lit(""))
    found = F.transform(spans(body, NAME), lambda x: F.struct(x["start"].alias("start"), F.trim(F.regexp_replace(x["text"], BLANK, " ")).alias("text")))

    def named(x: Column) -> Column:
        before = F.regexp_replace(F.substring(body, F.greatest(x["start"] - 1, F.lit(1)), F.least(x["start"], F.lit(2))), r"(?U)\s+$", "")
        begins = (x["start"] == 0) | before.rlike(r"[.!?]$")
        capitals = (F.upper(x["text"]) == x["text"]) & (F.length(x["text"]) <= 3)
        return ~F.split(x["text"], " ")[0].isin(NO_NAME) & ~capitals & ~(~x["text"].contains(" ") & begins)

    kept = F.filter(found, named)
    if title is not None:
        good = title.rlike("^[A-Z]") & (F.length(title) <= 60) & title.contains(" ")
        none = F.array().cast("array<struct<start:int,text:string>>")
        kept = F.concat(F.when(good, F.array(F.struct(F.lit(None).cast("int").alias("start"), title.alias("text")))).otherwise(none), kept)
    return _first_each(kept, "text", most, "start:int,text:string")


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def quantities(text: Column, most: int = 8) -> Column:
    """array<struct<raw, value, unit, quantity, start>>: amounts of money, then percentages, then measures, each raw text once, ``most`` at
    most; values in (0, 1,000,000)."""
    return bound(F.coalesce(text, F.lit("")), lambda body: _quantities(body, most))


def _quantities(body: Column, most: int) -> Column:
    row = lambda x, raw, value, unit, quantity: F.struct(raw.alias("raw"), value.alias("value"), unit.alias("unit"), quantity.alias("quantity"), x["start"].alias("start"))
    signs = F.create_map(*[F.lit(v) for kv in CURRENCIES.items() for v in kv])
    stems = F.create_map(*[F.lit(v) for q, units in QUANTITIES.items() for u in units for v in (u, q)])
    money = F.transform(spans(body, MONEY), lambda x: row(x, F.concat(_part(x["text"], MONEY, 1), _part(x["text"], MONEY, 2)), _number(_part(x["text"], MONEY, 2)), signs[_part(x["text"], MONEY, 1)], F.lit("price")))
    share = F.transform(spans(body, PERCENT), lambda x: row(x, F.concat(_part(x["text"], PERCENT, 1), F.lit("%")), _number(_part(x["text"], PERCENT, 1)), F.lit("per cent"), F.lit("percentage")))

    def measured(x: Column) -> Column:
        unit = _part(x["text"], MEASURE, 2)
        low = F.lower(unit)
        stem = F.when(low.endswith("ss"), low).otherwise(F.regexp_replace(low, "s+$", ""))
        return row(x, F.concat(_part(x["text"], MEASURE, 1), F.lit(" "), unit), _number(_part(x["text"], MEASURE, 1)), low, F.try_element_at(stems, stem))

    measures = F.filter(F.transform(spans(body, MEASURE), measured), lambda x: x["quantity"].isNotNull())
    usable = F.filter(F.concat(money, share, measures), lambda x: (x["value"] > 0) & (x["value"] < 1_000_000))
    return _first_each(usable, "raw", most, "raw:string,value:double,unit:string,quantity:string,start:int")


def number_spans(text: Column) -> Column:
    """array<struct<start, length, text>>: amounts, percentages and measures that don't overlap, in order: where two do, the one that begins first, the longer one of those."""
    body = F.coalesce(text, F.lit(""))
    return apart(F.concat(spans(body, MONEY), spans(body, PERCENT), spans(body, MEASURE)))


def clauses(text: Column, most: int = 8) -> Column:
    """array<string>: sentences of 40 to 180 characters that begin with a letter, ask nothing and name no speaker, without their full stop; ``most`` at most."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    said = F.transform(F.split(flat, SENTENCE, -1), lambda s: F.trim(F.regexp_replace(s, BLANK, " ")))

    def good(s: Column) -> Column:
        spoken = reduce(lambda a, b: a | b, [s.startswith(x) for x in SPEAKERS])
        return F.length(s).between(SHORTEST, LONGEST) & ~s.endswith("?") & ~spoken & s.rlike(r"^\p{L}")

    return F.transform(F.slice(F.filter(said, good), 1, most), lambda s: F.regexp_replace(s, r"\.+$", ""))
