"""Questions as writers of JSON shape them, brought to one shape: expressions over ``variant`` values, no Python.

A question's options may be strings, an object of texts and descriptions, or objects that name their text in several ways;
levels may be bare numbers, an object, or objects; an intended value may be a numeral or a word in a string. Values are
written as text as JSON writes them (``true``, ``1.5``), strings as they are. JSON null counts as missing, and so does, where a choice of
names is tried, an empty string, zero, false and an empty list or object. An object's entries come in the order of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdigris.functions.passages import bound

#: How long texts may be, and what stands for a missing description or justification.
TEXT, DESCRIPTION, JUSTIFICATION = 120, 400, 800
NO_DESCRIPTION, NO_JUSTIFICATION = "option", "see document"
#: Names under which writers put an option's text and description, a level's value and description, an intended choice.
OPTION_TEXT = ["text", "option", "label", "value", "name"]
OPTION_DESCRIPTION = ["description", "meaning", "desc"]
LEVEL_VALUE = ["value", "score", "level", "rank"]
LEVEL_DESCRIPTION = ["description", "label", "meaning", "text"]
INTENDED_CHOICE = ["text", "option", "label", "value"]

BLANKS = " \t\n\r\x0b\x0c"
WHOLE = r"^[+-]?[0-9]{1,18}$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING, BOOLEAN, VOID, or a name of a number's type; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def member(value: Column, name: str) -> Column:
    """What an object has under a name, as a variant; null where it has nothing or is no object."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), value.try_cast("string"))


def first_said(value: Column, names: list[str]) -> Column:
    """As text, the first member of these names that says something."""
    return F.coalesce(*[bound(member(value, n), lambda m: F.when(~F.to_json(m).isin("null", '""', "0", "0.0", "false", "[]", "{}"), as_text(m))) for n in names])


def _or(text: Column, other: Column) -> Column:
    return F.coalesce(F.when(text != "", text), other)


def _option(text: Column, description: Column) -> Column:
    return F.struct(text.alias("text"), description.alias("description"))


def option(value: Column) -> Column:
    """One option: a string is its own description, other values their text, objects by the names they use."""
    plain = as_text(value)

    def named(said: Column) -> Column:
        described = bound(strip(F.coalesce(first_said(value, OPTION_DESCRIPTION), said)).substr(1, DESCRIPTION), lambda d: _or(d, said))
        return _option(strip(said).substr(1, TEXT), described)

    return (
        F.when(kind(value) == "OBJECT", bound(F.coalesce(first_said(value, OPTION_TEXT), F.lit("")), named))
        .when(kind(value) == "STRING", _option(strip(plain).substr(1, TEXT), _or(strip(plain).substr(1, DESCRIPTION), F.lit(NO_DESCRIPTION))))
        .otherwise(_option(F.coalesce(plain, F.lit("null")).substr(1, TEXT), F.coalesce(plain, F.lit("null")).substr(1, DESCRIPTION)))
    )


def options(value: Column) -> Column:
    """array<struct<text, description>>; null where the value is neither a list nor an object."""
    named = F.map_entries(value.try_cast("map<string,variant>"))
    of_entry = lambda e: _option(strip(e["key"]).substr(1, TEXT), _or(strip(F.coalesce(as_text(e["value"]), F.lit(""))).substr(1, DESCRIPTION), e["key"]))
    return F.when(kind(value) == "OBJECT", F.transform(named, of_entry)).when(kind(value) == "ARRAY", F.transform(value.try_cast("array<variant>"), option))


def _level(value: Column, description: Column) -> Column:
    return F.struct(value.alias("value"), _or(description.substr(1, DESCRIPTION), F.concat(F.lit("level "), value.cast("string"))).alias("description"))


def level(value: Column, at: Column) -> Column:
    """One level, or null for a value that is none (a truth value, null, a list, a word). An object without a whole number takes its place in the list."""
    plain = strip(F.coalesce(as_text(value), F.lit("")))
    given = as_text(F.coalesce(*[member(value, n) for n in LEVEL_VALUE]))  # the first name that is there
    number = F.coalesce(F.when(strip(given).rlike(WHOLE), strip(given).try_cast("long")), at.cast("long"))
    bare = F.when(kind(value) == "STRING", F.when(plain.rlike(WHOLE), plain.try_cast("long"))).otherwise(value.try_cast("double").cast("long"))
    return (
        F.when(kind(value) == "OBJECT", _level(number, strip(F.coalesce(first_said(value, LEVEL_DESCRIPTION), F.lit("")))))
        .when(kind(value).isin("BOOLEAN", "VOID", "ARRAY"), F.lit(None))
        .when(bare.isNotNull(), _level(bare, F.lit("")))
    )


def levels(value: Column) -> Column:
    """array<struct<value, description>>; null where the value is neither a list nor an object."""
    named = F.map_entries(value.try_cast("map<string,variant>"))
    number = lambda e, i: F.coalesce(F.when(strip(e["key"]).rlike(WHOLE), strip(e["key"]).try_cast("long")), i.cast("long"))
    of_entries = F.transform(named, lambda e, i: _level(number(e, i), strip(F.coalesce(as_text(e["value"]), F.lit("")))))
    return F.when(kind(value) == "OBJECT", of_entries).when(kind(value) == "ARRAY", F.filter(F.transform(value.try_cast("array<variant>"), level), lambda x: x.isNotNull()))


def intended(question: Column) -> Column:
    """The intended value as text: a score's numeral, a noul's true or false, a choice's text."""
    value, type_ = member(question, "intended"), as_text(member(question, "type"))
    word = F.lower(strip(as_text(value)))
    string = kind(value) == "STRING"
    return (
        F.when((type_ == "score") & string & word.rlike(WHOLE), word.try_cast("long").cast("string"))
        .when((type_ == "noul") & string & word.isin("true", "yes"), F.lit("true"))
        .when((type_ == "noul") & string & word.isin("false", "no"), F.lit("false"))
        .when((type_ == "choice") & (kind(value) == "OBJECT"), first_said(value, INTENDED_CHOICE))
        .otherwise(as_text(value))
    )


def justification(question: Column) -> Column:
    value = member(question, "justification")
    joined = F.array_join(F.transform(value.try_cast("array<variant>"), lambda x: F.coalesce(as_text(x), F.lit("null"))), " ").substr(1, JUSTIFICATION)
    return _or(F.when(kind(value) == "ARRAY", joined).otherwise(as_text(value)), F.lit(NO_JUSTIFICATION))


def questions(text: Column) -> Column:
    """The questions of a JSON text {"questions": [...]}, each with type, question, options, levels, intended, justification.

    Null where the text is no JSON or no object; no questions where it has none or they are no list; questions that are no objects are left out."""
    # each part is bound, as an expression within a lambda is worked out anew wherever it is written
    return bound(F.try_parse_json(text), _questions)


def _questions(whole: Column) -> Column:
    listed = F.coalesce(F.try_variant_get(whole, "$.questions", "array<variant>"), F.array().cast("array<variant>"))
    shaped = F.transform(
        F.filter(listed, lambda q: kind(q) == "OBJECT"),
        lambda q: F.struct(
            as_text(member(q, "type")).alias("type"), as_text(member(q, "question")).alias("question"), bound(member(q, "options"), options).alias("options"), bound(member(q, "levels"), levels).alias("levels"),
            intended(q).alias("intended"), justification(q).alias("justification"),
        ),
    )
    return F.when(kind(whole) == "OBJECT", shaped)


def with_questions(df: DataFrame, column: str, out: str = "questions") -> DataFrame:
    return df.withColumn(out, questions(F.col(column)))
