"""Questions written out, and rows varied with what changes no answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import prompts as P
from verdigris.functions.hashing import unit
from verdigris.plans.registry import query, table

NOISE = ['{"theme": "dark"}', "Ticket 4711 is open.", '{"locale": "de"}']
KINDS = ["view", "click", "purchase", "error"]


def _sql_draw(name: str) -> str:
    return f"(('0x' || left(sha256(concat_ws(chr(0), 'vary', event_id::varchar, '{name}')), 12))::bigint / 281474976710656.0)"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query(
    f"""with e as (select event_id, 'Did user ' || user_id || ' mean to ' || event_type || '?' q, props s, event_type t from events), o as (select *, 'A: yes' || chr(10) || 'B: no — another ' || t || chr(10) || 'C: ' || t || chr(10) || 'D: ' l from e)
select event_id, '{P.GUARD["standard"]}' || chr(10) || 'State: ' || coalesce(s, '{{}}') || chr(10) || 'Question: ' || q || chr(10) || l || '{P.UNKNOWN_TEXT["standard"]}' as full_text,
case when coalesce(s, '{{}}') = '{{}}' then '' else 'State:' || chr(10) || replace(s, ' ', '') || chr(10) end || 'Question: ' || q || chr(10) || '{P.GUARD["compact"]}' || chr(10) || l || 'unknown' as compact_text,
'kind: ' || t || chr(10) || 'props: ' || coalesce(s, 'null') as instructions from o"""
)
def prompt_texts(spark, sf_dir):
    """A question an event in both layouts, and structured instructions on one line an entry."""
    rows = table(spark, sf_dir, "events")
    asked = F.format_string("Did user %d mean to %s?", "user_id", "event_type")
    option = lambda value, said: F.struct(value.alias("value"), said.alias("description"))
    nothing = F.lit(None).cast("string")
    options = F.array(option(F.lit("true"), nothing), option(F.lit("false"), F.concat(F.lit("another "), "event_type")), option(F.col("event_type"), nothing))
    told = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return rows.select("event_id", P.prompt(asked, F.col("props"), options).alias("full_text"), P.prompt(asked, F.col("props"), options, "compact").alias("compact_text"), P.flattened(told).alias("instructions"))


@query(
    f"select event_type, event_id % 5 as shift, (list_position(list_concat({_sql_list(KINDS)}[1 + event_id % 5:], {_sql_list(KINDS)}[:event_id % 5]), event_type) - 1)::int as gold_position, count(*) as n from events group by all"
)
def gold_positions(spark, sf_dir):
    """Where answers stand among options that are rotated, as a count."""
    kinds, shift = F.array(*map(F.lit, KINDS)), (F.col("event_id") % 5).cast("int")
    turned = F.concat(F.slice(kinds, 1 + shift, F.lit(4)), F.slice(kinds, F.lit(1), shift))
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 5).alias("shift"), P.gold_position(turned, F.col("event_type")).cast("int").alias("gold_position"))
    return rows.groupBy("event_type", "shift", "gold_position").agg(F.count("*").alias("n"))


@query(
    f"""with e as (select event_id, case when event_id % 2 = 0 then props end s, 'Kind of event ' || event_id || '?' q, case when event_id % 3 > 0 then {_sql_list(KINDS)} end o, case when event_id % 4 > 0 then event_type end t, case when event_id % 4 = 0 then 'not_listed' end c from events),
d as (select *, {", ".join(f"{_sql_draw(n)} d_{n}" for n in ("noise", "form", "none", "decoy", "label", "state"))} from e), f as (select *, o is not null and c is not null and d_none < 0.35 settled, o is not null and t is not null and d_decoy < 0.1 decoy, {_sql_list(P.NO_MATCH)}[1 + floor(d_label * 4)::int] label from d)
select event_id, case when coalesce(s, '') in ('', '{{}}') and d_noise < 0.15 then {_sql_list(NOISE)}[1 + floor(d_state * 3)::int] else s end as state, case when d_form < 0.06 then 'question: ' || q else q end as question,
array_to_string(case when settled or decoy then list_append(o, label) else o end, '|') as options, case when settled then label else t end as target, case when settled then null else c end as cause from f"""
)
def varied_rows(spark, sf_dir):
    """Events as questions, some without a state, some whose answer isn't listed, some of them not choices."""
    n = F.col("event_id")
    draw = lambda name: unit("vary", n, name)
    rows = table(spark, sf_dir, "events").select(
        n,
        F.when(n % 2 == 0, F.col("props")).alias("s"),
        F.concat(F.lit("Kind of event "), n.cast("string"), F.lit("?")).alias("q"),
        F.when(n % 3 > 0, F.array(*map(F.lit, KINDS))).alias("o"),
        F.when(n % 4 > 0, F.col("event_type")).alias("t"),
        F.when(n % 4 == 0, "not_listed").alias("c"),
    )
    out = rows.select(n, P.varied(*[F.col(c) for c in "sqotc"], draw, NOISE).alias("v")).select(n, "v.*")
    return out.withColumn("options", F.array_join("options", "|"))
