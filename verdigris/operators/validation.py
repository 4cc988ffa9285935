"""Validation of decision records: tables of rules, compiled to one expression that tells every rule a record breaks.

A rule is a row (code, applies, holds): two SQL conditions over the parsed record. Where ``applies`` is true and ``holds`` isn't
(false or null), the code is told. So a rule reads as a sentence, rules can be listed, added or left out by code, and all
of them are worked out in one pass without Python. What takes other records (repeated ids, groups and images that cross
splits) is aggregated by key and joined back.

Values of answers keep their JSON type: true, 1 and "1" differ. Every digest is that of ``input_digest``: SHA-256 of the JSON
{"images": ..., "request": ...} with sorted keys and no spaces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Rule(NamedTuple):
    code: str
    applies: str
    holds: str


REVIEW = "reviewer_id: string, value: variant, evidence: string, input_sha256: string"
RECORD = f"""struct<id: string, track: string, split: string, group_id: string, annotation_status: string, gold: variant, gold_withheld: boolean,
images: array<struct<path: string, sha256: string>>,
request: struct<request_id: string, fields: array<struct<id: string, type: string, options: array<struct<value: string>>, levels: array<struct<value: variant>>>>>,
provenance: struct<review_route: string, review_flags: variant, quarantined: boolean, audit_sample: boolean, judgement_dependent: boolean,
  reviews: array<struct<{REVIEW}>>, adjudication: struct<{REVIEW}>, model_prelabels: array<struct<provider: string, value: variant, input_sha256: string>>,
  construction: struct<truth_source: string, truth: variant, image_checks: string>,
  model_audit: struct<verdict: string, adjudicated_value: variant, auditors: array<string>, input_sha256: string>>>""".replace("\n", " ")


def _same(a: str, b: str) -> str:
    """Two JSON values are equal in type and value; a missing one equals nothing but a missing gold."""
    return f"coalesce(to_json({a}), '') = coalesce(to_json({b}), 'null')"


def _said(x: str) -> str:
    """A text that says something and has no blanks around it."""
    return f"(length({x}) > 0 and trim({x}) = {x})"


def _in_domain(x: str) -> str:
    """Null, or of the field's type and among its options or levels."""
    return f"""(coalesce(to_json({x}), 'null') = 'null' or case f.type when 'boolean' then schema_of_variant({x}) = 'BOOLEAN'
when 'choice' then schema_of_variant({x}) = 'STRING' and exists(f.options, o -> o.value = try_variant_get({x}, '$', 'string'))
when 'ordinal' then schema_of_variant({x}) = 'BIGINT' and exists(f.levels, l -> to_json(l.value) = to_json({x})) end)"""


def _reviewed(x: str) -> str:
    """A review says what and why."""
    return f"({x}.value is not null and length(trim({x}.evidence)) > 0)"


_FIELD = "size(r.request.fields) = 1"
_WITHHELD = "coalesce(r.gold_withheld, false)"
_REVIEWS = "coalesce(p.reviews, array())"
_ROUTED = f"r.annotation_status = 'reviewed' and not {_WITHHELD}"
_DOUBLE = f"{_ROUTED} and coalesce(p.review_route, '') not in ('consensus_verified', 'construction_verified')"
_CONSENSUS = f"{_ROUTED} and p.review_route = 'consensus_verified'"
_CONSTRUCTED = f"{_ROUTED} and p.review_route = 'construction_verified'"
_TWO = f"size({_REVIEWS}) >= 2"
_VALUES = "size(array_distinct(transform(p.reviews, x -> to_json(x.value))))"
_AUDITED = f"{_CONSTRUCTED} and p.audit_sample"
_BY_MODEL = f"p.model_audit is not null and size({_REVIEWS}) = 0"

#: What every record must be.
RECORD_RULES = [
    Rule("id", "true", _said("r.id")),
    Rule("track", "true", "r.track in ('text', 'visual', 'joint')"),
    Rule("split", "true", _said("r.split")),
    Rule("group", "true", _said("r.group_id")),
    Rule("request_id", "r.id is not null", "r.request.request_id = r.id"),
    Rule("one_field", "true", _FIELD),
    Rule("field_type", _FIELD, "f.type in ('boolean', 'choice', 'ordinal')"),
    Rule("options", f"{_FIELD} and f.type = 'choice'", f"size(f.options) >= 2 and forall(f.options, o -> {_said('o.value')}) and size(array_distinct(transform(f.options, o -> o.value))) = size(f.options)"),
    Rule("levels", f"{_FIELD} and f.type = 'ordinal'", "size(f.levels) >= 2 and forall(f.levels, l -> schema_of_variant(l.value) = 'BIGINT') and size(array_distinct(transform(f.levels, l -> to_json(l.value)))) = size(f.levels)"),
    Rule("gold_domain", _FIELD, _in_domain("r.gold")),
    Rule("text_has_image", "r.track = 'text'", "size(coalesce(r.images, array())) = 0"),
    Rule("image_missing", "r.track in ('visual', 'joint')", "size(r.images) > 0"),
    Rule("image_path", "size(r.images) > 0", "forall(r.images, i -> length(i.path) > 0 and not contains(i.path, '\\\\') and forall(split(i.path, '/'), s -> s not in ('', '.', '..')))"),
    Rule("image_digest", "size(r.images) > 0", "forall(r.images, i -> i.sha256 rlike '^[0-9a-f]{64}$')"),
    Rule("withheld_gold", _WITHHELD, "coalesce(to_json(r.gold), 'null') = 'null'"),
]
#: Only where records must be reviewed.
REVIEWED_RULE = Rule("unreviewed", "true", "r.annotation_status = 'reviewed'")
#: By which route a reviewed label came, and what the route asks for: two people, model consensus and a person, or construction.
ROUTE_RULES = [
    Rule("flagged", _ROUTED, "coalesce(to_json(p.review_flags), 'null') in ('null', '[]', '{}', '\"\"', 'false', '0') and not coalesce(p.quarantined, false)"),
    Rule("two_reviews", _DOUBLE, _TWO),
    Rule("reviewer", f"{_DOUBLE} and {_TWO}", f"forall(p.reviews, x -> {_said('x.reviewer_id')})"),
    Rule("review_evidence", f"{_DOUBLE} and {_TWO}", f"forall(p.reviews, x -> {_reviewed('x')})"),
    Rule("review_input", f"{_DOUBLE} and {_TWO}", "forall(p.reviews, x -> x.input_sha256 = digest)"),
    Rule("review_domain", f"{_DOUBLE} and {_TWO} and {_FIELD}", f"forall(p.reviews, x -> {_in_domain('x.value')})"),
    Rule("reviewers_differ", f"{_DOUBLE} and {_TWO}", "size(array_distinct(transform(p.reviews, x -> x.reviewer_id))) = size(p.reviews)"),
    Rule("agreed_gold", f"{_DOUBLE} and {_TWO} and {_VALUES} = 1", _same("p.reviews[0].value", "r.gold")),
    Rule("adjudication", f"{_DOUBLE} and {_TWO} and {_VALUES} > 1", "p.adjudication is not null"),
    Rule("adjudicator", f"{_DOUBLE} and {_TWO} and {_VALUES} > 1 and p.adjudication is not null", f"{_said('p.adjudication.reviewer_id')} and not array_contains(transform(p.reviews, x -> x.reviewer_id), p.adjudication.reviewer_id)"),
    Rule("adjudication_evidence", f"{_DOUBLE} and {_TWO} and {_VALUES} > 1 and p.adjudication is not null", _reviewed("p.adjudication")),
    Rule("adjudication_input", f"{_DOUBLE} and {_TWO} and {_VALUES} > 1 and p.adjudication is not null", "p.adjudication.input_sha256 = digest"),
    Rule("adjudicated_gold", f"{_DOUBLE} and {_TWO} and {_VALUES} > 1 and p.adjudication is not null", _same("p.adjudication.value", "r.gold")),
    Rule("consensus_barred", _CONSENSUS, "not coalesce(p.audit_sample, false) and not coalesce(p.judgement_dependent, false)"),
    Rule("prelabels", _CONSENSUS, "size(p.model_prelabels) > 0 and forall(p.model_prelabels, x -> x.provider is not null and x.value is not null)"),
    Rule("prelabel_input", f"{_CONSENSUS} and size(p.model_prelabels) > 0", "forall(p.model_prelabels, x -> x.input_sha256 = digest)"),
    Rule("unanimous", f"{_CONSENSUS} and size(p.model_prelabels) > 0", "size(array_distinct(transform(p.model_prelabels, x -> x.provider))) >= 2 and size(array_distinct(transform(p.model_prelabels, x -> to_json(x.value)))) = 1"),
    Rule("one_review", _CONSENSUS, f"size({_REVIEWS}) = 1"),
    Rule("reviewer", f"{_CONSENSUS} and size({_REVIEWS}) = 1", _said("p.reviews[0].reviewer_id")),
    Rule("review_evidence", f"{_CONSENSUS} and size({_REVIEWS}) = 1", _reviewed("p.reviews[0]")),
    Rule("review_input", f"{_CONSENSUS} and size({_REVIEWS}) = 1", "p.reviews[0].input_sha256 = digest"),
    Rule("consensus_review", f"{_CONSENSUS} and size({_REVIEWS}) = 1 and size(p.model_prelabels) > 0", _same("p.reviews[0].value", "p.model_prelabels[0].value")),
    Rule("consensus_gold", f"{_CONSENSUS} and size(p.model_prelabels) > 0", _same("p.model_prelabels[0].value", "r.gold")),
    Rule("truth_source", _CONSTRUCTED, "p.construction.truth_source in ('generator_spec', 'programmatic')"),
    Rule("truth", _CONSTRUCTED, "p.construction.truth is not null"),
    Rule("truth_gold", f"{_CONSTRUCTED} and p.construction.truth is not null", _same("p.construction.truth", "r.gold")),
    Rule("image_checks", f"{_CONSTRUCTED} and size(r.images) > 0", "p.construction.image_checks = 'passed'"),
    Rule("judgement_audit", f"{_CONSTRUCTED} and p.judgement_dependent", "coalesce(p.audit_sample, false)"),
    Rule("audit_missing", _AUDITED, f"size({_REVIEWS}) > 0 or p.model_audit is not null"),
    Rule("model_audit", f"{_AUDITED} and {_BY_MODEL}", "p.model_audit.verdict = 'confirmed' and size(p.model_audit.auditors) > 0 and p.model_audit.adjudicated_value is not null"),
    Rule("model_audit_input", f"{_AUDITED} and {_BY_MODEL}", "p.model_audit.input_sha256 = digest"),
    Rule("model_audit_gold", f"{_AUDITED} and {_BY_MODEL}", _same("p.model_audit.adjudicated_value", "r.gold")),
    Rule("audit_review_input", f"{_AUDITED} and size({_REVIEWS}) > 0", "forall(p.reviews, x -> x.input_sha256 = digest and x.value is not null)"),
    Rule("audit_review_gold", f"{_AUDITED} and size({_REVIEWS}) > 0", f"forall(p.reviews, x -> {_same('x.value', 'r.gold')})"),
]


def compiled(rules: list[Rule]) -> Column:
    """The codes of the broken rules, each once, in the order of the table."""
    told = F.array(*[F.when(F.coalesce(F.expr(r.applies), F.lit(False)) & ~F.coalesce(F.expr(r.holds), F.lit(False)), F.lit(r.code)) for r in rules])
    return F.array_distinct(F.array_compact(told))


def input_digest(record: Column) -> Column:
    """The digest of a record's (a variant's) model input."""
    part = lambda name, other: F.coalesce(F.to_json(F.try_variant_get(record, f"$.{name}", "variant")), F.lit(other))
    return F.sha2(F.concat(F.lit('{"images":'), part("images", "[]"), F.lit(',"request":'), part("request", "null"), F.lit("}")), 256)


def validated(df: DataFrame, record: str, require_reviewed: bool = False, rules: list[Rule] | None = None, out: str = "problems") -> DataFrame:
    """``df`` with the codes of all rules that the JSON text of a record breaks; ``["json"]`` for a text that is no JSON object, or null.

    ``rules`` replaces RECORD_RULES and ROUTE_RULES. In their conditions r is the record, p its provenance, f the first field of its
    request and digest that of its input."""
    from verdigris.functions.lenient import kind

    table = rules if rules is not None else [*RECORD_RULES, *([REVIEWED_RULE] if require_reviewed else []), *ROUTE_RULES]
    whole = F.try_parse_json(F.col(record))
    parsed = df.select(F.struct("*").alias("__row"), F.when(kind(whole) == "OBJECT", whole).alias("v"), F.from_json(record, RECORD).alias("r"))
    ready = parsed.withColumns({"p": F.col("r.provenance"), "f": F.get("r.request.fields", F.lit(0)), "digest": input_digest(F.col("v"))})
    return ready.select("__row.*", F.when(F.col("v").isNull(), F.array(F.lit("json"))).otherwise(compiled(table)).alias(out))


def across_records(df: DataFrame, id: str, group: str, split: str, images: str) -> DataFrame:
    """id, problems: ``repeated_id``, ``group_crosses``, ``image_crosses`` of each row, empty for none.

    ``images`` is an array of keys (paths, digests). Keys are counted by partial aggregates; only those that break a rule are joined back.
    Null ids, groups, splits and images break none here."""
    from verdigris.storage import materialise

    rows = materialise(df.select(F.col(id).alias("id"), F.col(group).alias("g"), F.col(split).alias("s"), F.col(images).alias("i")).withColumn("row", F.monotonically_increasing_id()), "records")
    crossing = lambda keyed: keyed.where("k is not null").groupBy("k").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("k")
    twice = rows.where("id is not null").groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    imaged = rows.select("row", "s", F.explode("i").alias("k"))
    told = (
        rows.select("row", F.col("id").alias("k")).join(twice, "k").select("row", F.lit(0).alias("at"))
        .unionAll(rows.select("row", F.col("g").alias("k")).join(crossing(rows.select("s", F.col("g").alias("k"))), "k").select("row", F.lit(1).alias("at")))
        .unionAll(imaged.join(crossing(imaged), "k").select("row", F.lit(2).alias("at")))
    )
    names = F.array(F.lit("repeated_id"), F.lit("group_crosses"), F.lit("image_crosses"))
    listed = told.groupBy("row").agg(F.transform(F.sort_array(F.collect_set("at")), lambda x: F.get(names, x)).alias("problems"))
    return rows.join(listed, "row", "left").select(F.col("id").alias(id), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


#: Rules on the specification from which a gold answer was constructed: each names a construction whose gold can be doubted, so it
#: holds where the record is *not* of that kind. In their conditions v is the whole record as a variant.
_S = "$.provenance.spec"


def _spec(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '{path}', '{kind}')"


_UNKNOWN = f"coalesce(to_json({_spec('$.gold', 'variant')}), 'null') = 'null'"
_VELOCITY = f"{_spec(_S + '.params.velocity.v', 'double')}"
_TXNS, _DECLINED = _spec(_S + ".rec.txns_24h", "double"), _spec(_S + ".rec.declined_24h", "double")
CONSTRUCTION_RULES = [
    Rule("D_NEG_PAIR_UNK", f"{_spec('$.provenance.trap')} = 'negation'", f"not ({_spec('$.provenance.trap_info.source')} = 'pair' and {_UNKNOWN})"),
    Rule("D_ML_VELOCITY", f"{_spec('$.family')} = 'multi_label' and {_spec(_S + '.k')} = 'risk' and {_spec(_S + '.ask')} = 'velocity' and contains({_spec('$.state')}, 'Record: {{')".replace("{{", "{"),
         f"not (coalesce({_spec(_S + '.params.velocity.approved_only', 'boolean')}, false) and {_DECLINED} > 0 and not coalesce({_spec(_S + '.missing', 'boolean')}, false) and {_TXNS} - {_DECLINED} < {_VELOCITY} and {_VELOCITY} <= {_TXNS})"),
    Rule("D_TOOL_LOST", f"{_spec(_S + '.k')} = 'tool'", f"not (coalesce({_spec(_S + '.unk', 'boolean')}, false) and {_UNKNOWN})"),
    Rule("D_LP_BAND", f"{_spec('$.family')} = 'long_policy'", f"not coalesce({_spec(_S + '.schema')} = 'banded' and {_spec(_S + '.p.dom')} = 'public_sector', false)"),
]


def construction_defects(df: DataFrame, record: str, rules: list[Rule] = CONSTRUCTION_RULES, out: str = "defects") -> DataFrame:
    """``df`` with the codes of the construction rules under which a record's gold can be doubted."""
    parsed = df.select(F.struct("*").alias("__row"), F.try_parse_json(F.col(record)).alias("v"))
    return parsed.select("__row.*", compiled(rules).alias(out))


def defect_counts(df: DataFrame, defects: str, stratum: list[str]) -> DataFrame:
    """stratum, code, n, rows: how many of a stratum's rows have each defect that occurs in it."""
    rows = df.groupBy(*stratum).agg(F.count("*").alias("rows"))
    return df.select(*stratum, F.explode(defects).alias("code")).groupBy(*stratum, "code").agg(F.count("*").alias("n")).join(rows, stratum)
