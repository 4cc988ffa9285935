"""Every rule hit and missed: a sound record of each route, and what breaks it."""

import copy
import hashlib
import json

import pytest

from verdigris.operators import validation as V


def digest(r):
    part = {"images": r["images"], "request": r["request"]}
    return hashlib.sha256(json.dumps(part, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sound(route="double", **more):
    r = {"id": "é1", "track": "text", "split": "dev", "group_id": "g", "annotation_status": "reviewed", "gold": "a", "images": [], "request": {"request_id": "é1", "state": {"z": 1.5, "b": "ü"}, "fields": [{"id": "x", "type": "choice", "options": [{"value": "a"}, {"value": "b"}]}]}}
    r |= more
    d = digest(r)
    review = lambda who, value="a": {"reviewer_id": who, "value": value, "evidence": "seen", "input_sha256": d}
    r["provenance"] = {
        "double": {"reviews": [review("p"), review("q")]},
        "adjudicated": {"reviews": [review("p"), review("q", "b")], "adjudication": review("z")},
        "consensus": {"review_route": "consensus_verified", "reviews": [review("p")], "model_prelabels": [{"provider": x, "value": "a", "input_sha256": d} for x in "mn"]},
        "construction": {"review_route": "construction_verified", "construction": {"truth_source": "programmatic", "truth": "a", "image_checks": "passed"}},
        "audited": {"review_route": "construction_verified", "audit_sample": True, "construction": {"truth_source": "generator_spec", "truth": "a"}, "model_audit": {"verdict": "confirmed", "adjudicated_value": "a", "auditors": ["m"], "input_sha256": d}},
        "audit_review": {"review_route": "construction_verified", "audit_sample": True, "judgement_dependent": True, "construction": {"truth_source": "generator_spec", "truth": "a"}, "reviews": [review("p")]},
    }[route]
    return r


IMAGE = {"path": "i/a.png", "sha256": "0" * 64}
LEVELS = [{"id": "x", "type": "ordinal", "levels": [{"value": 1}, {"value": 2}]}]
#: (codes, route, path to a value, the new value; ... removes it)
BREAKS = [
    (["id", "request_id"], "construction", "id", " é1"), (["id"], "construction", "id", ...), (["track"], "construction", "track", "sound"), (["split"], "construction", "split", ""), (["group"], "construction", "group_id", ...),
    (["request_id"], "construction", "request.request_id", "other"), (["one_field"], "construction", "request.fields", []), (["field_type", "gold_domain"], "construction", "request.fields.0.type", "multi"),
    (["options"], "construction", "request.fields.0.options", [{"value": "a"}]), (["options"], "construction", "request.fields.0.options", [{"value": "a"}, {"value": "a"}]), (["levels", "gold_domain"], "construction", "request.fields", [{"id": "x", "type": "ordinal", "levels": [{"value": 1}, {"value": "2"}]}]),
    (["gold_domain", "truth_gold"], "construction", "gold", "c"), (["gold_domain", "truth_gold"], "construction", "gold", True), (["truth_gold"], "construction", "gold", ...),
    (["text_has_image"], "construction", "images", [IMAGE]), (["image_missing"], "construction", "track", "visual"), (["text_has_image", "image_path"], "construction", "images", [IMAGE | {"path": "../a"}]), (["text_has_image", "image_path"], "construction", "images", [IMAGE | {"path": "a\\b"}]),
    (["text_has_image", "image_path"], "construction", "images", [IMAGE | {"path": "/a"}]), (["text_has_image", "image_digest"], "construction", "images", [IMAGE | {"sha256": "XYZ"}]), (["withheld_gold"], "construction", "gold_withheld", True),
    (["flagged"], "construction", "provenance.review_flags", ["odd"]), (["flagged"], "construction", "provenance.quarantined", True),
    (["two_reviews"], "double", "provenance.reviews", ...), (["reviewer"], "double", "provenance.reviews.0.reviewer_id", "p "), (["review_evidence"], "double", "provenance.reviews.1.evidence", " "), (["review_evidence", "adjudication"], "double", "provenance.reviews.1.value", ...),
    (["review_input"], "double", "provenance.reviews.1.input_sha256", "0"), (["review_domain", "adjudication"], "double", "provenance.reviews.1.value", "c"), (["reviewers_differ"], "double", "provenance.reviews.1.reviewer_id", "p"), (["agreed_gold"], "double", "gold", "b"),
    (["adjudication"], "adjudicated", "provenance.adjudication", ...), (["adjudicator"], "adjudicated", "provenance.adjudication.reviewer_id", "q"), (["adjudication_evidence"], "adjudicated", "provenance.adjudication.evidence", ...), (["adjudication_input"], "adjudicated", "provenance.adjudication.input_sha256", "1"), (["adjudicated_gold"], "adjudicated", "provenance.adjudication.value", "b"),
    (["consensus_barred"], "consensus", "provenance.audit_sample", True), (["consensus_barred"], "consensus", "provenance.judgement_dependent", True), (["prelabels"], "consensus", "provenance.model_prelabels", []), (["prelabel_input"], "consensus", "provenance.model_prelabels.1.input_sha256", "1"),
    (["unanimous"], "consensus", "provenance.model_prelabels.1.provider", "m"), (["unanimous"], "consensus", "provenance.model_prelabels.1.value", "b"), (["one_review"], "consensus", "provenance.reviews", []), (["reviewer"], "consensus", "provenance.reviews.0.reviewer_id", ""),
    (["review_evidence"], "consensus", "provenance.reviews.0.evidence", ...), (["review_input"], "consensus", "provenance.reviews.0.input_sha256", ...), (["consensus_review"], "consensus", "provenance.reviews.0.value", "b"), (["consensus_gold"], "consensus", "gold", "b"),
    (["truth_source"], "construction", "provenance.construction.truth_source", "guess"), (["truth"], "construction", "provenance.construction.truth", ...), (["truth_source", "truth"], "construction", "provenance.construction", ...), (["truth_gold"], "construction", "provenance.construction.truth", None),
    (["judgement_audit"], "construction", "provenance.judgement_dependent", True), (["audit_missing"], "audited", "provenance.model_audit", ...), (["model_audit"], "audited", "provenance.model_audit.auditors", []), (["model_audit"], "audited", "provenance.model_audit.verdict", "open"),
    (["model_audit_input"], "audited", "provenance.model_audit.input_sha256", ...), (["model_audit_gold"], "audited", "provenance.model_audit.adjudicated_value", "b"), (["audit_review_input"], "audit_review", "provenance.reviews.0.input_sha256", "1"), (["audit_review_gold"], "audit_review", "provenance.reviews.0.value", "b"),
]


def broken(route, path, value):
    r = sound(route)
    *way, last = [int(x) if x.isdigit() else x for x in path.split(".")]
    at = r
    for x in way:
        at = at[x]
    if value is ...:
        at.pop(last)
    else:
        at[last] = copy.deepcopy(value)
    if path.split(".")[0] in ("request", "images"):  # what was reviewed is what there is now
        r["provenance"] = sound(route, **{k: r[k] for k in ("request", "images", "track")})["provenance"]
    return r


def test_every_rule_hit_and_missed(spark):
    whole = [sound(x) for x in ("double", "adjudicated", "consensus", "construction", "audited", "audit_review")]
    whole += [sound("construction", track="joint", images=[IMAGE]), sound("construction") | {"annotation_status": "draft", "provenance": {}}, sound("double") | {"gold_withheld": True, "gold": None, "provenance": {}}]
    ordinal = sound("construction", request={"request_id": "é1", "fields": LEVELS}, gold=2)
    ordinal["provenance"]["construction"]["truth"] = 2
    wrong = copy.deepcopy(ordinal)
    wrong["gold"] = wrong["provenance"]["construction"]["truth"] = True  # JSON true is no level
    unchecked = sound("construction", track="joint", images=[IMAGE])
    unchecked["provenance"]["construction"].pop("image_checks")
    cases = [([], r) for r in [*whole, ordinal]] + [(["gold_domain"], wrong), (["image_checks"], unchecked)] + [(codes, broken(*rest)) for codes, *rest in BREAKS]
    rows = [(i, json.dumps(r, ensure_ascii=False)) for i, (_, r) in enumerate(cases)] + [(-1, None), (-2, "{"), (-3, "[1]"), (-4, "7")]
    df = V.validated(spark.createDataFrame(rows, "i int, t string").repartition(3), "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r["i"]: r["problems"] for r in df.collect()}
    assert all(got[i] == ["json"] for i in (-1, -2, -3, -4))
    for i, (codes, r) in enumerate(cases):
        assert got[i] == codes, (codes, r)
    assert {c for codes, _ in cases for c in codes} == {r.code for r in V.RECORD_RULES + V.ROUTE_RULES}
    (draft,) = V.validated(spark.createDataFrame([(json.dumps(whole[7]),)], "t string"), "t", require_reviewed=True).collect()
    assert draft["problems"] == ["unreviewed"]


def test_rules_over_other_records(spark):
    rows = [("1", "g", "dev", ["a", "b"]), ("1", "h", "dev", []), ("2", "g", "test", ["c"]), ("3", "k", "test", ["b", "b"]), ("4", None, "dev", None), (None, None, "test", [None]), (None, "m", None, ["z"])]
    got = sorted((r["id"] or "", r["problems"]) for r in V.across_records(spark.createDataFrame(rows, "id string, g string, s string, i array<string>"), "id", "g", "s", "i").collect())
    assert got == [("", []), ("", []), ("1", ["repeated_id"]), ("1", ["repeated_id", "group_crosses", "image_crosses"]), ("2", ["group_crosses"]), ("3", ["image_crosses"]), ("4", [])]


@pytest.mark.parametrize(
    "code, record, off",
    [
        ("D_NEG_PAIR_UNK", {"gold": None, "provenance": {"trap": "negation", "trap_info": {"source": "pair"}}}, {"gold": "a"}),
        ("D_ML_VELOCITY", {"family": "multi_label", "state": "Record: {..}", "gold": "a", "provenance": {"spec": {"k": "risk", "ask": "velocity", "params": {"velocity": {"approved_only": True, "v": 5}}, "rec": {"txns_24h": 6, "declined_24h": 2}}}}, {"state": "none"}),
        ("D_TOOL_LOST", {"provenance": {"spec": {"k": "tool", "unk": True}}}, {"gold": "x"}),
        ("D_LP_BAND", {"family": "long_policy", "gold": 1, "provenance": {"spec": {"schema": "banded", "p": {"dom": "public_sector"}}}}, {"family": "short_policy"}),
    ],
)
def test_constructions_whose_gold_can_be_doubted(spark, code, record, off):
    rows = [("x", json.dumps(record)), ("x", json.dumps(record | off)), ("x", "{}"), ("x", None)]
    df = V.construction_defects(spark.createDataFrame(rows, "s string, t string"), "t")
    assert [r["defects"] for r in df.collect()] == [[code], [], [], []]
    assert [tuple(r) for r in V.defect_counts(df, "defects", ["s"]).collect()] == [("x", code, 1, 4)]
