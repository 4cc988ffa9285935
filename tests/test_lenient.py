"""Shapes of generated JSON against a plain model of them."""

import json
import random

from pyspark.sql import functions as F

from verdigris.functions import lenient


def said(x):
    return None if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def pick(o, names):
    return next((said(o[n]) for n in names if o.get(n) not in (None, "", 0, False, [], {})), None)


def whole(s):
    try:
        return int(s.strip()) if s is not None and s.strip().lstrip("+-").isdigit() else None
    except ValueError:
        return None


def options_by_hand(v):
    if isinstance(v, dict):
        return [(k.strip()[:120], (said(x) or "").strip()[:400] or k) for k, x in sorted(v.items())]
    if not isinstance(v, list):
        return None
    out = []
    for o in v:
        if isinstance(o, str):
            out.append((o.strip()[:120], o.strip()[:400] or "option"))
        elif isinstance(o, dict):
            text = pick(o, lenient.OPTION_TEXT) or ""
            out.append((text.strip()[:120], (pick(o, lenient.OPTION_DESCRIPTION) or text).strip()[:400] or text))
        else:
            out.append(((said(o) or "null")[:120], (said(o) or "null")[:400]))
    return out


def levels_by_hand(v):
    if isinstance(v, dict):
        pairs = [(whole(k) if whole(k) is not None else i, (said(x) or "").strip()[:400]) for i, (k, x) in enumerate(sorted(v.items()))]
        return [(n, d or f"level {n}") for n, d in pairs]
    if not isinstance(v, list):
        return None
    out = []
    for i, x in enumerate(v):
        if isinstance(x, bool) or x is None or isinstance(x, list):
            continue
        if isinstance(x, dict):
            given = next((x[n] for n in lenient.LEVEL_VALUE if n in x), None)
            n = whole(said(given))
            n = i if n is None else n
            out.append((n, (pick(x, lenient.LEVEL_DESCRIPTION) or "").strip()[:400] or f"level {n}"))
        elif isinstance(x, str):
            if whole(x) is not None:
                out.append((whole(x), f"level {whole(x)}"))
        else:
            out.append((int(x), f"level {int(x)}"))
    return out


VALUES = ["", " ", "a", "  bé\n", "12", " -3 ", "x" * 500, 0, 1, 7, -2, 2.5, True, False, None, [], [1, "a"], {}, {"text": "t"}, {"q": {"r": [1]}}]
NAMES = ["text", "option", "label", "value", "name", "description", "meaning", "desc", "score", "level", "rank", "7", "z", "-1"]


def question(rng):
    value = lambda: rng.choice(VALUES)
    thing = lambda: {n: value() for n in rng.sample(NAMES, rng.randint(0, 4))}
    some = lambda: rng.choice([lambda: [rng.choice([value, thing])() for _ in range(rng.randint(0, 4))], thing, value])()
    q = {"type": rng.choice(["score", "noul", "choice", "other", None]), "options": some(), "levels": some(), "intended": rng.choice([value, thing, lambda: rng.choice([" Yes", "FALSE", "no", "true "])])()}
    return q | ({"justification": rng.choice([value(), ["a", 1, None], "why", None, ""])} if rng.random() < 0.8 else {})


def test_shapes_equal_a_plain_model_and_no_python_runs(spark):
    rng = random.Random(6)
    given = [[question(rng) for _ in range(rng.randint(0, 3))] + rng.choice([[], [1], ["x"]]) for _ in range(400)]
    rows = [(i, json.dumps({"questions": qs})) for i, qs in enumerate(given)]
    df = lenient.with_questions(spark.createDataFrame(rows, "i int, t string").repartition(3), "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in df.collect():
        qs = [q for q in given[r["i"]] if isinstance(q, dict)]
        assert len(r["questions"]) == len(qs)
        for got, q in zip(r["questions"], qs):
            listed = lambda x: None if x is None else [tuple(y) for y in x]
            assert listed(got["options"]) == options_by_hand(q["options"]), q
            assert listed(got["levels"]) == levels_by_hand(q["levels"]), q
            v, word = q["intended"], q["intended"].strip().lower() if isinstance(q["intended"], str) else None
            want = said(v)
            if q["type"] == "score" and word is not None and whole(word) is not None:
                want = str(whole(word))
            elif q["type"] == "noul" and word in ("yes", "no", "true", "false"):
                want = "true" if word in ("yes", "true") else "false"
            elif q["type"] == "choice" and isinstance(v, dict):
                want = pick(v, lenient.INTENDED_CHOICE)
            assert got["intended"] == want, q
            j = q.get("justification")
            assert got["justification"] == ((" ".join("null" if x is None else said(x) for x in j) if isinstance(j, list) else said(j)) or "see document"), q


def test_texts_that_are_no_objects(spark):
    rows = [(None,), ("",), ("{bad",), ("[1]",), ("7",), ("{}",), ('{"questions": 3}',), ('{"questions": null}',), ('{"questions": [null, 1]}',)]
    got = spark.createDataFrame(rows, "t string").select(F.size(lenient.questions(F.col("t"))).alias("n"), lenient.questions(F.col("t")).isNull().alias("none")).collect()
    assert [r["none"] for r in got] == [True] * 5 + [False] * 4 and [r["n"] for r in got[5:]] == [0] * 4


def test_names_of_options_are_each_looked_up_once(spark):
    """What is looked up is bound: each name of an option's text and description stands in the plan once."""
    df = spark.createDataFrame([('{"questions": [{"options": [{"label": "x", "meaning": ""}]}]}',)], "t string")
    found = df.select(lenient.questions(F.col("t")).alias("q"))
    assert found.first()["q"][0]["options"] == [("x", "x")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.desc,") == 1 and plan.count("$.option,") <= 2  # a text of options, and one of an intended choice
