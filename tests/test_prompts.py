"""Texts of questions against a plain model, and on odd rows."""

import json

from pyspark.sql import functions as F

from verdigris.functions import prompts as P


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_flattened(spark):
    def plain(x):
        text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return "\n".join(f"{k}: {text(v)}" for k, v in x.items()) if isinstance(x, dict) else "\n".join(map(text, x))

    made = [{"b": "x, y: z", "a": [1, "p,q:\"r\\", {"c": None}], "n": None, "t": True}, ["one", 2, {"k": "v,w"}], {"ü": "日本"}, {"deep": {"s": "a\n" * 20_000}}, [{"s": '"' * 5_000}]]
    got = one(spark, [(json.dumps(x, ensure_ascii=False),) for x in made], "t string", P.flattened(F.col("t")))
    assert [g for (g,) in got] == [plain(x) for x in made]
    odd = [("plain text",), ("{not json",), ("[1, 2",), ("{}",), ("[]",), ("",), (None,)]
    assert one(spark, odd, "t string", P.flattened(F.col("t"))) == [("plain text",), ("{not json",), ("[1, 2",), (None,), (None,), (None,), (None,)]
    assert one(spark, [('{"what": "red", "examples": ["a", "b"]}',)], "t string", P.flattened(F.col("t"), "; ")) == [('what: red; examples: ["a", "b"]',)]


def test_states_and_prompts(spark):
    states = [{"b": 1, "a": {"z": [1, 2], "y": "k: v, w"}}, "a string\nof \"two\" lines", {}, [1, {"q": "ä"}]]
    rows = [(json.dumps(x, ensure_ascii=False),) for x in states] + [(None,), ("no json",)]
    got = one(spark, rows, "s string", P.rendered_state(F.col("s")), P.rendered_state(F.col("s"), "compact"))
    for x, (a, b) in zip(states, got):
        assert a == json.dumps(x, sort_keys=True, ensure_ascii=False)
        assert b == (x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    assert got[4:] == [("{}", "{}"), ('"no json"', "no json")]
    options = [("true", None), ("false", "it is not"), ("low", "")]
    schema = "q string, s string, o array<struct<value string, description string>>"
    full, short = one(spark, [("Is it?", '{"a": 1}', options), ("Is it?", "{}", options)], schema, P.prompt(F.col("q"), F.col("s"), F.col("o")), P.prompt(F.col("q"), F.col("s"), F.col("o"), "compact"))
    assert full[0] == P.GUARD["standard"] + '\nState: {"a": 1}\nQuestion: Is it?\nA: yes\nB: no — it is not\nC: low\nD: ' + P.UNKNOWN_TEXT["standard"]
    assert full[1].startswith('State:\n{"a":1}\nQuestion: Is it?\n') and short[1] == "Question: Is it?\n" + P.GUARD["compact"] + "\nA: yes\nB: no — it is not\nC: low\nD: unknown"
    assert one(spark, [(None, "{}", options), ("Is it?", "{}", None)], schema, P.prompt(F.col("q"), F.col("s"), F.col("o"))) == [(None,), (None,)]


def test_codes_and_positions(spark):
    got = [r[0] for r in spark.range(703).select(P.option_code(F.col("id"))).collect()]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert got == [*letters, *(a + b for a in letters for b in letters), None]
    rows = [(["a", "b", "b"], "b"), (["a"], "z"), ([], "a"), (["a"], None), (None, "a")]
    assert one(spark, rows, "o array<string>, g string", P.gold_position(F.col("o"), F.col("g"))) == [(1,), (None,), (None,), (None,), (None,)]


def test_varied_rows_keep_their_answers(spark):
    schema = "state string, question string, options array<string>, target string, cause string"
    rows = [("{}", "q", ["a", "b"], "a", None), ("{}", "q", ["a", "b"], None, "not_listed"), ('{"k": 1}', "question: q", ["a", " Other "], None, "not_listed"), (None, "q\nr", None, "true", None), ("", "q", ["a"] * 25, None, "not_listed"), ("{}", "q", ["a"], None, "blurred")]
    args = [F.col(c) for c in ("state", "question", "options", "target", "cause")]
    always = one(spark, rows, schema, P.varied(*args, lambda name: F.lit(0.0), ["noise"]).alias("v"))
    got = [tuple(v) for (v,) in always]
    assert got[0] == ("noise", "question: q", ["a", "b", "other"], "a", None)
    assert got[1] == ("noise", "question: q", ["a", "b", "other"], "other", None)
    assert got[2] == rows[2]
    assert got[3] == ("noise", "q\nr", None, "true", None)
    assert got[4] == ("noise", "question: q", ["a"] * 25, None, "not_listed")
    assert got[5] == ("noise", "question: q", ["a"], None, "blurred")
    never = one(spark, rows, schema, P.varied(*args, lambda name: F.lit(0.99), ["noise"]).alias("v"))
    assert [tuple(v) for (v,) in never] == rows
