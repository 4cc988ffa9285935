"""Hand-computed cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from verdigris.functions import distributions as D, finance as X, values as V
from verdigris.functions.text import ngrams, tokens
from verdigris.operators import calibration, graph, labels, metrics, quality, sampling, similarity, stats, timeseries


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_classes_come_from_gold_only(spark):
    df = spark.createDataFrame([("t", "true", "true", True), ("t", "true", "true", True), ("t", "true", "true", True), ("t", "false", "true", False)], "k string, gold string, pred string, correct boolean")
    (r,) = metrics.classification(df, ["k"], "gold", "pred").collect()
    assert (r["n"], r["accuracy"], r["balanced_accuracy"]) == (4, 0.75, 0.5)
    assert r["macro_f1"] == pytest.approx(3 / 7)


def test_typed_values_and_abstention(spark):
    df = spark.range(1)
    true, one, word = V.typed("bool", F.lit(True)), V.typed("int", F.lit(1)), V.typed("str", F.lit("1"))
    none = F.lit(None).cast("struct<kind:string,key:string>")
    ask = lambda gold, status, value: df.select(V.correct(gold, F.lit(status), value)).first()[0]
    assert ask(true, "answered", true) and not ask(true, "answered", one) and not ask(one, "answered", word)
    assert ask(none, "abstained", none) and not ask(none, "answered", true)
    assert not ask(true, "abstained", none) and not ask(true, "error", true) and not ask(true, None, true)


def test_probability_vectors(spark):
    keys = F.array(F.lit("a"), F.lit("b"))
    ask = lambda m: spark.sql(f"select {m} as m").select(V.vector_state(F.lit(True), F.col("m"), keys)).first()[0]
    assert ask("map('a', 0.25D, 'b', 0.75D)") == "valid"
    assert ask("map('a', 0.25D)") == "invalid" and ask("map('a', 0.5D, 'b', 0.6D)") == "invalid"
    assert ask("map('a', double('nan'), 'b', 1D)") == "invalid" and ask("cast(null as map<string,double>)") == "missing"


def test_ece_rules_differ_at_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "c double")
    got = {r: [x[0] for x in df.select(D.ece_bin(F.col("c"), r)).collect()] for r in D.ECE_RULES}
    assert got["closed_left_10"] == [0, 1, 9] and got["closed_right_10"] == [0, 0, 9]
    assert got["closed_right_15"] == [None, 1, 14] and got["closed_right_15_zero"] == [0, 1, 14] and got["closed_left_15"] == [0, 1, 14]


def test_first_maximum_wins_and_rotation_is_undone(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    r = df.select(D.argmax(F.col("p")).alias("a"), D.realigned(D.rotated(F.col("p"), 2), 2).alias("b")).first()
    assert r["a"] == 0 and r["b"] == [0.4, 0.4, 0.2]


def test_risk_coverage_ties_are_one_step(spark):
    df = spark.createDataFrame([(0.9, True, True), (0.9, False, True), (0.5, True, True), (None, False, True), (0.8, False, False)], "c double, ok boolean, answerable boolean")
    curve = metrics.risk_coverage(df, "c", "ok").orderBy(F.desc("confidence")).collect()
    assert [(r["n"], r["errors"], r["coverage"]) for r in curve] == [(2, 1, 0.5), (3, 1, 0.75)]
    a = metrics.aurc(metrics.risk_coverage(df, "c", "ok")).first()
    assert a["aurc"] is None and a["partial_aurc"] == pytest.approx(0.5 * 2 / 4 + (1 / 3) / 4)


def test_few_clusters_give_no_interval(spark):
    df = spark.createDataFrame([(i % 9, True) for i in range(30)], "c int, ok boolean")
    r = stats.cluster_bootstrap(df, "c", "ok", 50).first()
    assert r["clusters"] == 9 and r["low"] is None and r["accuracy"] == 1.0
    r = stats.cluster_bootstrap(spark.createDataFrame([(i, i % 2 == 0) for i in range(40)], "c int, ok boolean"), "c", "ok", 200).first()
    assert 0.2 < r["low"] < 0.5 < r["high"] < 0.8


def test_signflip(spark):
    df = spark.createDataFrame([(i, True, i >= 3) for i in range(5)], "c int, a boolean, b boolean")
    r = stats.paired_signflip(df, "c", "a", "b").first()
    assert (r["discordant"], r["p_value"]) == (3, 0.25)
    assert stats.paired_signflip(df, "c", "a", "a").first()["p_value"] == 1.0
    many = spark.createDataFrame([(i, True, False) for i in range(20)], "c int, a boolean, b boolean")
    assert stats.paired_signflip(many, "c", "a", "b", samples=300).first()["p_value"] == pytest.approx(1 / 301, abs=0.02)


def test_power_grows_with_clustering():
    assert stats.required_clusters(0.05, 0.25, 0.3, 3)[0] > stats.required_clusters(0.05, 0.25, 0.0, 3)[0]


def test_kappa_of_one_class_is_one(spark):
    df = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert stats.kappa(df, "a", "b").first()["kappa"] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(0, 30), min_size=1), st.integers(0, 80))
def test_allocations_use_what_there_is(sizes, n):
    for take in (sampling.water_fill(sizes, n), sampling.sqrt_allocation(sizes, max(n, 2 * len(sizes)), 2), sampling.weighted_rates(sizes, {}, n)):
        assert all(0 <= take[k] <= sizes[k] for k in sizes)
    assert sum(sampling.water_fill(sizes, n).values()) == min(n, sum(sizes.values())) == sum(sampling.weighted_rates(sizes, {}, n).values())


def test_expected_load_stays_under_the_cap():
    q = sampling.quotas_under_cap({"a": 100, "b": 50}, {"a": 1.0, "b": 2.0}, {"a": 0.5}, 60)
    assert sum(v * (1.5 if k == "a" else 1) for k, v in q.items()) <= 60 and sum(q.values()) > 40


def test_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n long")
    assert sum(r["take"] for r in sampling.largest_remainder(counts, "s", "n", 7).collect()) == 7


def test_group_cap_passes_by_what_is_too_large(spark):
    df = spark.createDataFrame([("f", g) for g, m in (("a", 5), ("b", 9), ("c", 2)) for _ in range(m)], "f string, g string")
    kept = sampling.running_cap(df, "f", "g", 8, "s").groupBy("g").count().collect()
    assert 1 <= len(kept) and (sum(r["count"] for r in kept) <= 8 or len(kept) == 1)


def test_one_word_edit_is_a_near_duplicate_and_one_shared_gram_is_flagged(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = [*words[:39], "other"]
    long = [*words[:13], *[f"x{i}" for i in range(200)]]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(long)), (3, "nothing here"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["verdict"], r["reasons"]) for r in similarity.decontaminate(docs, bench, id="doc_id", text="text", bench_id="item_id", bench_text="text").collect()}
    assert got == {1: ("drop", "near_dup"), 2: ("flag", "shared_gram"), 3: ("keep", ""), 4: ("keep", ""), 5: ("keep", "")}


def test_frequent_line_is_a_template(spark):
    line = "please choose the best answer from this list"
    bench = spark.createDataFrame([(i, f"{line}\nq{i}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    got = similarity.decontaminate(docs, bench, id="doc_id", text="text", bench_id="item_id", bench_text="text").first()
    assert (got["verdict"], got["reasons"]) == ("flag", "template")


def test_grams_of_short_texts(spark):
    df = spark.createDataFrame([("a b",), ("a b c d",), (None,)], "t string").select(tokens(F.col("t")).alias("w"))
    assert [r[0] for r in df.select(ngrams(F.col("w"), 3)).collect()] == [[], ["a b c", "b c d"], []]


def test_survivors_follow_the_greedy_order(spark):
    """A loser cannot eliminate: 2 loses to 1 first, so 3 stays though 2 would beat it."""
    rec = spark.createDataFrame([(1, 9), (2, 8), (3, 7), (4, 6)], "doc_id long, score long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "a long, b long, share double")
    assert sorted(r["doc_id"] for r in similarity.survivors(rec, pairs, "doc_id", F.col("score")).collect()) == [1, 3]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    parent = list(range(13))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {i: find(i) for e in edges for i in e}


def test_family_roots_stop_at_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")], "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.family_roots(df, "id", "parent").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": (None, None), "o": ("o", 0)}


def test_hamming_pairs(spark):
    codes = [0, 1, 0b111, -1, -2, 1 << 63 - 1]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, c long")
    want = sorted((i, j, d, 1, 1) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (d := bin((codes[i] ^ codes[j]) & (2**64 - 1)).count("1")) <= 3)
    assert rows(similarity.hamming_pairs(df, "id", "c", 3)) == want


def test_hamming_classes(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 6), (5, None)], "id long, c long")
    assert rows(similarity.hamming_pairs(df, "id", "c", 6)) == [(1, 1, 0, 3, 3), (1, 4, 1, 3, 1)]


def test_temperature_fit_lowers_the_loss(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(0, 4, (400, 3))
    y = [int(rng.choice(3, p=np.exp(v / 3) / np.exp(v / 3).sum())) for v in z]
    t = calibration.best_temperature(z, np.array(y))
    assert 2 < t < 4.5
    df = spark.createDataFrame([("k", v.tolist(), g) for v, g in zip(z, y)], "k string, z array<double>, y int")
    fitted = calibration.fit_temperatures(df, "k", "z", "y").first()
    assert fitted["n"] == 400 and fitted["temperature"] == pytest.approx(t, rel=1e-6)
    grid = calibration.grid_temperatures(df, "k", "z", "y", [1.0, 3.0, 9.0]).first()
    assert grid["temperature"] == 3.0


def test_unseen_bucket_keeps_temperature_one(spark):
    df = spark.createDataFrame([("new", [2.0, 0.0])], "k string, z array<double>")
    table = spark.createDataFrame([("old", 5.0)], "k string, temperature double")
    r = calibration.apply_temperatures(df, table, "k", "z").first()
    assert r["pred"] == 0 and r["p"][0] == pytest.approx(1 / (1 + math.exp(-2)))


def test_teacher_table(spark):
    df = spark.createDataFrame(
        [("a", "A", "constructed", "x", True, "y", 0.1, False), ("b", "B", "constructed", "x", True, "x", 0.1, False), ("c", "B", "none", None, True, "x", 0.1, False), ("d", "B", "none", None, True, "x", 0.1, False), ("d", "B", "none", None, True, "x", 0.2, False), ("e", "B", "none", None, True, "u", 0.4, True), ("f", "B", "none", None, False, None, None, False)],
        "id string, source string, gold_kind string, gold string, ok boolean, pred string, p_unknown double, unknown_variant boolean",
    )
    got = {r["id"]: r["reason"] for r in labels.teacher_keep(df).collect()}
    assert got == {"a": "review_first", "b": "kept", "c": "one_solve", "d": "kept", "e": "not_unknown", "f": "no_solve"}


def test_review_merge(spark):
    df = spark.createDataFrame([("a", "r1", "x", 1, False), ("a", "r1", "y", 2, False), ("a", "r2", "y", 1, False), ("b", "r1", "x", 1, False), ("b", "r2", "y", 1, False), ("c", "r1", "x", 1, False), ("b2", "r1", "x", 1, False), ("b2", "r2", "y", 1, False), ("b2", "r3", "z", 1, True)], "id string, reviewer string, value string, seq int, adjudicated boolean")
    got = {r["id"]: (r["state"], r["value"]) for r in labels.merge_reviews(df).collect()}
    assert got == {"a": ("agreed", "y"), "b": ("escalated", None), "c": ("pending", None), "b2": ("adjudicated", "z")}


def test_cascade_counts_fall(spark):
    df = spark.range(10)
    out = quality.cascade(df, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 4), ("none", F.lit(None).cast("boolean"))]).orderBy("step").collect()
    assert [(r["rule"], r["dropped"], r["left"]) for r in out] == [("even", 5, 5), ("small", 2, 3), ("none", 0, 3)]


def test_step_function_and_as_of(spark):
    df = spark.sql("select 'p' pool, timestamp'2024-01-01 00:00:00' t, 2 level union all select 'p', timestamp'2024-01-01 03:00:00', 1")
    assert timeseries.step_integral(df, "pool", "t", "level", F.lit("2024-01-01 05:00:00").cast("timestamp")).first()["hours"] == 8.0
    quotes = spark.sql("select 'k' k, date'2024-01-05' d, 1.5D v union all select 'k', date'2024-01-10', 2.5D")
    asks = spark.sql("select 'k' k, explode(array(date'2024-01-04', date'2024-01-05', date'2024-01-12', date'2024-06-01')) d")
    assert [r["v"] for r in timeseries.as_of(asks, quotes, "k", "d", "d", "v").orderBy("d").collect()] == [None, 1.5, 2.5, None]


def test_business_days(spark):
    days = timeseries.calendar(spark, "2024-01-01", "2024-02-28", ["2024-01-01"])
    df = spark.sql("select date_add(date'2023-12-31', cast(i as int)) d from range(1, 8) t(i)")
    got = {str(r["d"]): str(r["due"]) for r in timeseries.add_business_days(df, "d", 2, days).collect()}
    assert got["2024-01-05"] == "2024-01-09" and got["2024-01-06"] == "2024-01-09" and got["2024-01-01"] == "2024-01-03"
    r = spark.sql("select date'2024-01-31' d").select(timeseries.add_months_clamped(F.col("d"), 1), timeseries.nth_weekday(F.col("d"), 0, 5), timeseries.nth_weekday(F.col("d"), 4, 5)).first()
    assert [str(x) for x in r] == ["2024-02-29", "2024-01-29", "None"]


def test_probability_functions(spark):
    r = spark.range(1).select(X.choose(F.lit(52), F.lit(5)), X.hypergeometric(F.lit(10), F.lit(4), F.lit(3), F.lit(2)), X.choose(F.lit(3), F.lit(4)), X.break_even(F.lit(100), F.lit(7.0), F.lit(8.0))).first()
    assert r[0] == pytest.approx(2598960) and r[1] == pytest.approx(6 * 6 / 120) and r[2] == 0.0 and r[3] is None


def test_replies(spark):
    from verdigris.operators import records

    df = spark.createDataFrame([('x {"answer": " Yes ", "confidence": 2} y',), ("{bad",), (None,), ('{"answer": "other"}',), ("{}",)], "t string")
    got = [tuple(r[0]) for r in df.select(records.parse_reply(F.col("t"), F.array(F.lit("yes"), F.lit("no")))).collect()]
    assert got == [("ok", "yes", 1.0), ("unparsed", None, None), ("unparsed", None, None), ("out_of_domain", None, None), ("no_answer", None, None)]


def test_union_refuses_repeated_ids(spark):
    from verdigris.operators import records

    a, b = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([(2, 0.5)], "id long, b double")
    assert records.union_checked([a, b], "id").count() == 2
    with pytest.raises(Exception, match="repeated id 1"):
        records.union_checked([a, a], "id").collect()


def test_soft_labels_keep_the_last_usable_row(spark):
    from verdigris.operators import records

    rec = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    lab = spark.createDataFrame([(1, 1, True, 0.1), (1, 2, True, 0.2), (1, 3, False, 0.9), (2, 1, False, 0.7)], "id long, seq int, ok boolean, p double")
    got = {r["id"]: r["p"] for r in records.attach_soft_labels(rec, lab, "id", F.col("ok"), "seq", ["p"]).collect()}
    assert got == {1: 0.2, 2: None, 3: None}


def test_donors_are_others(spark):
    from verdigris.functions.hashing import stable_order
    from verdigris.operators import records

    df = spark.range(50)
    got = records.donors(df, "id", stable_order(F.col("id")), ["id"]).collect()
    assert len(got) == 50 and all(r["donor_id"] != r["id"] for r in got)
    assert records.donors(spark.range(1), "id", stable_order(F.col("id")), ["id"]).first()["donor_id"] is None


def test_slugs_and_numbers(spark):
    from verdigris.functions import text as X

    df = spark.createDataFrame([(["Yes, please!", "yes please", "—", "ß"],)], "o array<string>")
    assert df.select(X.unique_slugs(F.col("o"))).first()[0] == ["yes_please", "yes_please_2", "option", "option_2"]
    r = spark.createDataFrame([("a 1,234.5 then -3 and 12%",)], "t string").select(X.numbers(F.col("t"))).first()[0]
    assert r == pytest.approx([1234.5, -3.0, 0.12])


def test_batches_keep_their_budget(spark):
    from verdigris.operators import assembly

    df = spark.createDataFrame([(i, 1 + (i * 37) % 90) for i in range(300)] + [(999, 500)], "id long, t long")
    size = {r["id"]: r["t"] for r in df.collect()}
    own: dict = {}
    for r in assembly.batch_plan(df, "id", "t", 200, 64).collect():
        own.setdefault((r["chunk"], r["batch"]), []).append(size[r["id"]])
    assert sum(map(len, own.values())) == 301
    assert all(len(b) == 1 or len(b) * max(b) <= 200 for b in own.values())


def test_held_out_groups_are_not_linked_to_kept_ones(spark):
    from verdigris.operators import assembly

    data = [(g, "f" if g < "e" else "g", 5) for g in "abcdefgh"]
    groups = spark.createDataFrame(data, "group string, family string, rows long")
    links = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "e"), ("f", "a"), ("f", "b"), ("f", "c")], "a string, b string")
    state = {r["group"]: r["state"] for r in assembly.resolve_held_out(groups, links, {"f": 8, "g": 5, "none": 3}, 10).collect()}
    held = {g for g, s in state.items() if s == "held_out"}
    assert "f" not in held and len(held & set("abcd")) == 2 and len(held & set("efgh")) == 1
    for a, b in (("a", "b"), ("c", "d"), ("d", "e"), ("f", "a")):
        assert {state[a], state[b]} != {"held_out", "kept"}
    none = assembly.resolve_held_out(groups, links, {}, 10).collect()
    assert {r["state"] for r in none} == {"kept"}


def test_manifest_refuses_held_out_ids(spark):
    from verdigris.operators import assembly

    new, old, held = spark.range(10), spark.range(5, 60), spark.range(100, 110)
    out = assembly.replay_manifest(new, old, held, "id", 0.5, "s").collect()
    assert sorted(r["id"] for r in out if r["origin"] == "new") == list(range(10)) and sum(r["origin"] == "replay" for r in out) == 5
    with pytest.raises(Exception, match="held-out id 3"):
        assembly.replay_manifest(new, old, spark.range(3, 4), "id", 0.5, "s").collect()
    kept, gone = assembly.extract_flagged(spark.range(20).withColumn("b", F.col("id") % 2), "id", F.col("id") < 10, "b", 2, "s")
    assert kept.count() == 4 and gone.count() == 10


def test_fit_by_type_pools_small_types(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    z = rng.normal(0, 3, (120, 3))
    y = [int(rng.choice(3, p=np.exp(v / 2) / np.exp(v / 2).sum())) for v in z]
    df = spark.createDataFrame([("big" if i < 100 else "small", v.tolist(), g) for i, (v, g) in enumerate(zip(z, y))], "k string, z array<double>, y int")
    got = {r["k"]: r for r in calibration.fit_by_type(df, "k", "z", "y").collect()}
    assert got["small"]["pooled"] and got["small"]["temperature"] == pytest.approx(max(1.0, calibration.best_temperature(z, np.array(y))), rel=1e-6)
    assert not got["big"]["pooled"] and got["big"]["temperature"] == pytest.approx(max(1.0, calibration.best_temperature(z[:100], np.array(y[:100]))), rel=1e-6)


def test_fits_take_logits_of_several_lengths_and_skip_what_has_none(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        m = (2, 3, 5)[i % 3]
        z = (rng.normal(size=m) * 4).tolist()
        p = np.exp(np.array(z) / 2.5)
        rows.append((("a", "b", None)[i % 2 + (i % 7 == 0)], z, int(rng.choice(m, p=p / p.sum()))))
    odd = [("a", None, 1), ("a", [1.0, None], 0), ("a", [1.0, float("nan")], 0), ("a", [1.0, 2.0], 5), ("a", [1.0, 2.0], None), ("none", None, None)]
    df = spark.createDataFrame(rows + odd, "k string, z array<double>, y int")
    got = {r["k"]: r for r in calibration.fit_temperatures(df, "k", "z", "y").collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        own = [(z, y) for key, z, y in rows if key == k]
        loss = lambda t: np.mean([np.log(np.exp((np.array(z) - max(z)) / t).sum()) - (z[y] - max(z)) / t for z, y in own])  # noqa: B023, E731
        assert r["n"] == len(own) and loss(r["temperature"]) <= min(loss(t) for t in np.exp(np.linspace(-1, 3, 400))) + 1e-9
    one = calibration.fit_by_type(df, "k", "z", "y", least=10_000).collect()
    assert len({r["temperature"] for r in one}) == 1 and all(r["pooled"] for r in one)


def test_which_calibration_ships(spark):
    df = spark.createDataFrame([("a", [2.0, 0.0], i % 2) for i in range(40)], "k string, z array<double>, y int")
    fits = spark.createDataFrame([("a", 50.0)], "k string, temperature double")
    bad = spark.createDataFrame([("a", 0.5)], "k string, temperature double")
    ask = lambda per, authored: tuple(calibration.choose_calibration(df, per, authored, "k", "z", "y").first())[1:3]
    assert ask(fits, 2.0) == (50.0, "per_type") and ask(bad, 2.0) == (2.0, "authored") and ask(bad, None) == (0.5, "per_type")
    assert ask(None, 2.0) == (2.0, "authored") and ask(None, None) == (1.0, "none")


def test_bootstraps_over_families_and_pairs(spark):
    rng = np.random.default_rng(3)
    fam = [f"f{i}" for i in rng.integers(0, 400, 4000)]
    base = rng.normal(size=400)
    ok = lambda lift: [bool(rng.random() < 1 / (1 + np.exp(-base[int(f[1:])] - lift))) for f in fam]
    left = spark.createDataFrame([(i, f, o) for i, (f, o) in enumerate(zip(fam, ok(0.0)))], "id int, fam string, ok boolean")
    right = spark.createDataFrame([(i, f, o) for i, (f, o) in enumerate(zip(fam, ok(0.5)))], "id int, fam string, ok boolean")
    r = stats.paired_family_bootstrap(left, right, "id", "fam", "ok", 2000).first()
    per = {}
    for a, b in zip(left.collect(), right.collect()):
        n, d = per.get(a["fam"], (0, 0))
        per[a["fam"]] = (n + 1, d + b["ok"] - a["ok"])
    units = np.array(list(per.values()))
    drawn = [(lambda u: u[:, 1].sum() / u[:, 0].sum())(units[rng.integers(0, len(units), len(units))]) for _ in range(2000)]
    assert r["delta"] == pytest.approx(units[:, 1].sum() / 4000) and r["families"] == len(per)
    assert r["low"] == pytest.approx(np.quantile(drawn, 0.025), abs=0.006) and r["high"] == pytest.approx(np.quantile(drawn, 0.975), abs=0.006)
    for wrong, words in ((right.where("id > 0"), "same ids"), (right.unionAll(right.limit(1)), "same ids"), (right.withColumn("fam", F.when(F.col("id") == 5, "f999").otherwise(F.col("fam"))), "matching families")):
        with pytest.raises(Exception, match=words):
            stats.paired_family_bootstrap(left, wrong, "id", "fam", "ok", 10).collect()

    pairs = [(f"{v}{i}", f"p{i}", v, bool(rng.random() < q), "test") for i in range(300) for v, q in (("text_only", 0.8), ("irrelevant_image", 0.7))]
    schema = "id string, pair string, variant string, ok boolean, part string"
    df = spark.createDataFrame(pairs, schema)
    r = stats.paired_irrelevance_delta(df, "id", "pair", "variant", "ok", "part", 500).first()
    mean = lambda v: np.mean([o for _, _, x, o, _ in pairs if x == v])
    assert r["irrelevant_image_delta"] == pytest.approx(mean("irrelevant_image") - mean("text_only")) and r["low"] < r["irrelevant_image_delta"] < r["high"] and r["pairs"] == 300
    for extra, words in ((("x", "p0", "text_only", True, "test"), "text_only and one"), (("x", "p999", "text_only", True, "test"), "text_only and one"), (("x", None, "text_only", True, "test"), "text_only and one"), (("text_only1", "p1", "text_only", True, "test"), "ids must differ")):
        with pytest.raises(Exception, match=words):
            stats.paired_irrelevance_delta(spark.createDataFrame([*pairs, extra], schema), "id", "pair", "variant", "ok", "part", 10).collect()
    for wrong in (df.withColumn("part", F.when(F.col("pair") != "p3", "test").otherwise("dev")), df.withColumn("ok", F.when(F.col("pair") != "p3", F.col("ok")))):
        with pytest.raises(Exception, match="partition test"):
            stats.paired_irrelevance_delta(wrong, "id", "pair", "variant", "ok", "part", 10).collect()
    few = spark.createDataFrame([(i, i % 3, i % 2 == 0, i % 5 == 0) for i in range(30)], "i int, c int, a boolean, b boolean")
    r = stats.paired_comparison(few, "c", "a", "b").first()
    assert r["low"] is None and r["records"] == 30 and r["a_only_correct"] == 12 and r["b_only_correct"] == 3


def test_weights_of_units_are_poisson(spark):
    units = spark.range(3000).select(F.col("id").cast("string").alias("u"), F.lit(1).alias("n"), F.col("id").alias("v"))
    got = stats.resampled(units, "u", ["n", "v"], 200, "x").toPandas()
    assert len(got) == 200 and set(got.replicate) == set(range(1, 201)) and abs(got.n.mean() - 3000) < 12 and 40 < got.n.std() < 70
    assert abs(stats.PASSES[0] / stats.MODULUS - np.exp(-1)) < 1e-9
