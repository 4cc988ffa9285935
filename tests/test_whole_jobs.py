"""Operators against the whole of their job, where a shorter way once lost rows."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import calibration, similarity


def test_temperature_fit_reads_all_rows_of_a_large_key(spark):
    """60,000 rows of one key, of which a third are equal."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    z = rng.normal(0, 4, (60_000, 3))
    y = np.array([rng.choice(3, p=np.exp(v / 2) / np.exp(v / 2).sum()) for v in z])
    z[:20_000], y[:20_000] = [3.0, 0.0, -1.0], 1
    df = spark.createDataFrame(pd.DataFrame({"k": "k", "z": z.tolist(), "y": y}), "k string, z array<double>, y int")
    fitted = calibration.fit_temperatures(df, "k", "z", "y").first()
    assert fitted["n"] == 60_000 and fitted["temperature"] == pytest.approx(calibration.best_temperature(z, y), rel=1e-6)


def test_survivors_of_a_long_chain(spark):
    """Each record wins over the next, in rank order, so every other one goes; two pairs are settled a round."""
    n = 106
    rec = spark.createDataFrame([(i, n - i) for i in range(n)], "doc_id long, score long")
    pairs = spark.createDataFrame([(i, i + 1, 0.99 - i / 1000) for i in range(n - 1)], "a long, b long, share double").coalesce(1)
    left = similarity.survivors(rec.coalesce(1), pairs, "doc_id", F.col("score")).collect()
    assert sorted(r["doc_id"] for r in left) == list(range(0, n, 2))


def test_copies_of_two_sources_are_told_by_class(spark):
    """More holders of an n-gram than any cap would let through: 210 copies over two sources, and one near copy."""
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(words), f"s{i % 2}") for i in range(210)] + [(500, " ".join([*words[:39], "x"]), "s0"), (501, "too short", "s1"), (502, None, "s1")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    pairs, members = similarity.near_duplicate_pairs(df, id="doc_id", text="text", source="source")
    assert sorted((r["a"], r["b"], r["links"]) for r in pairs.collect()) == [(0, 0, 105 * 105), (0, 500, 105)]
    assert members.count() == 211
    kept = similarity.near_duplicate_survivors(df, id="doc_id", text="text", source="source", score=F.lit(1))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 210, 2), 500, 501, 502]


def _brute_survivors(data, n=3):
    grams = {}
    for i, text, *_ in data:
        w = text.split()
        grams[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    pairs = []
    for i, _, s, score, g in data:
        for j, _, t, other, h in data:
            if i < j and s != t and g != h and grams[i] & grams[j]:
                share = len(grams[i] & grams[j]) / min(len(grams[i]), len(grams[j]))
                if share > 0.5:
                    w, l = ((i, score), (j, other)) if score >= other else ((j, other), (i, score))
                    pairs.append((-share, -w[1], w[0], -l[1], l[0]))
    lost = set()
    for *_, w, _, l in sorted((p[0], p[1], p[2], p[3], p[4]) for p in pairs):
        if w not in lost and l not in lost:
            lost.add(l)
    return sorted(i for i, *_ in data if i not in lost)


@pytest.mark.parametrize("seed", range(3))
def test_survivors_of_classes_are_those_of_records(spark, seed):
    import random

    rng = random.Random(seed)
    bases = [[rng.choice("abcdefgh") for _ in range(9)] for _ in range(4)]
    data = []
    for i in range(40):
        w = list(rng.choice(bases))
        if rng.random() < 0.5:
            w[rng.randrange(9)] = rng.choice("abcdefgh")
        data.append((i, " ".join(w[: rng.choice((6, 9, 9))]), rng.choice("xyz"), rng.randrange(4), rng.choice("pqrst")))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, score int, grp string")
    kept = similarity.near_duplicate_survivors(df, 3, id="doc_id", text="text", source="source", score=F.col("score"), group="grp")
    assert sorted(r["doc_id"] for r in kept.collect()) == _brute_survivors(data)


def test_first_earlier_duplicate_of_a_hot_passage(spark):
    import random

    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(20))
    phrase = [" ".join(f"{c}{i}" for i in range(10)) for c in "qrst"]
    data = [(i, " ".join([rng.choice(phrase), f"a{i} b{i} c{i}", passage if i % 3 else rng.choice(phrase), f"d{i}"])) for i in range(60)]
    df = spark.createDataFrame([*data, (60, data[7][1]), (61, "")], "doc_id long, text string")
    texts = dict([*data, (60, data[7][1]), (61, "")])
    grams = {i: {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)} for i, t in texts.items()}
    want = {}
    for i in grams:
        for j in range(i):
            if len(grams[i] & grams[j]) >= 5:
                want[i] = (j, len(grams[i] & grams[j]))
                break
    got = {r["doc_id"]: (r["earlier"], r["shared"]) for r in similarity.earlier_duplicates(df, id="doc_id", text="text").collect()}
    assert got == want


def test_survivors_by_component_and_in_rounds(spark):
    import random

    rng = random.Random(12)
    score = {i: rng.randint(0, 5) for i in range(120)}
    pairs = {(a, b): rng.choice([0.5, 0.6, 0.9]) for a, b in (sorted(rng.sample(range(120), 2)) for _ in range(150))}
    order = []
    for (a, b), share in pairs.items():
        w, x = (a, b) if (score[a], -a) > (score[b], -b) else (b, a)
        order.append((-share, -score[w], w, -score[x], x))
    lost = set()
    for _, _, w, _, x in sorted(order):
        if w not in lost:
            lost.add(x)
    rec = spark.createDataFrame(list(score.items()), "doc_id long, score int")
    given = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a long, b long, share double").repartition(3)
    for bound in (similarity.COMPONENT_PAIRS, 3):  # whole components, and rounds for all but the smallest
        kept = similarity.survivors(rec, given, "doc_id", F.col("score"), bound)
        assert {r["doc_id"] for r in kept.collect()} == set(score) - lost


def test_a_long_chain_of_pairs_takes_no_rounds_of_its_own(spark):
    rec = spark.createDataFrame([(f"{i:04}", 2000 - i) for i in range(1000)], "doc_id string, score long")
    chain = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}", 1 - i / 2000) for i in range(999)], "a string, b string, share double")
    assert sorted(int(r["doc_id"]) for r in similarity.survivors(rec, chain, "doc_id", F.col("score")).collect()) == list(range(0, 1000, 2))


def test_keys_of_codes_are_not_broadcast(spark):
    """84 keys a code: what the optimiser takes for a small table would be gathered on the driver."""
    codes = spark.range(2_000).select("id", F.xxhash64("id").alias("c"))
    found = similarity.hamming_pairs(codes.unionAll(codes.where("id % 100 = 7").select(F.col("id") + 10_000, F.col("c").bitwiseXOR(F.lit(5)))), "id", "c", 6)
    assert found.where("b = a + 10000 and distance = 2").count() == 20
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_leakage_of_common_passages(spark):
    """Rows of both sides that share a passage in their lesser half, a template line of fewer words than an n-gram, copies, and an id on both sides."""
    own = lambda i, k: " ".join(f"{c}{i}" for c in "abcdefghijklmnopqrstuvwxyz"[:k])
    shared = " ".join(f"p{i}" for i in range(14))
    data = [(i, f"{own(i, 26)} {shared}\none two three four five six") for i in range(300)] + [(1000, own(5, 26) + " x"), (1001, own(7, 26)), (1002, own(7, 26))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("f", F.lit(None).cast("string"))
    held = df.where("doc_id % 2 = 0 and doc_id < 400").unionAll(df.where("doc_id in (1001, 1000)"))
    train = df.where("doc_id % 2 = 1 and doc_id < 400").unionAll(df.where("doc_id in (1002, 1000)"))
    found = similarity.leakage(train, held, "f", id="doc_id", text="text")
    want = [(5, 1000, "near_dup"), (7, 1001, "near_dup"), (1000, 1000, "field"), (1000, 1000, "near_dup"), (1000, 1000, "same_id"), (1000, 1000, "state"), (1002, 1001, "field"), (1002, 1001, "near_dup"), (1002, 1001, "state")]
    assert sorted(tuple(r) for r in found.collect()) == want
    # 150 x 150 pairs share the passage and the template; none is made
    links = similarity.benchmark_links(train, held.withColumnsRenamed({"doc_id": "i", "text": "t"}), id="doc_id", text="text", bench_id="i", bench_text="t", weak=False)
    assert links.count() == 4  # lines and whole texts of copies, and of the id on both sides


def test_earlier_duplicates_meet_the_first_holders_only(spark, monkeypatch):
    """Windows of one passage, so that its n-grams have all different holders: most pairs of records share some, few are looked at."""
    import random

    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    data = []
    for i in range(300):
        at, long = rng.randrange(100), rng.randrange(9, 40)
        data.append((i, " ".join([f"a{i}", *passage[at : at + long], f"b{i}"])))
    grams = {i: {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)} for i, t in data}
    want = {i: next(((j, n) for j in range(i) if (n := len(grams[i] & grams[j])) >= 5), None) for i in grams}
    met, common = [], similarity._common
    monkeypatch.setattr(similarity, "_common", lambda pairs, bundles: met.append(pairs.count()) or common(pairs, bundles))
    got = {r["doc_id"]: (r["earlier"], r["shared"]) for r in similarity.earlier_duplicates(spark.createDataFrame(data, "doc_id long, text string"), id="doc_id", text="text").collect()}
    assert got == {i: e for i, e in want.items() if e}
    assert sum(bool(grams[i] & grams[j]) for i in grams for j in range(i)) > 13_000 and sum(met) < 5_000


def test_hashed_ngrams_are_as_many_as_ngrams(spark):
    from verdigris.functions.text import hashed_ngrams, ngrams

    rows = spark.createDataFrame([("a b a b a b a c a b a b a b a b d a b c d e f g h i j k l m n",), ("a b c",), ("",)], "t string").select(F.filter(F.split("t", " "), lambda w: w != "").alias("w"))
    told = rows.select(*[F.struct(F.size(hashed_ngrams(F.col("w"), n)).alias("h"), F.size(ngrams(F.col("w"), n)).alias("g")) for n in (1, 2, 3, 5, 8, 13)]).collect()
    assert all(x["h"] == x["g"] for r in told for x in r)


@pytest.mark.parametrize("job", ["pairs", "survivors"])
def test_near_duplicates_write_what_is_shared_only(spark, monkeypatch, job):
    """Twenty texts of 300 words of their own, two of which share most: no table on the way holds a set of n-grams, or a row for each."""
    import re

    data = [(i, " ".join(f"w{i}x{k}" for k in range(300)), f"s{i % 2}", i) for i in range(20)]
    data.append((20, re.sub("w0x299", "other", data[0][1]), "s1", 20))
    df, written, write = spark.createDataFrame(data, "doc_id long, text string, source string, score int"), [], similarity.materialise

    def told(table, tag):
        out = write(table, tag)
        written.append((tag, out.count(), [c for c, kind in out.dtypes if kind.startswith("array")]))
        return out

    monkeypatch.setattr(similarity, "materialise", told)
    names = {"id": "doc_id", "text": "text", "source": "source"}
    if job == "pairs":
        found = [(r["a"], r["b"], r["shared"], r["links"]) for r in similarity.near_duplicate_pairs(df, **names)[0].collect()]
        assert found == [(0, 20, 287, 1)]
    else:
        kept = similarity.near_duplicate_survivors(df, **names, score=F.col("score"))
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 21))
    assert written and all(rows <= len(data) and not arrays for _, rows, arrays in written)


def test_contamination_cuts_records_once(spark):
    """Also where n-grams of both kinds have one length: they don't count double."""
    docs = spark.createDataFrame([(1, "x a b c d e f g h i y", "t"), (2, "a b c d e f g h", "t"), (3, "one two three\nother", "t"), (4, None, "t")], "doc_id long, text string, task string")
    items = spark.createDataFrame([(7, "a b c d e f g h i\none two three"), (8, "z a b c d e f g h")], "item_id long, text string")
    told = similarity.contamination(docs, items, ["task"], 8, 8, id="doc_id", text="text", bench_id="item_id", bench_text="text")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert told.first().asDict() == {"task": "t", "records": 4, "any_gram": 2, "near_dup": 1, "two_8grams": 1, "exact": 0, "short_line": 1}
