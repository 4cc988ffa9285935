"""Draws from a pool against the walk written out."""

import hashlib
import re

from pyspark.sql import functions as F

from verdigris.operators import distractors as D


def norm(x):
    return " ".join(re.findall("[a-z0-9]+", x.lower()))


def conflict(a, b):
    x, y = set(a.split()), set(b.split())
    return not a or not b or a in b or b in a or x <= y or y <= x


def number(seed, what, i, m):
    return int(hashlib.sha256(f"{seed}:{what}:{i}".encode()).hexdigest()[:12], 16) % m


def by_hand(rows, pool, k, seed="pool"):
    clean = {}
    for x in pool:
        x = (x or "").strip(" ")
        if x and len(x) <= 128 and x != "__unknown__" and norm(x):
            clean[norm(x)] = min(x, clean.get(norm(x), x))
    order = sorted(clean, key=lambda n: hashlib.sha256(n.encode()).hexdigest())
    p = D._prime(len(order))
    out = []
    for i, gold in rows:
        if i is None:
            continue
        place = 0
        for a in range(p):
            at = (number(seed, "start", i, p) + (number(seed, "step", i, p - 1) + 1) * a) % p
            if at < len(order) and (gold is None or not conflict(norm(gold), order[at])) and place < k:
                place += 1
                out.append((i, place, clean[order[at]]))
    return sorted(out)


def test_draws(spark):
    pool = [f"{a} {b}" for a in ("red", "Blue", "old", "new!") for b in ("Fox", "fox den", "cat", "42")] + ["red  fox", "RED FOX", "", None, "  ", "__unknown__", "x" * 129, "!!", "é", "zeta", "eta"]
    rows = [(i, ["red fox", "cat", None, "!!", "eta", "nothing of it"][i % 6]) for i in range(90)] + [(None, "cat")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, gold string, distractor string").repartition(3)
    source = spark.createDataFrame([(x,) for x in pool], "t string").repartition(2)
    for k in (1, 4, 30):
        got = D.draw(df, "id", "gold", source, "t", k)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, pool, k)
    everything = D.draw(df, "id", None, source, "t", 100).groupBy("id").agg(F.count_distinct("distractor").alias("n")).collect()
    assert len(everything) == 90 and {r["n"] for r in everything} == {18}
    assert D.draw(df, "id", "gold", source.limit(0), "t", 2).collect() == [] and D.draw(df.limit(0), "id", "gold", source, "t", 2).collect() == []


def test_primes():
    assert [D._prime(n) for n in (0, 1, 2, 3, 4, 14, 97, 90)] == [2, 2, 2, 3, 5, 17, 97, 97]
