"""Names, numbers and clauses of passages against regular expressions one text at a time."""

import random
import re

from pyspark.sql import functions as F

from tests.conftest import SF
from verdigris.functions import passages as P

WORDS = ["The", "Ada Lovelace", "Bank of England", "NASA", "USA", "However", "paris", "Émile", "Zürich", "Then", "O’Brien", "King  and\nQueen", "cost", "$5", "£ 1,200.50", "€0", "12 kg", "3.5 Hours", "7 lbs", "40%", "40 per cent", "1,000,001 km", "9 glass", "ran.", "Why?", "stop!", "User:", "an ordinary run of words that goes on for a while", "日本 10 days", "$3 kg", "2 percent"]


def python(pattern):
    return re.compile(pattern.replace("(?U)", "").replace("(?Ui)", "(?i)"))


def test_spans_and_names_and_numbers(spark):
    rng = random.Random(9)
    texts = ["", None, "x"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    titles = [rng.choice([None, "A Tale", "word", "lower case", "É A", "T" * 61 + " x"]) for _ in texts]
    rows = [(i, x, t) for i, (x, t) in enumerate(zip(texts, titles))]
    t = F.col("t")
    df = spark.createDataFrame(rows, "i int, t string, title string").select("i", "t", "title", P.spans(t, P.NAME).alias("found"), P.names(t, F.col("title")).alias("names"), P.quantities(t).alias("q"), P.number_spans(t).alias("s"), P.clauses(t).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    quantity = {u: q for q, units in P.QUANTITIES.items() for u in units}
    for r in df.collect():
        x, title = r["t"] or "", r["title"]
        if r["t"] is not None:
            assert [tuple(f) for f in r["found"]] == [(m.start(), len(m[0]), m[0]) for m in python(P.NAME).finditer(x)]
        names = [(None, title)] if title and "A" <= title[0] <= "Z" and len(title) <= 60 and " " in title else []
        for m in python(P.NAME).finditer(x):
            v = re.sub(r"\s+", " ", m[1]).strip()
            first = m.start() == 0 or x[max(0, m.start() - 2) : m.start()].strip().endswith((".", "!", "?"))
            if v.split()[0] in P.NO_NAME or (v.isupper() and len(v) <= 3) or (" " not in v and first) or v in [n for _, n in names]:
                continue
            names.append((m.start(), v))
        assert [tuple(n) for n in r["names"]] == names[:12]
        rows = [(m[1] + m[2], float(m[2].replace(",", "")), P.CURRENCIES[m[1]], "price", m.start()) for m in python(P.MONEY).finditer(x)]
        rows += [(m[1] + "%", float(m[1].replace(",", "")), "per cent", "percentage", m.start()) for m in python(P.PERCENT).finditer(x)]
        rows += [(f"{m[1]} {m[2]}", float(m[1].replace(",", "")), m[2].lower(), quantity[m[2].lower().rstrip("s")], m.start()) for m in re.compile(P.MEASURE.replace("(?Ui)", ""), re.I).finditer(x) if m[2].lower().rstrip("s") in quantity]
        unique = []
        for n in rows:
            if 0 < n[1] < 1_000_000 and n[0] not in [u[0] for u in unique]:
                unique.append(n)
        assert [tuple(n) for n in r["q"]] == unique[:8]
        ends = [0, *(s["start"] + s["length"] for s in r["s"])]
        assert all(s["start"] >= e and x[s["start"] : s["start"] + s["length"]] == s["text"] for s, e in zip(r["s"], ends))
        at = sorted({(m.start(), -len(m[0])) for p in (P.MONEY, P.PERCENT) for m in python(p).finditer(x)} | {(m.start(), -len(m[0])) for m in re.compile(P.MEASURE.replace("(?Ui)", ""), re.I).finditer(x)})
        want, end = [], 0
        for a, n in at:
            if a >= end:
                want.append((a, -n))
                end = a - n
        assert [(s["start"], s["length"]) for s in r["s"]] == want


def test_clauses_of_whole_documents(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", P.clauses(F.col("text")).alias("c")).collect():
        want = []
        for s in re.split(r"(?<=[.!?])\s+", r["text"].replace("\n", " ")):
            s = re.sub(r"\s+", " ", s).strip()
            if 40 <= len(s) <= 180 and not s.endswith("?") and not s.startswith(("User:", "System:", "Assistant:")) and s[:1].isalpha():
                want.append(s.rstrip("."))
        assert r["c"] == want[:8]


def test_quantities_of_a_long_text_are_found_in_one_pass(spark):
    """20,000 amounts, of which seven differ, and an eighth at the end: each is compared with what is found, not with all before it."""
    import time

    text = " ".join(f"$ {1 + i % 7} lie." for i in range(20_000)) + " $ 99 lie."
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    found = df.select(P.quantities(F.col("t")).alias("q")).first()["q"]
    assert [x["raw"] for x in found] == [*(f"${i}" for i in range(1, 8)), "$99"] and found[7]["start"] == text.index("$ 99")
    assert time.time() - began < 60
