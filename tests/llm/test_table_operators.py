"""URL rules, archives, neighbours and the ledger."""

import base64
import hashlib
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle import compare, connection
from verdigris.llm import ann, queries, url_filter, warc
from verdigris.llm.token_ledger import TokenLedger


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.SQL[name], connection(SF)) == ""


def test_url_rules_on_odd_addresses(spark):
    rows = [
        (1, "https://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://a.net/de", "a.net", "/de", "net/", "block"),
        (3, "http://a.net", "a.net", "", None, "allow"),
        (4, "http://myexample.com/de/x", "myexample.com", "/de/x", None, "allow"),
        (5, "http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
        (6, "http://example.com/DE/x", "example.com", "/DE/x", None, "allow"),
        (7, "no scheme.net/", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "x://spam.org/fr/?q", "spam.org", "/fr/", "org/fr/", "allow"),
        (10, "x://free.spam-bets.io/a", "free.spam-bets.io", "/a", None, "block"),
        (11, "://net/", "net", "/", "net/", "block"),
        (12, "a://b://c.net/", "b:", "//c.net/", None, "allow"),
        (13, "https://ÀÉ.net?x=/", "ÀÉ.net", "", None, "allow"),
        (13, "https://ÀÉ.net?x=/", "ÀÉ.net", "", None, "allow"),
        (None, "http://a.net/", "a.net", "/", "net/", "block"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "old", "mine") for r in rows], "page_id long, url string, rule string, tokens string")
    out = url_filter.judge_urls(df, queries.URL_RULES())
    got = sorted((tuple(r) for r in out.select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(rows, key=repr) and "tokens" in out.columns
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES()).count() == 0


def test_url_rules_are_filed_under_their_rarest_literal(spark):
    from verdigris.llm.url_filter import UrlRule, rule_index

    rule = UrlRule("r", "block", "x", ("common", "rare"))
    index, buckets = rule_index([rule], {"common": 100, "rare": 2})
    filed = spark.range(1).select(index.alias("i")).first()["i"]
    assert [e["token"] for b in filed for e in b] == ["rare"] and len(filed) == buckets


def test_thousands_of_rules_equal_running_them_all(spark):
    """Wildcards with several literals over hosts and paths, against every rule on every address."""
    import random
    import re

    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta ads7 click track banner login wp admin php img v2".split())
    rules = [url_filter.host_rule(f"{word()}.{word()}/{word()}/", rng.choice(["block", "allow"])) for _ in range(40)]
    for i in range(3_000):
        text = rng.choice([f"*.{word()}-{word()}.*/{word()}/*", f"*/{word()}/*.{word()}", f"{word()}{i}.*/*{word()}*/{word()}/*", f"*/{word()}-{word()}{i % 50}/*"])
        rules.append(url_filter.wildcard_rule(text, rng.choice(["block", "allow"])))
    urls = [f"http://{word()}.{word()}-{word()}.{word()}/{word()}/{word()}-{word()}{rng.randrange(60)}/{word()}.{word()}?q" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    for i, u in enumerate(urls):
        text = u.partition("://")[2].partition("?")[0]
        fit = sorted((not r.listed, -len(r.name), r.name, r.verdict) for r in rules if re.search(r.pattern, text))
        assert got[i] == ((fit[0][2] if not fit[0][0] else None, fit[0][3]) if fit else (None, "allow")), u


def test_url_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "http://a.net/x" + "y" * 100_000, "h", "u", "r")], "page_id long, url string, Host string, __url string, Rule string")
    out = url_filter.judge_urls(df, queries.URL_RULES())
    assert out.columns == ["page_id", "url", "__url", "host", "path", "rule", "verdict"]
    r = out.first()
    assert (r["__url"], r["host"], r["rule"], len(r["path"])) == ("u", "a.net", "net/", 100_002)


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(
        [(5, "same"), (3, "same"), (9, "same"), (4, None), (6, ""), (1, "Ünï <p>\r\n\r\n</p>"), (3, "same"), (None, "same"), (None, "alone"), (8, "x" * 300_000)], "page_id long, html string"
    ).withColumn("payload", F.lit(1))
    out = warc.archive_and_read(pages).collect()
    text = {5: "same", 3: "same", 9: "same", 4: "", 6: "", 1: "Ünï <p>\r\n\r\n</p>", 8: "x" * 300_000}
    assert len(out) == 10
    for r in out:
        if r["page_id"] is not None:
            raw = text[r["page_id"]].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in out)
    assert ("5", "revisit", 3) in kinds and ("9", "revisit", 3) in kinds and ("6", "revisit", 4) in kinds and ("4", "response", None) in kinds
    assert [k for k in kinds if k[0] == "3"] == [("3", "response", None)] * 2
    assert [k for k in kinds if k[0] == "None"] == sorted([("None", "response", None), ("None", "revisit", 3)])
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archive_has_a_dictionary_frame_first_and_a_frame_a_record():
    out = io.BytesIO()
    rows = [("response", i, None, f"<html><body>page {i} {'lorem ipsum dolor ' * 30}{i * i}</body></html>".encode()) for i in range(200)]
    assert warc.write_archive(out, iter(rows)) == 200
    raw = out.getvalue()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size > 256 and raw[8 + size : 12 + size] == warc.FRAME
    got = list(warc.read_archive(io.BytesIO(raw)))
    assert [int(h["x-page-id"]) for h, _ in got] == list(range(200)) and [b for _, b in got] == [r[3] for r in rows]


def test_broken_archives_are_refused():
    import zstandard

    out = io.BytesIO()
    warc.write_archive(out, iter([("response", 1, None, b"abc"), ("response", 2, None, b"def")]))
    raw = out.getvalue()
    pack = lambda record: raw[:8] + zstandard.ZstdCompressor().compress(record)
    good = warc.render("response", 1, None, b"abc")
    for broken in (b"", raw[:-3], b"XXXX" + raw[4:], raw[:20] + b"\x00" * 8 + raw[28:], pack(good[:-1]), pack(good.replace(b"Content-Length: 3", b"Content-Length: 4")), pack(good.replace(b"WARC/1.1", b"WARC/9")), pack(good.replace(b"abc", b"abd")), pack(good.replace(b"WARC-Date", b"No-Date")), pack(b"no end")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(broken)))


def test_archives_of_others_are_read(spark, tmp_path):
    """No dictionary frame, header names in other cases, a warcinfo record, digests of another kind, no page ids."""
    import zstandard

    record = lambda lines, block: ("\r\n".join(["WARC/1.0", *lines, f"content-length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    head = ["WARC-RECORD-ID: <urn:uuid:1>", "warc-date: 2024-01-01T00:00:00Z"]
    records = [record(["warc-type: warcinfo", *head], b"software: x"), record(["Warc-Type: response", *head, "WARC-Block-Digest: md5:00"], b"abc"), record(["WARC-Type: revisit", *head, "WARC-Refers-To: <urn:uuid:1>"], b"")]
    raw = b"".join(zstandard.ZstdCompressor().compress(r) for r in records)
    assert [h["warc-type"] for h, _ in warc.read_archive(io.BytesIO(raw))] == ["warcinfo", "response", "revisit"]
    (tmp_path / "other.warc.zst").write_bytes(raw)
    listed = spark.createDataFrame([(f"file://{tmp_path}/other.warc.zst",)], "path string")
    got = sorted((r["record_type"], r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(listed).collect())
    assert got == [("response", None, 3, None), ("revisit", None, None, None)]
    with pytest.raises(warc.WarcError):
        warc.parse(record(["warc-type: x", *head], b"").replace(b"content-length: 0", "content-length: ٣".encode()))


def brute(vectors, queries_, k):
    out = []
    for q in queries_:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d)]
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rng = np.random.default_rng(4)
    good = {i: rng.normal(size=6).tolist() for i in range(40)} | {i: [1.0] * 6 for i in range(100, 130)}
    bad = [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [1.0, 2.0]), (204, [None] + [1.0] * 5), (None, [1.0] * 6), (3, good[3])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("score", F.lit(0))
    got = [tuple(r) for r in ann.search(df, df.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect()]
    want = brute(good, [i for i in sorted(good) if i % 10 == 0], 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    few = [tuple(r) for r in ann.search(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()]
    assert [r[:2] for r in sorted(few, key=lambda r: r[1])] == [(0, 1), (0, 2)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall(spark):
    out = queries.op5_prefix_forest(spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    got: dict = {}
    for r in out:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits.append(len(got[q] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_queries_take_the_dimension_of_the_table(spark):
    """Most queries have another dimension than most rows of the table."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)] + [(i, [1.0, 2.0, float(i)]) for i in range(20, 24)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id in (3, 20, 21, 22)"), k=2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(3, 2, 1.0), (3, 4, 1.0)]


def test_recall_over_several_full_shards_and_blocks(spark):
    """Random directions, the hardest case: four shards, three blocks, a vector that many rows hold, data off the origin."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4_000, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + 5.0
    x[2_000:2_400] = x[2_000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # the fixed number of strings in the proportion of full shards
    out = ann.search(df, df.where("vec_id % 20 = 0"), shard=1_000, block=80, wanted=ann.WANTED * 1_000 // ann.SHARD).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 4_000, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(got[q]) == 10 and all(s == d[v] for v, s in got[q])
        hits.append(len({v for v, _ in got[q]} & set(np.lexsort((np.arange(4_000), d))[:10].tolist())) / 10)
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.9
    assert [v for v, _ in got[2_000]] == list(range(2_001, 2_011))


def test_ledger(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    first = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, "b", None, "v1", 7), (3, "b", None, "v1", 7), (None, "b", "x", "v1", 7), (4, "b", "x", "v1", None)], "doc_id long, source string, lang string, version string, tokens long")
    assert ledger.apply("1", inserts=first) and not ledger.apply("1", inserts=first)
    total = lambda: sorted(tuple(r) for r in ledger.totals().select("source", F.coalesce("lang", F.lit("")), "version", "documents", "tokens").collect())
    assert total() == [("a", "en", "v1", 2, 15), ("b", "", "v1", 1, 7)]
    assert ledger.refused("1") == 2 and ledger.refused("2") is None
    revised = spark.createDataFrame([(2, "v1", 6), (1, "v1", 10), (77, "v1", 9)], "doc_id long, version string, tokens long")
    assert ledger.apply("2", revised=revised)
    assert total() == [("a", "en", "v1", 2, 16), ("b", "", "v1", 1, 7)]
    assert ledger.apply("3", deletes=spark.createDataFrame([(3, "v1"), (1, "v1"), (55, "v1")], "doc_id long, version string"), inserts=spark.createDataFrame([(9, "a", "en", "v2", 1)], first.schema))
    assert total() == [("a", "en", "v1", 1, 6), ("a", "en", "v2", 1, 1)]
    assert ledger.refused("2") == ledger.refused("3") == 0
    (tmp_path / "ledger/heads/000000000004-4").mkdir(parents=True)  # a batch that broke off before its commit
    ledger.vacuum()
    assert ledger.apply("4", deletes=spark.createDataFrame([(9, "v2")], "doc_id long, version string"))
    assert total() == [("a", "en", "v1", 1, 6)]


def test_ledger_in_any_order_with_repeats_equals_a_dictionary(spark, tmp_path):
    """Random batches of inserts, deletes and revisions, some sent again, against a dictionary of what is held."""
    import random

    rng = random.Random(5)
    ledger, held, sent = TokenLedger(spark, f"file://{tmp_path}/random", buckets=4), {}, []
    for n in range(7):
        if sent and rng.random() < 0.3:
            name, parts = rng.choice(sent)
            assert not ledger.apply(name, **{k: spark.createDataFrame(v, s) for k, (v, s) in parts.items()})
            continue
        version = lambda: rng.choice(["v1", "v2", None])
        key = lambda: (rng.randrange(12), version())
        new = [(k[0], rng.choice(["a", None]), rng.choice(["en", "de"]), k[1], rng.randrange(50)) for k in (key() for _ in range(10))]
        gone, counts = [key() for _ in range(4)], [(*key(), rng.randrange(50)) for _ in range(5)]
        parts = {"inserts": (new, "doc_id long, source string, lang string, version string, tokens long"), "deletes": (gone, "doc_id long, version string"), "revised": (counts, "doc_id long, version string, tokens long")}
        parts = {k: parts[k] for k in rng.sample(sorted(parts), rng.choice((1, 2, 3)))}
        assert ledger.apply(f"b-{n}", **{k: spark.createDataFrame(v, s) for k, (v, s) in parts.items()})
        sent.append((f"b-{n}", parts))
        for k in gone if "deletes" in parts else ():
            held.pop(k, None)
        best: dict = {}
        for d, s, lang, v, t in new if "inserts" in parts else ():
            best[d, v] = max(best.get((d, v), (-1, "", "")), (t, s or "", lang))
        held.update({k: (s or None, lang, t) for k, (t, s, lang) in best.items()})
        most: dict = {}
        for d, v, t in counts if "revised" in parts else ():
            most[d, v] = max(most.get((d, v), -1), t)
        held.update({k: (*held[k][:2], t) for k, t in most.items() if k in held})
        want: dict = {}
        for (_, v), (s, lang, t) in held.items():
            m, x = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (m + 1, x + t)
        assert {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect()} == want
        assert ledger.rows().count() == len(held)


def test_ledger_query_equals_direct_counts(spark):
    import tiktoken

    from tests.llm.test_text_operators import P, RANKS

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    seen, want = set(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if r["text"] not in seen:
            seen.add(r["text"])
            n, t = want.get((r["source"], r["lang"]), (0, 0))
            want[r["source"], r["lang"]] = (n + 1, t + len(encoding.encode_ordinary(r["text"] or "")))
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == want


def test_pipeline(spark, monkeypatch):
    import corpus_pipeline
    from verdigris.llm import toxicity

    fitted, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: fitted[0] if fitted else fitted.append(fit(*a, **k)) or fitted[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(ids & {i for i, t in labels.items() if t == 0}) > 0.8 * sum(t == 0 for t in labels.values())
