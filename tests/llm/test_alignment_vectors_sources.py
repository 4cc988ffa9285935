"""Token alignment, near-duplicate vectors and source divergence against brute force and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle import compare, connection, rows_of
from verdigris.llm import embedding_dedup, queries, source_divergence, token_alignment
from verdigris.session import ship_package

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["foo", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", "日本", "\r\n", "{", "};", ".", "<|endoftext|>", "<s>", "<0x0A>", "\xa0", "▁", "​", "\x1c", "　", "\u0085", "ﬁ", "🙂", "ing", "\x00"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned_by_hand(text, a, b, coder):
    """(n_a, n_b, n_groups, digest, links) from whole texts, byte ranges compared one by one."""
    if not text:
        return 0, 0, 0, "", []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b = [coder.bytes_a[i] for i in ids_a], [coder.bytes_b[i] for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return 0, 0, 0, "", []

    def ranges(parts):
        ends = np.cumsum([len(x) for x in parts]).tolist()
        return list(zip([0, *ends], ends))

    over_a, over_b = ranges(bytes_a), ranges(bytes_b)
    cuts = sorted({e for _, e in over_a} & {e for _, e in over_b})
    groups = []
    for p, c in zip([0, *cuts], cuts):
        inside = [",".join(str(i) for i, (s, e) in zip(ids, over) if p <= s and e <= c) for ids, over in ((ids_a, over_a), (ids_b, over_b))]
        groups.append("|".join(inside))
    links = [(x, y) for x, (s, e) in zip(ids_a, over_a) for y, (u, v) in zip(ids_b, over_b) if s < v and u < e]
    return len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_letters_of_bytes_are_a_byte_level_vocabularys():
    from tokenizers.pre_tokenizers import ByteLevel

    letters = token_alignment._unicode_of_bytes()
    assert set(letters) == set(ByteLevel.alphabet()) and sorted(letters.values()) == list(range(256))


def test_alignment_equals_the_libraries_on_whole_texts(spark, libraries):
    ship_package(spark)
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += [x.replace("▁", "") for x in texts] + [None, "", "word " * 3000, "x" * 5000, "one two", "one two"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [(i if i % 50 else None, x, "other") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(5)
    coder = token_alignment.Aligner(A, B)
    by_hand = [aligned_by_hand(x, *libraries, coder) for x in texts]
    held = Counter(p for *_, links in by_hand for p in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = [(i, na, nb, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), d) for (i, _, _), (na, nb, g, d, links) in zip(rows, by_hand)]
    for limit in (token_alignment.STAT_ROWS, 10):  # counts broadcast, and joined
        got = token_alignment.align_corpus(docs, A, B, stat_rows=limit).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_of_an_empty_table(spark):
    ship_package(spark)
    assert token_alignment.align_corpus(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def linked_by_hand(rows, threshold):
    """(n_links, component) of each (id, vector) row."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    near = {i: {j for j in good if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in good}
    out = []
    for i, (own, _) in enumerate(rows):
        if i not in near:
            out.append((own, 0, own))
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((own, len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted((a, n, c, a is not None and a == c) for a, n, c in out if a is not None), sorted((n, -1 if c is None else c) for a, n, c in out if a is None)


@pytest.mark.parametrize("tile", [16, 4096])
def test_vectors_equal_brute_force(spark, tile):
    ship_package(spark)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    vectors = [(centres[i % 12] + rng.normal(scale=0.05 + 0.03 * (i % 9), size=24)).tolist() for i in range(300)]
    vectors += [rng.normal(size=24).tolist() for _ in range(100)] + [vectors[0]] * 5 + [[3 * x for x in vectors[1]]] + [rng.normal(size=3).tolist() for _ in range(20)]
    vectors += [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf"), 1.0], [1e200] * 24, [1e-200] * 24, [-1.0] * 24]
    chain = [[float(np.cos(x)), float(np.sin(x))] for x in np.arange(40) * 0.15]
    rows = [(i, v) for i, v in enumerate(vectors + chain)] + [(None, vectors[0]), (None, [7.0, 1.0, 2.0, 9.0]), (3, vectors[3])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, vector int").repartition(3)
    got = embedding_dedup.near_duplicate_vectors(df, tile=tile).collect()
    known, nameless = linked_by_hand(rows, 0.95)
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None) == known
    assert sorted((r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got if r["vec_id"] is None) == nameless
    assert not any(r["kept"] for r in got if r["vec_id"] is None)


def test_vectors_of_an_empty_table(spark):
    ship_package(spark)
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_far_tiles_never_meet(spark):
    boxes = [(2, i, [float(np.cos(x)), float(np.sin(x)), 0.0], [float(np.cos(x)), float(np.sin(x)), 0.0]) for i, x in enumerate(np.linspace(0, 3, 60))]
    pairs = {tuple(r) for r in embedding_dedup.tile_pairs(spark.createDataFrame(boxes, "d int, tile long, low array<double>, high array<double>"), 0.95).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i, 60) if np.cos(3 / 59 * (j - i)) >= 0.95}


def test_the_query_on_vectors_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_embedding_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == linked_by_hand(rows, 0.95)[0]


def test_divergence_equals_its_sql(spark):
    assert compare(queries.op13_source_divergence(spark, SF), queries.DIVERGENCE_SQL, connection(SF)) == ""


def test_divergence_of_odd_rows(spark):
    import duckdb

    ship_package(spark)
    texts = ["The the THE cat", "cät É é É", None, "", "a\x00b_c d'e", "12 345 !!", "zz " * 40, "the cat"]
    rows = [(None if i % 7 == 0 else i, texts[i % 8], [None, "", "en", "de", "fr"][i % 5], [None, "a", "b", "", "ä", "z"][(i // 5) % 6], i) for i in range(700)]
    rows += [(1, None, "xx", "only", 0), (2, "12", "yy", "p", 0), (3, "", "yy", "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").repartition(3)
    db = duckdb.connect()
    db.register("documents", docs.select("text", "lang", "source").toArrow())
    got = source_divergence.divergence(docs)
    found = db.execute(queries.DIVERGENCE_SQL)
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in found.description], found.fetchall())
    assert got.where("lang = 'yy' and part = 'pair' and value = 0").count() == 2 and got.where("lang = 'xx'").count() == 0
    assert source_divergence.divergence(docs.limit(0)).collect() == []


def test_shares_are_exact_beyond_what_a_long_holds(spark):
    rows = [(c, d) for c, d in ((0, 5), (12_345_678_901_234, 98_765_432_109_876), (9_999_999_999_995, 10**13), (7, 10**14))]
    got = spark.createDataFrame(rows, "c long, d long").select("c", "d", source_divergence.share(F.col("c"), F.col("d")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 5) // d for c, d in rows]
