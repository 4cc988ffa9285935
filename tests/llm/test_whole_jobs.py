"""Operators against the whole of their job, where a shorter way once lost rows."""

import random

import numpy as np

from verdigris.llm import edit_fingerprint, shingle_sets


def test_near_duplicate_stage_finds_all_copies_of_similarity_0_8(spark):
    """Planted copies with more and more words replaced, against all pairs of five-word shingle sets."""
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(30):
        words = [word() for _ in range(rng.choice([40, 150, 600]))]
        rows.append(" ".join(words))
        for share in (0.004, 0.01, 0.02, 0.03, 0.06):
            rows.append(" ".join(word() if rng.random() < share else w for w in words))
    rows += ["", "one two", "One  two", None, "one two three"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (x or "").lower().split()) else set() for x in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not (a or b) or (a | b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.shingle_components(docs).collect()}
    assert got == dict(enumerate(root))
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(r[0] for r in left) == sorted(set(root))
    assert shingle_sets.shingle_components(docs.limit(0)).count() == 0


def test_one_bucket_of_many_texts_that_are_not_all_alike(spark, monkeypatch):
    """Copies of one text of which only some pairs reach 0.8: leaders alone don't join them, blocks of several chunks must."""
    monkeypatch.setattr(shingle_sets, "CHUNK_ROWS", 16)
    monkeypatch.setattr(shingle_sets, "FOLLOWERS", 10)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [base]
    for _ in range(90):
        k = rng.randrange(len(rows))
        copy = list(rows[k])
        for _ in range(rng.choice([1, 3, 5, 8])):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append(copy)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert 10 < len(set(root)) < 80
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.shingle_components(docs).collect()}
    assert got == dict(enumerate(root))


def test_intersections_of_common_and_rare_elements(monkeypatch):
    monkeypatch.setattr(shingle_sets, "COLUMNS", 7)
    monkeypatch.setattr(shingle_sets, "MEETINGS", 50)
    draw = np.random.default_rng(5)
    for _ in range(40):
        # a few elements that nearly all sets hold, many that few do, and empty sets
        sides = [[np.unique(np.r_[draw.integers(0, 20, draw.integers(0, 30)), draw.integers(100, 2000, draw.integers(0, 60))]).astype(np.int64) for _ in range(draw.integers(1, 40))] for _ in range(2)]
        want = [[len(set(a) & set(b)) for b in sides[1]] for a in sides[0]]
        assert (shingle_sets.intersections(*sides) == want).all()


def test_edit_duplicates_join_texts_of_other_lengths(spark):
    """Copies with text appended, inserted or deleted: walks of other lengths, up to either side of a power of two."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        x = letters(rng.choice([400, 680, 1360, 3000]))
        n = len(x)
        y = [x + letters(n // 100), x + letters(n // 20), x + letters(n // 10), x[: n // 2] + "q" + x[n // 2 :], x[: n // 2] + x[n // 2 + 2 :]][i % 5]
        a, b = edit_fingerprint.walker().fingerprints([x, y])
        rows += [(i, x), (100 + i, y)]
        if edit_fingerprint.likeness(a, b, edit_fingerprint.walker().steps) >= 0.8:
            want[100 + i] = i
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.edit_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[k] == v for k, v in want.items())
    print("alike", len(want), "found", found)
    assert len(want) >= 40 and found == len(want)
    assert all(c in (d, d - 100) for d, c in got.items())


def test_toxicity_of_held_out_rows_of_the_table(spark):
    """sf0.1: of the held-out toxic texts with a word that only toxic learning texts have, several times, nine tenths are caught."""
    from verdigris.llm import queries, toxicity

    sf = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    seen: dict = {}
    for i, y in labels.items():
        if not out[i]["held_out"]:
            for w in set(toxicity.words_of(texts[i])):
                n = seen.setdefault(w, [0, 0])
                n[y] += 1
    marks = {w for w, (clean, toxic) in seen.items() if toxic >= 20 and not clean}
    held = [i for i in labels if out[i]["held_out"]]
    told = [out[i]["predicted"] for i in held if labels[i] == 1 and marks & set(toxicity.words_of(texts[i]))]
    accused = [out[i]["predicted"] for i in held if labels[i] == 0]
    assert len(told) > 40 and sum(told) >= 0.9 * len(told)
    assert sum(accused) <= 0.04 * len(accused)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in out.values())


def test_toxicity_of_odd_rows(spark):
    from verdigris.llm import toxicity

    model = toxicity.train([f"good words {i}" for i in range(40)] + [f"grobnik words {i}" for i in range(40)], [0] * 40 + [1] * 40, toxicity.Settings(steps=200, buckets=1 << 12))
    rows = [(None, "grobnik"), (1, None), (1, None), (2, ""), (3, "123 ..."), (4, "word " * 200_000), (5, "grobnik words"), (5, "grobnik words")]
    out = toxicity.with_score(spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, score string"), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {(r["doc_id"], (r["text"] or "")[:9]): r["score"] for r in out}
    assert by[1, ""] == by[2, ""] == by[3, "123 ..."] and by[5, "grobnik w"] > 0.5


def _odd_documents(spark):
    """Null and empty texts, a null id, a repeated row, a repeated id, a very long text, and columns with names that stages use inside."""
    rows = [(1, "one plain text of a few words that goes on", "en", "a"), (1, "one plain text of a few words that goes on", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "a text without an id of its own at all", "en", "a"), (4, "word " * 60_000, "en", "a"), (4, "another text under the id of four, not alike", "en", "a"), (5, 'and the token = "' + "0a1b2c3d4e" * 4 + '" is here', "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "mine", "mine") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __toxicity string, __scan string")


def test_each_stage_on_odd_rows_and_no_rows(spark, monkeypatch):
    import corpus_pipeline
    from tests.conftest import SF
    from verdigris.llm import toxicity

    small = toxicity.train(["good words"] * 20 + ["grobnik words"] * 20, [0] * 20 + [1] * 20, toxicity.Settings(steps=100, buckets=1 << 12))
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: small)  # fits are tested by themselves
    docs = _odd_documents(spark)
    size = {"toxicity": None, "near_duplicates": 7, "secrets": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, None}
        else:
            assert out.columns == docs.columns and all(r["__toxicity"] == r["__scan"] == "mine" for r in rows), name
            assert size[name] is None or len(rows) == size[name], name
        if name == "near_duplicates":
            # empty and null texts are copies of each other; a repeated row stays as often as it occurs
            assert sorted((r["doc_id"] for r in rows if r["doc_id"]), key=int) == [1, 1, 2, 4, 4, 5]
        if name == "secrets":
            told = next(r for r in rows if r["doc_id"] == 5)
            assert told["text"] == 'and the token = "[SECRET]" is here' and told["n_chars"] == len(told["text"])
            assert next(r for r in rows if r["doc_id"] == 2)["text"] is None
        assert stage(spark, docs.limit(0), SF).count() == 0, name
