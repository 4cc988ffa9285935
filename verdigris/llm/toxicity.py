"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, with marks at its ends, so that a short word is
one of them; a document's vector is the mean over its words. So a misspelling that was never seen shares most of its vector with
the word that was. Training reads a bounded sample of labelled rows; once trained, the softmax folds into one number
per subword, and scoring runs over every whole text.

Null and empty texts have no words and get the score of the bias alone; texts of any length are scored whole, repeated rows
each by themselves, and a column of the result's name is replaced. Labels of one kind only, or none, give every text
the same score, below one half unless they are all 1. A word's marks and n-grams are over
lower-cased letters; anything that is no letter separates words.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdigris.llm.workers import claim
from verdigris.storage import materialise

LOWEST, HIGHEST = 3, 5  # lengths of character n-grams


@dataclass(frozen=True)
class Settings:
    #: Bound of the sample that is fitted, in rows; picked by a hash of their text, so the same on every run.
    sample_rows: int = 16_000
    buckets: int = 1 << 18
    dimensions: int = 4
    #: Steps of ``batch`` rows, the same for any sample: small ones are gone through more often.
    steps: int = 2_000
    batch: int = 32
    #: A subword in fewer (document, word) places of the sample has no vector, and vectors shrink by ``decay``: what one document alone
    #: says is not learned by heart.
    least_seen: int = 5
    decay: float = 1e-3
    #: Power of the weights that would make both labels equally heavy.
    balance: float = 0.5
    rate: float = 0.05
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    import regex

    global _LETTERS
    if _LETTERS is None:
        _LETTERS = regex.compile(r"\p{L}+")
    return _LETTERS.findall((text or "").lower())


_LETTERS = None


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, end of each word's share): every word's n-grams, end marks included, hashed together in numpy."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    room = ends[owner] - np.arange(len(letters))
    hashed, owners = [], []
    rolling = np.zeros(len(letters), np.uint64)
    for n in range(1, HIGHEST + 1):
        ahead = np.r_[letters[n - 1 :], np.zeros(min(n - 1, len(letters)), np.uint64)]
        rolling = rolling * _MULTIPLIER + ahead + np.uint64(1)
        if n >= LOWEST:
            some = room >= n
            hashed.append(rolling[some] ^ np.uint64(n))
            owners.append(owner[some])
    codes, of = np.concatenate(hashed), np.concatenate(owners)
    codes = (codes ^ (codes >> np.uint64(31))) * _MIXER
    order = np.argsort(of, kind="stable")
    return ((codes ^ (codes >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)[order], np.cumsum(np.bincount(of, minlength=len(words)))


def grams_in(letters: int) -> int:
    """How many n-grams a word of so many letters has."""
    return sum(max(0, letters + 3 - n) for n in range(LOWEST, HIGHEST + 1))


_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Bags:
    """Documents as bags of words, and words as bags of subwords, in flat arrays."""

    BLOCK = 20_000  # words hashed at once

    def __init__(self, texts: Iterable[str], buckets: int):
        number: dict[str, int] = {}
        words, counts, sizes = array("i"), array("i"), array("i")
        for x in texts:
            found = Counter(words_of(x))
            words.extend(number.setdefault(w, len(number)) for w in found)
            counts.extend(found.values())
            sizes.append(len(found))
        self.word, self.count = np.frombuffer(words, np.int32), np.frombuffer(counts, np.int32)
        self.doc_at = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)]
        distinct = list(number)
        del number
        distinct.reverse()
        shares = np.fromiter((grams_in(len(w)) for w in reversed(distinct)), np.int64, len(distinct))
        self.gram_at = np.r_[0, np.cumsum(shares)]
        self.gram = np.empty(self.gram_at[-1], np.int32)
        at = 0
        while distinct:  # words are let go as they are hashed
            gram, _ = subwords([distinct.pop() for _ in range(min(self.BLOCK, len(distinct)))], buckets)
            self.gram[at : at + len(gram)] = gram
            at += len(gram)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    width = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())


def train(texts: Iterable[str], labels: np.ndarray | array, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """``labels`` are read after all texts. (One number per bucket, bias): a document's log-odds are bias + mean over words of the mean over subwords."""
    rng = np.random.default_rng(settings.seed)
    bags = _Bags(texts, settings.buckets)
    vectors = rng.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32)
    soft = rng.normal(0, 0.5, (settings.dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(vectors.shape, 1e-8, np.float32), np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    labels = np.asarray(labels, dtype=np.int64)
    share = max(1, (labels == 1).sum()) / max(1, len(labels))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1e-6, 1 - share)).astype(np.float32) ** settings.balance
    holders = np.bincount(bags.word, minlength=len(bags.gram_at) - 1)
    seen_in = np.bincount(bags.gram, np.repeat(holders, np.diff(bags.gram_at)), settings.buckets)
    learned = seen_in >= settings.least_seen
    vectors[~learned] = 0
    if len(set(labels.tolist())) < 2:
        prior = ((labels == 1).sum() + 0.5) / (len(labels) + 2)  # below one half where there is no label at all
        return np.zeros(settings.buckets, np.float32), float(np.log(prior / (1 - prior)))
    order = np.zeros(0, np.int64)
    for _ in range(settings.steps):
        while len(order) < settings.batch:
            order = np.r_[order, rng.permutation(len(labels))]
        rows, order = order[: settings.batch], order[settings.batch :]
        a, b = bags.doc_at[rows], bags.doc_at[rows + 1]
        entry, owner = _spans(a, b), np.repeat(np.arange(len(rows)), b - a)
        if not len(entry):
            continue
        word, back = np.unique(bags.word[entry], return_inverse=True)
        g0, g1 = bags.gram_at[word], bags.gram_at[word + 1]
        gram, of_word = bags.gram[_spans(g0, g1)], np.repeat(np.arange(len(word)), g1 - g0)
        per_word = np.add.reduceat(vectors[gram], np.r_[0, np.cumsum(g1 - g0)[:-1]], axis=0) / (g1 - g0)[:, None]
        total = np.bincount(owner, bags.count[entry], len(rows))
        share_of = (bags.count[entry] / total[owner]).astype(np.float32)
        hidden = np.stack([np.bincount(owner, share_of * per_word[back, d], len(rows)) for d in range(settings.dimensions)], axis=1).astype(np.float32)
        logits = hidden @ soft * SHARPNESS + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), labels[rows]] -= 1
        p *= weight[rows][:, None] / len(rows)
        g_soft, g_bias, g_hidden = SHARPNESS * (hidden.T @ p) + settings.decay * soft, p.sum(axis=0), SHARPNESS * (p @ soft.T)
        g_word = np.stack([np.bincount(back, share_of * g_hidden[owner, d], len(word)) for d in range(settings.dimensions)], axis=1) / (g1 - g0)[:, None]
        bucket, spot = np.unique(gram, return_inverse=True)
        g_vector = np.stack([np.bincount(spot, g_word[of_word, d], len(bucket)) for d in range(settings.dimensions)], axis=1).astype(np.float32)
        some = learned[bucket]
        bucket, g_vector = bucket[some], g_vector[some]
        g_vector += settings.decay * vectors[bucket]
        for value, grad, seen, where in ((soft, g_soft, seen_s, ...), (bias, g_bias, seen_b, ...), (vectors, g_vector, seen_v, bucket)):
            seen[where] += grad * grad
            value[where] -= settings.rate * grad / np.sqrt(seen[where])
    folded = (vectors @ (soft[:, 1] - soft[:, 0]) * SHARPNESS).astype(np.float32)
    return folded, float(bias[1] - bias[0])


#: Scale of the mean vector before the softmax: a few words among hundreds must be able to move it.
SHARPNESS = 60.0


class Scorer:
    """Scores in a worker; remembers the numbers of words."""

    MEMORY = 300_000

    def __init__(self, folded: np.ndarray, bias: float):
        self.folded, self.bias, self.known = folded, bias, {}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        known = self.known
        try:
            total = sum([known[w] for w in words])
        except KeyError:
            if len(known) > self.MEMORY:
                known.clear()
            new = [w for w in set(words) if w not in known]
            grams, ends = subwords(new, len(self.folded))
            starts = np.r_[0, ends[:-1]]
            known.update(zip(new, (np.add.reduceat(self.folded[grams], starts) / (ends - starts)).tolist()))
            total = sum([known[w] for w in words])
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / len(words), -60, 60))))


_SCORERS: dict[str, Scorer] = {}


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int) -> DataFrame:
    """(x, y): about ``rows`` labelled texts, those whose hash is below the share that leaves so many; copies of a text with one
    label count once. Labels meet hashes, not texts; the texts of the picked ids, a bounded table, are then read where they lie."""
    hashed = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    told = labels.where(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
    known = materialise(hashed.join(told, "id").groupBy("h", "y").agg(F.min("id").alias("id")), "labelled")
    below = min(1 << 31, (rows << 31) // max(1, known.count()))
    picked = known.where(F.pmod("h", F.lit(1 << 31)) < below)
    texts = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("x")).withColumn("h", F.xxhash64("x"))
    return texts.join(F.broadcast(picked), ["id", "h"]).groupBy("h", "y").agg(F.first("x").alias("x")).select("x", "y")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Train on a sample of the labelled rows of ``docs``. The sample is bounded, so one task takes it: the texts and the words they
    are cut into stay out of the driver, and a lost executor costs that task. The driver gets the folded model."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity-fit")
        found = array("i")

        def texts() -> Iterator[str]:
            for batch in batches:
                for x, y in zip(batch.x.array, batch.y.array):
                    found.append(int(y))
                    yield x

        folded, bias = train(texts(), found, settings)
        yield pd.DataFrame({"folded": [folded.astype("<f4").tobytes()], "bias": [bias]})

    picked = sample(docs, labels, id, text, label, settings.sample_rows).repartition(1).sortWithinPartitions(F.xxhash64("x"), "y")
    model = picked.mapInPandas(learn, "folded binary, bias double").collect()
    if not model:  # the plan was known to be empty, and no task ran
        return train([], array("i"), settings)
    return np.frombuffer(bytes(model[0]["folded"]), "<f4").astype(np.float32), model[0]["bias"]


def with_score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    import uuid

    told, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # as large as the buckets

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity", _SCORERS.clear)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*told.value)
        for column in batches:
            yield pd.Series([_SCORERS[key].score(x) for x in column.array], dtype="float64")

    return df.withColumn(out, score(F.col(text)))
