"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, with_columns

SENTENCE_END = r"[.!?\n]+"
WORD = r"[^\W\d_]+"
STEMS = (3, 4, 5, 6, 7)  # lengths of the beginnings of words that are features too, so that inflected forms count


def features(word: str) -> list[str]:
    """What a word stands for: itself and its beginnings."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    """``bias`` is the score of a sentence without known words; ``weights`` has the learned features of words."""

    bias: float = -12.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``text, y, weight``: a bounded sample of labelled rows outside the held-out fifth.

    At most ``max_rows / 2`` rows of each class, those with the smallest hash of their id; ``weight`` restores
    the classes' shares. Rows whose label or id is null, and ids without a text, take no part. The sample's ids
    are at most ``max_rows`` longs, so they are broadcast. A labelled id that several rows of ``docs`` share counts
    once, with the least of its texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2).withColumn("weight", F.lit(max(1.0, n / (max_rows // 2)))) for y, n in sorted(counts.items())]
    if not parts:
        return docs.limit(0).select(F.col("text").cast("string"), F.lit(0).alias("y"), F.lit(1.0).alias("weight"))
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionAll(p)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")).select("text", "y", "weight")


def lexicon(rows: DataFrame, least: int, excess: float) -> list[str]:
    """Features that stand in toxic documents more often than chance: by ``excess`` standard deviations or more.

    Counted over the words of distinct sentences, so that copies of a document count once. The sample's bound and
    ``least`` bound how many there can be; there is no other cap.
    """

    def sentences(batches):
        cut = re.compile(SENTENCE_END)
        for whole in batches:
            for b in slices(whole, 0):
                found = [(s, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in set(cut.split((t or "").lower()))]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["s", "y"])

    def count(batches):
        word = re.compile(WORD)
        for whole in batches:
            for b in slices(whole, 0):
                n, pos = Counter(), Counter()
                for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = set(word.findall(s))
                    n.update(found)
                    if y:
                        pos.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[w] for w in n], pa.int64())], names=["w", "n", "pos"])

    distinct = rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(sentences, "s string, y int").distinct()
    words = distinct.mapInArrow(count, "w string, n bigint, pos bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).persist()
    try:
        total = words.agg(F.sum("pos"), F.sum("n")).first()
        rate = (total[0] or 0) / max(1, total[1] or 0)
        of = F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("-"))) for k in STEMS])
        per = words.select(F.explode(of).alias("f"), "n", "pos").where("f is not null").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        beyond = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1e-9)
        return sorted(r.f for r in per.where((F.col("n") >= least) & (beyond >= excess)).select("f").collect())
    finally:
        words.unpersist()


def bags(rows: DataFrame, known: list[str]) -> list:
    """The sample as (y, weight, sentences without a known feature, features with their sentence's number): bounded by the sample's bound."""
    at = {f: i for i, f in enumerate(known)}

    def run(batches):
        cut, word = re.compile(SENTENCE_END), re.compile(WORD)
        of = Remembered(lambda w: [at[f] for f in features(w) if f in at])
        heads = {f[:3].rstrip("-") for f in known}
        for whole in batches:
            for b in slices(whole, 0):
                out = []
                for text in b.column(0):
                    found = [[i for w in sorted(set(word.findall(s))) if w[:3] in heads for i in of[w]] for s in cut.split((text.as_py() or "").lower())]
                    full = [f for f in found if f]
                    out.append((max(1, len(found)) - len(full), [i for f in full for i in f], [k for k, f in enumerate(full) for _ in f]))
                none, idx, sent = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(none, pa.int32()), pa.array(idx, pa.list_(pa.int32())), pa.array(sent, pa.list_(pa.int32()))], names=["y", "weight", "none", "idx", "sent"])

    return rows.select("text", F.col("y").cast("int").alias("y"), "weight").mapInArrow(run, "y int, weight double, none int, idx array<int>, sent array<int>").collect()


class Remembered(dict):
    """Values made on first use, remembered up to a bound."""

    def __init__(self, make, bound: int = 200_000):
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least: int = 4, excess: float = 3.0, steps: int = 400, l2: float = 0.02) -> Model:
    """Fits weights of words and their beginnings, and the bias, from document labels alone.

    A sentence is toxic with probability s = sigmoid(bias + weights of its different words' features); a document
    with 1 - prod(1 - s). ``max_rows`` bounds the labelled rows used (documented sample, see ``sample``); the
    held-out fifth never takes part. Without rows of both classes the model has no words.
    """
    rows = sample(docs, labels, "toxic", max_rows).persist()
    try:
        known = lexicon(rows, least, excess)
        data = bags(rows, known)
    finally:
        rows.unpersist()
    y = np.array([r.y for r in data], float)
    if not len(y) or y.min() == y.max():
        return Model()
    weight = np.array([r.weight for r in data])
    none = np.array([r.none for r in data], float)
    sizes = [(max(r.sent) + 1 if r.sent else 0) for r in data]
    first = np.cumsum([0, *sizes])
    doc = np.repeat(np.arange(len(data)), sizes)
    idx = np.concatenate([np.asarray(r.idx, np.int64) for r in data])
    sent = np.concatenate([np.asarray(r.sent, np.int64) + first[i] for i, r in enumerate(data)])
    k, n = len(known), weight.sum()
    theta = np.zeros(k + 1)
    theta[k] = -6.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = theta[k] + np.bincount(sent, theta[idx], first[-1])
        act = np.bincount(doc, np.logaddexp(0, z), len(data)) + none * np.logaddexp(0, theta[k])
        act = np.maximum(act, 1e-12)
        d = weight * np.where(y == 1, -1 / np.expm1(np.minimum(act, 50)), 1.0)
        dz = d[doc] / (1 + np.exp(-z))
        g = np.empty(k + 1)
        g[:k] = np.bincount(idx, dz[sent], k) / n * 50 + l2 * theta[:k] * 0.1
        g[k] = (dz.sum() + (d * none).sum() / (1 + np.exp(-theta[k]))) / n * 50
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * min(1.0, 4 * (steps - t + 1) / steps)
    return Model(float(theta[k]), {w: float(x) for w, x in zip(known, theta)})


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (double), ``n_sentences``, and ``offending``: sentences whose own score reaches the threshold.

    ``offending`` is an array of (sentence number from 0, its text, its score). One pass, no shuffle; texts are
    scored whole, however long. A null or empty text is one empty sentence and scores as the bias alone. Other
    columns pass through, but for those named like the new ones; rows may repeat; an empty table gives an empty table.
    """
    bias = model.bias
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))

    def run(parts):
        cut, word = re.compile(SENTENCE_END), re.compile(WORD)
        low = float(np.logaddexp(0, bias))
        of = Remembered(model.word)
        heads = {f[:3].rstrip("-") for f in model.weights}  # a word with other first letters has no weight
        for _, texts in parts:
            scores, counts, found = [], [], []
            for value in texts:
                raw = value.as_py() or ""
                sentences, lowered = cut.split(raw), cut.split(raw.lower())
                act, bad = 0.0, []
                for i, s in enumerate(lowered):
                    hits = [of[w] for w in set(word.findall(s)) if w[:3] in heads]
                    if not any(hits):
                        act += low
                        continue
                    z = bias + sum(sorted(hits))
                    act += float(np.logaddexp(0, z))
                    if (p := 1 / (1 + float(np.exp(-z)))) >= threshold:
                        bad.append({"sentence": i, "text": sentences[i] if i < len(sentences) else s, "score": p})
                scores.append(-float(np.expm1(-act)))
                counts.append(len(sentences))
                found.append(bad)
            yield [pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, kind)]

    return with_columns(docs, text, {"toxicity": "double", "n_sentences": "int", "offending": "array<struct<sentence:int,text:string,score:double>>"}, run)
