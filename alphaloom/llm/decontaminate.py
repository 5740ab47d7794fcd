"""Benchmark passages in documents: latent semantic retrieval, then common subsequences and an answer check."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, slices, with_columns

STRIDE = 16  # words; a passage is two strides long
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


@dataclass
class Items:
    """The benchmark, tokenized on the driver: its size is checked against ``max_words`` before."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]

    @staticmethod
    def load(benchmark: DataFrame, item_id: str, text: str, max_words: int) -> Items:
        rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint"), F.col(text).cast("string"))
        size = rows.agg(F.sum(F.length(F.col(text))), F.count("*")).first()
        if (size[0] or 0) > 8 * max_words:
            raise ValueError(f"the benchmark has {size[0]} characters; split it and search for each part")
        ids, words, answers = [], [], []
        for i, t in sorted(set((r[0], r[1]) for r in rows.collect())):
            if found := words_of(t):
                ids.append(i)
                words.append(found)
                parts = [w for s in re.split(r"[.!?\n]+", t) if (w := words_of(s))]
                last = parts[-1] if len(parts) > 1 and len(parts[-1]) >= 3 else found
                answers.append(last[-max(3, len(found) // 4) :])
        return Items(ids, words, answers)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each benchmark word is; the vocabulary is bounded by the benchmark's checked size."""

    def run(batches):
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for t in b.column(0):
                total += 1
                hit = vocabulary.keys() & words_of(t.as_py())
                if hit:
                    counts[[vocabulary[w] for w in hit]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*counts[some], total], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    total = 0
    for r in rows:
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def passages(ids: np.ndarray, idf: np.ndarray):
    """A document's weighted words: (stride numbers, word numbers, weights)."""
    at = np.flatnonzero(ids >= 0)
    return at // STRIDE, ids[at], idf[ids[at]]


def sketch(rows: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, basis: np.ndarray, text: str) -> np.ndarray:
    """A'A x basis for the TF-IDF matrix A of the rows' passages, summed over partitions on the executors."""
    size, rank = basis.shape

    def run(batches):
        total = np.zeros((size, rank))
        for b in batches:
            for t in b.column(0):
                found = words_of(t.as_py())
                ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
                stride, term, weight = passages(ids, idf)
                if not len(term):
                    continue
                first = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
                norm = np.sqrt(np.add.reduceat(weight * weight, first))
                seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
                w = weight / np.maximum(norm[seg], 1e-12)
                y = np.add.reduceat(w[:, None] * basis[term], first, axis=0)
                np.add.at(total, term, w[:, None] * y[seg])
        some = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i].tobytes() for i in some], pa.binary())], names=["term", "row"])

    def add(group: pa.Table) -> pa.Table:
        terms, at = np.unique(group.column("term").to_numpy(), return_inverse=True)
        values = np.frombuffer(b"".join(group.column("row").to_pylist())).reshape(-1, rank)
        out = np.zeros((len(terms), rank))
        np.add.at(out, at, values)
        return pa.table({"term": pa.array(terms, pa.int32()), "row": pa.array([x.tobytes() for x in out], pa.binary())})

    parts = rows.select(F.col(text).cast("string")).mapInArrow(run, "term int, row binary")
    summed = parts.groupBy((F.col("term") % 64).alias("part")).applyInArrow(add, "term int, row binary").collect()
    out = np.zeros((size, rank))
    for r in summed:
        out[r.term] = np.frombuffer(bytes(r.row))
    return out


def latent_space(rows: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int, text: str, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix, by randomised range finding with power rounds."""
    size = len(idf)
    rank = min(rank, size)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, rank + 8))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(sketch(rows, vocabulary, idf, basis, text))[0]
    small = basis.T @ sketch(rows, vocabulary, idf, basis, text)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    # directions in which no passage lies say nothing
    best = best[: max(1, int((values[best] > 1e-9 * values.max()).sum()))]
    return (basis @ vectors[:, best]).astype(np.float32)


def masks_of(item: list[bytes]) -> dict[bytes, int]:
    """Each word's positions in the item as a bit set."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[bytes, int], length: int, region: list[bytes]) -> int:
    """Length of the longest common subsequence of a region and an item of ``length`` words, bit-parallel over the item."""
    full = v = (1 << length) - 1
    for m in map(masks.get, region):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


class Words:
    """Which words are in which items: bits of (item, word) where they take a few megabytes, else sorted numbers of those that are."""

    def __init__(self, items: int, size: int, pairs: np.ndarray, most_bits: int = 1 << 26):
        self.size = size
        keys = np.unique(pairs[:, 0] * size + pairs[:, 1]) if len(pairs) else np.empty(0, np.int64)
        self.bits = self.keys = None
        if items * size <= most_bits:
            self.bits = np.zeros(items * size, bool)
            self.bits[keys] = True
        else:
            self.keys = np.append(keys, np.iinfo(np.int64).max)

    def has(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        key = item * self.size + term
        return self.bits[key] if self.bits is not None else self.keys[np.searchsorted(self.keys, key)] == key


def enough_shared(terms: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, inside: Words, need: np.ndarray) -> np.ndarray:
    """Which candidates can reach the asked subsequence at all.

    A subsequence of the asked length leaves out only so many words of the item, so at least ``need`` of its
    less common words must stand in the region; ``terms`` at word ``places`` are those of the documents.
    """
    a, b = np.searchsorted(places, low), np.searchsorted(places, high)
    size = b - a
    ends = np.cumsum(size)
    at = np.repeat(a - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    hit = np.concatenate([[0], np.cumsum(inside.has(np.repeat(item, size), terms[at]))])
    return hit[ends] - hit[ends - size] >= need[item]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = 96, cosine: float = 0.28, subsequence: float = 0.6, answer: float = 0.5, max_df: float = 0.02, max_words: int = 2_000_000, few: int = 8) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, cosine, subsequence share, answer share), empty for clean documents.

    Every passage of every document (two strides of 16 words, each stride shared by two passages; passages
    without a weighted word are none) and every
    passage of every item is mapped to the latent space of TF-IDF; pairs at or above ``cosine`` are candidates.
    A candidate leaks if at least ``subsequence`` of the item's words stand in the document's surroundings of
    the passage in the item's order, and ``answer`` of the item's end (its last sentence, or last quarter) does.
    Word frequencies count all documents, which are all searched; the singular vectors are those of all the
    benchmark's passages, the query set, so nothing is fitted on a part of the documents.
    Words in over ``max_df`` of the documents carry no weight in retrieval. Items with under ``few`` weighted words
    in a passage (common words, or a leak in many documents) do not rely on it: they are also compared wherever one
    of their rarest words stands, so many of them that a leak cannot leave out all (``cosine`` is 0 where the
    passage has no vector). The benchmark is the stated query set; its size is checked (``max_words``) before it is
    sent to the tasks.

    Null, empty and very short texts have no passage and no leak; items with a null id or text, or without
    words, are ignored; repeated rows give repeated results; other columns pass through but for ``leaks``; an
    empty table stays empty, and an empty benchmark finds nothing.
    """
    kind = "array<struct<item_id:bigint,cosine:double,subsequence:double,answer:double>>"
    src = docs.select(*[c for c in docs.columns if c != "leaks"], F.col(text).cast("string").alias(f"{OWN}text"))
    items = Items.load(benchmark, item_id, item_text, max_words)
    if not items.ids:
        return docs.select(*[c for c in docs.columns if c != "leaks"], F.expr(f"cast(array() as {kind})").alias("leaks"))
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in items.words for w in ws}))}
    counts, total = document_frequencies(src, vocabulary, f"{OWN}text")
    idf = np.where(counts <= max(max_df * total, 2), np.log((1 + total) / (1.0 + counts)) + 0.1, 0.0)
    known = {w: i for w, i in vocabulary.items() if idf[i] > 0}
    # words in under a tenth of the documents serve the bound on subsequences
    plain = counts <= max(0.1 * total, 2)
    pairs = [np.empty((0, 2), np.int64)]
    need = np.zeros(len(items.ids), np.int64)
    for k, ws in enumerate(items.words):
        of_item_ids = [vocabulary[w] for w in ws]
        pairs.append(np.array([(k, t) for t in of_item_ids if plain[t]], np.int64).reshape(-1, 2))
        need[k] = int(np.ceil(subsequence * len(ws))) - int((~plain[of_item_ids]).sum())
    inside = Words(len(items.ids), len(vocabulary), np.concatenate(pairs))
    heavy = idf > 0
    masks = [masks_of(ws) for ws in items.words]
    tail_masks = [masks_of(ws) for ws in items.answers]
    pads = np.array([max(STRIDE, len(ws) + len(ws) // 4) for ws in items.words], np.int64)
    rows = benchmark.select(F.col(item_text).cast("string").alias("t")).where(F.col(item_id).isNotNull() & F.col("t").isNotNull())
    space = latent_space(rows, known, idf, rank, "t")
    targets, of, exact = [], [], []
    for k, ws in enumerate(items.words):
        for a in range(0, max(1, len(ws) - STRIDE), STRIDE):
            ids = [known[w] for w in ws[a : a + 2 * STRIDE] if w in known]
            if len(ids) < few and k not in exact[-1:]:
                exact.append(k)
            vec = (idf[ids][:, None] * space[ids]).sum(axis=0)
            if (n := np.linalg.norm(vec)) > 1e-9:
                targets.append(vec / n)
                of.append(k)
    queries = np.array(targets, np.float32).reshape(-1, space.shape[1])
    weighted = (idf[:, None] * space).astype(np.float32)
    of_item = np.array(of, np.int64)
    least = np.array([int(np.ceil(subsequence * len(ws))) for ws in items.words], np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    seeds = []  # (word, item): the item's rarest words, of which a subsequence of the asked length has one at least
    for k in exact:
        terms_of = [vocabulary[w] for w in items.words[k]]
        pairs.append(np.array([(k, t) for t in terms_of], np.int64))
        rarest = sorted(terms_of, key=lambda t: (counts[t], t))[: len(terms_of) - max(1, int(least[k])) + 1]
        seeds += [(t, k) for t in set(rarest)]
    whole_item = Words(len(items.ids), len(vocabulary), np.concatenate(pairs))
    seed_term, seed_item = np.array(sorted(seeds), np.int64).reshape(-1, 2).T

    def run(parts):
        at = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("subsequence", pa.float64()), ("answer", pa.float64())]))
        for _, texts in parts:
            docs_words = [words_of(t.as_py()) for t in texts]
            # word places of all documents on one line, each from a stride's start, an empty stride between documents
            bases = np.cumsum([0, *(STRIDE * (len(ws) // STRIDE + 2) for ws in docs_words)])
            places, terms = [], []
            for ws, base in zip(docs_words, bases):
                ids = np.fromiter(map(vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
                p = np.flatnonzero(ids >= 0)
                places.append(p + base)
                terms.append(ids[p])
            place, term = np.concatenate(places), np.concatenate(terms)
            all_term, all_place = term, place
            less = plain[term]
            bound_term, bound_place = term[less], place[less]
            heavy_at = heavy[term]
            stride, term = place[heavy_at] // STRIDE, term[heavy_at]
            leaks: list[dict[int, tuple]] = [{} for _ in docs_words]
            number, sums, norm = np.empty(0, np.int64), None, None

            def compare(k: int, at: int, low: int, high: int, near):
                d = int(np.searchsorted(bases, at + STRIDE, side="right")) - 1
                region = docs_words[d][max(0, low - int(bases[d])) : max(0, high - int(bases[d]))]
                share = common_subsequence(masks[k], len(items.words[k]), region) / len(items.words[k])
                if share < subsequence:
                    return
                tail = common_subsequence(tail_masks[k], len(items.answers[k]), region) / len(items.answers[k])
                if tail >= answer and (k not in leaks[d] or share > leaks[d][k][1]):
                    leaks[d][k] = (float(near()), share, tail)

            if len(term) and len(queries):
                first = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
                lone = np.add.reduceat(weighted[term], first, axis=0)
                # passages: a stride and the next, where either has weight
                number = np.unique(np.concatenate([stride[first], stride[first] - 1]))
                sums = np.zeros((len(number), lone.shape[1]), np.float32)
                sums[np.searchsorted(number, stride[first])] += lone
                sums[np.searchsorted(number, stride[first] - 1)] += lone
                norm = np.linalg.norm(sums, axis=1)
                for x in range(0, len(number), 2048):
                    part = number[x : x + 2048]
                    near = (sums[x : x + 2048] / np.maximum(norm[x : x + 2048, None], 1e-9)) @ queries.T
                    i, j = np.nonzero(near >= cosine)
                    item = of_item[j]
                    start = part[i] * STRIDE
                    low, high = start - pads[item], start + 2 * STRIDE + pads[item]
                    fine = np.flatnonzero(enough_shared(bound_term, bound_place, low, high, item, inside, need))
                    for c in fine.tolist():
                        compare(int(item[c]), int(start[c]), int(low[c]), int(high[c]), lambda: near[i[c], j[c]])

            def cosine_at(k: int, stride: int) -> float:
                x = int(np.searchsorted(number, stride))
                own = queries[of_item == k]
                return float((own @ (sums[x] / max(norm[x], 1e-9))).max()) if x < len(number) and number[x] == stride and len(own) else 0.0

            a, z = np.searchsorted(seed_term, all_term), np.searchsorted(seed_term, all_term, side="right")
            ends = np.cumsum(z - a)
            at_seed = np.repeat(a - (ends - (z - a)), z - a) + np.arange(ends[-1] if len(ends) else 0)
            spots = np.unique(np.stack([np.repeat(all_place // STRIDE, z - a), seed_item[at_seed]]), axis=1)
            for x in range(0, spots.shape[1], 8192):
                at_stride, item = spots[:, x : x + 8192]
                start = at_stride * STRIDE
                low, high = start - pads[item], start + 2 * STRIDE + pads[item]
                for c in np.flatnonzero(enough_shared(all_term, all_place, low, high, item, whole_item, least)).tolist():
                    k = int(item[c])
                    compare(k, int(start[c]), int(low[c]), int(high[c]), lambda: cosine_at(k, int(at_stride[c])))
            out = [[{"item_id": items.ids[k], "cosine": c, "subsequence": s, "answer": a} for k, (c, s, a) in sorted(x.items())] for x in leaks]
            yield [pa.array(out, at)]

    return with_columns(docs, text, {"leaks": kind}, run)
