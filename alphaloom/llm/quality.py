"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_columns
from .toxicity import sample

#: Bins of each line feature: edges of the value's ranges.
SHARES = (0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
EDGES = [
    (1, 2, 3, 5, 8, 12, 20, 40, 80, 160),  # words
    (1, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),  # mean bytes of a word
    SHARES,  # bytes that are symbols
    SHARES,  # bytes A-Z
    SHARES,  # bytes 0-9
    SHARES,  # words followed by themselves
    (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99),  # distinct words per word
    (2, 3, 5, 10),  # times the line is in its document
    (0.001, 0.1, 0.3, 0.6, 0.9),  # sentence ends per word
    (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),  # the most frequent word's share
]
WIDTH = 16
OWN_BINS = len(EDGES) * WIDTH
#: Per line: its own bins, then the previous and the next line's (bin 15: there is none), then a constant.
FEATURES = 3 * OWN_BINS + 1

SYMBOLS = b"#$%&*|@^~=+<>{}[]_\\/"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
ENDS = b".!?"


def line_values(line: bytes, times: int) -> tuple:
    words = line.split()
    n, size = max(1, len(words)), max(1, len(line))
    counts = Counter(words)
    return (
        len(words),
        (size - len(words) + 1) / n,
        (size - len(line.translate(None, SYMBOLS))) / size,
        (size - len(line.translate(None, UPPER))) / size,
        (size - len(line.translate(None, DIGITS))) / size,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(counts) / n,
        times,
        (size - len(line.translate(None, ENDS))) / n,
        max(counts.values(), default=0) / n,
    )


def lines_of(text: str | None) -> list[bytes]:
    """The lines that are not blank; a text without any is one empty line."""
    found = [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x and not x.isspace()]
    return found or [b""]


def featurize(texts: list[str | None], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (16 bits) of every line (lines x features), lines per document, bytes per line."""
    made, sizes, counts = [], [], []
    values: list[tuple] = []

    def binned():
        table = np.array(values, float).reshape(-1, len(EDGES))
        made.append(np.stack([np.searchsorted(e, table[:, k], side="right") + k * WIDTH for k, e in enumerate(EDGES)], axis=1).astype(np.int16))
        values.clear()

    for text in texts:
        lines = lines_of(text)
        times = Counter(lines)
        for x in lines:
            values.append(line_values(x, times[x]))
            if len(values) >= at_once:
                binned()
        sizes += [max(1, len(x)) for x in lines]
        counts.append(len(lines))
    binned()
    bins = np.concatenate(made)
    counts = np.array(counts, np.int64)
    first = np.cumsum(counts) - counts
    none = (np.arange(len(EDGES)) * WIDTH + WIDTH - 1).astype(np.int16)
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[first], after[first + counts - 1] = none, none
    constant = np.full((len(bins), 1), FEATURES - 1, np.int16)
    return np.concatenate([bins, before + np.int16(OWN_BINS), after + np.int16(2 * OWN_BINS), constant], axis=1), counts, np.array(sizes, float)


@dataclass
class Model:
    """``weights``: log-odds of a good line per feature; ``moves``: log potentials of (label, next label)."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, odds: np.ndarray, counts: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Forward-backward over all documents at once, line by line: P(good) per line, pair marginals if asked for, log partition per document."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        longest = int(n[0])
        at = [first[: np.searchsorted(-n, -t, side="left")] + t for t in range(longest)]
        node = np.stack([np.zeros(len(odds)), odds], axis=1)
        fore = node.copy()
        for t in range(1, longest):
            prev = fore[at[t] - 1]
            fore[at[t]] = node[at[t]] + np.logaddexp(prev[:, :1] + self.moves[0], prev[:, 1:] + self.moves[1])
        back = np.zeros_like(node)
        for t in range(longest - 2, -1, -1):
            here = at[t][: len(at[t + 1])]
            nxt = node[here + 1] + back[here + 1]
            back[here] = np.logaddexp(nxt[:, :1] + self.moves[:, 0], nxt[:, 1:] + self.moves[:, 1])
        ends = (np.cumsum(counts) - 1)[order]
        total = np.empty(len(counts))
        total[order] = np.logaddexp(fore[ends, 0], fore[ends, 1])
        line_total = np.repeat(total, counts)
        good = np.exp(np.minimum(0, fore[:, 1] + back[:, 1] - line_total))
        if not pairs:
            return good, None, total
        inner = np.ones(len(odds), bool)
        inner[np.cumsum(counts) - 1] = False
        a = np.flatnonzero(inner)
        pair = np.exp(fore[a][:, :, None] + self.moves[None] + (node[a + 1] + back[a + 1])[:, None, :] - line_total[a][:, None, None])
        return good, pair, total


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_lines: int = 2_000, steps: int = 120, l2: float = 1e-3) -> Model:
    """Fits the field from document labels: a labelled document's lines all carry its label.

    ``max_rows`` bounds the labelled documents used (at most half of each class, smallest hash of the id first,
    weighted back to the classes' shares) and ``max_lines`` the lines that each of them gives to the fit (the
    first ones; scoring takes all lines of all documents). Features are made on the executors; the bounded matrix is fitted by gradient ascent on the conditional likelihood.
    Without rows of both classes every line is equally likely good or bad.
    """
    rows = sample(docs, labels, "quality", max_rows)

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 0)):
            feats, counts, _ = featurize(b.column(0).to_pylist())
            ends = np.cumsum(counts)
            cols = [pa.array([feats[e - n : e - n + min(n, max_lines)].tobytes() for e, n in zip(ends, counts)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *cols], names=["y", "weight", "feats"])

    data = rows.select("text", F.col("y").cast("int").alias("y"), "weight").mapInArrow(run, "y int, weight double, feats binary").collect()
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    if len({r.y for r in data}) < 2:
        return model
    wide = 3 * len(EDGES) + 1
    feats = [np.frombuffer(bytes(r.feats), np.int16).reshape(-1, wide) for r in data]
    counts = np.array([len(f) for f in feats])
    flat = np.concatenate(feats).astype(np.int64)
    y = np.repeat([r.y for r in data], counts)
    # every document weighs the same, however many lines it has
    doc_weight = np.array([r.weight for r in data]) / counts
    weight = np.repeat(doc_weight, counts)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - 1] = False
    pair_weight = weight[inner][:, None, None]
    same = np.zeros((2, 2))
    for c in (0, 1):
        same[c, c] = weight[inner][y[inner] == c].sum()
    n = doc_weight.sum()
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        model = Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        good, pair, _ = model.marginals(model.weights[flat].sum(axis=1), counts)
        g = np.empty_like(theta)
        g[:FEATURES] = np.bincount(flat.ravel(), np.repeat(weight * (good - y), wide), FEATURES) / n
        g[FEATURES:] = (((pair * pair_weight).sum(axis=0) - same) / n).ravel()
        g += l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * min(1.0, 3 * (steps - t + 1) / steps)
        theta[FEATURES:] = np.clip(theta[FEATURES:], -1.5, 1.5)  # equal labels within documents would drive the moves without bound
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``quality`` (the lines' chances of being good, weighted by their bytes) and ``bad_lines`` (numbers of lines more likely bad).

    Lines are those not blank, numbered from 0; a null, empty or blank text is one empty line. One pass, no
    shuffle; whole texts. Other columns pass through, but for those named like the new ones; rows may repeat;
    an empty table gives an empty table.
    """

    def run(parts):
        for _, texts in parts:
            feats, counts, sizes = featurize(texts.to_pylist())
            odds = np.concatenate([model.weights[feats[x : x + 20_000]].sum(axis=1) for x in range(0, len(feats), 20_000)])
            good, _, _ = model.marginals(odds, counts, pairs=False)
            first = np.cumsum(counts) - counts
            quality = np.add.reduceat(good * sizes, first) / np.add.reduceat(sizes, first)
            bad = [np.flatnonzero(good[f : f + n] < 0.5).tolist() for f, n in zip(first, counts)]
            yield [pa.array(np.clip(quality, 0, 1)), pa.array(bad, pa.list_(pa.int32()))]

    return with_columns(docs, text, {"quality": "double", "bad_lines": "array<int>"}, run)
