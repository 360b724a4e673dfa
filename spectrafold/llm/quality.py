"""Quality: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (lengths, shares of kinds of characters, repetition
of words and lines).  Boosting goes round the features in turn; every step fits a
shallow tree to one feature and adds it to that feature's lookup table, and
afterwards to tables of the strongest feature pairs.  A score is the sum of one
table cell for each feature and pair, found by binning whole columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, text_of
from .toxicity import labelled_sample

MAX_PER_CLASS = 6000
BINS, PAIR_BINS = 32, 8
FEATURES = ["chars", "words", "word_len", "upper", "digit", "symbol", "loud", "bars", "distinct", "top_word", "lines", "line_repeat", "line_len", "ends", "high", "blank", "long_word"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "%&*#$@^~=+<>{}[]\\/_"]] = True


def features(text: str) -> list[float]:
    """The numbers of FEATURES for a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    ln = max(1, len(lines))
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        n / w,
        float(count[65:91].sum()) / n,
        float(count[48:58].sum()) / n,
        float(count[_SYMBOLS].sum()) / n,
        float(count[33] + count[63]) / n,
        float(count[124]) / n,
        len(seen) / w,
        max(seen.values(), default=0) / w,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / ln,
        n / ln,
        float(count[46]) / w,
        float(count[128:].sum()) / n,
        float(count[32] + count[10] + count[9]) / n,
        float(max(map(len, seen), default=0)),
    ]


@dataclass
class QualityModel:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)  # bin bounds of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin bounds for pairs
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.coarse)]
            for i, j, t in self.pairs:
                z += t[c[i], c[j]]
        return z


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of gradient and curvature sums; place 0: none."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    tg, th = g.sum(), h.sum()
    gain = cg**2 / (ch + ridge) + (tg - cg) ** 2 / (th - ch + ridge) - tg**2 / (th + ridge)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values of a tree of two levels over one feature's bins."""
    cuts = {0, len(g)}
    for _ in range(2):
        bounds = sorted(cuts)
        for lo, hi in zip(bounds, bounds[1:]):
            _, k = _best_cut(g[lo:hi], h[lo:hi], ridge)
            if k:
                cuts.add(lo + k)
    bounds = sorted(cuts)
    out = np.zeros(len(g))
    for lo, hi in zip(bounds, bounds[1:]):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values and gain of a tree that cuts one feature, then the other in each half."""
    best, out = -1.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            halves = [(slice(0, k), *_best_cut(a[:k].sum(0), b[:k].sum(0), ridge)), (slice(k, None), *_best_cut(a[k:].sum(0), b[k:].sum(0), ridge))]
            gain = sum(x[1] for x in halves) + sum(a[s].sum() ** 2 / (b[s].sum() + ridge) for s, _, _ in halves)
            if gain > best:
                best, value = gain, np.zeros(a.shape)
                for s, _, c in halves:
                    for part in [slice(0, c), slice(c, None)] if c else [slice(None)]:
                        value[s, part] = a[s, part].sum() / (b[s, part].sum() + ridge)
                out = value.T if flip else value
    return out, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> QualityModel:
    """Cyclic boosting of the features' tables, then of the tables of the ``pairs`` strongest pairs."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(float(np.log(prior / (1 - prior))))
    width = x.shape[1]
    model.edges = [_edges(x[:, k], BINS) for k in range(width)]
    model.coarse = [_edges(x[:, k], PAIR_BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    z = np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            m = len(model.tables[k])
            step = rate * _tree(np.bincount(bins[k], g, m), np.bincount(bins[k], h, m), ridge)
            model.tables[k] += step
            z += step[bins[k]]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def grid(v: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(g, i, j), grid(h, i, j), ridge)[1], i, j) for i in range(width) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in gains[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            g, h = slopes()
            step = rate * _pair_tree(grid(g, i, j), grid(h, i, j), ridge)[0]
            table += step
            z += step[coarse[i], coarse[j]]
    model.pairs = chosen
    return model


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> QualityModel:
    """Trains on at most ``max_per_class`` labelled documents of each class (labels: doc_id, label).

    Only their features come to the driver.  Without rows of both classes the model
    is a constant.
    """
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, max_per_class))
    rows = docs.select(F.col("doc_id").alias("id"), text_of().alias("text")).join(sample, F.col("id") == F.col("doc_id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "label"]].assign(x=list(_matrix(b["text"])))

    got = rows.mapInPandas(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(float(np.log(p / (1 - p))))
    return train(np.array(got["x"].tolist(), float), y)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score (0 to 1) and predicted (1 from 0.5 on) for every row.

    Null texts count as empty, whose features are zeros.  Rows are scored on their
    own, so repeated rows and ties agree, and an empty table gives an empty one.
    Carried columns named score or predicted give way to those of the result.
    """
    carry = carried(carry, ("score", "predicted"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of at most BINS cells

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = shared.value.margin(_matrix(texts)) if len(texts) else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))), dtype=float)

    # not deterministic, so that no optimizer rule scores a text twice; only texts go to Python
    score = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    scored = docs.select(*carry, score(text_of(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
