"""Toxicity: subword bags averaged into a linear softmax.

A word is the bag of its character n-grams, hashed to rows of an embedding table.
Passages of WINDOW words (the last may be shorter) average the embeddings of their
words; a linear softmax over the two classes scores each passage, and a document is
as toxic as its passages together (log-sum-exp of their margins).  Embeddings and
softmax are trained jointly in numpy.  Words that were never seen, misspellings above
all, share n-grams with those that were.

For two classes the softmax is a logistic function of one margin, and the margin of
an average is the average of the words' margins; so scoring needs one number for
each bucket and remembers one for each word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, carried, text_of

BUCKETS, DIM, WINDOW = 1 << 17, 8, 3
#: n-grams in fewer training texts stay zero.
MIN_TEXTS = 4
MAX_PER_CLASS = 3000
BATCH = 64
MAX_WORDS = 800_000
_MARKS = ".,;:!?\"'()[]{}<>|*%&$#-_/"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of 3 to 6 characters, ends marked, word after word, and how many each has; outer punctuation doesn't count.

    A word of punctuation alone has one gram, its two end marks.
    """
    marked = ["<" + w.strip(_MARKS) + ">" for w in words]
    length = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(marked)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters from here to the word's end
    padded = np.r_[codes, np.zeros(6, np.uint32)]
    found, valid = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, 7):
        h = (h ^ padded[n - 1 : n - 1 + len(codes)]) * np.uint32(0x01000193) + np.uint32(n)
        if n == 2:
            valid.append((left == 2) & (length[word] == 2))
        elif n > 2:
            valid.append(left >= n)
        if n > 1:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS))
    keep = np.stack(valid, 1)
    return np.stack(found, 1)[keep].astype(np.int64), np.bincount(word, keep.sum(axis=1), len(marked)).astype(np.int64)


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class ToxicityModel:
    margins: np.ndarray  # toxic against clean, for each bucket
    bias: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        flat, size = grams(words)
        return np.add.reduceat(self.margins[flat].astype(float), np.cumsum(size) - size) / size


def _passages(n: int) -> np.ndarray:
    return np.arange(0, n, WINDOW)


def _means(words: np.ndarray, n: int) -> np.ndarray:
    """Averages over the passages of a text's ``n`` word values."""
    at = _passages(n)
    return np.add.reduceat(words, at) / np.minimum(WINDOW, n - at)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin at ``start``."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1])


def train(docs: list[np.ndarray], labels: np.ndarray, bags: tuple[np.ndarray, np.ndarray], steps: int = 500, rate: float = 1.0, seed: int = 1) -> ToxicityModel:
    """Joint training by Adagrad over about ``steps`` mini-batches of BATCH texts.

    A text is an array of word numbers, ``bags`` has the words' buckets and how many
    each word has, as :func:`grams` gives them.  Margins
    are linear in the embeddings, so a word's share of the gradient is one number times
    the direction of the softmax.
    """
    rng = np.random.default_rng(seed)
    flat, size = bags
    begin = np.cumsum(size) - size
    table = (rng.uniform(-0.05, 0.05, (BUCKETS, DIM)) / DIM).astype(np.float32)
    weight = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias, step_table, step_weight, step_bias = np.array([0.0, -2.0]), np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    seen = np.zeros(BUCKETS, np.int64)
    for words in filter(len, map(np.unique, docs)):
        seen[np.unique(flat[_ranges(begin[words], size[words])])] += 1
    live = seen >= MIN_TEXTS
    table[~live] = 0
    usable = [k for k, d in enumerate(docs) if len(d)]
    place = np.zeros(len(size), np.int64)
    for _ in range(max(2, round(steps * BATCH / max(1, len(usable))))):
        order = rng.permutation(usable)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            tokens = np.concatenate([docs[k] for k in pick])
            words = np.unique(tokens)
            place[words] = np.arange(len(words))
            of = place[tokens]
            n = size[words]
            buckets = flat[_ranges(begin[words], n)]
            first_gram = np.cumsum(n) - n
            direction = weight[:, 1] - weight[:, 0]
            values = np.add.reduceat((table @ direction)[buckets], first_gram) / n
            lengths = np.array([len(docs[k]) for k in pick])
            starts = np.cumsum(lengths) - lengths
            passage = np.concatenate([s + _passages(m) for s, m in zip(starts, lengths)])
            width = np.diff(np.r_[passage, len(tokens)])
            doc_of = np.repeat(np.arange(len(pick)), [-(-m // WINDOW) for m in lengths])
            margin = np.add.reduceat(values[of], passage) / width + bias[1] - bias[0]
            first = np.r_[0, np.flatnonzero(np.diff(doc_of)) + 1]
            top = np.maximum.reduceat(margin, first)
            share = np.exp(margin - top[doc_of])
            total = np.add.reduceat(share, first)
            z = np.clip(top + np.log(total), -500, 500)
            gap = 1 / (1 + np.exp(-z)) - labels[pick]
            g = gap[doc_of] * share / total[doc_of] / len(pick)
            per_word = np.bincount(of, np.repeat(g / width, width), len(words)) / n
            grad = np.bincount(buckets, np.repeat(per_word, n), BUCKETS) * live
            touched = np.flatnonzero(grad)
            grad = grad[touched].astype(np.float32)
            # the mean passage, weighted by its gap: the gradient of the softmax
            pull = grad @ table[touched]
            grad_weight, grad_bias = np.stack([-pull, pull], 1), np.array([-g.sum(), g.sum()])
            step_table[touched] += grad.astype(float) ** 2 * float(direction @ direction) * 100
            step_weight += grad_weight**2
            step_bias += grad_bias**2
            table[touched] -= (rate * 10 * grad / np.sqrt(step_table[touched])).astype(np.float32)[:, None] * direction
            weight -= (rate * grad_weight / np.sqrt(step_weight)).astype(np.float32)
            bias -= rate * grad_bias / np.sqrt(step_bias)
    direction = weight[:, 1] - weight[:, 0]
    return ToxicityModel((table @ direction).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, by hash order; null and other labels don't count."""
    usable = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ranked = [usable.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return ranked[0].unionByName(ranked[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Trains on at most ``max_per_class`` labelled documents of each class (labels: doc_id, label); that is the only bound.

    Whole texts of any length are used.  Executors cut them into words; the driver
    gets four bytes for each word of a text, and each distinct word once.  Labels
    that contradict one another count as the larger, other labels than 0 and 1 and
    null ids don't count.  Without rows of both classes every score is 0.5 or lower.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = F.broadcast(labelled_sample(labels, max_per_class))
    rows = docs.select(F.col("doc_id").alias("id"), text_of().alias("text")).join(sample, F.col("id") == F.col("doc_id")).select("doc_id", "label", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            found, new = [], {}
            for text in b["text"]:
                words = words_of(text)
                for w in set(words).difference(known):
                    known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    new[known[w]] = w
                found.append(np.array([known[w] for w in words], "<u4").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "data": found, "word": None, "name": 0})
            if new:
                yield pd.DataFrame({"doc_id": 0, "label": -1, "data": None, "word": list(new.values()), "name": list(new)})

    work = Workspace(spark, "toxicity")
    made = work.save(rows.mapInPandas(cut, "doc_id long, label int, data binary, word string, name long"), "sample")
    words = made.filter("label < 0").groupBy("name").agg(F.min("word").alias("word")).toArrow().sort_by("name")
    texts = made.filter("label >= 0").select("doc_id", "label", "data").collect()
    work.drop()
    names = words["name"].to_numpy()
    texts = sorted(((r["doc_id"], r["label"], bytes(r["data"])) for r in texts), key=lambda r: (len(r[2]), r[0], r[2]))
    y = [label for _, label, _ in texts]
    if len(set(y)) < 2 or not len(names):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -2.0)
    return train([np.searchsorted(names, np.frombuffer(d, "<u4").astype(np.int64)) for _, _, d in texts], np.array(y, float), grams(words["word"].to_pylist()))


def encode(texts: list[str]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Word numbers of texts and the words' grams, as :func:`train` takes them."""
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    return docs, grams(list(known))


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.memo = model, {}

    def margins_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Margins of each text's words; words that the memo lacks are hashed together."""
        memo = self.memo
        new = set().union(*texts).difference(memo)
        if len(memo) + len(new) > MAX_WORDS:
            memo.clear()
            new = set().union(*texts)
        new = list(new)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            memo.update(zip(part, self.model.word_margins(part).tolist()))
        return [np.array([memo[w] for w in words]) for words in texts]

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for margins in self.margins_of([words_of(t) for t in texts]):
            m = (_means(margins, len(margins)) if len(margins) else np.zeros(1)) + self.model.bias
            top = m.max()
            z = top + np.log(np.exp(m - top).sum())
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score (0 to 1) and predicted (1 from 0.5 on) for every row.

    Null texts count as empty; a text without words gets the score of an empty
    passage.  Rows are scored on their own, so repeated rows and ties agree, and an
    empty table gives an empty one.  Carried columns named score or predicted give
    way to those of the result.
    """
    carry = carried(carry, ("score", "predicted"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            held = texts.tolist()
            yield pd.Series([s for k in range(0, len(held), 200) for s in scorer.scores(held[k : k + 200])], dtype=float)

    # not deterministic, so that no optimizer rule scores a text twice; only texts go to Python
    score = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    scored = docs.select(*carry, score(text_of(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
