"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata (the text's length).

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on at most MAX_TRAIN labelled documents, those whose hashed ids are smallest, each with at most
MAX_TRAIN_CHARS characters (longer ones aren't learned from); both bounds are parameters. Feature vectors of these, not
texts, come to the driver. Scoring is one pass over the whole texts, however long.

Defined results: null and empty texts get the score of their (mostly zero) statistics; without any document to learn from
every score is 0.5; of repeated labels of a document the lowest quality counts; labels without a quality or a document are
ignored. Of rows that repeat a doc_id the one with the smallest text is learned from, once; each gets a row of results. A
null doc_id is never learned from, and scored like others. Rows are learned from in the order of doc_id, so partitions
don't matter. Other columns aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import column, map_rows

MAX_TRAIN = 4000
MAX_TRAIN_CHARS = 100_000
BUCKETS = 1 << 12
RANK = 8
EPOCHS = 6
RATE = 0.08
PENALTY = 1e-5
SEED = 7

_CLASS = np.zeros((256, 6))
for _b in range(256):
    _CLASS[_b] = (65 <= _b <= 90, 97 <= _b <= 122 or _b >= 128, 48 <= _b <= 57, _b in b".,;:'\"()-?", _b in b"#$%&*+/<=>@[\\]^_`{|}~!", _b in b" \t\n\r\x0b\x0c")
STATISTICS = 16
SIZE = BUCKETS + STATISTICS
_END = re.compile(r"[.!?]\s")


def statistics(text: str, words: list[str], count: Counter) -> list[float]:
    """Structure of a text, and its length as metadata; each value is about 0 to 1."""
    raw = text.encode("utf-8", "surrogatepass")
    n, w = max(1, len(raw)), max(1, len(words))
    share = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASS / n
    lines = text.split("\n")
    sentences = len(_END.findall(text)) + 1
    doubled = sum(map(eq, words, words[1:])) / w
    most = max(count.values(), default=0) / w
    return [
        1.0, np.log1p(n) / 12, np.log1p(w) / 10, *share, min(1.0, n / w / 16), len(count) / w,
        most, doubled, 1 - len(set(lines)) / len(lines), min(1.0, w / sentences / 40), float(not words),
    ]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: (index, value, row starts with the end behind them)."""
    names, values, sizes, dense = [], [], [], []
    for t in texts:
        t = t or ""
        words = t.split()
        count = Counter(words)
        dense.append(statistics(t, words, count))
        own = np.log1p(np.fromiter(count.values(), dtype=float, count=len(count)))
        values.append(own / max(1e-9, np.sqrt((own**2).sum())))
        names.extend(count)
        sizes.append(len(count))
    hashed = np.zeros(0, dtype=np.int64)
    if names:
        flat = np.empty(len(names), dtype=object)
        flat[:] = names
        hashed = (pd.util.hash_array(flat, categorize=False) % np.uint64(BUCKETS)).astype(np.int64)
    index, value, starts, at = [], [], [0], 0
    own = np.arange(BUCKETS, SIZE)
    for n, v, d in zip(sizes, values, dense, strict=True):
        index += [hashed[at : at + n], own]
        value += [v, np.array(d)]
        at += n
        starts.append(starts[-1] + n + STATISTICS)
    return np.concatenate(index) if index else hashed, np.concatenate(value) if value else np.zeros(0), np.array(starts)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        linear, sums, squares = self._parts(index, value, starts)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)

    def _parts(self, index, value, starts):
        scaled = self.factors[index] * value[:, None]
        at = starts[:-1]
        return np.add.reduceat(self.weights[index] * value, at), np.add.reduceat(scaled, at), np.add.reduceat(scaled**2, at)

    def scores(self, texts: list[str | None]) -> list[float]:
        return sigmoid(self.logits(*features(texts))).tolist()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Logistic loss by Adagrad over small batches; the order of the rows and a fixed seed decide the result."""
    random = np.random.default_rng(SEED)
    if not rows:
        return Model(0.0, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    model = Model(0.0, np.zeros(SIZE), random.normal(0, 0.02, (SIZE, RANK)))
    grown_w, grown_v, grown_b = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    y = np.array(labels, dtype=float)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            size = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(size)])
            linear, sums, squares = model._parts(index, value, starts)
            slope = (sigmoid(model.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)) - y[batch]) / len(batch)
            touched, place = np.unique(index, return_inverse=True)
            each = np.repeat(slope, size)
            step_w = np.bincount(place, each * value, minlength=len(touched)) + PENALTY * model.weights[touched]
            inner = (each * value)[:, None] * (np.repeat(sums, size, axis=0) - model.factors[index] * value[:, None])
            step_v = np.stack([np.bincount(place, inner[:, f], minlength=len(touched)) for f in range(RANK)], axis=1) + PENALTY * model.factors[touched]
            grown_w[touched] += step_w**2
            grown_v[touched] += step_v**2
            grown_b += slope.sum() ** 2
            model.weights[touched] -= RATE * step_w / np.sqrt(grown_w[touched])
            model.factors[touched] -= RATE * step_v / np.sqrt(grown_v[touched])
            model.bias -= RATE * slope.sum() / np.sqrt(grown_b)
    return model


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Learn from labelled documents outside the held-out fold (remainder 1 of 3)."""
    known = labels.where("doc_id is not null and quality is not null").where(fold(3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # one row for each of at most max_train ids

    def make():
        def f(ids, texts, quality):
            index, value, starts = features(texts)
            cut = list(zip(starts, starts[1:], strict=False))
            return ids, quality, [index[a:b].astype(np.int32) for a, b in cut], [value[a:b].astype(np.float32) for a, b in cut]

        return f

    got = map_rows(rows, ["doc_id", "text", "quality"], "doc_id bigint, quality int, i array<int>, v array<float>", make)
    got = got.where(F.col("quality").isNotNull()).toArrow().sort_by([("doc_id", "ascending")])
    taken = [(i.values.to_numpy(), v.values.to_numpy().astype(float)) for i, v in zip(got["i"], got["v"], strict=True)]
    return train(taken, got["quality"].to_pylist())


def score(text: Column, model: Model) -> Column:
    """Probability of label 1."""
    return column("double", lambda: model.scores, text)
