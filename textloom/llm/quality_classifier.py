"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; boosting visits the features in turn, fits a shallow tree on one feature's
bins to the residual, and adds a small step of it to that feature's lookup table. Afterwards the pairs of
features that explain most of what remains get tables of their own in the same way. A score is
the logistic function of a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import in_small_batches, text_bytes, unused

#: At most so many labelled rows are fitted on: those with the least hash of their doc_id.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 6, 150, 60, 0.1, 3
FEATURES = (
    "log_words", "word_length", "word_length_spread", "symbols", "upper", "exclaims", "bars", "digits", "stops", "non_ascii",
    "line_rate", "distinct", "top_word", "echo", "dup_lines", "marked_words", "longest",
)
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"|", b"0123456789", b".,;:?", b"\n", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 9


def text_features(text: bytes | None) -> list[float]:
    """Features of a whole text; a text without words has zeros."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kind = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    letters = int(kind[2] + kind[8]) or 1
    marked = sum(1 for w in words if w[-1:] in (b"#", b"*", b"$", b"%", b"&", b"!", b"|"))
    echo = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [
        float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), kind[1] / n, kind[2] / letters, kind[3] / n, kind[4] / n, kind[5] / n, kind[6] / n, kind[9] / len(text),
        len(lines) / n, len(seen) / n, max(seen.values()) / n, echo / n, 1 - len(set(lines)) / len(lines), marked / n, float(np.log1p(sizes.max())),
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most LEAVES leaves on ordered bins, each split taken where it gains most."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    cuts = [0, len(gradient)]
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = score(a, mid) + score(mid, b) - score(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(mid[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values by cell of a tree of two levels: a cut of the first feature, and a tree of the second on either side; the cut that gains most."""
    best, out = 0.0, np.zeros(gradient.shape)
    for k in range(1, max(2, len(gradient))):
        made = np.concatenate([np.tile(_tree(gradient[part].sum(0), weight[part].sum(0)), (len(gradient[part]), 1)) for part in (slice(0, k), slice(k, None)) if len(gradient[part])])
        gain = float((made * gradient).sum() - (made**2 * weight).sum() / 2)
        if gain > best:
            best, out = gain, made
    return out


class AdditiveModel:
    """Lookup tables for features and pairs of features."""

    def __init__(self) -> None:
        self.start, self.edges, self.coarse, self.tables, self.pairs = 0.0, [], [], [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """x: rows of features; y: 0 or 1. With no rows, or one class, every score is that class's smoothed share."""
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        self.start = float(np.log(share / (1 - share)))
        cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if len(v) else np.empty(0)
        # Heavy ties at one value would leave no edge beside it, so the middles between distinct values near the tails are added.
        self.edges = [np.unique(np.concatenate([cut(x[:, j], BINS // 2), cut(np.unique(x[:, j]), BINS // 2)])) for j in range(x.shape[1])]
        self.coarse = [cut(np.unique(x[:, j]), PAIR_BINS) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not 0 < y.sum() < len(y):
            return self
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-total))
                k = len(self.tables[j])
                step = RATE * _tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k))
                self.tables[j] += step
                total += step[b]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        sizes = [len(e) + 1 for e in self.coarse]
        p = 1 / (1 + np.exp(-total))
        gains = {}
        for i, j in combinations(range(x.shape[1]), 2):
            cell = coarse[i] * sizes[j] + coarse[j]
            k = sizes[i] * sizes[j]
            gains[i, j] = float((np.bincount(cell, y - p, k) ** 2 / (np.bincount(cell, p * (1 - p), k) + 1.0)).sum())
        chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:PAIRS]
        self.pairs = {ij: np.zeros(sizes[ij[0]] * sizes[ij[1]]) for ij in chosen}
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in self.pairs.items():
                cell = coarse[i] * sizes[j] + coarse[j]
                p = 1 / (1 + np.exp(-total))
                g, h = np.bincount(cell, y - p, len(t)).reshape(sizes[i], sizes[j]), np.bincount(cell, p * (1 - p), len(t)).reshape(sizes[i], sizes[j])
                step = RATE * _pair_tree(g, h)
                t += step.ravel()
                total += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right") * (len(self.coarse[j]) + 1) + np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Fits on at most ``max_train`` labelled documents that are not held out.

    Labels other than 0 and 1 and rows without doc_id are left out; of several labels for one document the mean decides, and a tie counts as 0.
    Of several texts with one doc_id that with the least features is learned from.
    Only the features of these rows, never their texts, come to the driver.
    """
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    sample = usable.groupBy("doc_id").agg(F.when(F.avg("quality") > 0.5, 1).otherwise(0).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # Bounded by max_train rows of two numbers.
    rows = in_small_batches(docs).select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": list(feature_matrix(batch["text"]))})

    made = rows.mapInPandas(run, "doc_id long, label int, x array<double>")
    # One row for each doc_id, however often it repeats, so that max_train bounds what comes to the driver.
    found = made.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))  # the same model whatever order the rows came in
    return AdditiveModel().fit(x[order], found["label"].to_numpy(float)[order])


def scorer(model: AdditiveModel):
    """A column function of the text's bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(feature_matrix(texts)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType()).asNondeterministic()  # evaluated once for each row


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row for each row. Only the text is scored; null and empty
    texts get the score of a text without words; rows without doc_id count as held out."""
    score = scorer(train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), score(text_bytes()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all columns as they were; judged row by row, by the text alone.

    Null and empty texts are scored like a text without words, rows without doc_id and repeated rows like others. No documents give none.
    """
    score, name = scorer(train(docs, labels)), unused(docs, "_score")
    return docs.withColumn(name, score(text_bytes())).filter(F.col(name) >= THRESHOLD).drop(name)
