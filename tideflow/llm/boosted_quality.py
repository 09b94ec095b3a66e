"""Quality scores: histogram gradient-boosted trees over statistics of documents."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, map_slices, utf8

_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
_SPACES = [32, *range(9, 14)]
_SYMBOLS = list(b"#*$%&|<>")
_STOPS = list(b".,;:?")

FEATURES = ("log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digits", "beyond_ascii", "symbols", "exclaimed", "stops", "spaces",
            "distinct_words", "stuttered", "top_word", "log_lines", "words_per_line", "repeated_lines", "capital_words", "symbol_words", "sentence_ends")


def statistics(text: bytes | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text; all 0 for a text without words (null too)."""
    data = text or b""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    inner = size - int(seen[_SPACES].sum())
    begins = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    closes = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    return [
        np.log1p(size), np.log1p(n), inner / n, float(lengths.std()), seen[_UPPER].sum() / inner, seen[_LOWER].sum() / inner, seen[_DIGITS].sum() / inner,
        seen[128:].sum() / inner, seen[_SYMBOLS].sum() / inner, seen[33] / inner, seen[_STOPS].sum() / inner, 1 - inner / size,
        len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        ((begins >= 65) & (begins < 91)).mean(), np.isin(closes, _SYMBOLS).mean(), np.isin(closes, (46, 33, 63)).mean(),
    ]


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row, by stepping all rows down a level at a time."""
        margin, rows, depth = np.full(len(x), self.base), np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boost log-loss with trees grown level by level on histograms of binned features.

    Without rows the score is 0.5 for all; with one label only, that label's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin b: values up to edge b
    cell = binned + np.arange(k) * bins
    margin, grown = np.full(n, model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + cell).ravel()
            sums = [np.bincount(at, np.repeat(v, k), width * k * bins).reshape(width, k, bins) for v in (g, h, np.ones(n))]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least) | (total[2] - left[2] < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w, b in enumerate(best.tolist()):
                if gain.reshape(width, -1)[w, b] > 1e-9:
                    feature[first + w], threshold[first + w] = b // bins, edges[b // bins][b % bins]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - (2**depth - 1)
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[at]
        grown.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.stack(v) for v in zip(*grown, strict=True))
    return model


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, features ARRAY<DOUBLE>)`` of whole texts."""
    def run(part: pa.RecordBatch) -> dict[str, object]:
        return {"id": part.column(0), "features": pa.array([statistics(t) for t in utf8(part.column(1))], pa.list_(pa.float64()))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, features array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out_fold: int = 2,
                  max_rows: int = 12_000, threshold: float = 0.7, **options) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document.

    Trees are fitted to at most ``max_rows`` labelled documents, chosen by a hash of the id, whose
    CRC-32 of the id as text is not ``held_out_fold`` modulo ``folds``; labels and ids do not enter a
    score. Rows of ``labels`` with a null id or label are left out; without labels the score is 0.5.
    Null and empty texts, and texts without words, have all statistics 0 and a score like any other.
    Repeated rows repeat; an empty table gives no rows; other columns are ignored. All statistics are of
    the whole text, however long; its words are held once.
    """
    train = labelled_sample(docs, labels, label_col, id_col, text_col, folds, held_out_fold, max_rows)
    rows = document_statistics(train.withColumnRenamed("text", text_col), "label", text_col).collect()
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    model = fit(x, np.array([r.id for r in rows], float), **options)

    def run(part: pa.RecordBatch) -> dict[str, object]:
        scores = model.score(np.array([statistics(t) for t in utf8(part.column(2))]))
        return {"id": part.column(0), "held_out": part.column(1), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), fold_of(id_col, folds).eqNullSafe(held_out_fold).alias("held_out"), F.col(text_col).alias("text"))
    return map_slices(src, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
