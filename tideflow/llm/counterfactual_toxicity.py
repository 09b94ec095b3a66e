"""Toxicity scores that do not depend on which group a text mentions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, map_slices, materialise

#: Terms that may stand for each other, by group.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"), ("immigrants", "natives"),
    ("femmes", "hommes"), ("mujeres", "hombres"), ("frauen", "männer"),
)


def _marks(word: str) -> tuple[str, ...]:
    """What a word counts as: itself, and its first four to seven letters, which inflections share."""
    return (f"={word}", *(f"{k}{word[:k]}" for k in (7, 6, 5, 4) if len(word) >= k))


def _distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-case words of letters; for each chunk between spaces, its word (an index) and its text (an index)."""
    chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = chunks.flatten().dictionary_encode()
    names = pc.utf8_lower(pc.utf8_trim(coded.dictionary, "0123456789.,;:!?\"'()[]{}<>#*$%&|-_/\\+=~")).to_numpy(zero_copy_only=False).tolist()
    sizes = np.diff(chunks.offsets.to_numpy())
    return names, coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _marks_of(texts: pa.Array) -> list[list[str]]:
    """The distinct marks of each text."""
    names, words, owner = _distinct_words(texts)
    out: list[set[str]] = [set() for _ in range(len(texts))]
    marks = [_marks(n) if n else () for n in names]
    for w, o in zip(words.tolist(), owner.tolist(), strict=True):
        out[o].update(marks[w])
    return [sorted(x) for x in out]


@dataclass
class Model:
    marks: dict[str, int]
    weights: np.ndarray
    base: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance that each text is toxic: a logistic sum over the marks in it, each once."""
        names, words, owner = _distinct_words(texts)
        get, found, of = self.marks.get, [], []
        for i, n in enumerate(names):
            for m in _marks(n):
                if (k := get(m)) is not None:
                    found.append(k)
                    of.append(i)
        margin = np.full(len(texts), self.base)
        if found:
            bearing = np.zeros(len(names), bool)
            bearing[of] = True
            begin, mark = np.searchsorted(of, np.arange(len(names) + 1)), np.array(found)
            hit = np.flatnonzero(bearing[words])
            w, count = words[hit], np.diff(begin)[words[hit]]
            at = np.repeat(begin[w] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pairs = np.unique(np.repeat(owner[hit], count) * len(self.weights) + mark[at])
            margin += np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


@dataclass
class Swaps:
    """Counterfactual pairs: the marks that each gains (+1) and loses (-1), and how many texts it comes from."""

    moved: list[np.ndarray]
    signs: list[np.ndarray]
    weights: np.ndarray


def _flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate([np.zeros(0, np.int64), *x])


class Objective:
    """Mean log-loss of texts' marks, a ridge, and ``fairness`` times the mean squared change of the margin over all swaps."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, swaps: Swaps, k: int, ridge: float, fairness: float):
        (self.of, self.mark), (self.pair, self.moved) = _flat(rows), _flat(swaps.moved)
        self.sign = np.concatenate([np.zeros(0), *swaps.signs])
        self.share = swaps.weights / max(1.0, swaps.weights.sum())
        self.y, self.k, self.ridge, self.fairness = y, k, ridge, fairness

    def value(self, w: np.ndarray, base: float) -> float:
        margin = base + np.bincount(self.of, w[self.mark], len(self.y))
        change = np.bincount(self.pair, w[self.moved] * self.sign, len(self.share))
        return float((np.logaddexp(0, margin) - self.y * margin).sum() / max(1, len(self.y)) + self.ridge / 2 * w @ w + self.fairness * self.share @ change**2)

    def gradient(self, w: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        n = max(1, len(self.y))
        off = 1 / (1 + np.exp(-np.clip(base + np.bincount(self.of, w[self.mark], len(self.y)), -40, 40))) - self.y
        change = np.bincount(self.pair, w[self.moved] * self.sign, len(self.share))
        fair = np.bincount(self.moved, (self.share * change)[self.pair] * self.sign, self.k)
        return np.bincount(self.mark, off[self.of], self.k) / n + self.ridge * w + 2 * self.fairness * fair, off.sum() / n


def fit(rows: list[np.ndarray], y: np.ndarray, swaps: Swaps, k: int, ridge: float = 1e-5, fairness: float = 5.0, steps: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and base that bring ``Objective`` down, by gradient steps with a pace for each weight."""
    goal = Objective(rows, y, swaps, k, ridge, fairness)
    w, speed, power = np.zeros(k), np.zeros(k), np.zeros(k)
    share = (y.sum() + 1) / (len(y) + 2)
    base, base_speed, base_power = float(np.log(share / (1 - share))), 0.0, 0.0
    for step in range(1, steps + 1):
        g, b = goal.gradient(w, base)
        speed, power = 0.9 * speed + 0.1 * g, 0.99 * power + 0.01 * g * g
        base_speed, base_power = 0.9 * base_speed + 0.1 * b, 0.99 * base_power + 0.01 * b * b
        pace = rate * (1 - step / (steps + 1)) * 0.2
        w -= pace * (speed / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        base -= pace * (base_speed / (1 - 0.9**step)) / (np.sqrt(base_power / (1 - 0.99**step)) + 1e-8)
    return w, base


def _counterfactuals(rows: list[np.ndarray], marks: dict[str, int], groups: Sequence[Sequence[str]]) -> Swaps:
    """The swaps of identity terms in texts with the marks ``rows``.

    A term of a group that a text holds is swapped for each other of the group. Of a group that it does not
    mention, each term is placed in the text and swapped for each other, so that every text has swaps.
    Texts with the same marks of identity terms have the same swaps, which are made once and counted.
    """
    terms = {t: frozenset(marks[m] for m in _marks(t) if m in marks) for g in groups for t in g}
    whole = {t: marks.get(f"={t}") for t in terms}
    touched = frozenset().union(*terms.values())
    swaps: Counter = Counter()
    for held, n in Counter(frozenset(touched.intersection(r.tolist())) for r in rows).items():
        for group in groups:
            present = [t for t in group if whole[t] in held]
            for a, b in ((a, b) for a in present for b in group if b != a) if present else combinations(group, 2):
                rest = held - terms[a] if present else held
                gained, lost = terms[b] - terms[a] - rest, terms[a] - terms[b] - rest
                if gained or lost:
                    swaps[tuple(sorted(gained)), tuple(sorted(lost))] += n
    pairs = sorted(swaps)
    return Swaps([np.array(g + x, np.int64) for g, x in pairs], [np.repeat([1.0, -1.0], [len(g), len(x)]) for g, x in pairs], np.array([swaps[p] for p in pairs], float))


def _with_a_mention(row: np.ndarray, marks: dict[str, int], terms: Sequence[str]) -> np.ndarray:
    """The marks of a text with an identity term placed in it, chosen by a hash of its marks."""
    term = terms[zlib.crc32(row.astype("<i8").tobytes()) % len(terms)]
    return np.union1d(row, [marks[m] for m in _marks(term)])


def learn(sample: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, least_docs: int = 4, least_z: float = 2.5, **options) -> Model:
    """A model of ``sample(label, text)``; the sample is bounded, and what reaches the driver is its chosen marks.

    Marks in at least ``least_docs`` texts, with a z-value of ``least_z`` or more of their log odds between
    the labels, counted over the sample on the executors, are chosen, all of them: the model is bounded by
    its sample alone. The marks of identity terms are always among them. Each text is learned from as it is and with a mention of a group placed in it, under its label,
    so that the terms have weights of their own; swaps of terms in it enter the penalty.
    """
    def run(part: pa.RecordBatch) -> dict[str, object]:
        return {"label": part.column(0), "marks": pa.array(_marks_of(part.column(1)), pa.list_(pa.string()))}

    marked = materialise(map_slices(sample.select("label", "text"), run, "label int, marks array<string>").withColumn("row", F.monotonically_increasing_id()))
    sizes = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    each = marked.select("row", "label", F.explode("marks").alias("mark"))
    counted = each.groupBy("mark").agg(F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 0).alias("g")).where(F.col("b") + F.col("g") >= least_docs)
    odds = F.log((F.col("b") + 0.5) / (bad - F.col("b") + 0.5)) - F.log((F.col("g") + 0.5) / (good - F.col("g") + 0.5))
    noise = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    chosen = counted.withColumn("z", F.abs(odds / noise)).where(F.col("z") >= least_z).orderBy(F.desc("z"), "mark").select("mark")
    marks = {m: i for i, m in enumerate(chosen.toArrow().column(0).to_pylist())}
    terms = [t for g in groups for t in g]
    for m in (m for t in terms for m in _marks(t)):
        marks.setdefault(m, len(marks))
    # Marks of the bounded sample and the identity terms.
    wanted = sample.sparkSession.createDataFrame([(m, i) for m, i in marks.items()], "mark string, k int")
    kept = each.join(F.broadcast(wanted), "mark").groupBy("row").agg(F.collect_list("k").alias("ks"))
    texts = marked.select("row", "label").join(kept, "row", "left").select("label", F.coalesce(F.array_sort("ks"), F.array().cast("array<int>")).alias("ks")).toArrow().combine_chunks()
    listed = texts.column("ks").combine_chunks() if len(texts) else pa.array([], pa.list_(pa.int32()))
    flat, ends = listed.flatten().to_numpy().astype(np.int64), np.cumsum(listed.value_lengths().to_numpy())
    rows = np.split(flat, ends[:-1]) if len(ends) else []
    y, swaps = texts.column("label").to_numpy().astype(float), _counterfactuals(rows, marks, groups)
    placed = [_with_a_mention(r, marks, terms) for r in rows] if terms else []
    weights, base = fit(rows + placed, np.tile(y, 2) if terms else y, swaps, len(marks), **options)
    return Model(marks, weights, base)


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out_fold: int = 1,
                   max_rows: int = 20_000, threshold: float = 0.7, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, **options) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document, of its whole text.

    Fitted to at most ``max_rows`` labelled documents, chosen by a hash of the id, whose CRC-32 of the
    id as text is not ``held_out_fold`` modulo ``folds``. Labels and ids do not enter a score. Rows of
    ``labels`` with a null id or label are left out; without labels the score is 0.5. Null and empty
    texts have no marks and get the base score. Repeated rows repeat; an empty table gives no rows. A text
    is taken whole, however long: 512 rows and what is in them are held at a time. Other columns are
    ignored. ``groups`` are the terms that may stand for each other; ``fairness`` is the weight of the
    penalty on their swaps; ``learn`` and ``fit`` state the further ``options``.
    """
    model = learn(labelled_sample(docs, labels, label_col, id_col, text_col, folds, held_out_fold, max_rows), groups, **options)

    def run(part: pa.RecordBatch) -> dict[str, object]:
        scores = model.score(part.column(2))
        return {"id": part.column(0), "held_out": part.column(1), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), fold_of(id_col, folds).eqNullSafe(held_out_fold).alias("held_out"), F.col(text_col).alias("text"))
    return map_slices(src, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
