"""Tree ensembles for the targets, on Spark ML."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import side_by_side
from ..functions.scores import absolute_percentage_error, log_target, unlog_target, weighted
from .evaluate import enrich
from .series_key import SeriesLevels, fit_levels

BOOSTED, FOREST = "boosted", "forest"
_KINDS = {"boosted": BOOSTED, "gradientboosting": BOOSTED, "lightgbm": BOOSTED, "forest": FOREST, "randomforest": FOREST}


def make_regressor(kind: str = BOOSTED, trees: int = 30, depth: int = 0, step: float = 0.1, seed: int = 42):
    """A boosted or random-forest regressor; depth 0 stands for the default of the kind (5 and 15).

    ``GradientBoosting`` and ``LightGBM`` both give boosted trees, ``RandomForest`` the forest.
    """
    if kind.lower() not in _KINDS:
        raise ValueError(f"unknown model: {kind}")
    if _KINDS[kind.lower()] == FOREST:
        return RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth or 15, minInstancesPerNode=3, maxMemoryInMB=512, seed=seed)
    return GBTRegressor(labelCol="label", maxIter=trees, stepSize=step, maxDepth=depth or 5, minInstancesPerNode=5, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=seed)


def with_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """``df`` with the columns as one vector; nulls and NaN count as 0."""
    values = F.transform(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return df.withColumn(out, array_to_vector(values))


@dataclass
class FlatTrees:
    """The trees of an ensemble as arrays, a row of nodes for each: a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray  # of each tree in the mean of logarithms
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x``, all trees a level at a time."""
        x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
        trees, rows = np.arange(len(self.weight)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            low = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(low, self.left[trees, node], self.right[trees, node])
        return np.expm1(self.value[trees, node] @ self.weight)


_LINE = re.compile(r"\s*(?:Tree \d+ \(weight (?P<weight>\S+)\):|If \(feature (?P<feature>\d+) <= (?P<threshold>\S+)\)|Predict: (?P<value>\S+)|Else .*)")


def _trees_of(model) -> tuple[list[tuple[float, list[list[float]]]], int]:
    """Weight and nodes [feature, threshold, left, right, value] of each tree of a Spark ML ensemble, as it describes them, and their depth."""
    lines = [_LINE.fullmatch(x) for x in model.toDebugString.splitlines()[1:] if x.strip()]
    if not all(lines):
        raise ValueError("a description of trees that cannot be read")
    at, found, depth = iter(lines), [], 0

    def read(nodes: list[list[float]], level: int) -> int:
        nonlocal depth
        line, place, depth = next(at), len(nodes), max(depth, level)
        if line["value"] is not None:
            nodes.append([0, np.inf, place, place, float(line["value"])])
            return place
        nodes.append([int(line["feature"]), float(line["threshold"]), 0, 0, 0.0])
        nodes[place][2] = read(nodes, level + 1)
        next(at)  # Else
        nodes[place][3] = read(nodes, level + 1)
        return place

    for line in at:
        found.append((float(line["weight"]), []))
        read(found[-1][1], 0)
    return found, depth


def best_of(model: GBTRegressionModel, tune: DataFrame, patience: int = 100) -> int:
    """How many of a boosted model's trees do best on ``tune(label, features)`` by squared error, before ``patience`` trees bring nothing."""
    errors = model.evaluateEachIteration(tune, "squared")
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def best_iteration(model, tune: DataFrame, target: str, columns: Sequence[str], patience: int = 100) -> int:
    """``best_of`` on rows with the target and the columns of the model."""
    return best_of(model, with_vector(tune.withColumn("label", log_target(F.col(target))), columns), patience)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The boosted model of the first ``n`` trees."""
    context, java = SparkContext._active_spark_context, model._java_obj
    trees, all_trees, all_weights = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), java.trees(), java.treeWeights()
    weights = context._gateway.new_array(context._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = all_trees[i], float(all_weights[i])
    return GBTRegressionModel(context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, weights))


def mean_prediction(columns: Sequence[Column], second: Column | None = None, weights: tuple[float, float] = (1.0, 0.0)) -> Column:
    """The mean of predictions, weighted with a second model's where there is one."""
    mean = sum(columns, F.lit(0.0)) / len(columns)
    return mean if second is None else mean * weights[0] + second * weights[1]


@dataclass
class Ensemble:
    """Models of one target with different seeds; the prediction is the mean, plus a weighted second model where there is one."""

    columns: list[str]
    models: list
    second: RandomForestRegressionModel | None = None
    weights: tuple[float, float] = (1.0, 0.0)
    iterations: list[int] = field(default_factory=list)
    levels: SeriesLevels | None = None

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the column ``out``: the mean of the logarithms, raised back. The levels of its series are added where the models use them."""
        parts = [*self.models, *([self.second] if self.second else [])]
        scored, names = with_vector(self.levels.apply(df) if self.levels else df, self.columns, "__features"), [f"__p{i}" for i in range(len(parts))]
        for name, part in zip(names, parts, strict=True):
            scored = part.copy().setFeaturesCol("__features").setPredictionCol(name).transform(scored)
        mean = mean_prediction([F.col(n) for n in names[: len(self.models)]], F.col(names[-1]) if self.second else None, self.weights)
        return scored.withColumn(out, unlog_target(mean)).drop("__features", *names, *(self.levels.columns if self.levels else ()))

    def flat(self) -> FlatTrees:
        """All trees as arrays, for batches of rows outside of a plan."""
        share = self.weights[0] / len(self.models) if self.second else 1 / len(self.models)
        trees, deepest = [], 0
        for model, part in [*((m, share) for m in self.models), *([(self.second, self.weights[1])] if self.second else [])]:
            found, depth = _trees_of(model)
            mean = len(found) if isinstance(model, RandomForestRegressionModel) else 1
            trees += [(part * w / mean, nodes) for w, nodes in found]
            deepest = max(deepest, depth)
        width = max(len(nodes) for _, nodes in trees)
        table = np.array([nodes + [[0, np.inf, 0, 0, 0.0]] * (width - len(nodes)) for _, nodes in trees])
        feature, left, right = (table[:, :, i].astype(int) for i in (0, 2, 3))
        return FlatTrees(feature, table[:, :, 1], left, right, table[:, :, 4], np.array([w for w, _ in trees]), deepest)

    def save(self, path: str) -> None:
        """Each model in the format of Spark ML, and beside them the columns in their order, weights, iterations and the levels of series."""
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/seed-{i}")
        if self.second:
            self.second.write().overwrite().save(f"{path}/second")
        if self.levels:
            self.levels.save(f"{path}/series")
        about = {"columns": self.columns, "levels": self.levels is not None, "kinds": [type(m).__name__ for m in self.models], "second": self.second is not None, "weights": self.weights, "iterations": self.iterations}
        SparkSession.active().createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str) -> Ensemble:
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
        kinds = {c.__name__: c for c in (GBTRegressionModel, RandomForestRegressionModel)}
        models = [kinds[k].load(f"{path}/seed-{i}") for i, k in enumerate(about["kinds"])]
        second = RandomForestRegressionModel.load(f"{path}/second") if about["second"] else None
        levels = SeriesLevels.load(f"{path}/series") if about.get("levels") else None
        return Ensemble(about["columns"], models, second, tuple(about["weights"]), about["iterations"], levels)


@dataclass
class TrainingRows:
    """One frame of vectors for all fits of a target: ``frame(label, features)``, kept in memory and on disk until ``release``."""

    columns: list[str]
    levels: SeriesLevels | None
    frame: DataFrame

    def release(self) -> None:
        self.frame.unpersist()


#: Bytes of vectors to a partition: each tree is some ten jobs over all partitions, and small ones cost their start.
_PART_BYTES = 8 << 20


def training_rows(train: DataFrame, target: str, columns: Sequence[str], series_cols: Sequence[str] = ()) -> TrainingRows:
    """The vectors of ``train``; with ``series_cols``, the level of a row's series (``fit_levels``) is one of their columns."""
    levels, rows = fit_levels(train, series_cols, [target]) if series_cols else (None, train)
    names = [*columns, *(levels.columns if levels else ())]
    frame = with_vector(rows.withColumn("label", log_target(F.col(target))), names).select("label", "features")
    parts = 1 + train.count() * len(names) * 8 // _PART_BYTES
    return TrainingRows(names, levels, frame.coalesce(int(parts)).persist(StorageLevel.MEMORY_AND_DISK))


def tuning_rows(tune: DataFrame, target: str, like: TrainingRows) -> DataFrame:
    """``(label, features)`` of rows that ``like`` was not made of."""
    rows = like.levels.apply(tune) if like.levels else tune
    return with_vector(rows.withColumn("label", log_target(F.col(target))), like.columns).select("label", "features")


def boost_in_rounds(frame: DataFrame, tune: DataFrame, patience: int, trees: int = 30, depth: int = 0, step: float = 0.1, seed: int = 42) -> tuple[GBTRegressionModel, int]:
    """A boosted model of ``frame(label, features)`` that stops growing once ``patience`` trees in a row brought nothing on ``tune``; and how many were fitted.

    Each round fits one of Spark's regression trees to the slope of the squared error, twice what the trees before left
    over, and adds ``step`` of it (the first tree is taken whole), as ``GBTRegressor`` does. Both frames carry the prediction so
    far as a column, kept from round to round. The model has the trees up to the best.
    """
    maker = RandomForestRegressor(labelCol="__rest", predictionCol="__new", numTrees=1, bootstrap=False, subsamplingRate=0.85, featureSubsetStrategy="0.85", maxDepth=depth or 5, minInstancesPerNode=5)
    both = frame.withColumn("__tune", F.lit(False)).unionByName(tune.withColumn("__tune", F.lit(True))).withColumn("__sum", F.lit(0.0)).persist(StorageLevel.MEMORY_AND_DISK)
    grown, errors, best = [], [], 0
    off = F.when(F.col("__tune"), (F.col("label") - F.col("__sum")) ** 2)
    while len(grown) < trees and len(grown) - best < patience:
        rest = F.col("label") if not grown else 2 * (F.col("label") - F.col("__sum"))
        tree = maker.setSeed(seed + len(grown)).fit(both.where("NOT __tune").withColumn("__rest", rest)).trees[0].copy().setPredictionCol("__new")
        grown.append(tree)
        share = 1.0 if len(grown) == 1 else step
        following = tree.transform(both).withColumn("__sum", F.col("__sum") + F.lit(share) * F.col("__new")).drop("__new").persist(StorageLevel.MEMORY_AND_DISK)
        errors.append(following.agg(F.avg(off)).first()[0])
        both.unpersist()
        both = following
        if errors[-1] < min(errors[:-1], default=float("inf")):
            best = len(grown)
    both.unpersist()
    return _boosted_of(grown[: max(best, 1)], step), len(grown)


def _boosted_of(trees: list, step: float) -> GBTRegressionModel:
    """A boosted model of the given regression trees, the first whole and the others by ``step``."""
    context = SparkContext._active_spark_context
    of, weights = (context._gateway.new_array(k, len(trees)) for k in (context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, context._jvm.double))
    for i, tree in enumerate(trees):
        of[i], weights[i] = tree._java_obj, 1.0 if i == 0 else step
    return GBTRegressionModel(context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"gbtr_{trees[0].uid}", of, weights))


def fit_one(train: DataFrame, target: str, columns: Sequence[str], series_cols: Sequence[str] = (), **options) -> Ensemble:
    """One regressor of the target's logarithm; with ``series_cols`` it knows the level of each series."""
    rows = training_rows(train, target, columns, series_cols)
    try:
        return Ensemble(rows.columns, [make_regressor(**options).fit(rows.frame)], levels=rows.levels)
    finally:
        rows.release()


def _acts(kind: str, patience: int, trees: int) -> bool:
    """Whether patience can end a fit: a model with no more trees than that is fitted at once and cut."""
    return _KINDS[kind.lower()] == BOOSTED and patience < trees


def fit_ensemble(train: DataFrame, target: str, columns: Sequence[str], seeds: int = 3, first_seed: int = 42, forest_weight: float = 0.0, threads: int = 4,
                 valid: DataFrame | None = None, patience: int = 100, series_cols: Sequence[str] = (), **options) -> Ensemble:
    """``seeds`` models fitted side by side over one frame of vectors. On a panel this is one pooled model of all series, which
    tells them apart by their levels where ``series_cols`` are given.

    With ``valid``, boosted models stop early: each keeps the first trees that do best there, and grows no further
    once ``patience`` trees brought nothing.
    """
    rows = training_rows(train, target, columns, series_cols)
    tune = tuning_rows(valid, target, rows) if valid is not None else None
    kind, trees = options.get("kind", BOOSTED), options.get("trees", 30)

    def fit(seed: int) -> tuple[object, int | None]:
        if tune is not None and _acts(kind, patience, trees):
            model, _ = boost_in_rounds(rows.frame, tune, patience, seed=seed, **{k: v for k, v in options.items() if k != "kind"})
            return model, model.getNumTrees
        model = make_regressor(seed=seed, **options).fit(rows.frame)
        if tune is None or not isinstance(model, GBTRegressionModel):
            return model, None
        best = best_of(model, tune, patience)
        return first_trees(model, best), best

    try:
        fitted = side_by_side(fit, range(first_seed, first_seed + seeds), threads)
        second = make_regressor(kind=FOREST, trees=trees, seed=first_seed).fit(rows.frame) if forest_weight else None
    finally:
        rows.release()
    return Ensemble(rows.columns, [m for m, _ in fitted], second, (1.0, forest_weight), [n for _, n in fitted if n], rows.levels)


def refit_ensemble(history: DataFrame, target: str, columns: Sequence[str], seeds: int = 1, first_seed: int = 42, trees: int = 30, threads: int = 4, patience: int = 100, series_cols: Sequence[str] = (), **options) -> Ensemble:
    """Finds each seed's number of trees on the last month of ``history``, then fits all of it with that number.

    A history of one month cannot be divided and is an error.
    """
    last = F.trunc(F.lit(history.agg(F.max("date")).first()[0]), "MM")
    before, month = history.where(F.col("date") < last), history.where(F.col("date") >= last)
    if before.isEmpty():
        raise ValueError("the history has one month only: it cannot be divided into training and tuning")
    early, whole = (training_rows(part, target, columns, series_cols) for part in (before, history))
    tune = tuning_rows(month, target, early)

    def fit(seed: int) -> tuple[object, int]:
        best = trees
        if _acts(options.get("kind", BOOSTED), patience, trees):
            best = boost_in_rounds(early.frame, tune, patience, trees, seed=seed, **{k: v for k, v in options.items() if k != "kind"})[0].getNumTrees
        elif _KINDS[options.get("kind", BOOSTED).lower()] == BOOSTED:
            best = best_of(make_regressor(trees=trees, seed=seed, **options).fit(early.frame), tune, patience)
        return make_regressor(trees=best, seed=seed, **options).fit(whole.frame), best

    try:
        fitted = side_by_side(fit, range(first_seed, first_seed + seeds), threads)
    finally:
        early.release()
        whole.release()
    return Ensemble(whole.columns, [m for m, _ in fitted], iterations=[n for _, n in fitted], levels=whole.levels)


def cv_folds(days: DataFrame, splits: int = 3, date: str = "date") -> DataFrame:
    """Expanding folds over the distinct days: ``(fold, train_from, train_to, valid_from, valid_to, n_train, n_valid)``.

    Each validates on n // (splits + 1) days; the last ends with the last day.
    """
    from pyspark.sql import Window

    n_col = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = days.select(date).distinct().withColumn("k", F.row_number().over(Window.orderBy(date))).withColumn("n", n_col)
    size = F.floor(F.col("n") / (splits + 1))
    each = ranked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("cut", F.col("n") - (splits + 1 - F.col("fold")) * size)
    train, valid = F.col("k") <= F.col("cut"), (F.col("k") > F.col("cut")) & (F.col("k") <= F.col("cut") + size)
    return each.groupBy("fold").agg(
        F.min(F.when(train, F.col(date))).alias("train_from"), F.max(F.when(train, F.col(date))).alias("train_to"),
        F.min(F.when(valid, F.col(date))).alias("valid_from"), F.max(F.when(valid, F.col(date))).alias("valid_to"),
        F.count_if(train).alias("n_train"), F.count_if(valid).alias("n_valid"))


def _mape(target: str, predicted: str) -> Column:
    return F.avg(absolute_percentage_error(F.col(target), F.col(predicted)))


def fold_errors(scored: DataFrame) -> DataFrame:
    """``(fold, purchase_mape, redeem_mape, weighted_mape)`` of predictions ``{t}_pred`` of both targets: one pass gives each fold both."""
    out = scored.groupBy("fold").agg(*(_mape(t, f"{t}_pred").alias(f"{t}_mape") for t in ("purchase", "redeem")))
    return out.withColumn("weighted_mape", weighted(F.col("purchase_mape"), F.col("redeem_mape")))


def cross_validate(train: DataFrame, columns: Sequence[str], splits: int = 3, seed: int = 42, threads: int = 8, series_cols: Sequence[str] = (), **options) -> DataFrame:
    """``(fold, purchase_mape, redeem_mape, weighted_mape)``, one step ahead; the models of all folds are fitted side by side."""
    folds = cv_folds(train, splits).orderBy("fold").collect()

    def fit(job: tuple[int, str]) -> Ensemble:
        f, shift = folds[job[0]], 0 if job[1] == "purchase" else 100
        return fit_one(train.where(F.col("date") <= f.train_to), job[1], columns, series_cols, seed=seed + shift + f.fold, **options)

    jobs = [(i, t) for i in range(len(folds)) for t in ("purchase", "redeem")]
    fitted = dict(zip(jobs, side_by_side(fit, jobs, threads), strict=True))
    parts = []
    for i, f in enumerate(folds):
        scored = train.where(F.col("date").between(f.valid_from, f.valid_to))
        for t in ("purchase", "redeem"):
            scored = fitted[i, t].predict(scored, f"{t}_pred")
        parts.append(scored.select(F.lit(f.fold).cast("int").alias("fold"), "purchase", "purchase_pred", "redeem", "redeem_pred"))
    return fold_errors(reduce(DataFrame.unionByName, parts))


def loss_curve(train: DataFrame, valid: DataFrame, target: str, columns: Sequence[str], kind: str = BOOSTED, trees: int = 30, seed: int = 42, series_cols: Sequence[str] = (), **options) -> DataFrame:
    """``(target, trees, train_mape, valid_mape)`` at a fifth, two fifths … of the trees, five at least.

    A boosted model is fitted once: its prediction after k trees is the weighted sum of the first k.
    """
    points = sorted({max(5, int(trees * r / 5)) for r in range(1, 6)})
    sets = {"train": train, "valid": valid}
    found: dict[str, list[float]] = {}
    if _KINDS[kind.lower()] == BOOSTED:
        whole = fit_one(train, target, columns, series_cols, kind=kind, trees=max(points), seed=seed, **options)
        boosted = whole.models[0]
        for name, df in sets.items():
            scored = with_vector(whole.levels.apply(df) if whole.levels else df, whole.columns)
            for i, tree in enumerate(boosted.trees):
                scored = tree.copy().setPredictionCol(f"__t{i}").transform(scored)
            sums = [unlog_target(sum((F.col(f"__t{i}") * F.lit(boosted.treeWeights[i]) for i in range(min(k, len(boosted.trees)))), F.lit(0.0))) for k in points]
            found[name] = list(scored.agg(*(F.avg(absolute_percentage_error(F.col(target), s)) for s in sums)).first())
    else:
        models = [fit_one(train, target, columns, series_cols, kind=kind, trees=k, seed=seed, **options) for k in points]
        for name, df in sets.items():
            found[name] = [m.predict(df, "p").agg(_mape(target, "p")).first()[0] for m in models]
    rows = [(target, k, float(a), float(b)) for k, a, b in zip(points, found["train"], found["valid"], strict=True)]
    return train.sparkSession.createDataFrame(rows, "target string, trees int, train_mape double, valid_mape double")


def one_step_validation(train: DataFrame, valid: DataFrame, columns: Sequence[str], seed: int = 42, series_cols: Sequence[str] = (), **options) -> DataFrame:
    """Predictions of ``valid`` from its true past, by series, floored at 0, with errors and scores: better than a recursive forecast can be."""
    scored, targets = valid, (("purchase", 0), ("redeem", 100))
    fitted = side_by_side(lambda j: fit_one(train, j[0], columns, series_cols, seed=seed + j[1], **options), targets, 2)
    for (t, _), ensemble in zip(targets, fitted, strict=True):
        scored = ensemble.predict(scored, f"{t}_pred")
    floor = {f"{t}_pred": F.greatest(F.lit(0.0), F.col(f"{t}_pred")) for t in ("purchase", "redeem")}
    return enrich(scored.withColumns(floor).select(*series_cols, "date", F.col("purchase").alias("purchase_true"), "purchase_pred", F.col("redeem").alias("redeem_true"), "redeem_pred"))
