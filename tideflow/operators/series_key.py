"""The key of a series as an input of models: one pooled model of many series can tell them apart by their levels.

A key of thousands of values is no category that trees could split on. It becomes a number for each target: the
mean of the target's logarithm in that series, drawn towards the mean of all series by a prior weight. Training rows
get means from which their own fold of days is left out, so that no row sees its own target; rows to be predicted get
those of all training rows. Null is a key like any other, a key without training rows has the mean of all.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_null_safe
from ..functions.lineage import cut_lineage
from ..functions.scores import log_target

PRIOR, FOLDS = 20.0, 5


def level_column(target: str) -> str:
    return f"{target}_series_level"


@dataclass
class SeriesLevels:
    """``table``: a row for each series of the training rows, with the level of each target; ``overall``: the means of all."""

    series_cols: list[str]
    table: DataFrame
    overall: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.overall)

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the levels of their series, in place of what goes by these names."""
        joined = join_null_safe(rows.drop(*self.columns), self.table, self.series_cols)
        return joined.fillna(self.overall)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/levels")
        about = json.dumps({"series_cols": self.series_cols, "overall": self.overall})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str) -> SeriesLevels:
        spark = SparkSession.active()
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return SeriesLevels(about["series_cols"], spark.read.parquet(f"{path}/levels"), about["overall"])


def _fold(date: str, folds: int) -> Column:
    """Whole months go into a fold together: days of one month are alike."""
    return F.pmod(F.hash(F.trunc(date, "MM")), F.lit(folds))


def fit_levels(train: DataFrame, series_cols: Sequence[str], targets: Sequence[str], prior: float = PRIOR, folds: int = FOLDS, date: str = "date") -> tuple[SeriesLevels, DataFrame]:
    """The levels of all series of ``train``, and ``train`` with those of its rows, each without its own fold.

    Sums and counts by series and fold are combined before they are shuffled; all else is over them. Null targets don't count.
    """
    keys = list(series_cols)
    parts = train.groupBy(*keys, _fold(date, folds).alias("__fold")).agg(
        *(a for t in targets for a in (F.sum(log_target(F.col(t))).alias(f"__s_{t}"), F.count(t).cast("double").alias(f"__n_{t}"))))
    parts = cut_lineage(parts)
    sums = {f"__{k}_{t}": F.sum(f"__{k}_{t}").alias(f"__{k}_{t}") for t in targets for k in "sn"}
    got = parts.agg(*sums.values()).first()
    overall = {level_column(t): (got[f"__s_{t}"] or 0.0) / got[f"__n_{t}"] if got[f"__n_{t}"] else 0.0 for t in targets}

    def level(t: str, s: Column, n: Column) -> Column:
        return ((F.coalesce(s, F.lit(0.0)) + F.lit(prior * overall[level_column(t)])) / (F.coalesce(n, F.lit(0.0)) + F.lit(prior))).alias(level_column(t))

    whole = parts.groupBy(*keys).agg(*sums.values())
    table = cut_lineage(whole.select(*keys, *(level(t, F.col(f"__s_{t}"), F.col(f"__n_{t}")) for t in targets)))
    renamed = whole.withColumnsRenamed({c: f"__all{c}" for c in sums})
    without = join_null_safe(parts, renamed, keys) if keys else parts.crossJoin(F.broadcast(renamed))  # one row on the right
    rest = {t: [F.col(f"__all__{k}_{t}") - F.coalesce(F.col(f"__{k}_{t}"), F.lit(0.0)) for k in "sn"] for t in targets}
    left_out = without.select(*keys, "__fold", *(level(t, *rest[t]) for t in targets))
    numbered = train.drop(*overall).withColumn("__fold", _fold(date, folds))
    return SeriesLevels(keys, table, overall), join_null_safe(numbered, left_out, [*keys, "__fold"]).drop("__fold")
