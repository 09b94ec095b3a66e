"""Scoring forecasts against truths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.calendar import anomaly_class
from ..functions.joins import join_null_safe


def align(predictions: DataFrame, actuals: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Predictions with the truths of their day; days without one of both go. Null is a series like any other."""
    truths = actuals.select(*series_cols, "date", F.col("purchase").alias("purchase_true"), F.col("redeem").alias("redeem_true"))
    return join_null_safe(predictions, truths, [*series_cols, "date"], "inner")


def with_errors(forecast: DataFrame) -> DataFrame:
    """Adds relative errors and scores of both targets."""
    out = forecast.withColumns({f"{t}_error": scores.relative_error(F.col(f"{t}_true"), F.col(f"{t}_pred")) for t in ("purchase", "redeem")})
    return out.withColumns({f"{t}_score": scores.linear_score(F.col(f"{t}_error")) for t in ("purchase", "redeem")})


def _metrics() -> list[Column]:
    mean = {f"{t}_{n}": F.avg(f"{t}_{n if n == 'score' else 'error'}") for n in ("mape", "score") for t in ("purchase", "redeem")}
    total = scores.weighted(mean["purchase_score"], mean["redeem_score"])
    return [*(c.alias(n) for n, c in mean.items()), total.alias("total_score")]


def metrics(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean relative errors, mean scores and the weighted total."""
    return with_errors(forecast).groupBy(*by).agg(*_metrics())


def mae_mape(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute errors, and mean absolute errors as a share of the absolute truth."""
    def mean(t: str, f) -> Column:  # noqa: ANN001
        return F.avg(f(F.col(f"{t}_true"), F.col(f"{t}_pred")))

    return forecast.groupBy(*by).agg(*(mean(t, f).alias(f"{t}_{n}") for n, f in (("mae", lambda y, p: F.abs(y - p)), ("mape", scores.absolute_percentage_error)) for t in ("purchase", "redeem")))


def backtest_metrics(predictions: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Metrics of each fold and strategy, and of all days of a strategy under the fold ``overall``, with days over the zero of the score."""
    scored = with_errors(predictions)
    keys = [*series_cols, "strategy"]
    zero = [F.count_if(F.col(f"{t}_error") > scores.ZERO_AT).alias(f"{t}_zero_score_days") for t in ("purchase", "redeem")]
    sets = [[F.col(c) for c in ("fold", *keys)], [F.col(c) for c in keys]]
    return scored.groupingSets(sets, "fold", *keys).agg(*_metrics(), *zero).withColumn("fold", F.coalesce("fold", F.lit("overall")))


def enrich(forecast: DataFrame) -> DataFrame:
    """Adds absolute and relative errors, scores, the day's weighted score, over or under, the zero-score flag and the anomaly class."""
    out = with_errors(forecast)
    pairs = [(t, F.col(f"{t}_true"), F.col(f"{t}_pred")) for t in ("purchase", "redeem")]
    return out.withColumns({f"{t}_abs_error": F.abs(p - y) for t, y, p in pairs} | {f"{t}_direction": scores.direction(y, p) for t, y, p in pairs}
                           | {"daily_weighted_score": scores.weighted(F.col("purchase_score"), F.col("redeem_score")),
                              "is_zero_score_day": (F.col("purchase_error") > scores.ZERO_AT) | (F.col("redeem_error") > scores.ZERO_AT),
                              "anomaly": anomaly_class(F.col("date"))})


def zero_score_days(forecast: DataFrame) -> DataFrame:
    """The days on which an error is over the zero of the score."""
    return enrich(forecast).where("is_zero_score_day")
