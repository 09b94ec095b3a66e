"""Errors and scores of forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURCHASE_WEIGHT, REDEEM_WEIGHT, ZERO_AT = 0.45, 0.55, 0.3


def relative_error(true: Column, predicted: Column) -> Column:
    """Absolute difference over the signed truth, which counts as 1 where it is 0."""
    return F.abs(predicted - true) / F.when(true == 0, F.lit(1.0)).otherwise(true.cast("double"))


def linear_score(error: Column, zero_at: float = ZERO_AT) -> Column:
    """10 at no error, falling to 0 at ``zero_at``; null for a null error."""
    return F.when(error.isNotNull(), F.greatest(F.lit(0.0), F.lit(10.0) * (1 - error / F.lit(zero_at))))


def weighted(purchase: Column, redeem: Column) -> Column:
    return purchase * F.lit(PURCHASE_WEIGHT) + redeem * F.lit(REDEEM_WEIGHT)


def absolute_percentage_error(true: Column, predicted: Column) -> Column:
    """With the absolute truth, at least the machine epsilon, below."""
    return F.abs(predicted - true) / F.greatest(F.abs(true.cast("double")), F.lit(2.220446049250313e-16))


def log_target(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def unlog_target(c: Column) -> Column:
    return F.expm1(c)


def direction(true: Column, predicted: Column) -> Column:
    """``over`` above the truth, else ``under``."""
    return F.when(predicted > true, "over").otherwise("under")
