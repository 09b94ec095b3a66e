"""Joins in which null is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the further columns of ``right``, of which it must have none itself."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(other, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), how)
    return joined.drop(*(f"__{k}" for k in keys))
