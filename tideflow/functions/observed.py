"""Figures gathered while a job runs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation


def figures(seen: Observation) -> dict | None:
    """What was gathered; None where Spark found its input to be empty and left the gathering out of the plan."""
    try:
        return dict(seen.get)
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return None
