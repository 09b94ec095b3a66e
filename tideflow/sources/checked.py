"""Reading CSV files in one pass that sets aside what cannot be read, with the reason, and counts it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..functions.observed import figures
from .tables import trim_names

_LINE = "__line"
REASONS = ("fields", "encoding", "value")


@dataclass
class CheckedTable:
    """``rows``: what could be read, in the types of the schema; ``rejected``: ``(line, reason, columns)`` of all else; ``counts`` of both."""

    rows: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def _typed(name: str, kind, date_format: str) -> Column:  # noqa: ANN001
    text = F.trim(F.col(f"`{name}`"))
    given = F.when(text != "", text)
    return F.try_to_date(given, date_format) if isinstance(kind, DateType) else given if isinstance(kind, StringType) else given.try_cast(kind)


def read_checked(spark: SparkSession, path: str | list[str], schema: str | StructType, into: str, encoding: str = "utf-8", date_format: str = "yyyyMMdd", separator: str = ",", header: Sequence[str] | None = None) -> CheckedTable:
    """A CSV file with a header (or without one, if ``header`` names its columns) as a table under the folder ``into``, and beside it the lines that are no rows of ``schema``.

    A line is rejected for the first of these reasons: it has more or fewer ``fields`` than the header; a field holds U+FFFD, the
    sign of another ``encoding``; a field that isn't empty is no ``value`` of its column's type (``columns`` names
    those columns). Fields are matched to the schema by the trimmed names of the header; columns that the schema lacks are kept
    as text, columns that the files lack are an error. Empty fields are null.

    The files are read once: one job writes both parts, parted by reason, and counts them on its way.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    options = {"header": header is None, "encoding": encoding, "sep": separator}
    given = header if header is not None else spark.read.options(**options).csv(path).columns  # the first line alone is read for them
    names = [c.strip().removeprefix("﻿") for c in given]
    if missing := [f.name for f in wanted if f.name not in names]:
        raise ValueError(f"{path} lacks the columns: {', '.join(missing)}")
    text = StructType([StructField(n, StringType()) for n in [*names, _LINE]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, enforceSchema=True).schema(text).csv(path)
    raw = trim_names(raw)
    kinds = {f.name: f.dataType for f in wanted}
    typed = {n: _typed(n, kinds.get(n, StringType()), date_format) for n in names}
    wrong = {n: (F.trim(F.col(f"`{n}`")) != "") & typed[n].isNull() for n in names if not isinstance(kinds.get(n, StringType()), StringType)}
    bad = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in wrong.items()))) if wrong else F.array().cast("array<string>")
    garbled = F.array_compact(F.array(*(F.when(F.contains(F.col(f"`{n}`"), F.lit("�")), F.lit(n)) for n in names)))
    reason = F.when(F.col(_LINE).isNotNull(), "fields").when(F.size(garbled) > 0, "encoding").when(F.size(bad) > 0, "value").otherwise("none")
    columns = F.when(F.col(_LINE).isNotNull(), F.array().cast("array<string>")).when(F.size(garbled) > 0, garbled).otherwise(bad)
    line = F.coalesce(F.col(_LINE), F.array_join(F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)), separator))
    marked = raw.withColumns({"__reason": reason, "__columns": columns, "__whole": line})
    fine = F.col("__reason") == "none"
    both = marked.select("__reason", F.when(~fine, F.col("__whole")).alias("__rejected"), F.when(~fine, F.col("__columns")).alias("__columns"), *(F.when(fine, c).alias(n) for n, c in typed.items()))
    seen = Observation()
    counted = both.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(fine).alias("rows"), *(F.count_if(F.col("__reason") == r).alias(r) for r in REASONS))
    counted.write.partitionBy("__reason").mode("overwrite").parquet(into)
    found = spark.read.schema(both.schema).parquet(into)
    return CheckedTable(found.where(F.col("__reason") == "none").select(*(F.col(f"`{n}`") for n in names)),
                        found.where(F.col("__reason") != "none").select(F.col("__rejected").alias("line"), F.col("__reason").alias("reason"), F.col("__columns").alias("columns")), figures(seen) or dict.fromkeys(("read", "rows", *REASONS), 0))
