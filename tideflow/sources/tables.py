"""Reading ledgers, profiles and rate tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

LEDGER = "report_date STRING, user_id BIGINT, tBalance BIGINT, yBalance BIGINT, total_purchase_amt BIGINT, total_redeem_amt BIGINT"
PROFILE = "user_id BIGINT, sex STRING, city STRING, constellation STRING"
YIELD = "mfd_date STRING, mfd_daily_yield DOUBLE, mfd_7daily_yield DOUBLE"
INTERBANK = "mfd_date STRING, Interest_O_N DOUBLE, Interest_1_W DOUBLE, Interest_2_W DOUBLE, Interest_1_M DOUBLE, Interest_3_M DOUBLE, Interest_6_M DOUBLE, Interest_9_M DOUBLE, Interest_1_Y DOUBLE"

#: Table name: keyword in the file name, and schema.
TABLES = {"ledger": ("user_balance", LEDGER), "profile": ("user_profile", PROFILE), "daily_yield": ("day_share_interest", YIELD), "interbank": ("shibor", INTERBANK)}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, encoding: str = "utf-8", check: bool = True) -> DataFrame:
    """A CSV file with a header, in a stated encoding; a byte order mark is dropped and column names are trimmed.

    Fields are matched to ``schema`` by their names, and columns that the schema lacks are kept as
    text. With ``check``, a field that holds U+FFFD, the sign of a wrong encoding, is an error when it is
    read; the file is read once. ``gbk`` and ``gb18030`` need a session with ``spark.sql.legacy.javaCharsets``.
    """
    raw = trim_names(spark.read.csv(path, header=True, encoding=encoding))
    if check:
        wrong = F.raise_error(F.lit(f"{path} is not {encoding}")).cast("string")
        raw = raw.select(*(F.when(F.contains(F.col(f"`{c}`"), F.lit("�")), wrong).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    if schema is None:
        return raw
    wanted = {f.name: f.dataType for f in (schema if isinstance(schema, StructType) else StructType.fromDDL(schema))}
    return raw.select(*(F.col(f"`{c}`").try_cast(wanted[c]).alias(c) if c in wanted and not isinstance(wanted[c], StringType) else F.col(f"`{c}`") for c in raw.columns))


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().removeprefix("﻿") for c in df.columns))


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"{table} lacks the columns: {', '.join(missing)}")
    return df


def find_files(spark: SparkSession, folder: str, keyword: str) -> list[str]:
    """All .csv files of ``folder`` with ``keyword`` in their names, in any case; .txt files if there are none.

    All parts are one table. An error lists what the folder has.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = sorted(str(s.getPath().toString()) for s in system.listStatus(where)) if system.exists(where) else []
    for ending in (".csv", ".txt"):
        if found := [p for p in there if p.lower().endswith(ending) and keyword.lower() in p.rsplit("/", 1)[-1].lower()]:
            return found
    raise FileNotFoundError(f"no .csv or .txt file with {keyword!r} in {folder}; it has: {', '.join(re.sub('.*/', '', p) for p in there) or 'nothing'}")


def load_tables(spark: SparkSession, folder: str, encoding: str = "utf-8") -> dict[str, DataFrame]:
    """The four tables of a folder of CSV files."""
    return {name: read_csv(spark, find_files(spark, folder, keyword), schema, encoding) for name, (keyword, schema) in TABLES.items()}


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where the path does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table; an error says how to make it where it is missing."""
    found = read_if_exists(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} does not exist; write the daily features first")
    return found
