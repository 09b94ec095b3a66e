"""Cutting long lineages by tables in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the tables that ``scratch`` deletes at its end.
_within: ContextVar[str | None] = ContextVar("_lineage_within", default=None)


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir") + "/_lineage")
        root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def new_path(spark: SparkSession, keep: bool = False) -> str:
    """A path in the shared folder that is not taken; as in ``cut_lineage``, within the scratch at hand unless it is to be kept."""
    folder = _within.get()
    return f"{(folder.rsplit('/', 1)[0] if keep and folder else folder) or _root(spark)}/cut-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to and read from ``spark.checkpoint.dir``, or a folder of the warehouse where that is unset.

    Inside ``scratch`` the table goes with the other tables of the work; one to be kept stays beyond it, in the scratch around it if there is one.
    """
    spark = df.sparkSession
    path = new_path(spark, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables cut inside, deleted at the end: for work whose result is written or gathered by then."""
    folder = f"{_within.get() or _root(spark)}/scratch-{uuid.uuid4().hex}"
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
