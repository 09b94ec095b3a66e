"""Helpers that the text operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that are held as Python objects at a time.
SLICE_ROWS = 512


#: The folder that new tables go to, where ``scratch`` has set one.
_within: ContextVar[str | None] = ContextVar("_within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or under the warehouse if that is unset.

    On a cluster the warehouse must not be on local disks then, which would be different folders on each machine.
    """
    root = _within.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = qualified(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_shared")
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/tideflow-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark takes it to have."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables made inside, deleted at the end: for work whose result is written elsewhere by then."""
    folder = shared_dir(spark)
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        drop_path(spark, folder)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation of Python stages.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in slices of ``SLICE_ROWS`` rows; ``fn`` returns the columns of the output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(lo, SLICE_ROWS))
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``, as ``(node, label)`` with the smallest node as label.

    Alternating large-star and small-star rounds: each joins every edge with the smallest
    neighbour of one end, so a hub costs one row for each of its edges, never a pair of them.
    Nodes without an edge to another node have no row. Each round is written to the shared folder, and
    the one before is deleted. The rounds needed grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    path = shared_dir(spark)
    edges = materialise(edges.where("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), path)
    if edges.isEmpty():
        return edges.selectExpr("a AS node", "b AS label")
    while True:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = low.selectExpr("a", "m AS b")
        moved = large.join(low, "a").where("b != m").selectExpr("b AS a", "m AS b")
        former, path = path, shared_dir(spark)
        small = materialise(kept.unionByName(moved).where("a != b").distinct(), path)
        drop_path(spark, former)
        # A forest of stars: every node has one smaller neighbour, and no centre is itself attached.
        chained = small.join(small.selectExpr("a AS b").distinct(), "b", "left_semi")
        doubled = small.groupBy("a").count().where("count > 1")
        edges = small
        if chained.isEmpty() and doubled.isEmpty():
            return edges.selectExpr("a AS node", "b AS label").unionByName(edges.selectExpr("b AS node", "b AS label").distinct())


def release(spark: SparkSession) -> None:
    """Have the driver's garbage collected: Spark deletes the shuffle files of finished phases only once nothing refers to them.

    Results do not depend on it; without it the files stay until the driver happens to collect.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def identity(id_: Column, text: Column, *more: Column) -> tuple[Column, Column]:
    """``row`` and ``mark``, 79 bits of hash of a row's id and whole text: rows that differ in one of them are told apart.

    A null text counts as an empty one.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(id_, whole, *more), F.hash(whole, id_, *more).bitwiseAND(F.lit(0x7FFF)).cast("bigint")


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, for rows that are equal then; all others go before they are shuffled, but for one a task."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).where("__k = 1").drop("__k")


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, nth: str, how: str = "inner") -> DataFrame:
    """``many.join(one, keys, how)``, where a key may hold any share of ``many`` and has one row in ``one``.

    ``sizes(keys, n)`` counts the rows of each key. Keys with over a thousandth of all rows, of which there
    are less than a thousand, are dealt out by ``nth``, a number of the rows of ``many``.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Under 1,000 rows, whatever the size of the tables.
    heavy = F.broadcast(sizes.where(F.col("n") * 1000 > total).select(*keys, F.ceil(F.col("n") * 1000 / max(total, 1)).cast("int").alias("__pieces")))
    pieces = F.coalesce("__pieces", F.lit(1))
    left = many.join(heavy, keys, "left").withColumn("__piece", F.pmod(F.col(nth), pieces).cast("int")).drop("__pieces")
    right = one.join(heavy, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return left.join(right, [*keys, "__piece"], how).drop("__piece")


def fold_of(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text (empty for null), modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out_fold: int, max_rows: int) -> DataFrame:
    """``(label, text)`` of at most ``max_rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    An id with several labels has the least of them, one with several texts the least of those.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.where(fold_of("id", folds) != held_out_fold)
    total = known.count()
    # A little under the bound, so that the limit, which may take any rows, does not bite.
    share = 1.0 if total <= max_rows else 0.95 * max_rows / total
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 50)) < int(share * (1 << 50))).groupBy("id").agg(F.min("label").alias("label")).limit(max_rows)
    # At most max_rows rows of two numbers.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")
