"""URL rules by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot: a host and its subdomains are one interval of these keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bounds(keys: DataFrame, n_ranges: int, per_range: int) -> list[str]:
    """Keys that cut the sorted ``keys(sort_key)`` into about equal ranges, from a sample of ``per_range`` keys for each.

    A key may come several times: its rows are then dealt out over the ranges between.
    """
    total = keys.count()
    share = min(1.0, n_ranges * per_range / max(total, 1))
    found = sorted(r[0] for r in (keys if share == 1.0 else keys.sample(share, 9)).limit(2 * n_ranges * per_range).collect())
    return [found[i * len(found) // n_ranges] for i in range(1, n_ranges)] if found else []


def _seats(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` ranges that Spark's hash sends to a partition of its own among ``n``."""
    found: dict[int, int] = {}
    while len(found) < n:
        tried = spark.range(len(found) * 16, (len(found) + n) * 32).select(F.col("id").cast("int").alias("id"))
        found |= {r.at: r.id for r in tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()}
    return [found[i] for i in range(n)]


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None, per_range: int = 20) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every page; ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains if the url's path starts with its path. The longest
    (host and path together) wins; of equal length the one with the longer host; of one host and path
    with both verdicts, block. ``rule`` is its host and path, null where none fits; the verdict is
    ``default`` then. Urls that are null or have no ``://`` have an empty host and path. Rules with a
    null in a column are no rules; a rule with an empty host fits every url by its path. Ids may be
    null or repeat: every row gets its verdict. Empty tables of pages or rules are no special case, other
    columns are ignored, and a url may be of any length.

    Urls and rules are sorted by reversed host, in ranges cut by a bounded sample of the urls. A rule's
    host is an interval of the order, and goes to each range that it meets. The sweep over a range
    keeps a stack of the hosts that are open, from the outermost in, each with its rules by path.
    Urls with one key, however many, are dealt out over the ranges that it spans, each range is a task of its own.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host"))).withColumn("sort_key", F.concat("key", "path"))
    bounds = _bounds(urls.select("sort_key"), ranges, per_range)
    seats = _seats(spark, len(bounds) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spin = count(TaskContext.get().partitionId())  # a running number, so that repeated rows are dealt out too
        for batch in batches:
            dealt = []
            for key in batch.column(4).to_pylist():
                lo, hi = bisect_left(bounds, key), bisect_right(bounds, key)
                dealt.append(seats[lo + next(spin) % (hi - lo + 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(dealt, pa.int32())], ["id", "host", "path", "key", "part"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # What begins with a key, which ends with a dot, is below the key with the next character in place of the dot.
            met = [seats[bisect_left(bounds, k) : bisect_left(bounds, k[:-1] + "/") + 1] if k else seats for k in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, pa.list_(pa.int32()))], ["host", "path", "verdict", "key", "parts"])

    dealt = urls.mapInArrow(deal, f"id {kind}, host string, path string, key string, part int").withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")})
    ruled = rules.select("host", "path", "verdict").dropna().withColumn("host", F.translate("host", _UPPER, _LOWER)).withColumn("key", reversed_host(F.col("host")))
    sown = ruled.mapInArrow(spread, "host string, path string, verdict string, key string, parts array<int>").withColumn("part", F.explode("parts"))
    sown = sown.select(F.lit(None).cast(kind).alias("id"), "host", "path", "key", "part", F.lit(0).alias("kind"), "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # of (key, host, paths, lengths of paths)
        for batch in batches:
            out = []
            for at, host, path, key, is_url, verdict in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    _, _, paths, lengths = stack[-1]
                    paths[path] = "block" if paths.get(path, verdict) != verdict else verdict
                    lengths.add(len(path))
                    continue
                best = None
                for _, of, paths, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (found := paths.get(path[:n])) is not None:
                            best = max(best or (-1, -1, "", ""), (len(of) + n, len(of), of + path[:n], found))
                out.append((host, path, best[2] if best else None, best[3] if best else default))
            urls_only = batch.filter(pa.compute.equal(batch.column(5), 1)).column(0)
            yield pa.RecordBatch.from_arrays([urls_only, *(pa.array([r[i] for r in out], pa.string()) for i in range(4))], ["id", "host", "path", "rule", "verdict"])

    order = ["id", "part", "host", "path", "key", "kind", "verdict"]
    lines = dealt.select(*order).unionByName(sown.select(*order)).repartition(len(seats), "part").sortWithinPartitions("part", "key", "kind", "path")
    return lines.mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


#: DuckDB, with the rules of the registered query.
ORACLE_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS k
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.k = 1
"""
