"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact cosines for the candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


class PStableHashes:
    """``tables`` keys of ``projections`` cells each: floor((a.x + b) / width) with normal a, for unit vectors x."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, projections, dim))
        self.b = rng.uniform(0, width, (tables, projections))
        self.width = width
        self.weights = rng.integers(1, 2**62, projections, dtype=np.int64) * 2 + 1
        #: All ways of moving up to one cell along each projection.
        self.moves = np.array(list(product((-1, 0, 1), repeat=projections)), np.int64)

    def _places(self, unit: np.ndarray) -> np.ndarray:
        return (np.einsum("tmd,nd->ntm", self.a, unit) + self.b) / self.width

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables): the bucket of each vector."""
        with np.errstate(over="ignore"):
            return (np.floor(self._places(unit)).astype(np.int64) * self.weights).sum(-1)

    def probes(self, unit: np.ndarray, n_probes: int) -> np.ndarray:
        """(n, tables, n_probes): buckets by falling chance of holding a near vector.

        That is, by rising sum of squared distances to the cell borders that a move crosses.
        """
        places = self._places(unit)
        cells = np.floor(places).astype(np.int64)
        below = places - cells
        out = np.empty((*cells.shape[:2], min(n_probes, len(self.moves))), np.int64)
        up, down = (self.moves == 1).T.astype(float), (self.moves == -1).T.astype(float)
        with np.errstate(over="ignore"):
            shifts = (self.moves * self.weights).sum(1)
            home = (cells * self.weights).sum(-1)
            for i in range(len(unit)):
                cost = below[i] ** 2 @ down + (1 - below[i]) ** 2 @ up
                order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
                out[i] = home[i][:, None] + shifts[order]
        return out


@lru_cache(maxsize=8)
def _hashes(dim: int, tables: int, projections: int, width: float, seed: int) -> PStableHashes:
    return PStableHashes(dim, tables, projections, width, seed)


def _by_size(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each size apart: their rows, and a matrix of doubles."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = np.concatenate([np.zeros(0, np.int64), *(p.value_lengths().to_numpy(zero_copy_only=False) for p in parts)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0), *(p.flatten().to_numpy(zero_copy_only=False) for p in parts)])
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[begins[rows][:, None] + np.arange(dim)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component below 1: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(q: np.ndarray, x: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The cosine of each pair ``q[at], x[of]``."""
    q_norm, x_norm, out = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)), np.empty(len(at))
    for lo in range(0, len(at), 1 << 15):
        i, j = at[lo : lo + (1 << 15)], of[lo : lo + (1 << 15)]
        out[lo : lo + len(i)] = (q[i] * x[j]).sum(1) / (q_norm[i] * x_norm[j])
    return out


def _nearest(entries: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """``(query, uid, score)``: of a block's entries the k best in the buckets that each query asks for, ties to the smaller uid."""
    query, keys = asked["query"].to_numpy(), asked["keys"]
    entries = entries.sort_by("key")  # a bucket is a range of rows
    uid, kinds, begins = entries["uid"].to_numpy(), *np.unique(entries["key"].to_numpy(), return_index=True)
    of_size, out = dict((x.shape[1], (rows, _scaled(x))) for rows, x in _by_size(entries["v"])), []
    for asking, q in _by_size(asked["qv"]):
        if q.shape[1] not in of_size:
            continue
        rows, x = of_size[q.shape[1]]
        q, x_unit = _scaled(q), _unit(x)
        ends = [*np.searchsorted(rows, begins), len(rows)]
        for lo in range(0, len(asking), 512):
            part, these = q[lo : lo + 512], asking[lo : lo + 512]
            open_ = np.zeros((len(part), len(kinds)), bool)
            for i, wanted in enumerate(keys.take(pa.array(these)).to_pylist()):
                open_[i] = True if wanted is None else np.isin(kinds, wanted)
            unit, rough = _unit(part), np.full((len(part), len(rows)), -np.inf)
            for b in np.flatnonzero(open_.any(0)):
                asks, inside = np.flatnonzero(open_[:, b]), slice(ends[b], ends[b + 1])
                rough[asks, inside] = unit[asks] @ x_unit[inside].T
            m = min(k, len(rows))
            # The product rounds otherwise than the score: whatever may be among the m best by the score is kept, ties too.
            cut = np.partition(rough, len(rows) - m, axis=1)[:, len(rows) - m]
            i, j = np.nonzero((rough >= cut[:, None] - 1e-9) & np.isfinite(rough))
            score, of = _cosines(part, x, i, j), uid[rows[j]]
            order = np.lexsort((of, -score, i))
            place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            best = order[place < k]
            out.append((query[these[i[best]]], of[best], score[best]))
    cat = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
    return pa.table({"query": pa.array(cat[0].astype(np.int64)), "uid": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(float))})


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _ranked(found: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``(query, best)``: the n best ids of ``found(query, uid, score)``, by falling score and rising id."""
    # The n best vectors hold the n best ids: each has an id that goes before those of the rest.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "uid")
    vectors = found.dropDuplicates(["query", "uid"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= n)
    each = vectors.join(members, "uid").select("query", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, projections: int = 6,
           width: float = 1.6, probes: int = 80, seed: int = 6, block_rows: int = 8192, block_queries: int = 20_000) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; nearness is the cosine in double precision, ties go to
    the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id. Vectors are compared with those of their size only. Rows that share
    an id count once, with the least of their vectors. Other columns are ignored, very large and very
    small components are no special case, and an empty table gives no rows.

    Equal vectors share one entry of the index with their k + 1 smallest ids, which is all that k results
    can need, and are one query. Each query visits the ``probes`` likeliest buckets of each of ``tables``
    tables (``projections`` is at most 8: a move to either side of each is weighed). Buckets are dealt to
    blocks of about ``block_rows`` entries, a larger bucket to several; a block's task takes the cosines of
    the entries in its queries' buckets. Only a block that over ``block_queries`` queries visit is copied,
    once for each ``block_queries`` of them, so the rows shuffled grow with entries and visits alone. A
    query that finds fewer than k is compared with all entries, in blocks.
    """
    if projections > 8:
        raise ValueError("at most 8 projections")
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL").where(_usable(F.col("v")))
    kind = rows.schema["v"].dataType.simpleString()
    rows = materialise(rows.groupBy("id").agg(F.min("v").alias("v")))
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = materialise(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("uid", F.element_at("ids", 1)))
    members = entries.select("uid", "ids")
    queries = materialise(rows.where(F.col("id") % every == 0).join(entries.select("uid", "v"), "v").select(F.col("id").alias("query_id"), "uid"))
    targets = materialise(entries.select("uid", "v").join(queries.select("uid").distinct(), "uid").select(F.col("uid").alias("query"), F.col("v").alias("qv")))
    n_entries = entries.count()
    n_blocks = max(1, -(-n_entries // block_rows))
    setting, per_table = (tables, projections, width, seed), min(probes, 3**projections)

    def keyed(batches: Iterator[pa.RecordBatch], names: list[str], n: int, keys_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, n), np.int64)
            for at, x in _by_size(batch.column(1)):
                keys[at] = keys_of(_unit(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keyed(batches, ["uid", "v", "keys"], tables, lambda x: _hashes(x.shape[1], *setting).keys(x))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keyed(batches, ["query", "qv", "keys"], tables * per_table, lambda x: _hashes(x.shape[1], *setting).probes(x, probes).reshape(len(x), -1))

    index = materialise(entries.select("uid", "v").mapInArrow(bucketed, f"uid bigint, v {kind}, keys array<bigint>"))
    index = index.select("uid", "v", F.posexplode("keys").alias("t", "key"))
    large = materialise(index.groupBy("t", "key").count().where(F.col("count") > block_rows).select("t", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("splits")))
    splits = F.coalesce("splits", F.lit(1))
    block = F.pmod(F.xxhash64("t", "key", "split"), F.lit(n_blocks)).cast("int")
    asked = targets.mapInArrow(probed, f"query bigint, qv {kind}, keys array<bigint>").select("query", F.posexplode("keys").alias("at", "key"))
    asked = asked.withColumn("t", F.floor(F.col("at") / per_table).cast("int")).join(large, ["t", "key"], "left")
    asked = asked.withColumn("split", F.explode(F.sequence(F.lit(0), splits - 1))).withColumn("block", block)
    asked = materialise(asked.groupBy("query", "t", "block").agg(F.collect_set("key").alias("keys")))
    busy = materialise(asked.groupBy("t", "block").count().where(F.col("count") > block_queries).select("t", "block", F.ceil(F.col("count") / block_queries).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = index.join(large, ["t", "key"], "left").withColumn("split", F.pmod(F.xxhash64("uid"), splits).cast("int")).withColumn("block", block)
    dealt = dealt.join(busy, ["t", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("t", "block", "part", "key", "uid", "v")
    asked = asked.join(busy, ["t", "block"], "left").withColumn("part", F.pmod(F.xxhash64("query"), parts).cast("int")).join(targets, "query").select("t", "block", "part", "query", "qv", "keys")

    def compared(asked: DataFrame, dealt: DataFrame) -> DataFrame:
        where = ("t", "block", "part")
        return asked.groupBy(*where).cogroup(dealt.groupBy(*where)).applyInArrow(lambda a, e: _nearest(e, a, k + 1), "query bigint, uid bigint, score double")

    ranked = materialise(_ranked(compared(asked, dealt), members, k + 1))
    # Of a query's own vector all ids are listed, or k + 1 of them: with k + 1 ids, k are left without its own.
    short = materialise(targets.join(ranked.where(F.size("best") > k), "query", "left_anti"))
    n_short = short.count()
    if n_short:
        n_parts = max(1, -(-n_short // block_queries))
        cut = F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int").alias("block")
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
        all_entries = entries.select(F.lit(0).alias("t"), cut, F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).cast("bigint").alias("key"), "uid", "v")
        all_short = short.select(F.lit(0).alias("t"), everywhere, F.pmod(F.xxhash64("query"), F.lit(n_parts)).cast("int").alias("part"), "query", "qv", F.lit(None).cast("array<bigint>").alias("keys"))
        ranked = ranked.join(short, "query", "left_anti").unionByName(_ranked(compared(all_short, all_entries), members, k + 1))
    results = queries.join(ranked.withColumnRenamed("query", "uid"), "uid").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return results.select("query_id", F.posexplode("best").alias("at", "near")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")
