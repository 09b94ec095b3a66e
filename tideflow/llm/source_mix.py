"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone."""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise


def _period(weights: list[int], most: int) -> list[list[int]]:
    """For each class the slots of one period, or its first ``most``, by earliest deadline first among the released.

    Block i (from 0) of a class with weight w of W is released at floor(i W / w) and due by
    ceil((i + 1) W / w). One slot takes one block and the weights add up to W, so every block is
    in time: at no slot is a class a whole block off its share. Ties go to the earlier class.
    """
    total, slots = sum(weights), [[] for _ in weights]
    waiting, ready = [(0, c) for c in range(len(weights))], []  # by release, by deadline
    for t in range(min(total, most)):
        while waiting and waiting[0][0] <= t:
            _, c = heappop(waiting)
            heappush(ready, (-(-(len(slots[c]) + 1) * total // weights[c]), c))
        _, c = heappop(ready)
        slots[c].append(t)
        if len(slots[c]) < weights[c]:
            heappush(waiting, (len(slots[c]) * total // weights[c], c))
    return slots


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """Phases of the mix of ``blocks[c]`` blocks of each class: (class, first block, end block, base slot, weight, period, slots).

    A phase ends where a class has no block left; the others go on with their weights in a new phase.
    The work is one period for each phase, and there are no more phases than classes. Weights count
    without their common divisor, and a period ends with the blocks there are.
    """
    done, base, rows = [0] * len(blocks), 0, []
    while live := [c for c, n in enumerate(blocks) if done[c] < n]:
        common = gcd(*(weights[c] for c in live))
        weight, left = {c: weights[c] // common for c in live}, {c: blocks[c] - done[c] for c in live}
        period = sum(weight.values())
        slots = dict(zip(live, _period([weight[c] for c in live], sum(left.values())), strict=True))
        # Where the blocks end before the period does, one class at least has slots for all its blocks.
        last = [(n - 1) // weight[c] * period + slots[c][(n - 1) % weight[c]] for c, n in left.items() if (n - 1) % weight[c] < len(slots[c])]
        end = min(last) + 1
        for c in live:
            n = end // period * weight[c] + bisect_left(slots[c], end % period)
            rows.append((c, done[c], done[c] + n, base, weight[c], period, slots[c]))
            done[c] += n
        base += end
    return rows


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table as a literal of the plan."""
    def literal(v: object) -> Column:
        if isinstance(v, list):  # one literal, however long
            return F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") if v else F.array().cast("array<bigint>")
        return F.lit(v)

    return spark.range(1).select(F.inline(F.array(*(F.struct(*(literal(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))))


def _dealt(rows: DataFrame, counts: DataFrame, total: int) -> tuple[DataFrame, list[str]]:
    """``rows`` and the columns that part a class into ranges of ``__order``, none of which holds an id with a large share of all rows.

    The parts are the prefixes. A prefix that holds ids with over a thousandth of the rows (there are less
    than a thousand of them) is parted further: the ranges between such ids, and each such id, whose rows
    are dealt over as many pieces as it has thousandths. Only then the rows are written first, so that
    the number by which a row is dealt stays the same.
    """
    n = F.col("__n")
    large = (n > 1) & (n * 1000 > total)
    crowded = [tuple(r) for r in counts.where(large).select("__class", "__prefix").collect()]
    if not crowded:
        return rows, ["__prefix"]
    spark, keys = rows.sparkSession, ["__class", "__prefix"]
    within = rows.join(F.broadcast(_table(spark, crowded, keys)), keys)
    ids = within.groupBy(*keys, "__order").agg(F.count(F.lit(1)).alias("__n")).where(large).select(*keys, "__order", F.ceil(n * 1000 / total).cast("int")).collect()
    if not ids:
        return rows, ["__prefix"]
    # Less than a thousand ids in all.
    hot = _table(spark, [tuple(r) for r in ids], [*keys, "__id", "__of"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__id", "__of"))).alias("__hot"))
    rows = materialise(rows.withColumn("__nth", F.monotonically_increasing_id())).join(F.broadcast(hot), keys, "left")
    of = F.get(F.filter("__hot", lambda x: x["__id"] == F.col("__order")), F.lit(0))["__of"]
    smaller = F.size(F.filter(F.coalesce("__hot", F.array().cast(hot.schema["__hot"].dataType)), lambda x: x["__id"] < F.col("__order")))
    segment = 2 * smaller + F.when(of.isNotNull(), 1).otherwise(0)
    rows = rows.withColumns({"__segment": segment, "__piece": F.coalesce(F.pmod("__nth", of), F.lit(0))})
    return rows.drop("__hot", "__nth"), ["__prefix", "__segment", "__piece"]


def mix(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source",
        into: tuple[str, str, str] = ("block", "slot", "place")) -> DataFrame:
    """``docs`` with ``block``, ``slot`` and ``place``, or the names in ``into``: all rows in a mix of sources to target weights.

    The rows of a source, in the order of the MD5 of their ids, form blocks of ``block_docs``; the mix
    is the blocks in the order of ``slot``, with the rows of a block by ``place``. As long as no source
    is used up, after every slot each source is less than one block off its share. Then the weights of
    the others hold among themselves, again to less than one block from there on. No row is dropped or
    repeated. Sources that ``weights`` does not name, null too, are one class with ``rest_weight``.

    Weights are positive integers. Null ids count as empty; rows with one id stand next to each other
    in any order. An empty table gives no rows. Columns of ``docs`` named like the three are replaced;
    any others are kept as they are. Texts are not read.

    The numbering is in two steps, so that no task holds a source: rows are numbered within a source
    and a three-digit prefix of the MD5, and the counts of the 4,096 prefixes are added up per source.
    Rows of an id that over a thousandth of all rows share, null included, are dealt out (``_dealt``). The
    schedule is made on the driver from one count for each class, in a time that grows with the sum of the
    weights over their common divisor (about a second for a million), and enters the plan as literals.
    """
    if not all(isinstance(w, int) and w > 0 for w in [*weights.values(), rest_weight]):
        raise ValueError("weights must be positive integers")
    spark, names = docs.sparkSession, list(weights)
    index = F.create_map(*(F.lit(x) for pair in ((s, i) for i, s in enumerate(names)) for x in pair)) if names else None
    of_class = F.coalesce(index[F.col(source_col)], F.lit(len(names))) if names else F.lit(0)
    kept = [c for c in docs.columns if c not in into]
    rows = docs.select(*kept, of_class.alias("__class"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__order"))
    rows = rows.withColumn("__prefix", F.substring("__order", 1, 3))
    counts = rows.groupBy("__class", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    totals = {r[0]: r[1] for r in counts.groupBy("__class").agg(F.sum("__n")).collect()}
    blocks = [-(-totals.get(c, 0) // block_docs) for c in range(len(names) + 1)]
    phases = schedule(blocks, [*weights.values(), rest_weight])
    if not phases:
        none = F.lit(None).cast("bigint")
        return docs.select(*kept, *(none.alias(n) for n in into)).limit(0)
    rows, parts = _dealt(rows, counts, sum(totals.values()))
    counts = rows.groupBy("__class", *parts).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__class").orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__class", *parts, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__class", *parts).orderBy("__order", id_col))
    # 4,096 rows for each class at most with some 4,000 for the ids that are dealt out, and one for each class and phase: all bounded by the weights.
    numbered = rows.withColumn("__inside", inside - 1).join(F.broadcast(before), ["__class", *parts])
    numbered = numbered.withColumn("__at", F.col("__before") + F.col("__inside")).withColumn("__block", F.floor(F.col("__at") / block_docs))
    plan = _table(spark, phases, ["__of_class", "__first", "__end", "__base", "__weight", "__period", "__slots"])
    i = F.col("__block") - F.col("__first")
    slot = F.col("__base") + F.floor(i / F.col("__weight")) * F.col("__period") + F.get("__slots", (i % F.col("__weight")).cast("int"))
    meets = (F.col("__class") == F.col("__of_class")) & (F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__end"))
    made = (F.col("__block"), slot, F.col("__at") % block_docs)
    return numbered.join(F.broadcast(plan), meets).select(*kept, *(c.cast("bigint").alias(n) for c, n in zip(made, into, strict=True)))


def in_order(mixed: DataFrame, partitions: int | None = None, by: tuple[str, str] = ("slot", "place")) -> DataFrame:
    """The rows of ``mix`` in the order of the mix: over the partitions, which are written as files in this order, and within."""
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, *by).sortWithinPartitions(*by)


#: Of the registered query: 30 for src0, 2 to 6 for src1 to src19, 2 for the rest.
WEIGHTS = {"src0": 30} | {f"src{i}": 2 + i % 5 for i in range(1, 20)}
REST_WEIGHT = 2

#: DuckDB: the schedule slot by slot.
ORACLE_SQL = f"""
WITH RECURSIVE k(source, weight, class) AS (VALUES {", ".join(f"('{s}', {w}, {i + 1})" for i, (s, w) in enumerate(WEIGHTS.items()))}),
d AS (SELECT doc_id, source, coalesce(class, {len(WEIGHTS) + 1}) AS class, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents LEFT JOIN k USING (source)),
n AS (SELECT doc_id, source, class, CAST(floor((row_number() OVER (PARTITION BY class ORDER BY h, doc_id) - 1) / 16) AS BIGINT) AS block FROM d),
b AS (SELECT class, max(block) + 1 AS blocks FROM n GROUP BY class),
c AS (SELECT list(coalesce(weight, {REST_WEIGHT}) ORDER BY i) AS w, list(coalesce(blocks, 0) ORDER BY i) AS r
      FROM range(1, {len(WEIGHTS) + 2}) t(i) LEFT JOIN k ON k.class = i LEFT JOIN b ON b.class = i),
s AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS t0, w, r, list_transform(r, lambda x: CAST(0 AS BIGINT)) AS p, CAST(0 AS BIGINT) AS chosen, CAST(0 AS BIGINT) AS block, list_transform(r, lambda x: CAST(0 AS BIGINT)) AS done FROM c
  UNION ALL
  SELECT t, CASE WHEN used THEN t + 1 ELSE t0 END, w, CASE WHEN used THEN list_transform(r, lambda x, i: x - p2[i]) ELSE r END,
         CASE WHEN used THEN list_transform(p2, lambda x: CAST(0 AS BIGINT)) ELSE p2 END, c, done[c], list_transform(done, lambda x, i: x + CASE WHEN i = c THEN 1 ELSE 0 END)
  FROM (SELECT *, p2[c] = r[c] AS used FROM (
    SELECT *, list_transform(p, lambda x, i: x + CASE WHEN i = c THEN 1 ELSE 0 END) AS p2 FROM (
      SELECT *, list_sort(list_filter(list_transform(w, lambda x, i: CASE WHEN r[i] > 0 AND p[i] * total // x <= t - t0 THEN [-(-(p[i] + 1) * total // x), i] END), lambda z: z IS NOT NULL))[1][2] AS c FROM (
        SELECT t + 1 AS t, t0, w, r, p, done, list_sum(list_transform(w, lambda x, i: CASE WHEN r[i] > 0 THEN x ELSE 0 END))::BIGINT AS total FROM s
        WHERE list_sum(r) > 0))))
)
SELECT n.doc_id, n.source, n.block, s.t AS slot FROM n JOIN s ON s.chosen = n.class AND s.block = n.block AND s.t >= 0
"""
