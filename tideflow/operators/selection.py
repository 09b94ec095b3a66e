"""Exact percentiles of groups of any size, by narrowing the range that holds a rank.

``percentile`` keeps all different values of a group in one buffer. Here each pass counts the values of a group in some
hundred parts of the range that a wanted rank is known to lie in, with the least and greatest of each part; the part that
holds the rank is the next range. A range whose ends are equal is the value. Counts are combined before they
are shuffled, so a pass moves a few hundred rows for each group and task, however large the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_null_safe
from ..functions.lineage import cut_lineage

PARTS = 256


def exact_percentiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], series_cols: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """``(series, columns)``: for each column the values at the ``shares``, an array of doubles, interpolated as ``percentile`` does.

    A row for each series, null series too; null for a column without values. NaN is greater than all else, as in Spark's
    order. Passes end when each range is one value, or its doubles have no value between: two to four for spread values, and
    never more than the digits of a double in base ``parts``.
    """
    keys, one = [*series_cols], "__all"
    long = rows.select(*keys, F.lit(0).alias(one), F.explode(F.array(*(F.struct(F.lit(c).alias("__name"), F.col(c).cast("double").alias("__v")) for c in columns))).alias("__x"))
    long = cut_lineage(long.select(*keys, one, "__x.*").where("__v IS NOT NULL"))
    by = [*(keys or [one]), "__name"]
    sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # Of each share the two ranks between which it lies.
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))
    exact = (F.col("n") - 1) * F.col("p.share")
    ranks = sizes.withColumn("p", F.explode(places)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))))
    open_ = cut_lineage(ranks.select(*by, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below")).distinct())
    done = open_.where("lo = hi")
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        # Ranks of one range are one question; ranges of a group don't overlap but in their ends.
        asked = open_.select(*by, "lo", "hi").distinct()
        near = join_null_safe(long, asked, by, "inner").where("__v BETWEEN lo AND hi")
        # Equal parts of the range; of one that is infinite or too small to be divided, its ends and what lies between.
        wide = F.col("hi") / 2 - F.col("lo") / 2
        share = (F.col("__v") / 2 - F.col("lo") / 2) / wide
        part = F.when(F.isnan(wide) | (wide == float("inf")) | (wide == 0) | F.isnan("__v"), F.when(F.col("__v") == F.col("lo"), 0).when(F.col("__v") == F.col("hi"), 2).otherwise(1))
        part = part.otherwise(F.least(F.floor(share * parts), F.lit(parts - 1))).cast("int")
        counted = near.groupBy(*by, "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        running = Window.partitionBy(*by, "lo", "hi").orderBy("part")
        counted = counted.withColumn("upto", F.sum("n").over(running))
        met = join_null_safe(open_, counted.withColumnsRenamed({"lo": "of_lo", "hi": "of_hi"}), by, "inner").where("lo = of_lo AND hi = of_hi")
        found = met.where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("n")))
        following = cut_lineage(found.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below")))
        done = done.unionByName(following.where("lo = hi"))
        open_ = following.where("lo < hi")
    values = done.select(*by, "rank", F.col("lo").alias("__value"))
    ends = sizes.withColumn("p", F.explode(places)).select(*by, "p.i", F.floor(exact).alias("low"), F.ceil(exact).alias("high"), (exact - F.floor(exact)).alias("part"), (F.ceil(exact) - exact).alias("rest"))
    low = join_null_safe(ends.withColumn("rank", F.col("low")), values, [*by, "rank"]).withColumnRenamed("__value", "a").withColumn("rank", F.col("high"))
    both = join_null_safe(low, values, [*by, "rank"])
    value = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise(F.col("rest") * F.col("a") + F.col("part") * F.col("__value"))
    listed = both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("__list"))
    wide_ = listed.groupBy(*(keys or [one])).pivot("__name", list(columns)).agg(F.first("__list"))
    every = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select(F.lit(0).alias(one))
    return join_null_safe(every, wide_, keys or [one]).select(*keys, *columns)
