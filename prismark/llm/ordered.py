"""Neighbours in a total order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the value, by a search in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.lit(0)
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    if len(bounds) <= 64:
        return count(array(bounds))
    coarse = count(array(bounds[::step]))
    first = F.greatest(F.lit(0), coarse - 1) * step
    return first + count(F.slice(array(bounds), first + 1, F.lit(step)))


def with_next(rows: DataFrame, key: str, carried: str, parts: int) -> DataFrame:
    """`rows` with column `next`: `carried` of the row that follows by descending key, of the first row after the last.

    The key is a long without nulls; rows with the same key follow each other in the order of `carried`. Rows are dealt into
    `parts` ranges of the key, whose ends (two numbers a range) are all that the driver sees; the greatest key of each
    range is also dealt to the range before it, so every row has its neighbour in its own range.
    """
    ends = rows.select(key).repartitionByRange(parts, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("least"), F.max(key).alias("most")).orderBy("least").collect()
    if not ends:
        return rows.withColumn("next", F.col(carried))
    bounds = [r["least"] for r in ends[1:]]
    greatest = F.array(*[F.lit(r["most"]).cast("long") for r in ends])
    n = len(ends)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"), F.lit(False).alias("wrapped"))
    above = F.struct(F.when(F.col("part") == n - 1, 0).otherwise(F.col("part") + 1).alias("part"), F.lit(True).alias("halo"), (F.col("part") == n - 1).alias("wrapped"))
    dealt = rows.withColumn("part", _bucket(F.col(key), bounds))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col(key) == F.element_at(greatest, F.col("part") + 1), F.array(own, above)).otherwise(F.array(own))))
    order = Window.partitionBy("place.part").orderBy("place.wrapped", F.desc(key), carried)
    return dealt.withColumn("next", F.lead(carried).over(order)).where("not place.halo").drop("part", "place")
