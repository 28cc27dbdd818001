"""Sequence numbers after a total sort, without ordering everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.sources.shared import written


def number(df: DataFrame, order: list[Column], per: list[str], bucket: Column, into: str = "seq") -> DataFrame:
    """``into``: 1, 2, ... for each ``per`` in the given order; ``bucket`` must never decrease in that order.

    Rows are ordered within buckets; what comes before a bucket is a running sum over the few bucket counts. For orders whose
    buckets are bounded by what they are (lines of a block of a file); others are for ``number_by_range``.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*per, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*per).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*per, "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(*per, "__bucket").orderBy(*order))
    return df.withColumn("__own", own).join(counts, [*per, "__bucket"]).withColumn(into, F.col("__before") + F.col("__own")).drop("__bucket", "__own", "__before")


def number_by_range(df: DataFrame, order: list[Column], per: list[str], into: str = "seq") -> DataFrame:
    """``into``: 1, 2, ... for each ``per`` in the given order, whatever its values.

    Spark draws the bounds of the ranges from a sample of ``per`` and ``order``, so a range has about as many rows as any other even
    if one value of the first key holds all rows; ``order`` should tell rows apart as far as anything does. Each row
    has its place in its range; a range starts where the rows of its ``per`` in the ranges before end, which are a row
    for each range and ``per``. The ranges are written to the shared folder, for their bounds must not be drawn twice.
    """
    place = F.monotonically_increasing_id()  # the range's number, then the row's place in it
    ranged = df.repartitionByRange(*per, *order).sortWithinPartitions(*per, *order).withColumn("__id", place)
    ranged = written(ranged, "ranges").withColumn("__range", F.shiftright("__id", 33))
    parts = ranged.groupBy(*per, "__range").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(W.partitionBy(*per).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"__{c}") for c in per), F.col("__range").alias("__of"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = F.col("__range") == F.col("__of")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranged.join(parts, same).withColumn(into, F.col("__id") + F.col("__shift")).drop("__id", "__range", "__of", "__shift", *(f"__{c}" for c in per))
