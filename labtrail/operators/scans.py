"""Scans over one long series, in stretches.

A window over a whole series is one task for it. Here a window runs inside each stretch, a stretch gives one row of what it
hands on (its first, last or last known values), a second window runs over these few rows, and a join brings them to
the rows at the stretch's edge. ``stretch`` is a column that never decreases in the series' order; stretches without rows are no stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a series that make a stretch.
LENGTH = 1024


def stretches(place: str | Column, length: int = LENGTH) -> Column:
    """The stretch of a place 0, 1, 2 ... of a series."""
    return F.floor((F.col(place) if isinstance(place, str) else place) / length)


def _handed(df: DataFrame, key: list[str], order: str, stretch: Column, inside: Column, handed: Column, beyond) -> DataFrame:
    """``df`` with ``__in``, ``inside`` over its stretch, and ``__out``, what the stretches beyond hand on."""
    rows = df.withColumn("__stretch", stretch)
    edges = rows.groupBy(*key, "__stretch").agg(handed.alias("__edge"))
    edges = edges.select(*key, "__stretch", beyond(F.col("__edge"), W.partitionBy(*key).orderBy("__stretch")).alias("__out"))
    return rows.withColumn("__in", inside.over(W.partitionBy(*key, "__stretch").orderBy(order))).join(edges, [*key, "__stretch"])


def neighbour(df: DataFrame, key: list[str], order: str, stretch: Column, columns: list[str], into: str, following: bool = False) -> DataFrame:
    """``into``: a struct of ``columns`` of the series' row before (or after, if ``following``), null at its end. ``key`` must hold no nulls."""
    row = F.struct(*columns)
    if following:
        out = _handed(df, key, order, stretch, F.lead(row), F.min_by(row, order), lambda edge, w: F.lead(edge).over(w))
    else:
        out = _handed(df, key, order, stretch, F.lag(row), F.max_by(row, order), lambda edge, w: F.lag(edge).over(w))
    return out.withColumn(into, F.coalesce("__in", "__out")).drop("__in", "__out", "__stretch")


def carried(df: DataFrame, key: list[str], order: str, stretch: Column, value: str, into: str) -> DataFrame:
    """``into``: the last known ``value`` of the series so far, the row's own included. ``key`` must hold no nulls."""
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    inside = F.last(value, ignorenulls=True)
    out = _handed(df, key, order, stretch, inside, known, lambda edge, w: F.last(edge, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return out.withColumn(into, F.coalesce("__in", "__out")).drop("__in", "__out", "__stretch")


def summed_before(df: DataFrame, key: list[str], order: str, stretch: Column, value: str, into: str) -> DataFrame:
    """``into``: the sum of ``value`` over the series' rows before this one. ``key`` must hold no nulls."""
    inside = F.sum(value)
    out = _handed(df, key, order, stretch, inside, F.sum(value), lambda edge, w: F.sum(edge).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return out.withColumn(into, F.coalesce("__in", F.lit(0)) + F.coalesce("__out", F.lit(0)) - F.coalesce(F.col(value), F.lit(0))).drop("__in", "__out", "__stretch")
