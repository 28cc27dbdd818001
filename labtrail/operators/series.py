"""Gridded time series of each run and variable, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.operators.scans import LENGTH, carried, neighbour, stretches

KEY = ["experiment_id", "run_id", "variable"]


def snap(rows: DataFrame, dt: float) -> DataFrame:
    return rows.withColumn("grid_idx", F.floor(F.col("time_h") / dt).cast("int"))


def last_at_point(rows: DataFrame) -> DataFrame:
    """One row a grid point: the last by time, then observation_id."""
    last = F.max_by(F.struct("value", "observation_id", "unit"), F.struct("time_h", "observation_id")).alias("x")
    return rows.groupBy(*KEY, "grid_idx").agg(last).select(*KEY, "grid_idx", "x.*")


def grid_points(rows: DataFrame, dt: float, end: float, length: int = LENGTH) -> DataFrame:
    """Every grid point of every series; values are carried forward over gaps, what comes before the first is missing.

    They are carried inside stretches of ``length`` points and from one stretch to the next, so no series is one task.
    """
    real = last_at_point(snap(rows, dt))
    n = int(round(end / dt))
    points = real.select(*KEY).distinct().withColumn("grid_idx", F.explode(F.sequence(F.lit(0), F.lit(n))))
    points = points.join(real, [*KEY, "grid_idx"], "left")
    points = carried(points, KEY, "grid_idx", stretches("grid_idx", length), "value", "known")
    known = F.col("known")
    return points.select(*KEY, "grid_idx", F.round(F.col("grid_idx") * F.lit(dt), 6).alias("time_h"), known.alias("value"), (F.col("value").isNull() & known.isNotNull()).alias("imputed"), known.isNull().alias("missing"), "observation_id")


def series_quality(points: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return points.groupBy(*KEY).agg(share(F.col("observation_id").isNotNull()).alias("quality"), share(F.col("imputed")).alias("pct_imputed"), share(F.col("missing")).alias("pct_missing"))


def units(rows: DataFrame) -> DataFrame:
    """The unit of each series: that of its earliest row."""
    return rows.groupBy(*KEY).agg(F.min_by("unit", F.struct("time_h", "observation_id")).alias("unit"))


def available(points: DataFrame, run: str, variable: str) -> DataFrame:
    """What ``timecourse`` has to offer where there is no such series: every pair of run and variable; nothing where there is."""
    pairs = points.select(*KEY).distinct()
    asked = pairs.where((F.col("run_id") == run) & (F.col("variable") == variable)).select("experiment_id").distinct()
    return pairs.join(asked, "experiment_id", "left_anti")


def trajectories(points: DataFrame) -> DataFrame:
    """Arrays in time order, for export; the long form is what other operators read. ``units`` has their unit."""
    row = F.sort_array(F.collect_list(F.struct("grid_idx", "time_h", "value", "imputed", "observation_id")))
    t = points.groupBy(*KEY).agg(row.alias("x"))
    ids = F.filter(F.col("x.observation_id"), lambda i: i.isNotNull())
    method = F.when(F.exists("x", lambda p: p["imputed"]), "carry_forward").otherwise("none")
    return t.select(*KEY, F.col("x.time_h").alias("time_grid"), F.col("x.value").alias("values"), F.col("x.imputed").alias("imputation_flags"), ids.alias("source_observation_ids"), method.alias("imputation_method"))


def rates(points: DataFrame, length: int = LENGTH) -> DataFrame:
    """First differences over time between real points, in stretches of ``length`` grid points."""
    real = neighbour(points.where("observation_id is not null"), KEY, "grid_idx", stretches("grid_idx", length), ["time_h", "value"], "before")
    return real.select(*KEY, "grid_idx", ((F.col("value") - F.col("before.value")) / (F.col("time_h") - F.col("before.time_h"))).alias("rate"))


def timecourse(points: DataFrame, run: str, variable: str, lo: float, hi: float, k: int = 100) -> DataFrame:
    """The first ``k`` points of one series within [lo, hi], and whether there are more."""
    own = points.where((F.col("run_id") == run) & (F.col("variable") == variable) & F.col("time_h").between(lo, hi))
    w = W.partitionBy(*KEY)
    own = own.withColumn("n", F.row_number().over(w.orderBy("grid_idx"))).withColumn("truncated", F.count("*").over(w) > k)
    return own.where(F.col("n") <= k).select(*KEY, "grid_idx", "time_h", "value", "imputed", "truncated")


def chunks(points: DataFrame, length: int = LENGTH) -> DataFrame:
    """``chunk, offset`` and arrays of at most ``length`` grid points of a series, in order, ``offset`` the first's: no row grows with its series."""
    row = F.sort_array(F.collect_list(F.struct("grid_idx", "time_h", "value", "imputed", "observation_id")))
    t = points.groupBy(*KEY, stretches("grid_idx", length).alias("chunk")).agg(row.alias("x"))
    return t.select(*KEY, "chunk", F.col("x.grid_idx")[0].alias("offset"), F.col("x.grid_idx").alias("places"), F.col("x.time_h").alias("time_grid"), F.col("x.value").alias("values"), F.col("x.imputed").alias("imputation_flags"), F.col("x.observation_id").alias("observation_ids"))


def chunk_range(parts: DataFrame, lo: int, hi: int, length: int = LENGTH) -> DataFrame:
    """The grid points lo to hi, hi excluded, of ``chunks`` of that ``length``; other chunks aren't opened."""
    here = parts.where(F.col("chunk").between(lo // length, (hi - 1) // length))
    cells = F.arrays_zip(F.col("places").alias("grid_idx"), F.col("time_grid").alias("time_h"), F.col("values").alias("value"), F.col("imputation_flags").alias("imputed"), F.col("observation_ids").alias("observation_id"))
    return here.select(*KEY, F.explode(cells).alias("c")).select(*KEY, "c.*").where((F.col("grid_idx") >= lo) & (F.col("grid_idx") < hi))
