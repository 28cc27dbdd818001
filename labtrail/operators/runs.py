"""Which column, file name or manifest names the run of a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S

#: Rows of a column that are ordered together; transitions between such stretches are counted over their ends.
STRETCH = 65_536


def profile_columns(cells: DataFrame) -> DataFrame:
    """Of each column: filled cells, distinct values, changes from one filled cell to the next, and the values' shape."""
    col = ["table_id", "col_idx"]
    own = cells.withColumn("v", S.run_id(F.col("raw_value"))).where("v is not null").withColumn("stretch", F.floor(F.col("row_idx") / STRETCH))
    w = W.partitionBy(*col, "stretch").orderBy("row_idx")
    changes = own.withColumn("changed", F.coalesce(F.lag("v").over(w) != F.col("v"), F.lit(False)).cast("long"))
    parts = changes.groupBy(*col, "stretch").agg(F.sum("changed").alias("inner"), F.count("*").alias("n"), F.min_by("v", "row_idx").alias("first"), F.max_by("v", "row_idx").alias("last"), F.max("raw_header").alias("raw_header"))
    seam = F.coalesce(F.lag("last").over(W.partitionBy(*col).orderBy("stretch")) != F.col("first"), F.lit(False)).cast("long")
    parts = parts.withColumn("seam", seam).groupBy(*col).agg(F.sum("n").alias("n_filled"), F.sum(F.col("inner") + F.col("seam")).alias("transitions"), F.max("raw_header").alias("raw_header"))
    x, length = S.numeric(F.col("v")), F.length("v")
    decimal = F.col("v").contains(".") & x.isNotNull() & (x != F.floor(x))
    shape = own.select(*col, "v").distinct().groupBy(*col).agg(
        F.count("*").alias("n_distinct"), F.count_if(decimal).alias("n_decimal"), F.bool_and(F.col("v").startswith("RUN-")).alias("all_runs"), F.max(length).alias("longest"), F.min(length).alias("shortest")
    )
    return parts.join(shape, col)


def id_shaped() -> Column:
    """Whether a profiled column's distinct values look like ids: not mostly decimals, and all run ids or all short and of like length."""
    continuous = F.col("n_decimal") >= F.greatest(F.lit(1), F.floor(F.col("n_distinct") / 2))
    return ~continuous & (F.col("all_runs") | ((F.col("longest") <= 20) & (F.col("longest") - F.col("shortest") <= 4)))


def score_columns(profile: DataFrame) -> DataFrame:
    """``score`` of each profiled column as the run's name, 0 for none, and ``confidence``."""
    header = F.regexp_replace(F.lower(F.trim("raw_header")), r"\.\d+$", "")
    hint = F.exists(F.array(*map(F.lit, S.RUN_TOKENS)), lambda t: header.contains(t))
    ratio = F.col("transitions") / F.col("n_distinct")
    score = F.when(F.col("n_distinct") <= 50, F.col("n_distinct")).otherwise(0) + F.greatest(F.lit(0.0), 5 - ratio) + F.when(hint, 3.0).otherwise(0.0)
    none = (F.col("n_filled") < 4) | (F.col("n_distinct") < 2) | (F.col("n_distinct") > 100) | (F.col("transitions") == 0) | (~hint & (~id_shaped() | (ratio > 1.5)))
    return profile.withColumn("score", F.when(none, 0.0).otherwise(score.cast("double"))).withColumn("confidence", F.least(F.lit(0.95), 0.5 + F.col("score") / 10))


def pick_run_column(profile: DataFrame, exclude_time: bool = True) -> DataFrame:
    """The column of the highest score of each table, the first on ties; none where all score 0."""
    own = score_columns(profile).where("score > 0")
    if exclude_time:
        own = own.where(~S.is_time_header(F.col("raw_header")))
    best = F.max_by(F.struct("col_idx", "score", "confidence"), F.struct("score", -F.col("col_idx"))).alias("x")
    return own.groupBy("table_id").agg(best).select("table_id", "x.*")


def rationale(resolved: DataFrame) -> DataFrame:
    """``resolved`` with a sentence on why that run was taken."""
    is_ = lambda s: F.col("strategy") == s
    text = F.when(is_("manifest"), "the manifest lists it").when(is_("column"), F.concat(F.lit("column "), F.col("col_idx").cast("string"), F.lit(" looks like run names"))).when(is_("filename"), "the file name holds it").otherwise("nothing names it")
    return resolved.withColumn("rationale", text)


def resolve_runs(tables: DataFrame, picked: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """``tables(table_id, filename)`` with the first that is known of: manifest, column, file name, made-up name."""
    t = tables.join(picked.select("table_id", "col_idx", F.col("confidence").alias("of_column")), "table_id", "left")
    t = t.join(manifest.select("table_id", F.col("run_id").alias("listed")), "table_id", "left") if manifest is not None else t.withColumn("listed", F.lit(None).cast("string"))
    named = S.run_from_filename(F.col("filename"))
    strategy = F.when(F.col("listed").isNotNull(), "manifest").when(F.col("col_idx").isNotNull(), "column").when(named.isNotNull(), "filename").otherwise("synthetic")
    t = t.withColumn("strategy", strategy)
    made_up = F.when(F.coalesce(F.col("filename"), F.lit("")) != "", 0.3).otherwise(0.2)
    is_ = lambda s: F.col("strategy") == s
    confidence = F.when(is_("manifest"), 1.0).when(is_("column"), F.col("of_column")).when(is_("filename"), 0.7).otherwise(made_up)
    value = F.when(is_("manifest"), F.col("listed")).when(is_("filename"), named).when(is_("synthetic"), S.synthetic_run(F.col("filename")))
    return t.select("table_id", "strategy", F.when(is_("column"), F.col("col_idx")).alias("col_idx"), value.alias("value"), confidence.alias("confidence"))
