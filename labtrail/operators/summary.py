"""The summary: usable observations with what is expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.functions import scalars as S

MISSING_VALUE, MISSING_PLACE = "missing observation_id or value", "locator missing run_id or timestamp_h"


def split_summary(obs: DataFrame) -> DataFrame:
    """``obs`` with ``reason``: null for rows that are kept."""
    return obs.withColumn("reason", F.when(F.col("observation_id").isNull() | F.col("value").isNull(), MISSING_VALUE).when(F.col("run_id").isNull() | F.col("time_h").isNull(), MISSING_PLACE))


def summary(obs: DataFrame) -> DataFrame:
    return split_summary(obs).where("reason is null").drop("reason")


def with_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """``expected`` and ``expected_std_dev`` by variable; specs are a dimension of one row a variable."""
    specs = specs.select("variable", F.col("nominal").alias("expected"), F.col("std_dev").alias("expected_std_dev"))
    return rows.join(F.broadcast(specs) if specs.count() <= 10_000 else specs, "variable", "left")


def merge_specs(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults and an experiment's overrides, field by field; a field that is present with null clears the default.

    ``overrides`` has ``has_nominal`` and ``has_std_dev`` beside the values. Specs without both values aren't returned.
    """
    d, o = defaults.alias("d"), overrides.alias("o")
    m = d.join(o, "variable", "full_outer")
    pick = {f: F.when(F.coalesce(F.col(f"o.has_{f}"), F.lit(False)), F.col(f"o.{f}")).otherwise(F.col(f"d.{f}")) for f in ("nominal", "std_dev")}
    from_o = F.coalesce(F.col("o.has_nominal") & F.col("o.has_std_dev"), F.lit(False))
    none_o = ~F.coalesce(F.col("o.has_nominal") | F.col("o.has_std_dev"), F.lit(False))
    provenance = F.when(from_o, "dossier").when(none_o, "schema").otherwise("merged")
    return m.select("variable", *(c.alias(k) for k, c in pick.items()), provenance.alias("provenance")).where("nominal is not null and std_dev is not null")


def extent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment_id").agg(F.count_distinct("run_id").alias("n_runs"), F.count("*").alias("n_observations"), F.min("time_h").alias("t_min"), F.max("time_h").alias("t_max"))


def stats(rows: DataFrame) -> DataFrame:
    """Count, mean to four places, least and largest value; means are summed in whole millionths, so no order of rows changes them."""
    whole = S.millionths(F.col("value"))
    out = rows.groupBy("experiment_id", "run_id", "variable").agg(F.count("*").alias("n"), F.sum(whole).alias("__sum"), F.count(whole).alias("__known"), F.min("value").alias("low"), F.max("value").alias("high"))
    mean = F.when(F.col("__known") > 0, S.ratio_half_up(F.col("__sum"), F.col("__known") * 100).cast("double") / 1e4)
    return out.select("experiment_id", "run_id", "variable", "n", mean.alias("mean"), "low", "high")


def extent_sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment_id").agg(F.sort_array(F.collect_set("run_id")).alias("run_ids"), F.sort_array(F.collect_set("variable")).alias("variables"))


def spec_coverage(rows: DataFrame) -> DataFrame:
    """Variables of each experiment, and whether any of their rows has both spec values."""
    both = F.col("expected").isNotNull() & F.col("expected_std_dev").isNotNull()
    return rows.groupBy("experiment_id", "variable").agg(F.bool_or(both).alias("has_spec"))
