"""Range findings, and what is told from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators.numbering import number_by_range
from labtrail.operators.scans import LENGTH, neighbour, stretches

GROUP = ["experiment_id", "run_id", "variable"]


def _sigmas():
    return F.round((F.col("value") - F.col("expected")) / F.nullif(F.col("expected_std_dev"), F.lit(0.0)), 6)


def violations(rows: DataFrame) -> DataFrame:
    """Rows two or more standard deviations off, with severity and confidence."""
    rows = rows.withColumn("sigmas", _sigmas()).where("sigmas is not null").withColumn("severity_rank", S.severity_rank(F.col("sigmas")))
    return rows.where("severity_rank > 0").withColumn("severity", S.severity(F.col("severity_rank"))).withColumn("confidence", S.severity_confidence(F.col("severity_rank")))


def deviations(rows: DataFrame) -> DataFrame:
    """Every row with a spec, those within it too."""
    own = rows.where("expected is not null and expected_std_dev is not null")
    return own.select(*GROUP, "observation_id", "time_h", "value", F.round(F.col("value") - F.col("expected"), 6).alias("residual"), _sigmas().alias("sigmas"))


def rollup(found: DataFrame, threshold: int = 100) -> DataFrame:
    """Groups of more than ``threshold`` violations as one candidate each, the others row by row."""
    groups = found.groupBy(*GROUP).agg(F.max("severity_rank").alias("severity_rank"), F.min("time_h").alias("t_start"), F.max("time_h").alias("t_end"), F.min("value").alias("observed_min"), F.max("value").alias("observed_max"), F.max(F.abs("sigmas")).alias("max_abs_sigmas"), F.count("*").alias("n_violations"), F.min("observation_id").alias("observation_id"))
    few = found.join(groups.where(F.col("n_violations") <= threshold), GROUP, "left_semi")
    shared = ["severity_rank", "severity", "confidence", "t_start", "t_end", "observed_min", "observed_max", "max_abs_sigmas", "n_violations", "aggregated", "order_sigmas", "observation_id"]
    single = few.select(*GROUP, "severity_rank", "severity", "confidence", F.col("time_h").alias("t_start"), F.col("time_h").alias("t_end"), F.col("value").alias("observed_min"), F.col("value").alias("observed_max"), F.abs("sigmas").alias("max_abs_sigmas"), F.lit(1).cast("long").alias("n_violations"), F.lit(False).alias("aggregated"), F.abs("sigmas").alias("order_sigmas"), "observation_id")
    many = groups.where(F.col("n_violations") > threshold)
    many = many.withColumn("severity", S.severity(F.col("severity_rank"))).withColumn("confidence", S.severity_confidence(F.col("severity_rank"))).withColumn("aggregated", F.lit(True)).withColumn("order_sigmas", F.lit(0.0))
    return single.unionByName(many.select(*GROUP, *shared))


def findings(candidates: DataFrame) -> DataFrame:
    """Numbered by severity, sigmas (rollups count as 0), run, time and variable."""
    order = [F.desc("severity_rank"), F.desc("order_sigmas"), F.col("run_id"), F.col("t_start"), F.col("variable"), F.col("observation_id")]
    out = number_by_range(candidates, order, ["experiment_id"])
    return out.withColumn("finding_id", F.format_string("F-%04d", "seq")).drop("order_sigmas")


def evidence(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``experiment_id, finding_id, observation_id``: all evidence of each finding, of rolled-up ones every violation of ``rows`` in their group."""
    single = found.where("not aggregated").select("experiment_id", "finding_id", "observation_id")
    many = rows.select(*GROUP, "observation_id").join(found.where("aggregated").select(*GROUP, "finding_id"), GROUP)
    return single.unionByName(many.select("experiment_id", "finding_id", "observation_id"))


def timeline(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Findings in time order; lag to the run's next event in seconds, null where it isn't positive.

    A run's events are read in stretches of ``length`` places of the experiment's order.
    """
    own = number_by_range(found.where("t_start is not null").drop("seq"), [F.col("t_start"), F.desc("severity_rank"), F.col("run_id"), F.col("variable"), F.col("finding_id")], ["experiment_id"])
    own = neighbour(own, ["experiment_id", "run_id"], "seq", stretches("seq", length), ["t_start"], "after", following=True)
    gap = F.round((F.col("after.t_start") - F.col("t_start")) * 3600, 6)
    return own.withColumn("lag_s", F.when(gap > 0, gap)).select("experiment_id", "seq", "finding_id", "run_id", "variable", "t_start", "severity", "lag_s")


def with_caveat(found: DataFrame, quality: DataFrame) -> DataFrame:
    return found.join(quality.select(*GROUP, "quality"), GROUP, "left").withColumn("caveat", F.coalesce(F.col("quality") < 0.8, F.lit(False)))


def open_questions(found: DataFrame, quality: DataFrame) -> DataFrame:
    """A question for each series of quality below 0.8 that has findings."""
    return found.groupBy(*GROUP).agg(F.count("*").alias("n_findings"), F.min("finding_id").alias("first_finding")).join(quality.where("quality < 0.8"), GROUP).select(*GROUP, "n_findings", "first_finding", "quality")


def severity_rollup(found: DataFrame) -> DataFrame:
    return found.groupBy("experiment_id").pivot("severity", ["info", "minor", "major", "critical"]).count().fillna(0)


def top_findings(found: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` that come first by severity, rollups before single rows, id."""
    w = W.partitionBy("experiment_id").orderBy(F.desc("severity_rank"), F.desc("aggregated"), "seq")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def process_flags(rows: DataFrame, quality: DataFrame, coverage: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Sorted flags of each experiment: low quality, sparse data, several runs, missing specs.

    ``facts(experiment_id, stale, coverage_pct, provenance, organism)``, a row for each experiment, adds the rules on what
    the rows don't tell: observations of a stale schema, coverage below 50, unknown process, no organism. An experiment
    that it lacks has no coverage and no organism.
    """
    a = rows.groupBy("experiment_id").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))
    b = quality.groupBy("experiment_id").agg(F.bool_or(F.col("quality") < 0.8).alias("low"))
    c = coverage.groupBy("experiment_id").agg((F.avg(F.when(F.col("has_spec"), 0.0).otherwise(1.0)) > 0.5).alias("unspecified"))
    sparse, told = F.coalesce("n", F.lit(0)) < 20, []
    if facts is not None:
        a = a.join(facts.select("experiment_id", "stale", "coverage_pct", "provenance", "organism"), "experiment_id", "full")
        sparse = sparse | (F.coalesce("coverage_pct", F.lit(0)) < 50)
        told = [F.when(F.size("stale") > 0, "STALE_SCHEMA_OBSERVATIONS"), F.when(F.col("provenance") == "unknown", "UNKNOWN_PROCESS"), F.when(F.coalesce(F.trim("organism"), F.lit("")) == "", "UNKNOWN_ORGANISM")]
    flags = F.array(F.when(F.col("low"), "LOW_QUALITY_TRAJECTORY"), F.when(sparse, "SPARSE_DATA"), F.when(F.col("runs") > 1, "MULTI_RUN"), F.when(F.col("unspecified"), "SPECS_MOSTLY_MISSING"), *told)
    return a.join(b, "experiment_id", "left").join(c, "experiment_id", "left").select("experiment_id", F.array_join(F.sort_array(F.array_compact(flags)), ",").alias("flags"))


def filter_findings(found: DataFrame, run: str | None = None, variable: str | None = None, severity: str | None = None, limit: int = 100, finding: str | None = None, tier: str | None = None) -> DataFrame:
    """The first ``limit`` findings of each experiment that fit, with their total.

    Totals are counted apart and joined, so that no experiment is gathered in one task for them.
    """
    for name, value in (("run_id", run), ("variable", variable), ("severity", severity), ("finding_id", finding), ("tier", tier)):
        if value is not None:
            found = found.where(F.col(name) == value)
    totals = found.groupBy("experiment_id").agg(F.count("*").alias("total"))
    first = found.withColumn("place", F.row_number().over(W.partitionBy("experiment_id").orderBy("seq"))).where(F.col("place") <= limit)
    return first.join(totals, "experiment_id").withColumn("truncated", F.col("total") > limit)
