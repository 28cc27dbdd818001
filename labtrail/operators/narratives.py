"""Observations of prose: reading their items, choosing among them, and naming them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S

#: What a narrative item can be about (fixed values).
TAGS = ("closure_event", "deviation", "intervention", "observation", "conclusion", "protocol_note")
ITEM = "tag string, text string, run_id string, time_h string, confidence string, affected_variables string"


def coerce_items(items: DataFrame) -> DataFrame:
    """``doc_id, item_idx`` and the typed fields of JSON ``item`` strings.

    Items without text, of an unknown tag, or that are no JSON object, are dropped. Numbers that can't be read are null, the
    confidence then 0.6; a list of variables that is a single name counts as a list of one.
    """
    own = items.withColumn("i", F.from_json("item", ITEM))
    tag, text = F.lower(F.trim("i.tag")), F.nullif(F.trim("i.text"), F.lit(""))
    names = F.coalesce(F.from_json("i.affected_variables", "array<string>"), F.array("i.affected_variables"))
    names = F.filter(F.transform(names, lambda x: F.nullif(F.trim(x), F.lit(""))), lambda x: x.isNotNull())
    return own.where(tag.isin(*TAGS) & text.isNotNull()).select(
        "doc_id",
        "item_idx",
        tag.alias("tag"),
        text.alias("text"),
        S.run_id(F.col("i.run_id")).alias("run_id"),
        S.finite(S.numeric(F.col("i.time_h"))).alias("time_h"),
        S.clamp(F.col("i.confidence"), 0.6).alias("confidence"),
        F.coalesce(names, F.array().cast("array<string>")).alias("affected_variables"),
    )


def tags_present(narratives: DataFrame) -> DataFrame:
    """The tags that occur in each experiment, sorted."""
    return narratives.groupBy("experiment_id").agg(F.sort_array(F.collect_set("tag")).alias("tags_present"))


def filter_narratives(narratives: DataFrame, run: str | None = None, tag: str | None = None, variable: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of each experiment that fit, by narrative_id, with how many fit, whether some are left out, and all tags of the experiment.

    Totals are counted apart and joined, so that no experiment is gathered in one task for them.
    """
    own = narratives
    if run is not None:
        own = own.where(F.col("run_id") == run)
    if tag is not None:
        own = own.where(F.col("tag") == tag)
    if variable is not None:
        own = own.where(F.array_contains("affected_variables", variable))
    totals = own.groupBy("experiment_id").agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > limit)
    place = F.row_number().over(W.partitionBy("experiment_id").orderBy("narrative_id"))
    first = own.withColumn("place", place).where(F.col("place") <= limit)
    return first.join(totals, "experiment_id").join(tags_present(narratives), "experiment_id")


def rekey(narratives: DataFrame) -> DataFrame:
    """``narrative_id`` under the row's own ``experiment_id``: the tail ``N-dddd`` stays, ids without one are numbered by ``position``."""
    tail = F.nullif(F.regexp_extract("narrative_id", r"(N-\d{4,})$", 1), F.lit(""))
    return narratives.withColumn("narrative_id", F.concat_ws("-", "experiment_id", F.coalesce(tail, F.format_string("N-%04d", F.col("position")))))
