"""Blocks of prose, quotations from them, and values that a table has already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S


def narrative_blocks(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """A row for each line of ``min_len`` characters or more; ``paragraph_idx`` counts the shorter ones too."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_idx", "text"))
    return lines.withColumn("text", F.trim("text")).where(F.length("text") >= min_len)


def dedup_text(blocks: DataFrame) -> DataFrame:
    """The first of equal texts of a document (case and outer blanks apart); ``place`` counts kept rows from 1."""
    kept = blocks.groupBy("doc_id", F.lower(F.trim("text")).alias("__same")).agg(F.min(F.struct("paragraph_idx", "text")).alias("x")).select("doc_id", "x.*")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("paragraph_idx")))


def chunk(blocks: DataFrame, size: int = 20) -> DataFrame:
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("paragraph_idx"))
    return blocks.withColumn("chunk", F.floor((place - 1) / size).cast("int"))


def char_budget(blocks: DataFrame, cap: int = 200_000) -> DataFrame:
    """A document's blocks up to where their length first passes ``cap``, a header line ``[paragraph_idx]`` for each; ``truncated`` says if some are left out."""
    rendered = F.length("text") + F.length(F.col("paragraph_idx").cast("string")) + 3
    w = W.partitionBy("doc_id").orderBy("paragraph_idx")
    own = blocks.withColumn("upto", F.sum(rendered).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.withColumn("truncated", F.max("upto").over(W.partitionBy("doc_id")) > cap).where(F.col("upto") <= cap)


def gate_evidence(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidates with ``verdict``: ``ok``, or the first reason against their evidence in the paragraph that they name."""
    source = blocks.select("doc_id", "paragraph_idx", F.col("text").alias("source_text"))
    own = candidates.join(source, ["doc_id", "paragraph_idx"], "left")
    return own.withColumn("verdict", S.evidence_verdict(F.col("evidence"), F.col("source_text"), S.value_forms(F.col("value")))).drop("source_text")


def gate_stats(gated: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """``kept, rejected`` of each document; with ``unique``, the accepted rows that no table has already, the others are ``deduped``."""
    out = gated.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "ok").alias("kept"), F.count_if(F.col("verdict") != "ok").alias("rejected"))
    if unique is None:
        return out
    left = unique.groupBy("doc_id").agg(F.count("*").alias("left"))
    return out.join(left, "doc_id", "left").select("doc_id", F.coalesce("left", F.lit(0)).alias("kept"), "rejected", (F.col("kept") - F.coalesce("left", F.lit(0))).alias("deduped"))


def drop_table_duplicates(candidates: DataFrame, obs: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Candidates whose value no table observation of the same file and variable has, to ``tolerance``.

    An equi-join on bands of the value's magnitude: a match lies in the same band or the next one. Values may be text on
    both sides; those that are no numbers match if equal, outer blanks and case apart.
    """
    if dict(candidates.dtypes)["value"] == "string":
        number, same = S.numeric(F.col("value")), F.lower(F.trim("value"))
        own = candidates.select("file_id", "variable", "value").distinct().withColumns({"number": number, "same": same})
        told = obs.select("file_id", "variable", number.alias("number"), same.alias("same"))
        words = own.where("number is null").join(told.where("number is null").select("file_id", "variable", "same").distinct(), ["file_id", "variable", "same"], "left_semi")
        new = drop_table_duplicates(own.where("number is not null").select("file_id", "variable", F.col("number").alias("value")).distinct(), told.select("file_id", "variable", F.col("number").alias("value")), tolerance)
        old = own.where("number is not null").join(new.withColumnRenamed("value", "number"), ["file_id", "variable", "number"], "left_anti")
        gone = words.select("file_id", "variable", "value").unionByName(old.select("file_id", "variable", "value"))
        return candidates.join(gone, ["file_id", "variable", "value"], "left_anti")
    width = 1.01 * tolerance / (1 - tolerance)
    band = lambda c: F.floor(S.magnitude(F.col(c)) / width)
    known = obs.where("value is not null").select("file_id", "variable", F.col("value").alias("known"), band("value").alias("band")).distinct()
    near = F.explode_outer(F.when(F.col("value").isNotNull(), F.array(*(band("value") + i for i in (-1, 0, 1)))))
    tries = candidates.select("file_id", "variable", "value", near.alias("band")).distinct()
    same = tries.join(known, ["file_id", "variable", "band"]).where(S.values_match(F.col("value"), F.col("known"), tolerance)).select("file_id", "variable", "value").distinct()
    return candidates.join(same, ["file_id", "variable", "value"], "left_anti")


def supported_facts(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts whose value occurs, whatever its case, in a verified span of their document."""
    spans = spans.select(F.col("doc_id").alias("of_doc"), "span")
    hit = (F.col("doc_id") == F.col("of_doc")) & F.lower("span").contains(F.lower("value"))
    return facts.join(spans, hit, "left_semi")
