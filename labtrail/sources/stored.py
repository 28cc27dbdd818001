"""Stored tables that a batch of new rows changes in the partitions it touches, and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.operators.ingest import supersede
from labtrail.operators.trends import latest_ids
from labtrail.sources.shared import discard, exists, written

#: Partitions of a stored table; a batch lists those it touches, so at most so many numbers come to the driver.
BUCKETS = 64
PLACE = ["experiment_id", "variable", "locator"]


def supersede_stored(batch: DataFrame, target: str, buckets: int = BUCKETS) -> list[int]:
    """Add observations ``(experiment_id, variable, locator, observation_id, extracted_at)`` to the table at ``target``; returns the partitions rewritten.

    Rows of one place share a partition, so only places of the batch's partitions can get another ``superseded_by``; the
    others' files stay as they are. Rows that are there already change nothing, so a batch may run again after a failure. As in
    ``supersede``, rows with a null in their place are left out.
    """
    spark = batch.sparkSession
    own = batch.select(*PLACE, "observation_id", "extracted_at").dropna(subset=PLACE).distinct()
    own = own.withColumn("bucket", F.pmod(F.xxhash64(*PLACE), F.lit(buckets)).cast("int"))
    touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())
    if not touched:
        return []
    rows = own
    if exists(spark, target):
        known = spark.read.schema(own.withColumn("superseded_by", F.col("observation_id")).schema).parquet(target)
        rows = known.where(F.col("bucket").isin(touched)).select(own.columns).unionByName(own).distinct()
    _replace(supersede(rows), target)
    return touched


def extend_chains(links: DataFrame, target: str, buckets: int = BUCKETS) -> list[int]:
    """Add ``links(id, superseded_by)`` to the pointer table at ``target``, which ``pointers`` reads; returns the partitions rewritten.

    A pointer is stored in the partition of the id that it points to: whoever pointed to an id that is superseded now stands in that
    id's partition, and moves to that of the batch's latest. Batches come in order: what a link points to isn't superseded yet by one
    before. A batch may run again after a failure. Links without an id are left out, those without a successor are ends.
    """
    spark = links.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    ids = latest_ids(links.where("id is not null").distinct())
    ends = ids.select("latest").distinct().select(F.col("latest").alias("id"), "latest").join(ids.select("id"), "id", "left_anti")
    new = written(ids.unionByName(ends), "pointers")
    touched = sorted(r["bucket"] for r in new.select(F.explode(F.array(place("id"), place("latest"))).alias("bucket")).distinct().collect())
    if not touched:
        return []
    rows = new
    if exists(spark, target):
        known = spark.read.schema(new.withColumn("bucket", F.lit(0)).schema).parquet(target).where(F.col("bucket").isin(touched)).where("id is not null").select("id", "latest")
        moved = new.where("id != latest").select(F.col("id").alias("old"), F.col("latest").alias("now"))
        kept = known.join(moved, known["latest"] == moved["old"], "left").select("id", F.coalesce("now", "latest").alias("latest"))
        rows = kept.unionByName(new.join(known.select("id"), "id", "left_anti"))
    # A row of nulls for each partition, for one that all pointers have left is replaced too.
    blank = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*(F.lit(None).cast(t).alias(n) for n, t in new.dtypes), "bucket")
    _replace(rows.withColumn("bucket", place("latest")).unionByName(blank), target)
    discard(new)
    return touched


def pointers(spark: SparkSession, target: str) -> DataFrame:
    """``id, latest`` of a pointer table."""
    return spark.read.parquet(target).where("id is not null").select("id", "latest")


def _replace(rows: DataFrame, target: str) -> None:
    """Overwrite the partitions of ``rows``: written apart first, for those that are replaced are those that were read."""
    merged = written(rows, "stored")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
    discard(merged)
