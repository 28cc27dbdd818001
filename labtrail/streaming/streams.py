"""Structured Streaming forms of ingest and of the range check."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from labtrail.operators import findings, summary
from labtrail.sources.shared import exists

#: Hexadecimal digits of the hash that partition the files already seen.
PREFIX = 2


def range_stream(observations: DataFrame, specs: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Violations of each run and variable in tumbling windows of ``event_time``; rows later than ``late`` are left out."""
    rows = summary.with_specs(observations.withWatermark("event_time", late), specs)
    return findings.violations(rows).groupBy(F.window("event_time", window).alias("w"), "experiment_id", "run_id", "variable").agg(F.count("*").alias("n_violations")).select(F.col("w.start").alias("window_start"), "experiment_id", "run_id", "variable", "n_violations")


def ingest_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append files whose (experiment_id, content hash) ``target`` doesn't hold yet; runs over what is there, then ends.

    A batch that runs again after a failure finds its rows in ``target`` and adds none twice. ``target`` is partitioned by
    the first digits of the hash, and a batch reads the partitions of its own hashes alone.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
        first = hashed.groupBy("experiment_id", "sha256").agg(F.min("file_id").alias("file_id"))
        first = first.withColumn("prefix", F.substring("sha256", 1, PREFIX)).persist()
        if exists(spark, target):
            own = [r["prefix"] for r in first.select("prefix").distinct().collect()]  # at most 16 ** PREFIX
            known = spark.read.schema(first.schema).parquet(target).where(F.col("prefix").isin(own))
            first.join(known, ["experiment_id", "sha256"], "left_anti").write.mode("append").partitionBy("prefix").parquet(target)
        else:
            first.write.partitionBy("prefix").parquet(target)
        first.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A row of the roll-up stream: a violation as it is, a group's roll-up so far, or a late row.
ROLLED = "kind string, experiment_id string, run_id string, variable string, observation_id string, event_time timestamp, sigmas double, n_violations long, max_abs_sigmas double, t_start timestamp, t_end timestamp"


def rollup_stream(observations: DataFrame, specs: DataFrame, threshold: int = 100, late: str = "1 hour") -> DataFrame:
    """Violations as a stream of ``kind``: ``single`` until a run and variable has more than ``threshold`` of them, ``rollup`` from then on.

    A group's state is five numbers. Its roll-up comes anew with every batch that adds to it, with the count, the largest
    deviation and the ends in time of all its violations so far; ``settled`` keeps the last. Rows older than the watermark when their batch
    begins come as ``late``, and count in nothing. Each group's rows go through one task, a few thousand at a time.
    """
    rows = findings.violations(summary.with_specs(observations.withWatermark("event_time", late), specs))
    rows = rows.select("experiment_id", "run_id", "variable", "observation_id", "event_time", "sigmas")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, most, first, last = state.get if state.exists else (0, 0.0, None, None)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        grew = False
        for part in parts:
            old = part["event_time"] < mark
            own = part[~old].sort_values(["event_time", "observation_id"])
            out = part[old].assign(kind="late")
            room = max(0, threshold - n)
            if len(own):
                n, most, grew = n + len(own), max(most, float(own["sigmas"].abs().max())), True
                lo, hi = own["event_time"].min().value // 1000, own["event_time"].max().value // 1000
                first, last = min(lo, lo if first is None else first), max(hi, hi if last is None else last)
            yield pd.concat([out, own.head(room).assign(kind="single")]).reindex(columns=_NAMES)
        if grew:
            state.update((n, most, first, last))
            if n > threshold:
                ends = [pd.Timestamp(x, unit="us") for x in (first, last)]
                yield pd.DataFrame([("rollup", *key, None, None, None, n, most, *ends)], columns=_NAMES)

    state = "n long, most double, first long, last long"
    return rows.groupBy("experiment_id", "run_id", "variable").applyInPandasWithState(fold, ROLLED, state, "append", "NoTimeout")


_NAMES = [c.split()[0] for c in ROLLED.split(", ")]


def settled(rows: DataFrame) -> DataFrame:
    """What ``rollup_stream`` has told so far: each group's last roll-up, and the single violations of groups without one."""
    key = ["experiment_id", "run_id", "variable"]
    last = rows.where("kind = 'rollup'").groupBy(*key).agg(F.max_by(F.struct("n_violations", "max_abs_sigmas", "t_start", "t_end"), "n_violations").alias("r")).select(*key, "r.*")
    few = rows.where("kind = 'single'").join(last, key, "left_anti")
    single = few.select(*key, F.lit(1).cast("long").alias("n_violations"), F.abs("sigmas").alias("max_abs_sigmas"), F.col("event_time").alias("t_start"), F.col("event_time").alias("t_end"), "observation_id")
    return single.unionByName(last.withColumn("observation_id", F.lit(None).cast("string")))
