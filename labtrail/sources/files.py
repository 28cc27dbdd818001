"""Readers and writers of the engine's files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.operators import scans
from labtrail.operators.numbering import number, number_by_range
from labtrail.operators.series import KEY

#: Schemas of the dimension files: JSON, one object a line.
DIMENSIONS = {
    "dictionary": "ord int, variable string, unit string, data_type string, synonyms array<string>, nominal double, std_dev double",
    "registry": "process_id string, aliases array<string>, required array<string>, forbidden array<string>, strong array<string>",
    "priors": "organism string, aliases array<string>, variable string, low double, high double, source string",
    "manifest": "table_id string, run_id string",
}
DOSSIER = "experiment_id string, golden_columns map<string, struct<observations: array<struct<observation_id: string, run_id: string, time_h: double, value: double, unit: string>>>>"


def load_dimension(spark: SparkSession, path: str | None, kind: str, variable: str | None = None, default: str | None = None) -> DataFrame:
    """The file that is given, else the one that an environment variable names, else the default."""
    found = path or (os.environ.get(variable) if variable else None) or default
    if not found:
        raise ValueError(f"no file for the {kind}")
    return spark.read.schema(DIMENSIONS[kind]).json(found)


def scan_delimited(spark: SparkSession, path: str, tabbed: bool | None = None) -> DataFrame:
    """``table_id, row_idx, col_idx, raw_header, raw_value`` of every CSV or TSV file that ``path`` names: by suffix, unless ``tabbed`` says.

    Cells stay text, trimmed, null if blank. Lines are read as text, so files of different headers are one scan and a large file is
    read in blocks; rows are numbered from 0 by their order in the file. Quoted cells of CSV files may hold the delimiter, doubled
    quotes and line ends (``\\n`` in the cell, whatever the file has): a line starts a row if an even number of quotes comes before it in its file,
    counted in blocks and carried from block to block. In a file whose quotes are odd in number each line is a row. Blank lines
    between rows are none; a row is one value, so it must fit a task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("table_id"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value")
    by_tab = F.lower("table_id").endswith(".tsv") if tabbed is None else F.lit(tabbed)
    lines = _whole_rows(lines, by_tab).where("trim(value) <> ''")
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    cells = F.when(by_tab, F.split("value", "\t")).otherwise(quoted)
    rows = lines.select("table_id", "at", F.transform(cells, lambda c: F.nullif(F.trim(c), F.lit(""))).alias("cells"))
    heads = rows.groupBy("table_id").agg(F.min(F.struct("at", "cells")).alias("h")).select("table_id", F.col("h.at").alias("head_at"), F.col("h.cells").alias("heads"))
    body = rows.join(heads, "table_id").where(F.col("at") > F.col("head_at"))
    # Lines are ordered within stretches of a block, so that no file is ordered in one task.
    body = number(body, [F.col("at")], ["table_id"], F.struct("at.block", F.shiftright("at.line", 16)), "row_idx")
    out = body.select("table_id", (F.col("row_idx") - 1).alias("row_idx"), "heads", F.posexplode("cells").alias("col_idx", "raw_value"))
    return out.select("table_id", "row_idx", "col_idx", F.get("heads", F.col("col_idx")).alias("raw_header"), "raw_value")


def _whole_rows(lines: DataFrame, by_tab: Column) -> DataFrame:
    """Lines of ``lines(table_id, at, value)`` to rows that may go over several of them, ``at`` being the first one's."""
    own = lines.withColumn("quotes", F.when(by_tab, 0).otherwise(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))
    odd = own.groupBy("table_id").agg((F.sum("quotes") % 2 == 1).alias("odd"))
    own = own.join(odd, "table_id").withColumn("quotes", F.when(F.col("odd"), 0).otherwise(F.col("quotes")))
    stretch = F.struct("at.block", F.shiftright("at.line", 16))
    own = scans.summed_before(own, ["table_id"], "at", stretch, "quotes", "before").withColumn("start", F.when(F.col("before") % 2 == 0, F.col("at")))
    own = scans.carried(own, ["table_id"], "at", stretch, "start", "first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    return own.groupBy("table_id", F.col("first").alias("at")).agg(text.alias("value"))


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    """Observations of nested dossiers, in one object for each experiment or in parts; columns that hold no object are passed over."""
    d = spark.read.schema(DOSSIER).json(path)
    per = d.select("experiment_id", F.explode("golden_columns").alias("variable", "c")).where("c is not null")
    return per.select("experiment_id", "variable", F.explode("c.observations").alias("o")).select("experiment_id", "variable", "o.*")


def write_dossiers(obs: DataFrame, path: str, part_rows: int = 10_000) -> None:
    """JSON objects of an experiment, a variable and at most ``part_rows`` of its observations in time order; a dossier is all objects of its experiment."""
    order = [F.col(c) for c in ("time_h", "observation_id", "run_id", "value", "unit")]
    own = number_by_range(obs, order, ["experiment_id", "variable"], "__seq")
    o = F.sort_array(F.collect_list(F.struct(*order)))
    per = own.groupBy("experiment_id", "variable", F.floor((F.col("__seq") - 1) / part_rows).alias("__part")).agg(o.alias("observations"))
    per.select("experiment_id", F.create_map("variable", F.struct("observations")).alias("golden_columns")).write.json(path)


def write_extras(residual: DataFrame, source_files: DataFrame, path: str, part_rows: int = 10_000) -> None:
    """The rest of the dossiers: JSON objects of an experiment and about ``part_rows`` of its residual records, or of its source files.

    ``residual(experiment_id, kind, source, idx, content, reason)``, ``source_files(experiment_id, file_id, status)``.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(c for c in df.columns if c != "experiment_id"))
        number_of = df.groupBy("experiment_id").agg(F.ceil(F.count("*") / part_rows).alias("__parts"))
        dealt = df.join(number_of, "experiment_id").withColumn("__part", F.pmod(F.xxhash64(row), F.col("__parts")))
        return dealt.groupBy("experiment_id", "__part").agg(F.sort_array(F.collect_list(row)).alias(name)).drop("__part")

    parts(residual, "residual").unionByName(parts(source_files, "source_files"), allowMissingColumns=True).write.json(path)


def read_extras(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Residual records and source files of dossiers."""
    d = spark.read.schema("experiment_id string, residual array<struct<kind: string, source: string, idx: long, content: string, reason: string>>, source_files array<struct<file_id: string, status: string>>").json(path)
    return d.select("experiment_id", F.inline("residual")), d.select("experiment_id", F.inline("source_files"))


def write_points(points: DataFrame, path: str) -> None:
    """The long series file, one folder for each experiment; imputed is 0 or 1, a missing value is empty, ``unit`` comes last where ``points`` have it."""
    unit = [c for c in ("unit",) if c in points.columns]
    points.select(*KEY, "time_h", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.col("imputed").cast("int").alias("imputed"), *unit).write.partitionBy("experiment_id").option("header", True).csv(path)
