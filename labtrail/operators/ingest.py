"""From wide tables of text to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators.numbering import number_by_range

#: Dimension tables above so many rows are joined by shuffle, not broadcast.
SMALL = 10_000


def small(dim: DataFrame) -> DataFrame:
    return F.broadcast(dim) if dim.count() <= SMALL else dim


def melt_cells(wide: DataFrame, ids: list[str]) -> DataFrame:
    """``table_id, row_idx, col_idx, raw_header, raw_value`` of a wide table of one header row."""
    names = [c for c in wide.columns if c not in ids]
    cells = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("raw_header"), F.col(f"`{n}`").cast("string").alias("raw_value")) for i, n in enumerate(names)))
    return wide.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*")


def drop_empty(cells: DataFrame) -> DataFrame:
    return cells.where(~S.empty_cell(F.col("raw_value")))


def headers(cells: DataFrame) -> DataFrame:
    """Each table's headers; a header that occurs twice stands for its last column."""
    return cells.groupBy("table_id", "raw_header").agg(F.max("col_idx").alias("col_idx"))


def map_headers(heads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``table_id, raw_header, variable, confidence`` by name or synonym; of two variables with a synonym the later has it."""
    names = F.explode(F.concat(F.array("variable"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    names = dictionary.select("ord", "variable", names.alias("name")).groupBy(F.lower(F.trim("name")).alias("name")).agg(F.max_by("variable", "ord").alias("variable"))
    found = heads.withColumn("name", S.normalize_header(F.col("raw_header"))).join(small(names), "name", "left")
    return found.select("table_id", "raw_header", "variable", F.when(F.col("variable").isNull(), 0.0).otherwise(1.0).alias("confidence"))


def route_columns(mapping: DataFrame, dictionary: DataFrame, heads: DataFrame) -> DataFrame:
    """The mapping with ``route``: ``mapped`` or the first reason against, and what the dictionary and the table say."""
    dim = dictionary.select("variable", F.col("unit").alias("unit_canonical"), "data_type", F.lit(True).alias("known"))
    m = mapping.join(small(dim), "variable", "left").join(heads, ["table_id", "raw_header"], "left")
    route = (
        F.when(F.col("variable").isNull(), "no_mapping")
        .when(S.confidence_band(F.col("confidence")) == "residual", "low_confidence")
        .when(F.col("known").isNull(), "unknown_canonical")
        .when(F.col("unit_canonical").isNull(), "metadata_column_not_observation")
        .when(F.col("col_idx").isNull(), "header_not_in_table")
        .otherwise("mapped")
    )
    return m.withColumn("route", route).select("table_id", "raw_header", "col_idx", "variable", "confidence", "unit_canonical", "data_type", "route")


def table_observations(cells: DataFrame, routed: DataFrame, runs: DataFrame) -> DataFrame:
    """An observation for each filled cell of a mapped column, with the run and the time of its row.

    ``runs`` is ``runs.resolve_runs``: a table's run is a value for all rows, or the cell of a column of the same row.
    Cells and the row's run and time cells meet by (table, row), so that no table is gathered in one task.
    """
    time_col = time_columns(cells)
    places = runs.select("table_id", F.col("col_idx").alias("run_col"), F.col("value").alias("run_value")).join(time_col, "table_id", "left")
    mapped = routed.where("route = 'mapped'").drop("raw_header", "route")
    cells = cells.join(places, "table_id", "left")
    of_row = cells.groupBy("table_id", "row_idx").agg(
        F.max(F.when(F.col("col_idx") == F.col("run_col"), S.run_id(F.col("raw_value")))).alias("cell_run"),
        F.max(F.when(F.col("col_idx") == F.col("time_col"), S.numeric(F.col("raw_value")))).alias("time_h"),
    )
    own = drop_empty(cells).join(mapped, ["table_id", "col_idx"]).join(of_row, ["table_id", "row_idx"])
    extraction = S.extraction_confidence(F.col("raw_value"), F.col("data_type"))
    return own.select(
        "table_id",
        "row_idx",
        "col_idx",
        "raw_header",
        "variable",
        F.col("raw_value").alias("value_raw"),
        S.numeric(F.col("raw_value")).alias("value"),
        S.extract_unit(F.col("raw_header")).alias("unit_raw"),
        "unit_canonical",
        F.coalesce("cell_run", "run_value").alias("run_id"),
        "time_h",
        F.lit("table").alias("section"),
        F.col("confidence").alias("mapping_confidence"),
        extraction.alias("extraction_confidence"),
        combined_confidence(F.col("confidence"), extraction).alias("combined_confidence"),
        (S.confidence_band(F.col("confidence")) == "needs_review").alias("needs_review"),
    )


def narrative_observations(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Observations of prose: the evidence's first 80 characters as header, capped confidence, always to be reviewed."""
    dim = dictionary.select("variable", F.col("unit").alias("unit_canonical"))
    return candidates.join(small(dim), "variable").select("doc_id", "paragraph_idx", "variable", "value", "unit_canonical", F.substring("evidence", 1, 80).alias("raw_header"), F.lit("narrative").alias("section"), F.lit("reported").alias("observation_type"), S.clamp(F.col("confidence").cast("string"), 0.6).alias("confidence"), F.lit(True).alias("needs_review"))


def with_canonical_unit(obs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``unit_canonical`` of each row's variable, null for variables that the dictionary lacks."""
    return obs.join(small(dictionary.select("variable", F.col("unit").alias("unit_canonical"))), "variable", "left")


def time_columns(heads: DataFrame) -> DataFrame:
    """The first time column of each table that has one."""
    return heads.where(S.is_time_header(F.col("raw_header"))).groupBy("table_id").agg(F.min("col_idx").alias("time_col"))


def combined_confidence(mapping: Column, extraction: Column) -> Column:
    """The product, null if either is."""
    return mapping * extraction


def dossier_projection(obs: DataFrame) -> DataFrame:
    """Observations as dossiers hold them: value and unit after conversion, else as written, and nested confidence and source."""
    return obs.select(
        "variable",
        "run_id",
        "time_h",
        F.coalesce(F.col("value").cast("string"), F.col("value_raw")).alias("value"),
        F.coalesce("unit_canonical", "unit_raw").alias("unit"),
        F.struct(F.col("mapping_confidence").alias("mapping"), F.col("extraction_confidence").alias("extraction"), F.col("combined_confidence").alias("combined")).alias("confidence"),
        F.struct("section", "table_id", "row_idx", "col_idx", "raw_header").alias("source"),
        F.col("section").alias("via"),
        "needs_review",
    )


def all_observations(tables: DataFrame, narratives: DataFrame) -> DataFrame:
    """Both kinds together, repeats included; columns that one kind lacks are null there."""
    return tables.unionByName(narratives, allowMissingColumns=True)


def active(obs: DataFrame) -> DataFrame:
    return obs.where("superseded_by is null")


def supersede(obs: DataFrame) -> DataFrame:
    """``superseded_by``: the newest row at the same experiment, variable and place, null on that row itself."""
    key = ["experiment_id", "variable", "locator"]
    newest = obs.groupBy(*key).agg(F.max_by("observation_id", F.struct("extracted_at", "observation_id")).alias("newest"))
    return obs.join(newest, key).withColumn("superseded_by", F.when(F.col("newest") != F.col("observation_id"), F.col("newest"))).drop("newest")


def review_queue(obs: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest active rows that need review."""
    return active(obs).where("needs_review").orderBy("extracted_at", "observation_id").limit(n)


def register_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The first file of each experiment and content that isn't known yet; ``known`` has files of status ok."""
    hashed = files.select("experiment_id", "file_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    first = hashed.groupBy("experiment_id", "sha256").agg(F.min("file_id").alias("file_id"))
    return first.join(known.select("experiment_id", "sha256").distinct(), ["experiment_id", "sha256"], "left_anti")


def table_kinds(routed: DataFrame) -> DataFrame:
    """``table_id, kind``: whether any column of a table is mapped."""
    any_mapped = F.bool_or(F.col("route") == "mapped")
    return routed.groupBy("table_id").agg(F.when(any_mapped, "tables_partial").otherwise("tables_unmapped").alias("kind"))


def residual(routed: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells outside mapped columns, with the reason: of tables without any mapped column, and of partly mapped ones."""
    dim = routed.where("col_idx is not null").select("table_id", "col_idx", "route")
    own = cells.join(dim, ["table_id", "col_idx"], "left").where("route is null or route <> 'mapped'").join(table_kinds(routed), "table_id", "left")
    return own.select("table_id", "row_idx", "col_idx", "raw_header", "raw_value", F.coalesce("kind", F.lit("tables_unmapped")).alias("kind"), F.coalesce("route", F.lit("no_mapping_returned")).alias("reason"))


def whole_residual(routed: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """All that is kept beside observations: the cells of ``residual``, headers of the mapping that their table lacks, and all blocks of prose.

    ``blocks(doc_id, paragraph_idx, text)`` are of kind ``narrative``. Columns that one kind lacks are null there.
    """
    absent = routed.where("col_idx is null").join(table_kinds(routed), "table_id").select("table_id", "raw_header", "kind", F.col("route").alias("reason"))
    prose = blocks.select("doc_id", "paragraph_idx", "text", F.lit("narrative").alias("kind"), F.lit("prose").alias("reason"))
    return residual(routed, cells).unionByName(absent, allowMissingColumns=True).unionByName(prose, allowMissingColumns=True)


def residual_records(rest: DataFrame, blocks: DataFrame) -> DataFrame:
    """``kind, source, idx, content, reason``: whole rows of unmapped tables, unmapped columns of partly mapped ones, and all blocks of prose.

    ``rest`` is ``residual``, ``blocks(doc_id, paragraph_idx, text)``. A row's cells are joined by ``|`` in their order, a
    column stands by its number and header.
    """
    row = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "raw_value"))), lambda c: F.coalesce(c["raw_value"], F.lit("")))
    rows = rest.where("kind = 'tables_unmapped'").groupBy("table_id", "row_idx").agg(F.array_join(row, "|").alias("content"), F.min("reason").alias("reason"))
    columns = rest.where("kind = 'tables_partial'").groupBy("table_id", "col_idx").agg(F.max("raw_header").alias("content"), F.min("reason").alias("reason"))
    out = rows.select(F.lit("tables_unmapped").alias("kind"), F.col("table_id").alias("source"), F.col("row_idx").cast("long").alias("idx"), "content", "reason")
    out = out.unionByName(columns.select(F.lit("tables_partial").alias("kind"), F.col("table_id").alias("source"), F.col("col_idx").cast("long").alias("idx"), "content", "reason"))
    return out.unionByName(blocks.select(F.lit("narrative").alias("kind"), F.col("doc_id").cast("string").alias("source"), F.col("paragraph_idx").cast("long").alias("idx"), F.col("text").alias("content"), F.lit("prose").alias("reason")))


def experiment_residual(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each experiment the unmapped tables, the partly mapped ones and the blocks of prose; ``sources(source, experiment_id)``."""
    own = records.join(sources, "source")
    tables = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("source")))
    return own.groupBy("experiment_id").agg(tables("tables_unmapped").alias("tables_unmapped"), tables("tables_partial").alias("tables_partial"), F.count_if(F.col("kind") == "narrative").alias("narrative_blocks"))


def residual_counts(rest: DataFrame) -> DataFrame:
    return rest.groupBy("table_id", "kind", "reason").agg(F.count("*").alias("n"))


def ingestion_summary(obs: DataFrame, dictionary_size: int, files: DataFrame | None = None) -> DataFrame:
    """Counts of observations by confidence and kind; coverage in per cent of the dictionary, halves to even.

    ``files(table_id, status)`` adds ``n_failed``, how many of them failed; tables of files alone are there too.
    """
    covered = F.count_distinct("variable")
    out = obs.groupBy("table_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("combined_confidence") >= 0.85).alias("high_confidence"),
        F.count_if("needs_review").alias("n_review"),
        F.count_if(F.col("section") == "narrative").alias("n_narrative"),
        F.bround(covered * 100.0 / dictionary_size).cast("long").alias("coverage_pct"),
    )
    if files is None:
        return out
    failed = files.groupBy("table_id").agg(F.count_if(F.col("status") == "failed").alias("n_failed"))
    return out.join(failed, "table_id", "full").fillna(0)


def grouped(obs: DataFrame) -> DataFrame:
    """Observations of each variable of a run, in time order."""
    return obs.groupBy("experiment_id", "run_id", "variable").agg(F.sort_array(F.collect_list(F.struct("time_h", "observation_id", "value"))).alias("observations"))


def grouped_chunks(obs: DataFrame, length: int = 1000) -> DataFrame:
    """``chunk, offset`` and at most ``length`` observations of each variable of a run, in time order: no row grows with its run."""
    key = ["experiment_id", "run_id", "variable"]
    own = number_by_range(obs.select(*key, "time_h", "observation_id", "value"), [F.col("time_h"), F.col("observation_id"), F.col("value")], key, "__seq")
    place = F.floor((F.col("__seq") - 1) / length)
    some = F.sort_array(F.collect_list(F.struct("__seq", "time_h", "observation_id", "value")))
    out = own.groupBy(*key, place.alias("chunk")).agg(some.alias("x"))
    return out.select(*key, "chunk", (F.col("chunk") * length).alias("offset"), F.transform("x", lambda o: F.struct(o["time_h"], o["observation_id"], o["value"])).alias("observations"))


def present_variables(obs: DataFrame) -> DataFrame:
    return obs.groupBy("experiment_id").agg(F.sort_array(F.collect_set("variable")).alias("present"))


def stale_versions(obs: DataFrame, current: str) -> DataFrame:
    """Schema versions other than the current one, sorted."""
    return obs.groupBy("experiment_id").agg(F.sort_array(F.collect_set(F.when(F.col("schema_version") != current, F.col("schema_version")))).alias("stale"))
