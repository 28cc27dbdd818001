"""Queries of files, narratives, set operations, numbering and dimension checks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labtrail.operators import checks, narratives, numbering, summary
from labtrail.operators import ingest as g
from labtrail.plans import analytics as p
from labtrail.plans import ingest as t
from labtrail.plans import integrity as i
from labtrail.sources import adapters as a
from labtrail.sources import files
from labtrail.sources.shared import shared_dir
from labtrail.streaming import streams


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def a1_scan_delimited(spark, d):
    """Parts as TSV files, read as cells; row numbers follow the writing tasks, so the key stands for them."""
    at = _place(spark, "delimited")
    parts = a.load(spark, d, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat(F.lit(" "), "p_name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise("")).alias("value"), "p_type")
    head = parts.select("p_type").distinct().select(F.lit("Key\tP Name \tBrand").alias("value"), "p_type", F.lit(0).alias("part"))
    lines = head.unionByName(parts.withColumn("part", F.lit(1))).repartition("p_type").sortWithinPartitions("p_type", "part", "value")
    lines.select("value", "p_type").write.partitionBy("p_type").text(at)
    # text files end in .txt: their suffix is given by name
    cells = files.scan_delimited(spark, at, tabbed=True).withColumn("p_type", F.regexp_extract("table_id", "p_type=([^/]*)/", 1))
    return cells.select("p_type", "row_idx", "col_idx", "raw_header", "raw_value")


def a1_quoted_cells(spark, d):
    """Documents as CSV files, one for each source, their texts in quotes with all their line ends, read as cells."""
    at = _place(spark, "quoted")
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    docs = a.load(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), text, "lang").alias("value"), "source", "doc_id")
    head = docs.select("source").distinct().select(F.lit('Id,"The\ntext, whole",Lang').alias("value"), "source", F.lit(-1).cast("long").alias("doc_id"))
    head.unionByName(docs).repartition("source").sortWithinPartitions("source", "doc_id").select("value", "source").write.partitionBy("source").text(at)
    cells = files.scan_delimited(spark, at).withColumn("source", F.regexp_extract("table_id", "source=([^/]*)/", 1))
    return cells.select("source", "row_idx", "col_idx", "raw_header", "raw_value")


def a5_load_dimension(spark, d):
    """A dictionary of the tables' own variables, written as a dimension file and read again."""
    at = _place(spark, "dictionary")
    rows = a.load(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("nominal"))
    rows.select(F.col("event_type").alias("variable"), F.lit("u").alias("unit"), F.lit("float").alias("data_type"), F.array(F.upper("event_type")).alias("synonyms"), "nominal").write.json(at)
    return files.load_dimension(spark, at, "dictionary").select("variable", "unit", "data_type", F.array_join("synonyms", "|").alias("synonyms"), "nominal", "std_dev")


def a6_dossiers(spark, d):
    """Observations written as one dossier an experiment, and read again."""
    at = _place(spark, "dossiers")
    files.write_dossiers(p._rows(spark, d).select("experiment_id", "variable", "observation_id", "run_id", "time_h", "value", "unit"), at)
    return files.read_dossiers(spark, at)


def a7_points(spark, d):
    at = _place(spark, "points")
    files.write_points(p._points(spark, d), at)
    schema = "run_id string, variable string, time_h double, value double, imputed int, experiment_id string"
    return spark.read.schema(schema).option("header", True).csv(at)


def b8_dossier_projection(spark, d):
    own = g.dossier_projection(t._observed(spark, d))
    return own.select("variable", "value", "unit", F.col("confidence.combined").alias("combined"), F.col("source.table_id").alias("table_id"), F.col("source.row_idx").alias("row_idx"), "via")


def b9_active(spark, d):
    e = a.load(spark, d, "events")
    own = g.supersede(e.select(F.lit("EXP-0").alias("experiment_id"), F.col("event_type").alias("variable"), F.col("user_id").alias("locator"), F.col("event_id").alias("observation_id"), F.col("ts").alias("extracted_at")))
    return g.active(own).select("observation_id")


def c2_mapping_columns(spark, d):
    """Brands under the header of names: that header occurs twice, and its last column counts."""
    cells = t._cells(spark, d).withColumn("raw_header", F.when(F.col("raw_header") == "Brand", "P Name").otherwise(F.col("raw_header")))
    heads = g.headers(cells)
    return g.map_headers(heads, a.dictionary(spark)).where("variable is not null").join(heads, ["table_id", "raw_header"]).select("table_id", "raw_header", "variable", "col_idx")


def c3_canonical_units(spark, d):
    obs = t._cells(spark, d).select("table_id", "row_idx", "col_idx", F.when(F.col("col_idx") == 3, "size").when(F.col("col_idx") == 4, "retail_price").otherwise("mass").alias("variable"))
    return g.with_canonical_unit(obs, a.dictionary(spark))


def _items(spark, d):
    """Turns as JSON items: some of an unknown tag, without text, or with fields of other types."""
    c = a.load(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 9
    tags = F.get(F.array(*map(F.lit, (*narratives.TAGS, " Deviation", "gossip", "observation"))), k.cast("int"))
    text = F.when(k == 8, " ").otherwise(F.col("role"))
    names = F.when(k == 1, F.lit('"view"')).when(k == 2, F.lit("null")).otherwise(F.lit('["view", " click ", ""]'))
    item = F.concat(F.lit('{"tag": "'), tags, F.lit('", "text": "'), text, F.lit('", "run_id": '), F.col("conv_id").cast("string"), F.lit(', "time_h": "'), F.when(k == 3, "soon").otherwise(F.col("turn").cast("string")), F.lit('", "confidence": '), F.when(k == 4, '"high"').otherwise("0.9"), F.lit(', "affected_variables": '), names, F.lit("}"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("item_idx"), F.when((F.col("turn") == 5) & (F.col("conv_id") % 2 == 0), "no object").otherwise(item).alias("item"))


def _narratives(spark, d):
    own = narratives.coerce_items(_items(spark, d))
    return own.select(F.concat(F.lit("EXP-"), (F.col("doc_id") % 3).cast("string")).alias("experiment_id"), F.format_string("N-%05d-%02d", "doc_id", "item_idx").alias("narrative_id"), "tag", "run_id", "time_h", "confidence", "affected_variables")


def b18_filter_narratives(spark, d):
    own = narratives.filter_narratives(_narratives(spark, d), tag="deviation", variable="view", limit=20)
    return own.select("experiment_id", "narrative_id", "place", "total", "truncated", F.array_join("tags_present", "|").alias("tags_present"))


def b22_rekey(spark, d):
    c = a.load(spark, d, "conversations")
    old = F.when(F.col("turn") == 0, F.format_string("OLD-7-N-%04d", "conv_id")).when(F.col("turn") == 1, "N-12").otherwise(F.lit(None))
    own = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.lit("EXP-1").alias("experiment_id"), old.alias("narrative_id"))
    return narratives.rekey(own).select("position", "narrative_id")


def g1_all_observations(spark, d):
    prose = t.b24_narrative_observations(spark, d).withColumnRenamed("confidence", "mapping_confidence")
    return g.all_observations(t._observed(spark, d), prose).select("section", "variable", "raw_header", "table_id", "doc_id", "value", "needs_review")


def g2_variables(spark, d):
    """Variables of the specs and of the overrides, once each."""
    own = a.specs(spark).select("variable").unionByName(p._rows(spark, d).where("variable <> 'view'").select("variable"))
    return own.distinct()


def g4_missing_variables(spark, d):
    """The variables with a spec that a run has no values of."""
    have = p._rows(spark, d, "user_id").groupBy("experiment_id", "run_id").agg(F.collect_set("variable").alias("present"))
    required = F.array(*(F.lit(v) for v, *_ in a.SPECS))
    return have.select("experiment_id", "run_id", F.array_join(F.array_except(required, "present"), "|").alias("missing"))


def n1_number(spark, d):
    """Order lines in the order of their dates, numbered for each flag."""
    own = a.load(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = numbering.number_by_range(own, order, ["l_returnflag"])
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.format_string("E-%04d", "seq").alias("id"))


def s1_ingest(spark, d):
    """The documents as a stream of files into an empty table, then once more: the second run adds nothing."""
    at, path = _place(spark, "files"), f"{d}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    rows = stream.where("text is not null").select(F.col("source").alias("experiment_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    for run in "ab":
        streams.ingest_stream(rows, at, f"{at}-{run}").awaitTermination()
    return spark.read.parquet(at).select("experiment_id", "sha256", "file_id")


def _user_specs(spark, d):
    """A spec for each user: their mean, null for one of ten, and their last value less their first as spread."""
    e = a.load(spark, d, "events").groupBy(F.col("user_id").alias("variable")).agg(F.avg("value").alias("mean"), (F.max_by("value", "event_id") - F.min_by("value", "event_id")).alias("std_dev"))
    return e.select("variable", F.when(F.col("variable") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("mean")).alias("nominal"), "std_dev")


def v2_registry(spark, d):
    parts = a.load(spark, d, "part")
    registry = parts.select(F.concat(F.lit("P"), (F.col("p_partkey") % 997).cast("string")).alias("process_id"), F.array(F.upper("p_name")).alias("aliases"), F.array("p_brand").alias("required"), F.array("p_type").alias("forbidden"))
    known = parts.where("p_size > 3").select(F.explode(F.array("p_brand", "p_type")).alias("variable")).where("variable not in ('Brand#2', 'ECONOMY')").distinct()
    return checks.check_registry(registry, known)


def v3_priors(spark, d):
    per = a.load(spark, d, "part").groupBy(F.col("p_brand").alias("organism"), F.col("p_type").alias("variable"))
    own = per.agg(F.min("p_size").cast("double").alias("low"), (F.max("p_size") - 40).cast("double").alias("high"), F.when(F.min("p_partkey") % 3 != 0, "handbook").otherwise(" ").alias("source"))
    return checks.check_priors(own)


def v9_wording(spark, d):
    return checks.check_wording(i._claims(spark, d), ["experiment_id", "claim_id"])


QUERIES = {
    "a1_quoted_cells": a1_quoted_cells,
    "a1_scan_delimited": a1_scan_delimited,
    "a5_load_dimension": a5_load_dimension,
    "a6_dossiers": a6_dossiers,
    "a7_points": a7_points,
    "b8_dossier_projection": b8_dossier_projection,
    "b9_active": b9_active,
    "b18_filter_narratives": b18_filter_narratives,
    "b22_rekey": b22_rekey,
    "c2_mapping_columns": c2_mapping_columns,
    "c3_canonical_units": c3_canonical_units,
    "f1_summary": lambda s, d: summary.split_summary(a.observations(s, d)).where("reason is null").select("run_id", "time_h", "variable", "observation_id").orderBy("run_id", "time_h", "variable", "observation_id"),
    "g1_all_observations": g1_all_observations,
    "g2_variables": g2_variables,
    "g4_missing_variables": g4_missing_variables,
    "g5_tags": lambda s, d: narratives.tags_present(_narratives(s, d)).select("experiment_id", F.array_join("tags_present", "|").alias("tags_present")),
    "h21_narrative_items": lambda s, d: narratives.coerce_items(_items(s, d)).withColumn("affected_variables", F.array_join("affected_variables", "|")),
    "n1_number": n1_number,
    "s1_ingest": s1_ingest,
    "v1_dictionary": lambda s, d: checks.check_dictionary(_user_specs(s, d)),
    "v2_registry": v2_registry,
    "v3_priors": v3_priors,
    "v6_version": lambda s, d: checks.check_version(a.load(s, d, "orders").select(F.col("o_orderkey").alias("output_id"), F.col("o_orderpriority").alias("version")), "5-LOW"),
    "v8_vocabularies": lambda s, d: checks.check_vocabularies(a.load(s, d, "orders").select("o_orderkey", F.lower(F.substring("o_orderpriority", 3, 20)).alias("severity"), "o_orderstatus"), ["o_orderkey"], {"severity": ("urgent", "high", "low"), "o_orderstatus": ("F", "O")}),
    "v9_wording": v9_wording,
}

_TAGS = ", ".join(f"'{x}'" for x in narratives.TAGS)
_ITEMS = f"""WITH k AS (SELECT *, CAST((conv_id + turn) % 9 AS INTEGER) AS k FROM conversations),
 items AS (SELECT conv_id AS doc_id, turn AS item_idx, [{_TAGS}, 'deviation'][k + 1] AS tag, role AS text, printf('RUN-%04d', conv_id) AS run_id, CASE WHEN k <> 3 THEN CAST(turn AS DOUBLE) END AS time_h, CASE WHEN k = 4 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence, CASE k WHEN 1 THEN 'view' WHEN 2 THEN '' ELSE 'view|click' END AS affected_variables FROM k WHERE k < 7 AND NOT (turn = 5 AND conv_id % 2 = 0)),
 narr AS (SELECT *, 'EXP-' || (doc_id % 3) AS experiment_id, printf('N-%05d-%02d', doc_id, item_idx) AS narrative_id FROM items),
 tags AS (SELECT experiment_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags_present FROM narr GROUP BY 1)"""
SQL = {
    "a1_quoted_cells": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx FROM documents)
 SELECT source, row_idx, unnest([{'col_idx': 0, 'raw_header': 'Id', 'raw_value': CAST(doc_id AS VARCHAR)}, {'col_idx': 1, 'raw_header': 'The' || chr(10) || 'text, whole', 'raw_value': nullif(trim(text), '')}, {'col_idx': 2, 'raw_header': 'Lang', 'raw_value': lang}], recursive := true) FROM x""",
    "a1_scan_delimited": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY concat_ws(chr(9), p_partkey, ' ' || p_name, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END)) - 1 AS row_idx FROM part)
 SELECT p_type, row_idx, unnest([{'col_idx': 0, 'raw_header': 'Key', 'raw_value': CAST(p_partkey AS VARCHAR)}, {'col_idx': 1, 'raw_header': 'P Name', 'raw_value': p_name}, {'col_idx': 2, 'raw_header': 'Brand', 'raw_value': CASE WHEN p_partkey % 5 <> 0 THEN p_brand END}], recursive := true) FROM x""",
    "a5_load_dimension": "SELECT event_type AS variable, 'u' AS unit, 'float' AS data_type, upper(event_type) AS synonyms, round(avg(value), 2) AS nominal, CAST(NULL AS DOUBLE) AS std_dev FROM events GROUP BY 1",
    "a6_dossiers": p._BASE + " SELECT experiment_id, variable, observation_id, run_id, time_h, value, unit FROM kept",
    "a7_points": p._PTS + " SELECT experiment_id, run_id, variable, time_h, value, CAST(imputed AS INTEGER) AS imputed FROM points",
    "b8_dossier_projection": t._OBS + " SELECT variable, coalesce(CAST(value AS VARCHAR), value_raw) AS value, unit_canonical AS unit, combined_confidence AS combined, table_id, row_idx, section AS via FROM obs",
    "b9_active": "SELECT event_id AS observation_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
    "b18_filter_narratives": _ITEMS + " SELECT experiment_id, narrative_id, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY narrative_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY experiment_id) AS total, count(*) OVER (PARTITION BY experiment_id) > 20 AS truncated, tags_present FROM narr JOIN tags USING (experiment_id) WHERE tag = 'deviation' AND affected_variables LIKE 'view%' QUALIFY place <= 20",
    "b22_rekey": "SELECT conv_id * 1000 + turn AS position, 'EXP-1-' || printf('N-%04d', CASE turn WHEN 0 THEN conv_id ELSE conv_id * 1000 + turn END) AS narrative_id FROM conversations",
    "c2_mapping_columns": "WITH t AS (SELECT DISTINCT 'part/' || p_type AS table_id FROM part) SELECT * FROM t, (VALUES ('P Name', 'name', 5), ('P Size [mm]', 'size', 3), ('Retail Price (USD):', 'retail_price', 4)) m(raw_header, variable, col_idx)",
    "c3_canonical_units": t._CELLS + " SELECT table_id, row_idx, col_idx, CASE col_idx WHEN 3 THEN 'size' WHEN 4 THEN 'retail_price' ELSE 'mass' END AS variable, CASE col_idx WHEN 3 THEN 'cm' WHEN 4 THEN 'USD' END AS unit_canonical FROM cells",
    "f1_summary": p._BASE + " SELECT run_id, time_h, variable, observation_id FROM kept ORDER BY ALL",
    "g1_all_observations": t._OBS + ", " + t._GATED.removeprefix("WITH ") + " SELECT section, variable, raw_header, table_id, NULL AS doc_id, value, needs_review FROM obs UNION ALL SELECT 'narrative', CASE WHEN doc_id % 2 = 0 THEN 'size' ELSE 'retail_price' END, substr(evidence, 1, 80), NULL, doc_id, NULL, true FROM gated WHERE verdict = 'ok'",
    "g2_variables": p._BASE + " SELECT variable FROM specs UNION SELECT variable FROM kept WHERE variable <> 'view'",
    "g4_missing_variables": p._PTS + ", h AS (SELECT experiment_id, run_id, list(DISTINCT variable) AS present FROM k2 GROUP BY ALL) SELECT experiment_id, run_id, array_to_string(list_filter(['click', 'purchase', 'signup', 'view'], lambda v: NOT list_contains(present, v)), '|') AS missing FROM h",
    "g5_tags": _ITEMS + " SELECT * FROM tags",
    "h21_narrative_items": _ITEMS + " SELECT * FROM items",
    "n1_number": "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, printf('E-%04d', row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS id FROM (SELECT DISTINCT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)",
    "s1_ingest": "SELECT source AS experiment_id, sha256(text) AS sha256, min(doc_id) AS file_id FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "v1_dictionary": "WITH s AS (SELECT user_id AS variable, arg_max(value, event_id) - arg_min(value, event_id) AS sd FROM events GROUP BY 1) SELECT variable, 'nominal_finite' AS rule FROM s WHERE variable % 10 = 0 UNION ALL SELECT variable, 'std_dev_not_negative' FROM s WHERE sd < 0",
    "v2_registry": """WITH r AS (SELECT 'P' || (p_partkey % 997) AS id, lower(p_name) AS alias FROM part), n AS (SELECT p_brand AS v, p_size FROM part UNION ALL SELECT p_type, p_size FROM part)
 SELECT id AS what, 'id_unique' AS rule FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT alias, 'alias_unique' FROM r GROUP BY 1 HAVING count(DISTINCT id) > 1
 UNION ALL SELECT v, 'variable_known' FROM n GROUP BY 1 HAVING v IN ('Brand#2', 'ECONOMY') OR max(p_size) <= 3""",
    "v3_priors": "WITH x AS (SELECT p_brand AS organism, p_type AS variable, min(p_size) > max(p_size) - 40 AS bad, min(p_partkey) % 3 = 0 AS blank FROM part GROUP BY ALL) SELECT organism, variable, 'low_to_high' AS rule FROM x WHERE bad UNION ALL SELECT organism, variable, 'source_present' FROM x WHERE blank",
    "v6_version": "SELECT o_orderkey AS output_id, 'version_current' AS rule FROM orders WHERE o_orderpriority <> '5-LOW'",
    "v8_vocabularies": "SELECT o_orderkey, 'severity_known' AS rule FROM orders WHERE lower(substr(o_orderpriority, 3)) NOT IN ('urgent', 'high', 'low') UNION ALL SELECT o_orderkey, 'o_orderstatus_known' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "v9_wording": i._CLAIMS + " SELECT experiment_id, claim_id, 'no_cause' AS rule FROM claims WHERE seq % 11 = 0",
}
