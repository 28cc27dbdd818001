"""Queries of ingest over ``part``, ``documents``, ``events`` and ``lineitem``, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators import ingest as g
from labtrail.operators import prose, runs, units
from labtrail.sources import adapters as a
from labtrail.sources import stored
from labtrail.sources.shared import shared_dir


def _cells(spark, d):
    return g.melt_cells(a.wide_parts(spark, d), ["table_id", "row_idx"])


def _mapping(spark, d):
    return g.map_headers(g.headers(_cells(spark, d)), a.dictionary(spark))


def _routed(spark, d):
    """What names say, but for three columns: one of an unknown variable, one of low confidence, one that no table has."""
    by_name = _mapping(spark, d).where("raw_header not in ('Brand', 'Time (h)')")
    more = F.explode(F.array(*(F.struct(F.lit(h).alias("raw_header"), F.lit(v).alias("variable"), F.lit(c).alias("confidence")) for h, v, c in (("Brand", "mass", 0.9), ("Time (h)", "size", 0.4), ("Ghost", "size", 0.9)))))
    more = by_name.select("table_id").distinct().select("table_id", more.alias("m")).select("table_id", "m.*")
    return g.route_columns(by_name.unionByName(more), a.dictionary(spark), g.headers(_cells(spark, d)))


def _tables(spark, d):
    return _cells(spark, d).select("table_id").distinct().withColumn("filename", F.when(F.length("table_id") % 2 == 0, F.concat("table_id", F.lit("_run7.csv"))).otherwise(F.concat("table_id", F.lit(" x.csv"))))


def _picked(spark, d):
    return runs.pick_run_column(runs.profile_columns(_cells(spark, d)))


def _resolved(spark, d):
    return runs.resolve_runs(_tables(spark, d), _picked(spark, d))


def _observed(spark, d):
    return g.table_observations(_cells(spark, d), _routed(spark, d), _resolved(spark, d))


def _blocks(spark, d):
    return prose.narrative_blocks(a.load(spark, d, "documents"))


def _gated(spark, d):
    b = _blocks(spark, d)
    return prose.gate_evidence(a.evidence_candidates(b), b)


def a4_register_files(spark, d):
    docs = a.load(spark, d, "documents")
    files = docs.select(F.col("source").alias("experiment_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    known = docs.where("n_chars < 300").select(F.col("source").alias("experiment_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return g.register_files(files, known)


def a11_residual(spark, d):
    """All three kinds: no column of some tables is mapped, some columns of the others, and every block of prose."""
    routed = _routed(spark, d)
    none = (F.length("table_id") % 5 == 0) & (F.col("route") == "mapped")
    return g.whole_residual(routed.withColumn("route", F.when(none, "low_confidence").otherwise(F.col("route"))), _cells(spark, d), _blocks(spark, d))


def c7_convert(spark, d):
    raw = F.get(F.array(*map(F.lit, ("mg/mL", "kg/m^3", "g L^-1", "µg/mL of pellet", "OD600", "flerbs", "degF"))), F.col("l_linenumber") - 1)
    obs = a.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"), raw.alias("unit_raw"), F.when(F.col("l_linenumber") == 7, "degC").otherwise("g/L").alias("unit_canonical"))
    return units.convert(obs).withColumn("converted", F.round("converted", 6))


def c10_narrative_dedup(spark, d):
    """Table values are the events of even users; prose repeats all events' values, some of them slightly off."""
    e = a.load(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("file_id"), F.col("event_type").alias("variable"), "value", "user_id")
    prose_values = e.select("event_id", "file_id", "variable", (F.col("value") * (1 + F.col("event_id") % 5 * 0.0004)).alias("value"))
    return prose.drop_table_duplicates(prose_values, e.where("user_id % 2 = 0")).select("event_id", "file_id", "variable")


def c19_supersede(spark, d):
    e = a.load(spark, d, "events")
    locator = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return g.supersede(e.select(F.lit("EXP-0").alias("experiment_id"), F.col("event_type").alias("variable"), locator.alias("locator"), F.col("event_id").alias("observation_id"), F.col("ts").alias("extracted_at"))).select("observation_id", "superseded_by")


def c19_stored(spark, d):
    """The events of c19 in two batches, before and after a date, kept in a stored table."""
    e = a.load(spark, d, "events")
    locator = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    rows = e.select(F.lit("EXP-0").alias("experiment_id"), F.col("event_type").alias("variable"), locator.alias("locator"), F.col("event_id").alias("observation_id"), F.col("ts").alias("extracted_at"))
    at = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    early = F.hour("extracted_at") < 12
    for batch in (rows.where(early), rows.where(~early)):
        stored.supersede_stored(batch, at, 16)
    return spark.read.parquet(at).select("observation_id", "superseded_by")


def f5_review_queue(spark, d):
    e = a.load(spark, d, "events")
    return g.review_queue(e.select(F.col("event_id").alias("observation_id"), F.col("ts").alias("extracted_at"), F.lit(None).cast("long").alias("superseded_by"), (F.col("value") > 100).alias("needs_review")), 50).select("observation_id")


def b24_narrative_observations(spark, d):
    ok = _gated(spark, d).where("verdict = 'ok'").withColumn("variable", F.when(F.col("doc_id") % 2 == 0, "size").otherwise("retail_price")).withColumn("confidence", F.lit(0.95))
    return g.narrative_observations(ok, a.dictionary(spark)).drop("value")


def d1_chunks(spark, d):
    obs = a.observations(spark, d).where("run_id is not null and value is not null")
    text = F.array_join("observations.observation_id", "|")
    return g.grouped_chunks(obs, 50).select("experiment_id", "run_id", "variable", "chunk", "offset", F.size("observations").alias("n"), text.alias("ids"), F.array_join(F.transform("observations.value", lambda x: F.round(x * 100).cast("long").cast("string")), "|").alias("cents"))


def d1_grouped(spark, d):
    obs = a.observations(spark, d).where("run_id is not null and value is not null")
    return g.grouped(obs).select("experiment_id", "run_id", "variable", F.size("observations").alias("n"), F.array_join("observations.observation_id", "|").alias("ids"))


def d4_stale_versions(spark, d):
    obs = a.load(spark, d, "orders").select(F.col("o_orderstatus").alias("experiment_id"), F.col("o_orderpriority").alias("schema_version"))
    return g.stale_versions(obs, "5-LOW").select("experiment_id", F.array_join("stale", "|").alias("stale"))


QUERIES = {
    "a2_melt_cells": _cells,
    "a3_narrative_blocks": _blocks,
    "a4_register_files": a4_register_files,
    "a11_cells": lambda s, d: g.residual(_routed(s, d), _cells(s, d)),
    "a11_residual": a11_residual,
    "b1_filled_cells": lambda s, d: g.drop_empty(_cells(s, d)),
    "b3_route_columns": _routed,
    "b23_table_observations": _observed,
    "b24_narrative_observations": b24_narrative_observations,
    "c1_map_headers": _mapping,
    "c7_convert": c7_convert,
    "c10_narrative_dedup": c10_narrative_dedup,
    "c11_gate_evidence": lambda s, d: _gated(s, d).select("doc_id", "paragraph_idx", "verdict"),
    "c19_stored": c19_stored,
    "c19_supersede": c19_supersede,
    "d1_chunks": d1_chunks,
    "d1_grouped": d1_grouped,
    "d2_ingestion_summary": lambda s, d: g.ingestion_summary(_observed(s, d), len(a.DICTIONARY)),
    "d3_residual_counts": lambda s, d: g.residual_counts(g.residual(_routed(s, d), _cells(s, d))),
    "d4_stale_versions": d4_stale_versions,
    "d5_present_variables": lambda s, d: g.present_variables(a.observations(s, d)).withColumn("present", F.array_join("present", "|")),
    "d14_gate_stats": lambda s, d: prose.gate_stats(_gated(s, d)),
    "d15_profile_columns": lambda s, d: runs.profile_columns(_cells(s, d)),
    "e5_pick_run_column": _picked,
    "h12_resolve_runs": _resolved,
    "e6_dedup_text": lambda s, d: prose.dedup_text(_blocks(s, d)).select("doc_id", "paragraph_idx", "place"),
    "e7_chunk": lambda s, d: prose.chunk(_blocks(s, d)).select("doc_id", "paragraph_idx", "chunk"),
    "e8_char_budget": lambda s, d: prose.char_budget(_blocks(s, d), 2000).select("doc_id", "paragraph_idx", "upto", "truncated"),
    "f5_review_queue": f5_review_queue,
    "h17_causal_phrases": lambda s, d: a.load(s, d, "documents").select("doc_id", F.size(S.causal_phrases(F.coalesce("text", F.lit("")))).alias("n_phrases")),
}

_CELLS = "WITH " + a.CELLS_SQL
_FILLED = " raw_value IS NOT NULL AND lower(trim(raw_value)) NOT IN ('', 'nan')"
_NUM = r"CASE WHEN regexp_full_match(raw_value, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(trim(raw_value) AS DOUBLE) END"
_MAP = _CELLS + """, heads AS (SELECT table_id, raw_header, max(col_idx) AS col_idx FROM cells GROUP BY ALL),
 named AS (SELECT *, lower(trim(rtrim(trim(regexp_replace(CASE WHEN raw_header LIKE '%(%' AND raw_header LIKE '%)%' THEN regexp_replace(raw_header, '[(].*', '') ELSE raw_header END, '[[].*', '')), ':'))) AS norm FROM heads),
 dict(variable, unit, data_type) AS (VALUES ('size', 'cm', 'float'), ('list_price', 'EUR', 'float'), ('retail_price', 'USD', 'float'), ('name', NULL, 'string')),
 syn(norm, variable) AS (VALUES ('p size', 'size'), ('size', 'size'), ('price', 'list_price'), ('list_price', 'list_price'), ('retail price', 'retail_price'), ('retail_price', 'retail_price'), ('p name', 'name'), ('name', 'name')),
 mapping AS (SELECT table_id, raw_header, variable, CASE WHEN variable IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS confidence FROM named LEFT JOIN syn USING (norm))"""
_ROUTE = _MAP + """, m2 AS (SELECT * FROM mapping WHERE raw_header NOT IN ('Brand', 'Time (h)') UNION ALL SELECT t.*, x.* FROM (SELECT DISTINCT table_id FROM cells) t, (VALUES ('Brand', 'mass', 0.9::DOUBLE), ('Time (h)', 'size', 0.4::DOUBLE), ('Ghost', 'size', 0.9::DOUBLE)) x),
 routed AS (SELECT table_id, raw_header, col_idx, variable, confidence, unit AS unit_canonical, data_type, CASE WHEN variable IS NULL THEN 'no_mapping' WHEN confidence < 0.6 THEN 'low_confidence' WHEN data_type IS NULL THEN 'unknown_canonical' WHEN unit IS NULL THEN 'metadata_column_not_observation' WHEN col_idx IS NULL THEN 'header_not_in_table' ELSE 'mapped' END AS route FROM m2 LEFT JOIN dict USING (variable) LEFT JOIN heads USING (table_id, raw_header))"""
_REST = _ROUTE + """, rest AS (SELECT table_id, row_idx, cells.col_idx, cells.raw_header, raw_value, 'tables_partial' AS kind, coalesce(route, 'no_mapping_returned') AS reason FROM cells LEFT JOIN routed USING (table_id, col_idx) WHERE route IS NULL OR route <> 'mapped')"""
_PROFILE = r""", v0 AS (SELECT *, CASE WHEN regexp_full_match(raw_value, '\d+') THEN printf('RUN-%04d', CAST(raw_value AS BIGINT)) WHEN regexp_full_match(raw_value, '\d+\.0') THEN printf('RUN-%04d', CAST(CAST(raw_value AS DOUBLE) AS BIGINT)) ELSE trim(raw_value) END AS v FROM cells WHERE""" + _FILLED + r"""),
 ch AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) <> v, false) AS changed FROM v0),
 prof AS (SELECT table_id, col_idx, count(*) AS n_filled, CAST(sum(CAST(changed AS INTEGER)) AS BIGINT) AS transitions, max(raw_header) AS raw_header, count(DISTINCT v) AS n_distinct, count(DISTINCT v) FILTER (regexp_full_match(v, '\d*\.\d+')) AS n_decimal, bool_and(v LIKE 'RUN-%') AS all_runs, CAST(max(length(v)) AS INTEGER) AS longest, CAST(min(length(v)) AS INTEGER) AS shortest FROM ch GROUP BY ALL),
 hinted AS (SELECT *, regexp_matches(lower(raw_header), 'batch|run|trial') AS hint, CAST(transitions AS DOUBLE) / n_distinct AS ratio FROM prof),
 scored AS (SELECT *, CASE WHEN n_filled < 4 OR n_distinct < 2 OR n_distinct > 100 OR transitions = 0 OR (NOT hint AND (n_decimal >= greatest(1, n_distinct // 2) OR NOT (all_runs OR (longest <= 20 AND longest - shortest <= 4)) OR ratio > 1.5)) THEN CAST(0 AS DOUBLE) ELSE CAST(CASE WHEN n_distinct <= 50 THEN n_distinct ELSE 0 END AS DOUBLE) + greatest(0, 5 - ratio) + CASE WHEN hint THEN CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS score FROM hinted),
 picked AS (SELECT table_id, col_idx, score, least(CAST(0.95 AS DOUBLE), CAST(0.5 AS DOUBLE) + score / 10) AS confidence FROM scored WHERE score > 0 AND raw_header <> 'Time (h)' QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY score DESC, col_idx) = 1),
 resolved AS (SELECT table_id, CASE WHEN col_idx IS NOT NULL THEN 'column' WHEN length(table_id) % 2 = 0 THEN 'filename' ELSE 'synthetic' END AS strategy, col_idx, CASE WHEN col_idx IS NULL THEN CASE WHEN length(table_id) % 2 = 0 THEN 'RUN-0007' ELSE 'RUN-FROM-' || regexp_replace(regexp_replace(table_id, '.*/', ''), '[^A-Za-z0-9_-]', '_', 'g') || '_x' END END AS value, CASE WHEN col_idx IS NOT NULL THEN confidence WHEN length(table_id) % 2 = 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN picked USING (table_id))"""
_OBS = _ROUTE + _PROFILE + rf""", of_row AS (SELECT row_idx, table_id, max(CASE WHEN raw_header = 'Time (h)' THEN CAST(raw_value AS DOUBLE) END) AS time_h, max(CASE WHEN cells.col_idx = resolved.col_idx AND {_FILLED} THEN CASE WHEN regexp_full_match(raw_value, '\d+(\.0)?') THEN printf('RUN-%04d', CAST(CAST(raw_value AS DOUBLE) AS BIGINT)) ELSE trim(raw_value) END END) AS cell_run, max(value) AS run_value FROM cells JOIN resolved USING (table_id) GROUP BY ALL),
 num AS (SELECT *, {_NUM} AS x FROM cells WHERE {_FILLED}),
 obs AS (SELECT table_id, row_idx, num.col_idx, num.raw_header, variable, raw_value AS value_raw, x AS value, CASE num.col_idx WHEN 3 THEN 'mm' ELSE 'USD' END AS unit_raw, unit_canonical, coalesce(cell_run, run_value) AS run_id, time_h, 'table' AS section, confidence AS mapping_confidence, CASE WHEN x IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS extraction_confidence, confidence * CASE WHEN x IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS combined_confidence, confidence < 0.85 AS needs_review FROM num JOIN routed USING (table_id, col_idx) JOIN of_row USING (table_id, row_idx) WHERE route = 'mapped')"""
_BLOCKS = r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS paragraph_idx FROM documents),
 blocks AS (SELECT doc_id, paragraph_idx, trim(line) AS text FROM lines WHERE length(trim(line)) >= 20)"""
_WHOLE = _ROUTE + _BLOCKS.replace("WITH ", ", ", 1) + """, own AS (SELECT * REPLACE (CASE WHEN route = 'mapped' AND length(table_id) % 5 = 0 THEN 'low_confidence' ELSE route END AS route) FROM routed),
 kinds AS (SELECT table_id, CASE WHEN bool_or(route = 'mapped') THEN 'tables_partial' ELSE 'tables_unmapped' END AS kind FROM own GROUP BY 1),
 rest AS (SELECT table_id, row_idx, cells.col_idx, cells.raw_header, raw_value, coalesce(route, 'no_mapping_returned') AS reason FROM cells LEFT JOIN own USING (table_id, col_idx) WHERE route IS NULL OR route <> 'mapped' UNION ALL SELECT table_id, NULL, NULL, raw_header, NULL, route FROM own WHERE col_idx IS NULL)
 SELECT table_id, row_idx, col_idx, raw_header, raw_value, coalesce(kind, 'tables_unmapped') AS kind, reason, NULL::BIGINT AS doc_id, NULL::INTEGER AS paragraph_idx, NULL::VARCHAR AS text FROM rest LEFT JOIN kinds USING (table_id) UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'narrative', 'prose', doc_id, paragraph_idx, text FROM blocks"""
_GATED = _BLOCKS + r""", cand AS (SELECT doc_id, paragraph_idx, text, CASE WHEN doc_id % 4 = 0 THEN array_to_string(list_reverse(string_split(substr(text, 3, 40), '')), '') ELSE substr(text, 3, 40) END AS evidence, doc_id % 3 = 0 AS valued FROM blocks),
 gated AS (SELECT doc_id, paragraph_idx, evidence, CASE WHEN trim(evidence) = '' THEN 'empty' WHEN NOT contains(text, evidence) THEN 'not_in_source' WHEN valued AND NOT contains(evidence, '7') THEN 'value_missing' WHEN length(regexp_replace(evidence, '[^.!?]', '', 'g')) > 2 THEN 'too_many_sentences' ELSE 'ok' END AS verdict FROM cand)"""
_OBS_EVENTS = f"WITH {a.OBS_SQL.format(run='user_id % 10')}"
SQL = {
    "a2_melt_cells": _CELLS + " SELECT * FROM cells",
    "a3_narrative_blocks": _BLOCKS + " SELECT * FROM blocks",
    "a4_register_files": "SELECT source AS experiment_id, sha256(text) AS sha256, min(doc_id) AS file_id FROM documents d WHERE NOT EXISTS (FROM documents k WHERE k.n_chars < 300 AND k.source = d.source AND k.text = d.text) GROUP BY ALL",
    "a11_cells": _REST + " SELECT * FROM rest",
    "a11_residual": _WHOLE,
    "b1_filled_cells": _CELLS + " SELECT * FROM cells WHERE" + _FILLED,
    "b3_route_columns": _ROUTE + " SELECT * FROM routed",
    "b23_table_observations": _OBS + " SELECT * FROM obs",
    "b24_narrative_observations": _GATED + " SELECT doc_id, paragraph_idx, CASE WHEN doc_id % 2 = 0 THEN 'size' ELSE 'retail_price' END AS variable, CASE WHEN doc_id % 2 = 0 THEN 'cm' ELSE 'USD' END AS unit_canonical, substr(evidence, 1, 80) AS raw_header, 'narrative' AS section, 'reported' AS observation_type, CAST(0.85 AS DOUBLE) AS confidence, true AS needs_review FROM gated WHERE verdict = 'ok'",
    "c1_map_headers": _MAP + " SELECT * FROM mapping",
    "c7_convert": """SELECT l_orderkey, l_linenumber, l_quantity AS value, ['mg/mL', 'kg/m^3', 'g L^-1', 'µg/mL of pellet', 'OD600', 'flerbs', 'degF'][l_linenumber] AS unit_raw, CASE WHEN l_linenumber = 7 THEN 'degC' ELSE 'g/L' END AS unit_canonical,
 CASE WHEN l_linenumber = 5 THEN 'identity' WHEN l_linenumber = 6 THEN 'failed' ELSE 'converted' END AS status, round(CASE WHEN l_linenumber = 4 THEN l_quantity / 1000 WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN (l_quantity - 32) / 1.8 ELSE l_quantity END, 6) AS converted FROM lineitem""",
    "c10_narrative_dedup": """WITH p AS (SELECT event_id, user_id % 7 AS file_id, event_type AS variable, value * (1 + (event_id % 5) * CAST(0.0004 AS DOUBLE)) AS value FROM events), t AS (SELECT user_id % 7 AS file_id, event_type AS variable, value AS k FROM events WHERE user_id % 2 = 0)
 SELECT event_id, file_id, variable FROM p WHERE NOT EXISTS (FROM t WHERE t.file_id = p.file_id AND t.variable = p.variable AND abs(p.value - k) / greatest(abs(p.value), abs(k), 1.0) <= CAST(0.001 AS DOUBLE))""",
    "c11_gate_evidence": _GATED + " SELECT doc_id, paragraph_idx, verdict FROM gated",
    "c19_stored": "SELECT event_id AS observation_id, nullif(last_value(event_id) OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), event_id) AS superseded_by FROM events",
    "c19_supersede": "SELECT event_id AS observation_id, nullif(last_value(event_id) OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), event_id) AS superseded_by FROM events",
    "d1_chunks": _OBS_EVENTS + ", o AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, run_id, variable ORDER BY time_h, observation_id) - 1 AS k FROM obs WHERE run_id IS NOT NULL AND value IS NOT NULL) SELECT experiment_id, run_id, variable, k // 50 AS chunk, min(k) AS offset, CAST(count(*) AS INTEGER) AS n, string_agg(observation_id, '|' ORDER BY k) AS ids, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY k) AS cents FROM o GROUP BY experiment_id, run_id, variable, k // 50",
    "d1_grouped": _OBS_EVENTS + " SELECT experiment_id, run_id, variable, CAST(count(*) AS INTEGER) AS n, string_agg(observation_id, '|' ORDER BY time_h, observation_id) AS ids FROM obs WHERE run_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL",
    "d2_ingestion_summary": _OBS + " SELECT table_id, count(*) AS total, count(*) FILTER (combined_confidence >= 0.85) AS high_confidence, count(*) FILTER (needs_review) AS n_review, CAST(0 AS BIGINT) AS n_narrative, CAST(round_even(count(DISTINCT variable) * 100.0 / 4, 0) AS BIGINT) AS coverage_pct FROM obs GROUP BY 1",
    "d3_residual_counts": _REST + " SELECT table_id, kind, reason, count(*) AS n FROM rest GROUP BY ALL",
    "d4_stale_versions": "SELECT o_orderstatus AS experiment_id, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FILTER (o_orderpriority <> '5-LOW') AS stale FROM orders GROUP BY 1",
    "d5_present_variables": _OBS_EVENTS + " SELECT experiment_id, string_agg(DISTINCT variable, '|' ORDER BY variable) AS present FROM obs GROUP BY 1",
    "d14_gate_stats": _GATED + " SELECT doc_id, count(*) FILTER (verdict = 'ok') AS kept, count(*) FILTER (verdict <> 'ok') AS rejected FROM gated GROUP BY 1",
    "d15_profile_columns": _CELLS + _PROFILE + " SELECT * FROM prof",
    "e5_pick_run_column": _CELLS + _PROFILE + " SELECT * FROM picked",
    "h12_resolve_runs": _CELLS + _PROFILE + " SELECT * FROM resolved",
    "e6_dedup_text": _BLOCKS + ", k AS (SELECT doc_id, min(paragraph_idx) AS paragraph_idx FROM blocks GROUP BY doc_id, lower(text)) SELECT doc_id, paragraph_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx) AS INTEGER) AS place FROM k",
    "e7_chunk": _BLOCKS + " SELECT doc_id, paragraph_idx, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx) - 1) // 20 AS INTEGER) AS chunk FROM blocks",
    "e8_char_budget": _BLOCKS + ", r AS (SELECT doc_id, paragraph_idx, CAST(sum(length(text) + length(CAST(paragraph_idx AS VARCHAR)) + 3) OVER (PARTITION BY doc_id ORDER BY paragraph_idx) AS BIGINT) AS upto FROM blocks), m AS (SELECT *, max(upto) OVER (PARTITION BY doc_id) > 2000 AS truncated FROM r) SELECT * FROM m WHERE upto <= 2000",
    "f5_review_queue": "SELECT event_id AS observation_id FROM events WHERE value > 100 ORDER BY ts, event_id LIMIT 50",
    "h17_causal_phrases": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)\b(because|due to|caused by|resulted in|leading to)\b')) AS INTEGER) AS n_phrases FROM documents",
}
