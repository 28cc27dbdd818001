"""Queries of the scalar functions over ``part``, ``orders``, ``lineitem`` and ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators import ingest as g
from labtrail.operators import runs, units
from labtrail.plans import analytics as p
from labtrail.plans import ingest as t
from labtrail.sources import adapters as a

#: Texts around a number, chosen by the order's key: plain, padded, signed, with an exponent, and what is none.
SHAPES = ("{}", " {} ", "-{}", "{}e3", "1_{}", "{}d", "nan", "inf", "1e999", "", " x{} ")
UNITS = ("mg/mL", "kg/m³", "g L^-1", "µg/mL of {}", "OD600", "{}", "% w/w", "log CFU/mL ({})", "g·L⁻¹", "{}/{} of broth")
FILES = ("in/data_R{}.csv", "experiment_{}.csv", "trial-{}.tsv", "EXP_2024_run{}.csv", "notes.csv", "a b {}!.csv")


def _chosen(shapes, by: str, number: str):
    """The shape that ``by`` picks, with ``number`` in it."""
    return F.replace(F.get(F.array(*map(F.lit, shapes)), F.expr(f"cast({by} % {len(shapes)} as int)")), F.lit("{}"), F.expr(number))


def _chosen_sql(shapes, by: str, number: str) -> str:
    names = ", ".join(f"'{s}'" for s in shapes)
    return f"replace([{names}][CAST({by} % {len(shapes)} AS INTEGER) + 1], '{{}}', {number})"


def _raws(spark, d):
    number = "cast(o_custkey % 100 as string)"
    return a.load(spark, d, "orders").select("o_orderkey", _chosen(SHAPES, "o_orderkey", number).alias("raw"), "o_orderstatus", "o_orderpriority")


def _kinds(spark, d):
    kinds = F.array(*map(F.lit, ("int", "float", "bool", "int", "int", "string")))
    return g.drop_empty(t._cells(spark, d)).withColumn("kind", F.get(kinds, F.col("col_idx")))


def _heads(spark, d):
    n = F.col("p_partkey") % 6
    head = F.when(n == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") :"))).when(n == 1, F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]::"))).when(n == 2, F.concat(F.lit(" "), "p_name", F.lit(" (a) ("), "p_brand", F.lit(")"))).when(n == 3, F.concat("p_name", F.lit(" ( )"))).when(n == 4, F.concat("p_name", F.lit(":"))).otherwise(F.concat("p_name", F.lit(" (")))
    return a.load(spark, d, "part").select("p_partkey", head.alias("head"))


def _lines(spark, d):
    return a.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _unit_rows(spark, d):
    """Units as headers and tables hold them: of each brand and type, spelt in one of several ways."""
    some = a.load(spark, d, "part").select(_chosen(UNITS, "p_partkey", "lower(p_brand)").alias("unit")).distinct()
    return some.unionByName(a.load(spark, d, "part").select(F.col("p_type").alias("unit")).distinct())


def h9_synthetic_run(spark, d):
    return a.load(spark, d, "part").select("p_partkey", S.synthetic_run(_chosen(FILES, "p_partkey", "cast(p_size as string)")).alias("run"))


def b16_finite(spark, d):
    """Discounts of none are taken as infinite, taxes of none as no number."""
    odd = _lines(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))
    return odd.select("l_orderkey", "l_linenumber", S.finite(F.col("discount")).alias("discount"), S.finite(F.col("tax")).alias("tax"))


def h7_values_match(spark, d):
    other = F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 0.0003)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", S.values_match(F.col("l_extendedprice"), other).alias("same"))


#: Over the whole range of doubles.
SCALES = (1e-300, 1e-30, 1e-12, 1e-8, 1e-3, 1e5, 1e9, 1e16, 1e80, 1e295)


def h14_fmt_g(spark, d):
    """Prices, seven digits that may end in 5 among them, the same of either sign from 1e-297 to 1e300, and products near zero."""
    scale = F.get(F.array(*(F.lit(x) for x in SCALES)), (F.col("l_orderkey") % len(SCALES)).cast("int"))
    scaled = F.when(F.col("l_linenumber") % 2 == 1, -1).otherwise(1) * F.col("l_extendedprice") * scale
    texts = [S.fmt_g(x).alias(n) for n, x in (("price", F.col("l_extendedprice")), ("scaled", scaled), ("small", F.col("l_discount") * (F.col("l_tax") - 0.04)))]
    return _lines(spark, d).select("l_orderkey", "l_linenumber", *texts)


def h15_texts(spark, d):
    v = p._violations(spark, d)
    return v.select("experiment_id", "observation_id", S.finding_text(F.col("variable"), F.col("run_id"), F.col("value"), F.col("sigmas")).alias("summary"), S.sampling_hint(F.col("variable")).alias("hint"))


def h19_organism(spark, d):
    n = F.col("p_partkey")
    own = a.load(spark, d, "part").select("p_partkey", F.when(n % 2 == 0, " ").otherwise(F.col("p_name")).alias("a"), F.when(n % 3 == 0, F.col("p_brand")).alias("b"), F.col("p_type").alias("c"))
    return own.select("p_partkey", S.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("organism"))


def h23_id_kinds(spark, d):
    ids = _chosen(("F-{}", "N-{}", "T-{}", "D-F-{}", "D-{}", "Q-x{}", "E-{}-"), "event_id", "cast(event_id % 5000 as string)")
    return a.load(spark, d, "events").select("event_id", S.id_kind(ids).alias("kind"))


QUERIES = {
    "b2_confidence_band": lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", S.confidence_band(F.col("l_discount") * 10).alias("band")),
    "b4_needs_review": lambda s, d: t._routed(s, d).select("table_id", "raw_header", (S.confidence_band(F.col("confidence")) == "needs_review").alias("needs_review")),
    "b5_coerce": lambda s, d: _kinds(s, d).select("table_id", "row_idx", "col_idx", S.coerce_value(F.col("raw_value"), F.col("kind")).alias("value")),
    "b6_extraction_confidence": lambda s, d: _kinds(s, d).select("table_id", "row_idx", "col_idx", S.extraction_confidence(F.col("raw_value"), F.col("kind")).alias("confidence")),
    "b7_combined_confidence": lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", g.combined_confidence(F.when(F.col("l_linenumber") != 3, F.col("l_discount")), F.col("l_tax")).alias("confidence")),
    "b10_hours": lambda s, d: _raws(s, d).select("o_orderkey", S.hours(F.col("raw")).alias("time_h")),
    "b11_run_id": lambda s, d: _raws(s, d).select("o_orderkey", S.run_id(F.col("raw")).alias("run_id")),
    "b14_severity_confidence": lambda s, d: p._violations(s, d).select("severity", "confidence").distinct(),
    "b16_finite": b16_finite,
    "b21_clamp": lambda s, d: _raws(s, d).select("o_orderkey", S.clamp(F.concat(F.lit("0."), "raw"), 0.6).alias("narrative"), S.clamp(F.col("raw"), 0.0).alias("claim")),
    "h1_normalize_header": lambda s, d: _heads(s, d).select("p_partkey", S.normalize_header(F.col("head")).alias("name")),
    "h2_extract_unit": lambda s, d: _heads(s, d).select("p_partkey", S.extract_unit(F.col("head")).alias("unit")),
    "h3_normalize_units": lambda s, d: units.normalize_units(_unit_rows(s, d)),
    "h5_value_forms": lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", F.array_join(S.value_forms(F.col("l_quantity").cast("int").cast("string")), "|").alias("forms")),
    "h7_values_match": h7_values_match,
    "h8_run_from_filename": lambda s, d: a.load(s, d, "part").select("p_partkey", S.run_from_filename(_chosen(FILES, "p_partkey", "cast(p_size as string)")).alias("run")),
    "h9_synthetic_run": h9_synthetic_run,
    "h10_score_columns": lambda s, d: runs.score_columns(runs.profile_columns(t._cells(s, d))).select("table_id", "col_idx", "score", "confidence"),
    "h11_id_shaped": lambda s, d: runs.profile_columns(t._cells(s, d)).select("table_id", "col_idx", runs.id_shaped().alias("shaped")),
    "h13_time_columns": lambda s, d: g.time_columns(g.headers(t._cells(s, d))),
    "h14_fmt_g": h14_fmt_g,
    "h15_texts": h15_texts,
    "h16_organism_matches": lambda s, d: a.load(s, d, "part").select("p_partkey", S.organism_matches(F.substring("p_name", 1, 3), F.concat("p_type", F.lit(" Red"))).alias("same")),
    "h18_numeric": lambda s, d: _raws(s, d).select("o_orderkey", S.numeric(F.col("raw")).isNotNull().alias("is_number")),
    "h19_organism": h19_organism,
    "h20_block_class": lambda s, d: a.load(s, d, "part").select("p_partkey", S.block_class(_chosen(("Section-Header", "List of titles", "Item {}", "Caption", "Text {}", "Footnote"), "p_partkey", "p_brand")).alias("kind")),
    "h23_id_kinds": h23_id_kinds,
    "h24_basis": lambda s, d: _raws(s, d).select("o_orderkey", S.confidence_basis(F.when(F.col("o_orderstatus") == "F", "process_priors").when(F.col("o_orderstatus") == "O", "cross_run").otherwise(F.col("o_orderpriority"))).alias("basis")),
}

_RAWS = f"WITH raws AS (SELECT *, {_chosen_sql(SHAPES, 'o_orderkey', 'CAST(o_custkey % 100 AS VARCHAR)')} AS raw FROM orders), n AS (SELECT *, CASE WHEN regexp_full_match(raw, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN CASE WHEN raw = '1e999' THEN 'inf'::DOUBLE ELSE CAST(trim(raw) AS DOUBLE) END END AS x FROM raws)"
_KINDS = t._CELLS + f", k AS (SELECT *, ['int', 'float', 'bool', 'int', 'int', 'string'][col_idx + 1] AS kind, {t._NUM} AS x FROM cells WHERE{t._FILLED})"
_HEADS = "WITH heads AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' (' || p_brand || ') :' WHEN 1 THEN p_name || ' [' || p_brand || ']::' WHEN 2 THEN ' ' || p_name || ' (a) (' || p_brand || ')' WHEN 3 THEN p_name || ' ( )' WHEN 4 THEN p_name || ':' ELSE p_name || ' (' END AS head, p_name, p_brand FROM part)"
_FILES = f"WITH files AS (SELECT p_partkey, {_chosen_sql(FILES, 'p_partkey', 'CAST(p_size AS VARCHAR)')} AS name, p_size FROM part)"
SQL = {
    "b2_confidence_band": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.85 THEN 'auto' WHEN l_discount * 10 >= CAST(0.6 AS DOUBLE) THEN 'needs_review' ELSE 'residual' END AS band FROM lineitem",
    "b4_needs_review": t._ROUTE + " SELECT table_id, raw_header, confidence >= 0.6 AND confidence < 0.85 AS needs_review FROM routed",
    "b5_coerce": _KINDS + " SELECT table_id, row_idx, col_idx, CASE kind WHEN 'int' THEN coalesce(CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR), raw_value) WHEN 'bool' THEN CAST(lower(trim(raw_value)) IN ('true', 'yes', '1') AS VARCHAR) ELSE raw_value END AS value FROM k",
    "b6_extraction_confidence": _KINDS + " SELECT table_id, row_idx, col_idx, CAST(CASE WHEN kind IN ('int', 'float') AND x IS NULL THEN 0.5 ELSE 1 END AS DOUBLE) AS confidence FROM k",
    "b7_combined_confidence": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_discount * l_tax END AS confidence FROM lineitem",
    "b10_hours": _RAWS + " SELECT o_orderkey, CASE WHEN isfinite(x) THEN x END AS time_h FROM n",
    "b11_run_id": _RAWS + " SELECT o_orderkey, CASE WHEN lower(trim(raw)) NOT IN ('', 'nan') THEN CASE WHEN isfinite(x) THEN printf('RUN-%04d', CAST(x AS BIGINT)) ELSE trim(raw) END END AS run_id FROM n",
    "b14_severity_confidence": p._VIOL + " SELECT DISTINCT severity, confidence FROM viol",
    "b16_finite": "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem",
    "b21_clamp": _RAWS + " SELECT o_orderkey, CAST(least(0.85, coalesce(TRY_CAST(CASE WHEN regexp_full_match('0.' || raw, '0\\.\\d*(e\\d+)?\\s*') THEN trim('0.' || raw) END AS DOUBLE), 0.6)) AS DOUBLE) AS narrative, CAST(greatest(0, least(0.85, coalesce(x, 0))) AS DOUBLE) AS claim FROM n",
    "h1_normalize_header": _HEADS + " SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN lower(p_name) || ' (' ELSE lower(p_name) END AS name FROM heads",
    "h2_extract_unit": _HEADS + " SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN 'a) (' || p_brand END AS unit FROM heads",
    "h3_normalize_units": "WITH u AS (SELECT DISTINCT " + _chosen_sql(UNITS, "p_partkey", "lower(p_brand)") + """ AS unit FROM part UNION SELECT p_type FROM part),
 k AS (SELECT unit, CASE WHEN unit IN ('OD600', '% w/w') OR unit LIKE 'log CFU/mL (%' THEN 0 WHEN unit LIKE '% of %' OR unit IN ('kg/m³', 'g L^-1', 'g·L⁻¹') OR regexp_matches(unit, '[A-Za-z] [A-Za-z]') THEN 1 ELSE 2 END AS k FROM u)
 SELECT unit, CASE k WHEN 0 THEN 'dimensionless' WHEN 1 THEN 'rewrite' ELSE 'unconvertible' END AS action, CASE WHEN k <> 1 THEN NULL WHEN unit LIKE '% of %' THEN string_split(unit, ' of ')[1]
   WHEN unit = 'kg/m³' THEN 'kg/m^3' WHEN unit = 'g L^-1' THEN 'g*L^-1' WHEN unit = 'g·L⁻¹' THEN 'g*L^-1' ELSE replace(unit, ' ', '*') END AS plain, CAST(CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0 END AS DOUBLE) AS confidence FROM k""",
    "h5_value_forms": "SELECT l_orderkey, l_linenumber, concat_ws('|', q, q || '.0', q || '.00', q || '.000') AS forms FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem)",
    "h7_values_match": "SELECT l_orderkey, l_linenumber, abs(x - y) / greatest(abs(x), abs(y), 1.0) <= CAST(0.001 AS DOUBLE) AS same FROM (SELECT *, l_extendedprice AS x, l_extendedprice * (1 + l_linenumber * CAST(0.0003 AS DOUBLE)) AS y FROM lineitem)",
    "h8_run_from_filename": _FILES + " SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'RUN-2024' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE printf('RUN-%04d', p_size) END AS run FROM files",
    "h9_synthetic_run": _FILES + r" SELECT p_partkey, 'RUN-FROM-' || substr(regexp_replace(regexp_replace(regexp_replace(name, '^.*/', ''), '\.[^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g'), 1, 40) AS run FROM files",
    "h10_score_columns": t._CELLS + t._PROFILE + " SELECT table_id, col_idx, score, least(CAST(0.95 AS DOUBLE), CAST(0.5 AS DOUBLE) + score / 10) AS confidence FROM scored",
    "h11_id_shaped": t._CELLS + t._PROFILE + " SELECT table_id, col_idx, n_decimal < greatest(1, n_distinct // 2) AND (all_runs OR (longest <= 20 AND longest - shortest <= 4)) AS shaped FROM prof",
    "h13_time_columns": t._CELLS + " SELECT table_id, min(col_idx) AS time_col FROM cells WHERE lower(trim(raw_header)) = 'time (h)' GROUP BY 1",
    "h14_fmt_g": "SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice) AS price, printf('%g', CASE l_linenumber % 2 WHEN 1 THEN -1 ELSE 1 END * l_extendedprice * list_extract([1e-300, 1e-30, 1e-12, 1e-8, 1e-3, 1e5, 1e9, 1e16, 1e80, 1e295]::DOUBLE[], CAST(l_orderkey % 10 AS INTEGER) + 1)) AS scaled, printf('%g', l_discount * (l_tax - 0.04::DOUBLE)) AS small FROM lineitem",
    "h15_texts": p._VIOL + " SELECT experiment_id, observation_id, variable || ' in ' || run_id || ': ' || printf('%g', value) || ', ' || printf('%g', abs(sigmas)) || ' standard deviations off' AS summary, 'finer_' || variable || '_sampling' AS hint FROM viol",
    "h16_organism_matches": "SELECT p_partkey, contains(lower(p_type || ' Red'), lower(substr(p_name, 1, 3))) AS same FROM part",
    "h18_numeric": _RAWS + " SELECT o_orderkey, x IS NOT NULL AS is_number FROM n",
    "h19_organism": "SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS organism FROM part",
    "h20_block_class": "SELECT p_partkey, ['heading', 'heading', 'list_item', 'caption', 'paragraph', 'other'][CAST(p_partkey % 6 AS INTEGER) + 1] AS kind FROM part",
    "h23_id_kinds": "SELECT event_id, CASE WHEN event_id % 5000 >= 1000 THEN ['finding', 'narrative', 'trajectory', 'claim', 'deviation', NULL, NULL][CAST(event_id % 7 AS INTEGER) + 1] END AS kind FROM events",
    "h24_basis": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'process_priors' WHEN 'O' THEN 'cross_run' ELSE 'schema_only' END AS basis FROM orders",
}
