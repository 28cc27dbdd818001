"""Queries of the rules on experiments' facts, organisms, sources, narratives and kinds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators import checks, claims, prose, runs, series, summary, trends, units
from labtrail.operators import findings as f
from labtrail.operators import ingest as g
from labtrail.plans import analytics as p
from labtrail.plans import ingest as t
from labtrail.plans import integrity as i
from labtrail.plans import products
from labtrail.sources import adapters as a
from labtrail.sources import files

#: organism, aliases, family, variable, soft range.
PRIORS = (("S. cerevisiae", ["baker", "yeast"], "Batch", "click", 0.0, 120.0), ("E. coli", ["colibacillus"], "fed-batch", "view", 1.0, 150.0), ("E. coli", ["colibacillus"], "batch", "purchase", 5.0, 60.0))


def _many(df, run="run_id"):
    """Forty experiments: the run's number tells which."""
    return df.withColumn("experiment_id", F.concat(F.lit("EXP-"), (F.substring(run, 5, 9).cast("int") % 40).cast("string")))


def _facts(rows):
    """What is known of each experiment: a stale schema of some, an unknown process of some, no organism of some."""
    own = rows.groupBy("experiment_id").agg(F.count_distinct("variable").alias("v"))
    k = F.substring("experiment_id", 5, 9).cast("int")
    return own.select("experiment_id", F.when(k % 3 == 0, F.array(F.lit("1.0"))).otherwise(F.array().cast("array<string>")).alias("stale"), F.when(k % 5 == 0, 40).otherwise(F.col("v") * 20).alias("coverage_pct"), F.when(k % 4 == 0, "unknown").otherwise("manifest").alias("provenance"), F.when(k % 7 == 0, " ").otherwise("yeast").alias("organism"))


def d11_all_flags(spark, d):
    rows = _many(p._rows(spark, d, p.RUNS))
    coverage = summary.spec_coverage(summary.with_specs(rows, a.specs(spark)))
    return f.process_flags(rows, _many(series.series_quality(p._points(spark, d))), coverage, _facts(rows))


def c14_hourly(spark, d):
    """Questions on a grid of hours, on which most series are thin."""
    return f.open_questions(p._findings(spark, d), series.series_quality(series.grid_points(p._rows(spark, d), 1.0, 720.0)))


def _narratives(spark, d):
    """A narrative for each nation."""
    names = F.get(F.array(*(F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in (("click", "view"), ("purchase",), (), ("error",), ("view",)))), F.col("n_regionkey").cast("int"))
    return a.load(spark, d, "nation").select(F.concat(F.lit("EXP-"), (F.col("n_nationkey") % 2).cast("string")).alias("experiment_id"), F.format_string("N-%04d", "n_nationkey").alias("narrative_id"), names.alias("affected_variables"))


def _claims(spark, d):
    """The claims with narratives, kinds and tags; some ids are of another kind."""
    n = F.col("seq")
    kind = F.get(F.array(*map(F.lit, ("failure", "trend", "analysis", "question"))), (n % 4).cast("int"))
    letter = F.when(n % 19 == 0, "F").otherwise(F.get(F.array(*map(F.lit, "FTAQ")), (n % 4).cast("int")))
    cited = F.when(n % 6 == 0, F.array(F.format_string("N-%04d", n % 40))).otherwise(F.array().cast("array<string>"))
    tags = F.array(F.when(n % 2 == 0, "growth").otherwise("feed"), F.col("variable"))
    own = i._claims(spark, d).withColumn("variable", F.get("affected_variables", 0)).withColumns({"kind": kind, "cited_narrative_ids": cited, "domain_tags": tags})
    return own.withColumn("claim_id", F.concat(F.lit("D-"), letter, F.format_string("-%04d", n)))


def c9_citations(spark, d):
    rows = p._rows(spark, d).where("run_id <> 'RUN-0003'")
    return claims.drop_unknown(_claims(spark, d), p._findings(spark, d), rows, narratives=_narratives(spark, d)).select("experiment_id", "claim_id")


def c17_narratives(spark, d):
    own = claims.backfill(_claims(spark, d), p._rows(spark, d), _narratives(spark, d))
    return own.select("experiment_id", "claim_id", F.array_join("cited_narrative_ids", "|").alias("cited"))


def c10_text_values(spark, d):
    """Events of odd ids held against those of even ones of a file: numbers as text, and words in other case."""
    e = a.load(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("file_id"), F.col("event_type").alias("variable"))
    k = F.col("event_id")
    told = e.where(k % 2 == 0).select("file_id", "variable", F.when(k % 3 == 0, F.concat(F.lit("Level "), (k % 40).cast("string"))).otherwise((k % 5000).cast("string")).alias("value"))
    asked = e.where(k % 2 == 1).select("event_id", "file_id", "variable", F.when(k % 3 == 0, F.concat(F.lit(" LEVEL "), (k % 90).cast("string"))).when(k % 7 == 0, F.lit(None)).otherwise((k % 9000).cast("string")).alias("value"))
    return prose.drop_table_duplicates(asked, told).select("event_id")


def d14_all_stats(spark, d):
    """Accepted quotations whose value, 7, the table of one document in two has already."""
    gated = t._gated(spark, d).withColumns({"file_id": F.col("doc_id"), "variable": F.lit("size")})
    table = a.load(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("file_id"), F.lit("size").alias("variable"), F.lit("7.0").alias("value"))
    return prose.gate_stats(gated, prose.drop_table_duplicates(gated.where("verdict = 'ok'"), table))


def d2_with_files(spark, d):
    parts = t._cells(spark, d).select("table_id", F.when(F.length("table_id") % 3 == 0, "failed").otherwise("ok").alias("status")).distinct()
    gone = a.load(spark, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("table_id"), F.lit("failed").alias("status"))
    return g.ingestion_summary(t._observed(spark, d), len(a.DICTIONARY), parts.unionByName(gone))


def _priors(spark):
    return spark.createDataFrame(list(PRIORS), "organism string, aliases array<string>, family string, variable string, low double, high double")


def _organisms(spark, d):
    return p._rows(spark, d).select("experiment_id").distinct().withColumn("organism", F.when(F.col("experiment_id") == "EXP-0", "Yeast").otherwise("e. coli K12"))


def c12_by_family(spark, d):
    names = a.load(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("E. COLI "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "baker").otherwise(F.col("c_name")).alias("query"))
    return claims.resolve_priors(_priors(spark), names, family="BATCH").select("query", "organism", "variable")


def c18_by_organism(spark, d):
    own = claims.organism_priors(_priors(spark), _organisms(spark, d))
    unknown = p._rows(spark, d).select("experiment_id").where("false")
    return claims.downgrade(_claims(spark, d), own, unknown).select("experiment_id", "claim_id", "confidence_basis", "provenance_downgraded")


def l6_by_organism(spark, d):
    own = claims.organism_priors(_priors(spark), _organisms(spark, d))
    return claims.prior_violations(p._rows(spark, d), own).select("experiment_id", "observation_id", "low", "high")


def _outputs(spark, d):
    """Findings as an output holds them: ids with its prefix, but for some; some judged by a model, some without evidence."""
    n = F.col("seq")
    own = p._findings(spark, d).withColumn("output_id", F.concat(F.lit("C-"), "experiment_id"))
    ids = F.when(n % 23 == 0, F.col("finding_id")).when(n % 31 == 0, F.concat(F.lit("C-other:"), "finding_id")).otherwise(F.concat("output_id", F.lit(":"), "finding_id"))
    return own.withColumns({"finding_id": ids, "extracted_via": F.when(n % 5 == 0, "llm_judged").otherwise("deterministic"), "confidence": F.when(n % 17 == 0, 1.5).otherwise(F.col("confidence")), "observation_id": F.when(n % 29 != 0, F.col("observation_id"))})


def v4_planted(spark, d):
    """Series of which some lost their last value and others count an imputed share twice."""
    points = p._points(spark, d)
    own = series.trajectories(points).join(series.series_quality(points), series.KEY)
    k = F.substring("run_id", 5, 9).cast("int")
    cut = F.when(k % 4 == 0, F.slice("values", 1, 60)).otherwise(F.col("values"))
    return checks.check_trajectories(own.withColumns({"values": cut, "quality": F.when(k % 5 == 0, F.col("quality") + F.col("pct_imputed")).otherwise(F.col("quality"))}))


def v6_priors_version(spark, d):
    own = a.load(spark, d, "orders").select(F.col("o_orderkey").alias("output_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priors_version"))
    return checks.check_priors_version(own, "5-LOW")


def v7_errors(spark, d):
    """Orders as outputs, of which some report an error; their lines of large quantity are claims."""
    outputs = a.load(spark, d, "orders").select(F.col("o_orderkey").alias("output_id"), F.when(F.col("o_orderkey") % 3 == 0, "failed").alias("error"))
    return checks.check_errors(outputs, a.load(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("output_id")))


def v10_tags(spark, d):
    expected = p._rows(spark, d).select("experiment_id", "variable").distinct()
    tags = F.when(F.col("variable") == "view", F.array(F.lit("growth"), F.lit("yield"))).otherwise(F.array(F.lit("growth"), F.lit("feed"), F.col("variable")))
    return claims.score(_claims(spark, d), expected.select("experiment_id", F.array("variable").alias("keywords"), F.array().cast("array<string>").alias("must_cite"), F.lit(0.8).alias("min_confidence"), tags.alias("tags")))


def _sourced(spark, d):
    return p._rows(spark, d).withColumn("source", F.concat(F.lit("S"), (F.substring("observation_id", 3, 9).cast("long") % 3).cast("string")))


def l5_anomalies(spark, d):
    limits = spark.sql("SELECT * FROM VALUES ('click', -0.001D, 0.001D), ('view', -0.0005D, 0.0D) AS t(variable, slope_low, slope_high)")
    return trends.kinetic_anomalies(trends.kinetic_fit(p._rows(spark, d), 120.0), limits)


def l9_graph(spark, d):
    """Vertices and edges with source files, in one table."""
    vertices, edges = trends.facts_graph(_sourced(spark, d).withColumnRenamed("source", "file_id"))
    return vertices.select(F.lit("vertex").alias("part"), "kind", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select(F.lit("edge").alias("part"), "kind", "src", "dst"))


def c15_all_references(spark, d):
    """Findings of even numbers are missing: what the timeline, the questions and the graph's edges lack."""
    own = p._findings(spark, d)
    known = own.where("seq % 2 = 1")
    line = checks.missing_references(f.timeline(own).select("experiment_id", F.lit("timeline").alias("label"), "finding_id"), known, "finding_id")
    asked = checks.missing_references(c14_hourly(spark, d).select("experiment_id", F.lit("question").alias("label"), F.col("first_finding").alias("finding_id")), known, "finding_id")
    return line.unionByName(asked)


def c15_edges(spark, d):
    """Ends of the graph's edges that are no vertex, where measurements of 200 and more are missing."""
    vertices = trends.facts_graph(p._rows(spark, d).where("value < 200"))[0]
    return checks.missing_endpoints(trends.facts_graph(p._rows(spark, d))[1], vertices)


def c16_all_kinds(spark, d):
    """Evidence of findings, deviations, series and fits that observations below 200 lack."""
    rows, key = p._rows(spark, d), F.concat_ws("/", "run_id", "variable")
    used = p._evidence(spark, d).select("experiment_id", F.col("finding_id").alias("label"), "observation_id")
    others = (
        (f.deviations(p._spec_rows(spark, d)), F.lit("deviation")),
        (p._points(spark, d).where("observation_id is not null"), F.concat(F.lit("series "), key)),
        (trends.fit_evidence(rows, 120.0), F.concat(F.lit("fit "), F.concat_ws("/", key, "window_idx"))),
    )
    for own, label in others:
        used = used.unionByName(own.select("experiment_id", label.alias("label"), "observation_id"))
    return checks.missing_references(used, rows.where("value < 200"), "observation_id")


def d7_arrays(spark, d):
    """The arrays of each series, weighted by place so that order counts, and the unit of its earliest row."""
    rows = p._rows(spark, d, p.RUNS).withColumn("unit", F.concat(F.lit("u"), (F.substring("observation_id", 3, 9).cast("long") % 7).cast("string")))
    own = series.trajectories(p._points(spark, d)).join(series.units(rows), series.KEY)
    weighted = lambda c: F.round(F.aggregate(F.transform(c, lambda x, k: F.coalesce(x, F.lit(-1.0)) * (k + 1)), F.lit(0.0), lambda s, x: s + x), 2)
    flags = F.array_join(F.transform("imputation_flags", lambda x: x.cast("int").cast("string")), "")
    return own.select(*series.KEY, "unit", F.size("values").alias("n"), weighted("time_grid").alias("times"), weighted("values").alias("weighted_values"), flags.alias("flags"))


def a7_units(spark, d):
    at = products._place(spark, "points")
    rows = p._rows(spark, d, p.RUNS)
    files.write_points(p._points(spark, d).join(series.units(rows), series.KEY), at)
    schema = "run_id string, variable string, time_h double, value double, imputed int, unit string, experiment_id string"
    return spark.read.schema(schema).option("header", True).csv(at).groupBy("experiment_id", "run_id", "variable", "unit").agg(F.count("*").alias("n"), F.sum("imputed").alias("imputed"))


def _records(spark, d):
    """The residual, with no column of some tables mapped, and every block of prose."""
    routed = t._routed(spark, d)
    rest = g.residual(routed.withColumn("route", F.when(F.length("table_id") % 5 == 0, "low_confidence").otherwise(F.col("route"))), t._cells(spark, d))
    return g.residual_records(rest, t._blocks(spark, d))


def _sources(records):
    return records.select("source", "kind").distinct().select("source", F.concat(F.lit("EXP-"), F.when(F.col("kind") == "narrative", F.col("source").cast("long") % 2).otherwise(F.length("source") % 2).cast("string")).alias("experiment_id"))


def d3_by_experiment(spark, d):
    records = _records(spark, d)
    return g.experiment_residual(records, _sources(records))


def a8_extras(spark, d):
    """Residual records and source files, written into the dossiers' other parts and read again."""
    at = products._place(spark, "dossier-extras")
    records = _records(spark, d)
    parts = t._cells(spark, d).select("table_id").distinct()
    sources = parts.select(F.concat(F.lit("EXP-"), (F.length("table_id") % 2).cast("string")).alias("experiment_id"), F.col("table_id").alias("file_id"), F.lit("ok").alias("status"))
    files.write_extras(records.join(_sources(records), "source").select("experiment_id", "kind", "source", "idx", "content", "reason"), sources, at)
    residual, known = files.read_extras(spark, at)
    return residual.select("experiment_id", "kind", "source", "idx").unionByName(known.select("experiment_id", F.concat(F.lit("file "), "status").alias("kind"), F.col("file_id").alias("source"), F.lit(None).cast("long").alias("idx")))


def b17_by_tier(spark, d):
    own = p._findings(spark, d).withColumn("tier", F.when(F.col("aggregated"), "B").otherwise("A"))
    some = f.filter_findings(own, tier="A", severity="minor", limit=7)
    return some.unionByName(f.filter_findings(own, finding="F-0002")).select("experiment_id", "finding_id", "place", "total", "truncated")


def h15_series_texts(spark, d):
    own = series.series_quality(p._points(spark, d))
    return own.select(*series.KEY, S.caveat_text(F.col("pct_imputed")).alias("caveat"), S.question_text(F.col("variable"), F.col("run_id"), F.col("pct_imputed")).alias("question"))


def j2_chain(spark, d):
    """Units of parts by rule, then by a table; some are known to neither."""
    k = F.col("p_partkey") % 5
    unit = F.when(k == 0, "OD600").when(k == 1, F.concat(F.lit("g of "), F.lower("p_brand"))).when(k == 2, F.concat(F.lit("m"), F.lit("\u00b2"))).when(k == 3, "flerbs").otherwise(F.col("p_type"))
    table = a.load(spark, d, "part").select(F.col("p_type").alias("unit")).where("unit like 'S%'").distinct().withColumn("plain", F.lit("piece"))
    return units.normalize_chain(a.load(spark, d, "part").select(unit.alias("unit")), units.normalize_units, units.known_units(table))


QUERIES = {
    "a3_block_classes": lambda s, d: t._blocks(s, d).withColumn("block_class", S.block_class(F.when(F.length("text") < 60, "Section-Header").when(F.col("text").startswith("-"), "List-Item").otherwise("Text"))).groupBy("doc_id", "block_class").agg(F.count("*").alias("n")),
    "a7_units": a7_units,
    "a8_extras": a8_extras,
    "a11_records": lambda s, d: _records(s, d).select("kind", "source", "idx", "content"),
    "b17_by_tier": b17_by_tier,
    "b19_available": lambda s, d: series.available(p._points(s, d), "RUN-none", "view"),
    "c9_citations": c9_citations,
    "c10_text_values": c10_text_values,
    "c12_by_family": c12_by_family,
    "c14_hourly": c14_hourly,
    "c15_all_references": c15_all_references,
    "c15_edges": c15_edges,
    "c16_all_kinds": c16_all_kinds,
    "c17_narratives": c17_narratives,
    "c18_by_organism": c18_by_organism,
    "d2_with_files": d2_with_files,
    "d3_by_experiment": d3_by_experiment,
    "d7_arrays": d7_arrays,
    "d7_chunks": lambda s, d: series.chunk_range(series.chunks(p._points(s, d), 16), 10, 45, 16),
    "d11_all_flags": d11_all_flags,
    "d14_all_stats": d14_all_stats,
    "h12_rationale": lambda s, d: runs.rationale(t._resolved(s, d)).select("table_id", "strategy", "rationale"),
    "h15_series_texts": h15_series_texts,
    "j2_chain": j2_chain,
    "l2_by_source": lambda s, d: trends.source_contradictions(_sourced(s, d), 12.0),
    "l5_anomalies": l5_anomalies,
    "l6_by_organism": l6_by_organism,
    "l9_graph": l9_graph,
    "v4_planted": v4_planted,
    "v5_outputs": lambda s, d: checks.check_findings(_outputs(s, d)),
    "v6_priors_version": v6_priors_version,
    "v7_kinds": lambda s, d: checks.check_claims(_claims(s, d)),
    "v7_errors": v7_errors,
    "v10_tags": v10_tags,
}

_MANY = "'EXP-' || (CAST(substr(run_id, 5) AS INTEGER) % 40)"
_CLAIMS = i._CLAIMS + """, nar AS (SELECT 'EXP-' || (n_nationkey % 2) AS experiment_id, printf('N-%04d', n_nationkey) AS narrative_id, [['click', 'view'], ['purchase'], [], ['error'], ['view']][n_regionkey + 1] AS vars FROM nation),
 c2 AS (SELECT * EXCLUDE (claim_id), 'D-' || CASE WHEN seq % 19 = 0 THEN 'F' ELSE substr('FTAQ', CAST(seq % 4 AS INTEGER) + 1, 1) END || printf('-%04d', seq) AS claim_id, ['failure', 'trend', 'analysis', 'question'][CAST(seq % 4 AS INTEGER) + 1] AS kind, CASE WHEN seq % 6 = 0 THEN printf('N-%04d', seq % 40) END AS cited_narrative FROM claims)"""
_HOURLY = p._FIND + ", q AS (SELECT experiment_id, run_id, variable, round(count(DISTINCT floor(time_h)) FILTER (time_h < 721) / CAST(721 AS DOUBLE), 6) AS quality FROM kept GROUP BY ALL), asked AS (SELECT experiment_id, run_id, variable, count(*) AS n_findings, min(finding_id) AS first_finding, quality FROM found JOIN q USING (experiment_id, run_id, variable) WHERE quality < 0.8 GROUP BY ALL)"
_ORG = ", pr(experiment_id, variable, low, high) AS (VALUES ('EXP-0', 'click', 0::DOUBLE, 120::DOUBLE), ('EXP-1', 'view', 1::DOUBLE, 150::DOUBLE), ('EXP-1', 'purchase', 5::DOUBLE, 60::DOUBLE))"
_RECORDS = t._CELLS + """, blocks AS (SELECT doc_id, paragraph_idx, text FROM (SELECT doc_id, unnest(range(len(l))) AS paragraph_idx, trim(unnest(l)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(text) >= 20),
 un AS (SELECT 'tables_unmapped' AS kind, table_id AS source, CAST(row_idx AS BIGINT) AS idx, string_agg(coalesce(raw_value, ''), '|' ORDER BY col_idx) AS content FROM cells WHERE length(table_id) % 5 = 0 GROUP BY ALL),
 pa AS (SELECT DISTINCT 'tables_partial' AS kind, table_id AS source, CAST(col_idx AS BIGINT) AS idx, raw_header AS content FROM cells WHERE length(table_id) % 5 <> 0 AND col_idx NOT IN (3, 4)),
 records AS (FROM un UNION ALL FROM pa UNION ALL SELECT 'narrative', CAST(doc_id AS VARCHAR), paragraph_idx, text FROM blocks),
 placed AS (SELECT *, 'EXP-' || (CASE WHEN kind = 'narrative' THEN CAST(source AS BIGINT) ELSE length(source) END % 2) AS experiment_id FROM records)"""

SQL = {
    "a3_block_classes": _RECORDS + " SELECT doc_id, CASE WHEN length(text) < 60 THEN 'heading' WHEN starts_with(text, '-') THEN 'list_item' ELSE 'paragraph' END AS block_class, count(*) AS n FROM blocks GROUP BY ALL",
    "a7_units": p._PTS + " SELECT experiment_id, run_id, variable, 'u' AS unit, count(*) AS n, CAST(sum(CAST(imputed AS INTEGER)) AS BIGINT) AS imputed FROM points GROUP BY ALL",
    "a8_extras": _RECORDS + " SELECT experiment_id, kind, source, idx FROM placed UNION ALL SELECT DISTINCT 'EXP-' || (length(table_id) % 2), 'file ok', table_id, CAST(NULL AS BIGINT) FROM cells",
    "a11_records": _RECORDS + " FROM records",
    "b17_by_tier": p._FIND + """, a AS (SELECT experiment_id, finding_id, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY seq) AS INTEGER) AS place, count(*) OVER (PARTITION BY experiment_id) AS total FROM found WHERE NOT aggregated AND severity = 'minor')
 SELECT *, total > 7 AS truncated FROM a WHERE place <= 7 UNION ALL SELECT experiment_id, finding_id, 1, 1, false FROM found WHERE finding_id = 'F-0002'""",
    "b19_available": p._PTS + " SELECT DISTINCT experiment_id, run_id, variable FROM points",
    "c9_citations": _CLAIMS + " SELECT experiment_id, claim_id FROM c2 WHERE coalesce(cited <> 'F-999999', true) AND NOT (by_series AND run_id = 'RUN-0003') AND (cited_narrative IS NULL OR EXISTS (FROM nar WHERE nar.experiment_id = c2.experiment_id AND narrative_id = cited_narrative))",
    "c10_text_values": """WITH e AS (SELECT event_id, user_id % 50 AS file_id, event_type AS variable, event_id % 3 = 0 AS words FROM events), told AS (SELECT DISTINCT file_id, variable, words, CASE WHEN words THEN event_id % 40 ELSE event_id % 5000 END AS x FROM e WHERE event_id % 2 = 0), asked AS (SELECT *, CASE WHEN words THEN event_id % 90 WHEN event_id % 7 <> 0 THEN event_id % 9000 END AS x FROM e WHERE event_id % 2 = 1)
 SELECT event_id FROM asked q WHERE NOT EXISTS (FROM told t WHERE t.file_id = q.file_id AND t.variable = q.variable AND t.words = q.words AND CASE WHEN q.words THEN t.x = q.x ELSE abs(t.x - q.x) / CAST(greatest(t.x, q.x, 1) AS DOUBLE) <= CAST(0.001 AS DOUBLE) END)""",
    "c12_by_family": "SELECT DISTINCT 'E. COLI ' || c_mktsegment AS query, 'E. coli' AS organism, 'purchase' AS variable FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT 'baker', 'S. cerevisiae', 'click' FROM customer WHERE c_custkey % 3 = 1",
    "c14_hourly": _HOURLY + " SELECT * FROM asked",
    "c15_all_references": _HOURLY + " SELECT experiment_id, 'timeline' AS label, finding_id FROM found WHERE t_start IS NOT NULL AND seq % 2 = 0 UNION ALL SELECT experiment_id, 'question', first_finding FROM asked WHERE CAST(substr(first_finding, 3) AS BIGINT) % 2 = 0",
    "c15_edges": p._BASE + " SELECT 'measured_on' AS kind, 'src' AS end, observation_id AS id FROM kept WHERE value >= 200 OR isnan(value) UNION ALL SELECT 'measures', 'src', observation_id FROM kept WHERE value >= 200 OR isnan(value)",
    "c16_all_kinds": p._grid(p._EVID, p.RUNS) + """, fits AS (SELECT experiment_id, 'fit ' || run_id || '/' || variable || '/' || CAST(floor(time_h / 120) AS INTEGER) AS label, observation_id, count(*) OVER (PARTITION BY experiment_id, run_id, variable, floor(time_h / 120)) AS n FROM kept WHERE value > 0),
 used AS (SELECT experiment_id, finding_id AS label, observation_id FROM evid UNION ALL SELECT experiment_id, 'deviation', observation_id FROM s WHERE expected IS NOT NULL AND expected_std_dev IS NOT NULL
 UNION ALL SELECT experiment_id, 'series ' || run_id || '/' || variable, observation_id FROM points WHERE observation_id IS NOT NULL UNION ALL SELECT experiment_id, label, observation_id FROM fits WHERE n >= 3)
 SELECT * FROM used WHERE observation_id NOT IN (SELECT observation_id FROM kept WHERE value < 200)""",
    "c17_narratives": _CLAIMS + " SELECT experiment_id, claim_id, coalesce(cited_narrative, (SELECT string_agg(narrative_id, '|' ORDER BY narrative_id) FROM nar WHERE nar.experiment_id = c2.experiment_id AND list_contains(vars, variable)), '') AS cited FROM c2",
    "c18_by_organism": _CLAIMS + _ORG + " SELECT experiment_id, claim_id, CASE WHEN down THEN 'schema_only' ELSE basis END AS confidence_basis, down AS provenance_downgraded FROM (SELECT *, basis = 'process_priors' AND NOT EXISTS (FROM pr WHERE pr.experiment_id = c2.experiment_id AND pr.variable = c2.variable) AS down FROM c2)",
    "d2_with_files": t._OBS + """, s AS (SELECT table_id, count(*) AS total, count(*) FILTER (combined_confidence >= 0.85) AS high_confidence, count(*) FILTER (needs_review) AS n_review, CAST(0 AS BIGINT) AS n_narrative, CAST(round_even(count(DISTINCT variable) * 100.0 / 4, 0) AS BIGINT) AS coverage_pct FROM obs GROUP BY 1),
 fl AS (SELECT DISTINCT table_id, length(table_id) % 3 = 0 AS failed FROM cells UNION ALL SELECT 'supplier/' || s_suppkey, true FROM supplier) SELECT table_id, coalesce(total, 0) AS total, coalesce(high_confidence, 0) AS high_confidence, coalesce(n_review, 0) AS n_review, coalesce(n_narrative, 0) AS n_narrative, coalesce(coverage_pct, 0) AS coverage_pct, CAST(coalesce(failed, false) AS BIGINT) AS n_failed FROM fl FULL JOIN s USING (table_id)""",
    "d3_by_experiment": _RECORDS + " SELECT experiment_id, count(DISTINCT source) FILTER (kind = 'tables_unmapped') AS tables_unmapped, count(DISTINCT source) FILTER (kind = 'tables_partial') AS tables_partial, count(*) FILTER (kind = 'narrative') AS narrative_blocks FROM placed GROUP BY 1",
    "d7_chunks": p._PTS + " SELECT experiment_id, run_id, variable, grid_idx, time_h, value, imputed, observation_id FROM points WHERE grid_idx >= 10 AND grid_idx < 45",
    "d7_arrays": p._PTS + """, un AS (SELECT experiment_id, run_id, variable, 'u' || (arg_min(CAST(substr(observation_id, 3) AS BIGINT), (time_h, observation_id)) % 7) AS unit FROM k2 GROUP BY ALL)
 SELECT experiment_id, run_id, variable, any_value(unit) AS unit, CAST(count(*) AS INTEGER) AS n, round(sum(time_h * (grid_idx + 1)), 2) AS times, round(sum(coalesce(value, -1) * (grid_idx + 1) ORDER BY grid_idx), 2) AS weighted_values, string_agg(CAST(CAST(imputed AS INTEGER) AS VARCHAR), '' ORDER BY grid_idx) AS flags FROM points JOIN un USING (experiment_id, run_id, variable) GROUP BY ALL""",
    "d11_all_flags": p._PTS + f""", r AS (SELECT {_MANY} AS x, run_id, variable, variable IN (SELECT variable FROM (VALUES ('click'), ('purchase'), ('signup'), ('view')) s(variable)) AS spec FROM k2),
 e AS (SELECT x, CAST(substr(x, 5) AS INTEGER) AS k, count(*) AS n, count(DISTINCT run_id) AS runs, count(DISTINCT variable) AS v, count(DISTINCT variable) FILTER (NOT spec) AS bare FROM r GROUP BY ALL), w AS (SELECT {_MANY} AS x, bool_or(quality < 0.8) AS low FROM quality GROUP BY 1)
 SELECT x AS experiment_id, array_to_string(list_sort(list_filter([CASE WHEN low THEN 'LOW_QUALITY_TRAJECTORY' END, CASE WHEN n < 20 OR k % 5 = 0 OR v * 20 < 50 THEN 'SPARSE_DATA' END, CASE WHEN runs > 1 THEN 'MULTI_RUN' END, CASE WHEN bare * 2 > v THEN 'SPECS_MOSTLY_MISSING' END, CASE WHEN k % 3 = 0 THEN 'STALE_SCHEMA_OBSERVATIONS' END, CASE WHEN k % 4 = 0 THEN 'UNKNOWN_PROCESS' END, CASE WHEN k % 7 = 0 THEN 'UNKNOWN_ORGANISM' END], lambda y: y IS NOT NULL)), ',') AS flags FROM e LEFT JOIN w USING (x)""",
    "d14_all_stats": t._GATED + " SELECT doc_id, count(*) FILTER (verdict = 'ok' AND NOT had) AS kept, count(*) FILTER (verdict <> 'ok') AS rejected, count(*) FILTER (verdict = 'ok' AND had) AS deduped FROM (SELECT *, doc_id % 3 = 0 AND doc_id % 2 = 0 AS had FROM gated) GROUP BY 1",
    "h12_rationale": t._CELLS + t._PROFILE + " SELECT table_id, strategy, CASE strategy WHEN 'column' THEN 'column ' || col_idx || ' looks like run names' WHEN 'filename' THEN 'the file name holds it' ELSE 'nothing names it' END AS rationale FROM resolved",
    "h15_series_texts": p._PTS + " SELECT experiment_id, run_id, variable, CAST(round_even(pct_imputed * 100, 0) AS INTEGER) || '% of the series is carried forward' AS caveat, 'Is ' || variable || ' in ' || run_id || ' as it seems, with ' || CAST(round_even(pct_imputed * 100, 0) AS INTEGER) || '% carried forward?' AS question FROM quality",
    "j2_chain": """WITH u AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'OD600' WHEN 1 THEN 'g of ' || lower(p_brand) WHEN 2 THEN 'm\u00b2' WHEN 3 THEN 'flerbs' ELSE p_type END AS unit FROM part), k AS (SELECT unit, CASE WHEN unit = 'OD600' THEN 0 WHEN unit LIKE 'g of %' THEN 1 WHEN unit = 'm\u00b2' THEN 2 WHEN unit = 'flerbs' THEN 3 WHEN regexp_matches(unit, '[A-Za-z] [A-Za-z]') THEN 4 WHEN unit LIKE 'S%' THEN 5 ELSE 3 END AS k FROM u)
 SELECT unit, CASE WHEN k = 5 THEN 1 WHEN k <> 3 THEN 0 END AS step, CASE k WHEN 0 THEN 'dimensionless' WHEN 3 THEN 'unconvertible' ELSE 'rewrite' END AS action, CASE k WHEN 1 THEN 'g' WHEN 2 THEN 'm^2' WHEN 4 THEN replace(unit, ' ', '*') WHEN 5 THEN 'piece' END AS plain, CAST(CASE k WHEN 0 THEN 0.95 WHEN 3 THEN 0 WHEN 5 THEN 0.8 ELSE 0.85 END AS DOUBLE) AS confidence FROM k""",
    "l2_by_source": p._BASE + """, w AS (SELECT experiment_id, run_id, variable, CAST(floor(time_h / 12) AS INTEGER) AS grid_idx, CAST(substr(observation_id, 3) AS BIGINT) % 3 AS s, min(value) AS lo, max(value) AS hi FROM kept GROUP BY ALL),
 bad AS (SELECT DISTINCT experiment_id, run_id, variable, grid_idx FROM w x JOIN w y USING (experiment_id, run_id, variable, grid_idx) WHERE x.s <> y.s AND abs(x.hi - y.lo) / greatest(abs(x.hi), abs(y.lo), 1) > CAST(0.001 AS DOUBLE))
 SELECT experiment_id, run_id, variable, grid_idx, count(*) AS n_sources, min(lo) AS low, max(hi) AS high FROM w JOIN bad USING (experiment_id, run_id, variable, grid_idx) GROUP BY ALL""",
    "l5_anomalies": "WITH fit AS (" + i.SQL["l5_kinetic_fit"] + "), sp(variable, slope_low, slope_high) AS (VALUES ('click', -0.001::DOUBLE, 0.001::DOUBLE), ('view', -0.0005::DOUBLE, 0::DOUBLE)) SELECT experiment_id, run_id, variable, window_idx, slope, slope_low, slope_high FROM fit JOIN sp USING (variable) WHERE slope < slope_low OR slope > slope_high",
    "l6_by_organism": p._BASE + _ORG + " SELECT experiment_id, observation_id, low, high FROM kept JOIN pr USING (experiment_id, variable) WHERE value < low OR value > high",
    "l9_graph": p._BASE + """, k AS (SELECT *, experiment_id || '/' || run_id AS sample, 'S' || (CAST(substr(observation_id, 3) AS BIGINT) % 3) AS source FROM kept)
 SELECT DISTINCT 'vertex' AS part, 'sample' AS kind, sample AS src, CAST(NULL AS VARCHAR) AS dst FROM k UNION ALL SELECT DISTINCT 'vertex', 'condition', variable, NULL FROM k UNION ALL SELECT 'vertex', 'measurement', observation_id, NULL FROM k UNION ALL SELECT DISTINCT 'vertex', 'source', source, NULL FROM k
 UNION ALL SELECT 'edge', 'measured_on', observation_id, sample FROM k UNION ALL SELECT 'edge', 'measures', observation_id, variable FROM k UNION ALL SELECT DISTINCT 'edge', 'derived_from', sample, source FROM k""",
    "v4_planted": p._PTS + " SELECT experiment_id, run_id, variable, 'one_length' AS rule FROM quality WHERE CAST(substr(run_id, 5) AS INTEGER) % 4 = 0 UNION ALL SELECT experiment_id, run_id, variable, 'shares_add_up' FROM quality WHERE CAST(substr(run_id, 5) AS INTEGER) % 5 = 0 AND pct_imputed > 0.0010015",
    "v5_outputs": p._FIND + """, o AS (SELECT *, CASE WHEN seq % 23 = 0 THEN finding_id WHEN seq % 31 = 0 THEN 'C-other:' || finding_id ELSE 'C-' || experiment_id || ':' || finding_id END AS id, CASE WHEN seq % 17 = 0 THEN 1.5 ELSE confidence END AS conf FROM found)
 SELECT experiment_id, id AS finding_id, 'id_shape' AS rule FROM o WHERE seq % 23 = 0 OR seq % 31 = 0 UNION ALL SELECT experiment_id, id, 'evidence' FROM o WHERE seq % 29 = 0 UNION ALL SELECT experiment_id, id, 'confidence' FROM o WHERE conf > 1 UNION ALL SELECT experiment_id, id, 'judged_cap' FROM o WHERE seq % 5 = 0 AND conf > 0.85""",
    "v6_priors_version": "SELECT o_orderkey AS output_id, 'priors_version_current' AS rule FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'",
    "v7_kinds": _CLAIMS + """ SELECT experiment_id, claim_id, 'id_shape' AS rule FROM c2 WHERE seq % 19 = 0 AND kind <> 'failure' UNION ALL SELECT experiment_id, claim_id, 'citation' FROM c2 WHERE cited IS NULL AND cited_narrative IS NULL AND (kind IN ('analysis', 'question') OR NOT by_series)
 UNION ALL SELECT experiment_id, claim_id, 'confidence' FROM c2 WHERE confidence > 0.85 UNION ALL SELECT experiment_id, claim_id, 'basis' FROM c2 WHERE basis = 'hearsay' UNION ALL SELECT experiment_id, claim_id, 'no_cause' FROM c2 WHERE seq % 11 = 0""",
    "v7_errors": "SELECT o_orderkey AS output_id, 'error_has_no_claims' AS rule FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "v10_tags": _CLAIMS + ", e AS (SELECT DISTINCT experiment_id, variable FROM kept), m AS (SELECT experiment_id, variable, CAST(max(confidence) >= 0.8 AND variable <> 'view' AND bool_or(seq % 2 = 0) AND bool_or(seq % 2 = 1) AS DOUBLE) AS met FROM c2 GROUP BY experiment_id, variable) SELECT experiment_id, count(*) AS n_expected, round(avg(coalesce(met, 0)), 4) AS recall FROM e LEFT JOIN m USING (experiment_id, variable) GROUP BY 1",
}
