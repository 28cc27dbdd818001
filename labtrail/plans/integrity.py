"""Queries of claims, checks, trends and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labtrail.operators import checks, claims, prose, series, trends
from labtrail.plans import analytics as p
from labtrail.sources import adapters as a
from labtrail.sources import stored
from labtrail.sources.shared import shared_dir
from labtrail.streaming import streams

PRIORS = (("ring", ["loop"], "click", 0.0, 120.0), ("Bolt", ["screw", "small"], "view", 1.0, 150.0))
#: First event, second event, hours between them at most.
PAIRS = (("view", "purchase", 2.0), ("click", "error", 0.5), ("signup", "purchase", 24.0), ("click", "click", 1.0))
REGISTRY = (("P0", ["click", "view"], ["none"]), ("P1", ["click", "assay"], []), ("P2", ["view"], ["error"]))


def _priors(spark):
    return spark.createDataFrame(list(PRIORS), "organism string, aliases array<string>, variable string, low double, high double")


def _claims(spark, d):
    """A claim for each finding; some cite nothing, or what doesn't exist, or a series."""
    n = F.col("seq")
    none = F.array().cast("array<string>")
    cited = F.when(n % 5 == 0, none).when(n % 7 == 0, F.array(F.lit("F-999999"))).otherwise(F.array("finding_id"))
    pair = F.array(F.struct("run_id", "variable"))
    return p._findings(spark, d).select(
        "experiment_id",
        "seq",
        F.format_string("D-F-%04d", n).alias("claim_id"),
        cited.alias("cited_finding_ids"),
        F.when(n % 4 == 0, pair).otherwise(F.filter(pair, lambda x: F.lit(False))).alias("cited_trajectories"),
        F.array("variable").alias("affected_variables"),
        (F.lit(0.25) + (n % 8) * 0.125).alias("confidence"),
        F.when(n % 3 == 0, "process_priors").when(n % 13 == 0, "hearsay").otherwise("schema_only").alias("confidence_basis"),
        F.concat("variable", F.when(n % 11 == 0, " changed due to feed").otherwise(" is off")).alias("summary"),
    )


def c9_drop_unknown(spark, d):
    return claims.drop_unknown(_claims(spark, d), p._findings(spark, d), p._rows(spark, d).where("run_id <> 'RUN-0003'")).select("experiment_id", "claim_id")


def c12_many_priors(spark, d):
    """As many priors as parts, asked for by pieces of their names of two characters and more."""
    name = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 500).cast("string"))
    rows = a.load(spark, d, "part").select("p_partkey", name.alias("organism"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"), F.col("p_type").alias("variable"))
    asked = rows.select(F.expr("substring(organism, 1 + p_partkey % 4, 2 + p_partkey % 12)").alias("query"))
    return claims.resolve_priors(rows.drop("p_partkey"), asked.unionByName(rows.select(F.concat_ws("/", "aliases", "variable").alias("query")))).select("query", "organism", "variable")


def c13_fingerprint(spark, d):
    present = p._rows(spark, d, "user_id").withColumn("experiment_id", F.col("run_id")).groupBy("experiment_id").agg(F.collect_set("variable").alias("present"))
    registry = spark.createDataFrame(list(REGISTRY), "process_id string, required array<string>, forbidden array<string>")
    tried = present.select("experiment_id", F.concat(F.lit("P"), (F.substring("experiment_id", 5, 9).cast("int") % 3).cast("string")).alias("process_id"))
    return claims.fingerprint(tried, registry, present).select("experiment_id", "process_id", "accepted")


def c16_missing_evidence(spark, d):
    used = p._findings(spark, d).select("experiment_id", F.col("finding_id").alias("label"), "observation_id")
    return checks.missing_references(used, p._rows(spark, d).where("value < 200"), "observation_id")


def c16_all_evidence(spark, d):
    used = p._evidence(spark, d).withColumnRenamed("finding_id", "label")
    return checks.missing_references(used, p._rows(spark, d).where("value < 200"), "observation_id")


def c18_downgrade(spark, d):
    unknown = p._rows(spark, d).where("experiment_id = 'EXP-1'").select("experiment_id").distinct()
    return claims.downgrade(_claims(spark, d), _priors(spark), unknown).select("experiment_id", "claim_id", "confidence_basis", "provenance_downgraded")


def c20_supported_facts(spark, d):
    """The third word of a document, held against its own lines."""
    return prose.supported_facts(*_facts(spark, d))


def _facts(spark, d):
    docs = a.load(spark, d, "documents")
    facts = docs.select("doc_id", F.get(F.split("text", " "), 2).alias("value")).where("length(value) > 0")
    return facts, docs.select("doc_id", F.explode(F.split("text", "\n")).alias("span"))


def d18_duplicate_ids(spark, d):
    line = a.load(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    docs = a.load(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("id"))
    return checks.duplicate_ids(("lineitem", line), ("texts", docs))


def d18_all_collections(spark, d):
    """The ids of nine collections of each experiment; series and questions are named alike, and so are some fits and nodes."""
    rows, found = p._rows(spark, d), p._findings(spark, d)
    e, series_id = F.col("experiment_id"), F.concat_ws("/", "run_id", "variable")
    fit = F.concat_ws("/", "run_id", "variable", F.floor(F.col("time_h") / 120).cast("string"))
    node = F.when(F.floor("time_h") % 50 == 0, fit).otherwise(F.col("observation_id"))
    of = lambda df, i: df.select(e, i.alias("id"))
    return checks.ids_used_twice(
        ("findings", of(found, F.col("finding_id"))),
        ("timeline", of(found, F.concat(F.lit("EV-"), "finding_id"))),
        ("deviations", of(p._spec_rows(spark, d).where("expected is not null"), F.concat(F.lit("DV-"), "observation_id"))),
        ("trajectories", of(rows, series_id).distinct()),
        ("open_questions", of(found, series_id).distinct()),
        ("kinetic_estimates", of(rows, fit).distinct()),
        ("nodes", of(rows, node).distinct()),
        ("edges", of(rows, F.concat_ws(">", "observation_id", "variable"))),
        ("narratives", a.load(spark, d, "conversations").select(F.lit("EXP-1").alias("experiment_id"), F.concat_ws("-", F.lit("N"), "conv_id", "turn").alias("id"))),
    )


def v4_trajectories(spark, d):
    points = p._points(spark, d)
    return checks.check_trajectories(series.trajectories(points).join(series.series_quality(points), series.KEY))


def v10_score(spark, d):
    own = _claims(spark, d)
    expected = p._rows(spark, d).select("experiment_id", "variable").distinct().select("experiment_id", F.array("variable").alias("keywords"), F.array().cast("array<string>").alias("must_cite"), F.lit(0.8).alias("min_confidence"))
    return claims.score(own, expected)


def l9_edges(spark, d):
    return trends.facts_graph(p._rows(spark, d))[1]


def l10_latest_ids(spark, d):
    """Each event is superseded by the user's next one of its type."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return trends.latest_ids(a.load(spark, d, "events").select(F.col("event_id").alias("id"), F.lead("event_id").over(w).alias("superseded_by")))


def l10_stored(spark, d):
    """The same chains, stored and extended: links to events of the first half of the days, then the others."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    links = a.load(spark, d, "events").select(F.col("event_id").alias("id"), F.lead("event_id").over(w).alias("superseded_by"), F.coalesce(F.lead("ts").over(w), "ts").alias("told"))
    early, at = F.col("told") < F.lit("2024-01-15").cast("timestamp_ntz"), f"{shared_dir(spark)}/pointers-{uuid.uuid4().hex}"
    for batch in (links.where(early), links.where(~early)):
        stored.extend_chains(batch.select("id", "superseded_by"), at, 16)
    return stored.pointers(spark, at)


def s2_range_windows(spark, d):
    """The events as a stream: counts of closed windows."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, for a file stream takes no single file
    obs = stream.select((F.concat(F.lit("EXP-"), (F.col("user_id") % 2).cast("string"))).alias("experiment_id"), F.format_string("RUN-%04d", F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("variable"), "value", F.col("ts").cast("timestamp").alias("event_time"))
    out = f"{shared_dir(spark)}/range-{uuid.uuid4().hex}"
    counts = streams.range_stream(obs, a.specs(spark))
    query = counts.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).withColumn("window_start", F.col("window_start").cast("string"))


def s2_rollup(spark, d):
    """The events as a stream that counts each run and variable, singles up to a hundred and roll-ups beyond."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    obs = stream.select((F.concat(F.lit("EXP-"), (F.col("user_id") % 2).cast("string"))).alias("experiment_id"), F.format_string("RUN-%04d", F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("variable"), F.format_string("O-%09d", "event_id").alias("observation_id"), "value", F.col("ts").cast("timestamp").alias("event_time"))
    out = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rows = streams.rollup_stream(obs, a.specs(spark))
    rows.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    told = streams.settled(spark.read.schema(rows.schema).parquet(out))
    return told.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("t_start", "t_end")})


QUERIES = {
    "c9_drop_unknown": c9_drop_unknown,
    "c12_many_priors": c12_many_priors,
    "c12_resolve_priors": lambda s, d: claims.resolve_priors(_priors(s), a.load(s, d, "part").select(F.col("p_name").alias("query"))).select("query", "organism", "variable"),
    "c13_fingerprint": c13_fingerprint,
    "c15_missing_findings": lambda s, d: checks.missing_references(_claims(s, d).select("experiment_id", F.col("claim_id").alias("label"), F.explode("cited_finding_ids").alias("finding_id")), p._findings(s, d), "finding_id"),
    "c16_missing_evidence": c16_missing_evidence,
    "c16_all_evidence": c16_all_evidence,
    "c17_backfill": lambda s, d: claims.backfill(_claims(s, d), p._rows(s, d)).select("experiment_id", "claim_id", F.array_join(F.transform("cited_trajectories", lambda x: F.concat_ws("/", x["run_id"], x["variable"])), "|").alias("cited")),
    "c18_downgrade": c18_downgrade,
    "c20_supported_facts": c20_supported_facts,
    "d18_duplicate_ids": d18_duplicate_ids,
    "v4_trajectories": v4_trajectories,
    "v5_findings": lambda s, d: checks.check_findings(p._findings(s, d)),
    "v7_claims": lambda s, d: checks.check_claims(_claims(s, d)),
    "v10_score": v10_score,
    "l1_cohort_outliers": lambda s, d: trends.cohort_outliers(p._rows(s, d, "user_id")),
    "l2_contradictions": lambda s, d: trends.contradictions(p._rows(s, d), 12.0),
    "l3_mass_balance": lambda s, d: trends.mass_balance(p._rows(s, d), 12.0, "view", "click", 1.02, 0.1),
    "l4_pairs": lambda s, d: trends.precedes_any(p._rows(s, d), s.createDataFrame(list(PAIRS), "first string, second string, max_lag double")),
    "l5_sliding_fit": lambda s, d: trends.sliding_fit(p._rows(s, d), 24.0),
    "l4_precedes": lambda s, d: trends.precedes(p._rows(s, d), "view", "purchase", 2.0),
    "l5_kinetic_fit": lambda s, d: trends.kinetic_fit(p._rows(s, d), 120.0),
    "l6_prior_violations": lambda s, d: claims.prior_violations(p._rows(s, d), _priors(s)).select("experiment_id", "observation_id", "low", "high"),
    "l7_trend_direction": lambda s, d: trends.trend_direction(p._points(s, d)),
    "l8_cross_run_delta": lambda s, d: trends.cross_run_delta(p._rows(s, d)),
    "l9_edges": l9_edges,
    "d18_all_collections": d18_all_collections,
    "l10_latest_ids": l10_latest_ids,
    "l10_stored": l10_stored,
    "s2_rollup": s2_rollup,
    "l11_relationship": lambda s, d: trends.relationship_checks(p._rows(s, d), 12.0, "view", "click", 0.2, 5.0),
    "s2_range_windows": s2_range_windows,
}

_CLAIMS = p._FIND + """, claims AS (SELECT experiment_id, seq, run_id, variable, finding_id, printf('D-F-%04d', seq) AS claim_id, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 7 = 0 THEN 'F-999999' ELSE finding_id END AS cited, seq % 4 = 0 AS by_series, CAST(0.25 AS DOUBLE) + (seq % 8) * CAST(0.125 AS DOUBLE) AS confidence, CASE WHEN seq % 3 = 0 THEN 'process_priors' WHEN seq % 13 = 0 THEN 'hearsay' ELSE 'schema_only' END AS basis FROM found)"""
_PAIR = p._grid(p._BASE, p.RUN10) + ", pair AS (SELECT x.experiment_id, x.run_id, x.grid_idx, x.value AS a, y.value AS b FROM real x JOIN real y USING (experiment_id, run_id, grid_idx) WHERE x.variable = 'view' AND y.variable = 'click')"
_BYRUN = p._PTS
SQL = {
    "d18_all_collections": p._FIND + """, fits AS (SELECT *, run_id || '/' || variable || '/' || CAST(floor(time_h / 120) AS BIGINT) AS fit FROM kept),
 x AS (SELECT 'findings' AS c, experiment_id, finding_id AS id FROM found UNION ALL SELECT 'timeline', experiment_id, 'EV-' || finding_id FROM found UNION ALL SELECT 'deviations', experiment_id, 'DV-' || observation_id FROM s WHERE expected IS NOT NULL
 UNION ALL SELECT DISTINCT 'trajectories', experiment_id, run_id || '/' || variable FROM kept UNION ALL SELECT DISTINCT 'open_questions', experiment_id, run_id || '/' || variable FROM found UNION ALL SELECT DISTINCT 'kinetic_estimates', experiment_id, fit FROM fits
 UNION ALL SELECT DISTINCT 'nodes', experiment_id, CASE WHEN CAST(floor(time_h) AS BIGINT) % 50 = 0 THEN fit ELSE observation_id END FROM fits UNION ALL SELECT 'edges', experiment_id, observation_id || '>' || variable FROM kept UNION ALL SELECT 'narratives', 'EXP-1', 'N-' || conv_id || '-' || turn FROM conversations)
 SELECT experiment_id, id, count(*) AS n, string_agg(DISTINCT c, '|' ORDER BY c) AS collections FROM x GROUP BY 1, 2 HAVING count(*) > 1""",
    "s2_rollup": "WITH " + a.SPECS_SQL + """, v AS (SELECT 'EXP-' || (user_id % 2) AS experiment_id, printf('RUN-%04d', user_id % 10) AS run_id, event_type AS variable, printf('O-%09d', event_id) AS observation_id, ts, abs(round((value - nominal) / std_dev, 6)) AS s FROM events JOIN specs ON variable = event_type WHERE abs(round((value - nominal) / std_dev, 6)) >= 2),
 n AS (SELECT *, count(*) OVER (PARTITION BY experiment_id, run_id, variable) AS n FROM v)
 SELECT experiment_id, run_id, variable, CAST(1 AS BIGINT) AS n_violations, s AS max_abs_sigmas, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t_start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t_end, observation_id FROM n WHERE n <= 100
 UNION ALL SELECT experiment_id, run_id, variable, count(*), max(s), strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'), NULL FROM n WHERE n > 100 GROUP BY experiment_id, run_id, variable""",
    "c9_drop_unknown": _CLAIMS + " SELECT experiment_id, claim_id FROM claims WHERE coalesce(cited <> 'F-999999', true) AND NOT (by_series AND run_id = 'RUN-0003')",
    "c12_many_priors": """WITH pr AS (SELECT p_partkey, p_name || ' ' || (p_partkey % 500) AS organism, p_brand || ' ' || p_type AS alias, p_type AS variable FROM part),
 q AS (SELECT DISTINCT substr(organism, CAST(1 + p_partkey % 4 AS BIGINT), CAST(2 + p_partkey % 12 AS BIGINT)) AS query FROM pr UNION SELECT alias || '/' || variable FROM pr)
 SELECT query, organism, variable FROM q JOIN pr ON contains(lower(organism), lower(query)) OR contains(lower(query), lower(organism)) OR contains(lower(alias), lower(query)) OR contains(lower(query), lower(alias))""",
    "c12_resolve_priors": "WITH q AS (SELECT DISTINCT p_name AS query FROM part), pr(organism, alias, variable) AS (VALUES ('ring', 'ring', 'click'), ('ring', 'loop', 'click'), ('Bolt', 'bolt', 'view'), ('Bolt', 'screw', 'view'), ('Bolt', 'small', 'view')) SELECT DISTINCT query, organism, variable FROM q JOIN pr ON contains(lower(query), alias) OR contains(alias, lower(query))",
    "c13_fingerprint": _BYRUN + ", h AS (SELECT run_id, CAST(substr(run_id, 5) AS INTEGER) % 3 AS k, bool_or(variable = 'click') AS c, bool_or(variable = 'view') AS v, bool_or(variable = 'error') AS e FROM k2 GROUP BY 1) SELECT run_id AS experiment_id, 'P' || k AS process_id, CASE k WHEN 0 THEN c AND v WHEN 1 THEN false ELSE v AND NOT e END AS accepted FROM h",
    "s2_range_windows": "WITH " + a.SPECS_SQL + ", v AS (SELECT 'EXP-' || (user_id % 2) AS experiment_id, printf('RUN-%04d', user_id % 10) AS run_id, event_type AS variable, date_trunc('day', ts) AS day FROM events JOIN specs ON variable = event_type WHERE abs(round((value - nominal) / std_dev, 6)) >= 2) SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, experiment_id, run_id, variable, count(*) AS n_violations FROM v WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
    "c15_missing_findings": _CLAIMS + " SELECT experiment_id, claim_id AS label, cited AS finding_id FROM claims WHERE cited = 'F-999999'",
    "c16_missing_evidence": p._FIND + " SELECT experiment_id, finding_id AS label, observation_id FROM found WHERE observation_id NOT IN (SELECT observation_id FROM kept WHERE value < 200)",
    "c16_all_evidence": p._EVID + " SELECT experiment_id, finding_id AS label, observation_id FROM evid WHERE observation_id NOT IN (SELECT observation_id FROM kept WHERE value < 200)",
    "c17_backfill": _CLAIMS + ", t AS (SELECT experiment_id, variable, string_agg(DISTINCT run_id || '/' || variable, '|' ORDER BY run_id || '/' || variable) AS every FROM kept GROUP BY ALL) SELECT experiment_id, claim_id, CASE WHEN by_series THEN run_id || '/' || variable WHEN cited IS NULL THEN every ELSE '' END AS cited FROM claims LEFT JOIN t USING (experiment_id, variable)",
    "c18_downgrade": _CLAIMS + ", g AS (SELECT *, basis = 'process_priors' AND NOT (variable IN ('click', 'view') AND experiment_id <> 'EXP-1') AS down FROM claims) SELECT experiment_id, claim_id, CASE WHEN down THEN 'schema_only' ELSE basis END AS confidence_basis, down AS provenance_downgraded FROM g",
    "c20_supported_facts": "WITH f AS (SELECT doc_id, string_split(text, ' ')[3] AS value FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS span FROM documents) SELECT * FROM f WHERE length(value) > 0 AND EXISTS (FROM s WHERE s.doc_id = f.doc_id AND contains(lower(span), lower(value)))",
    "d18_duplicate_ids": "SELECT 'lineitem' AS collection, l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'texts', sha256(text), count(*) FROM documents GROUP BY ALL HAVING count(*) > 1",
    "v4_trajectories": p._PTS + " SELECT experiment_id, run_id, variable, 'shares_add_up' AS rule FROM quality WHERE abs(quality + pct_imputed + pct_missing - 1) > 0.001",
    "v5_findings": p._FIND + " SELECT experiment_id, finding_id, 'confidence' AS rule FROM found WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT experiment_id, finding_id, 'evidence' FROM found WHERE observation_id IS NULL",
    "v7_claims": _CLAIMS + " SELECT experiment_id, claim_id, 'citation' AS rule FROM claims WHERE cited IS NULL AND NOT by_series UNION ALL SELECT experiment_id, claim_id, 'confidence' FROM claims WHERE confidence > 0.85 UNION ALL SELECT experiment_id, claim_id, 'basis' FROM claims WHERE basis = 'hearsay' UNION ALL SELECT experiment_id, claim_id, 'no_cause' FROM claims WHERE seq % 11 = 0",
    "v10_score": _CLAIMS + ", e AS (SELECT DISTINCT experiment_id, variable FROM kept), m AS (SELECT DISTINCT experiment_id, variable, CAST(1 AS DOUBLE) AS met FROM claims WHERE confidence >= 0.8) SELECT experiment_id, count(*) AS n_expected, round(avg(coalesce(met, 0)), 4) AS recall FROM e LEFT JOIN m USING (experiment_id, variable) GROUP BY 1",
    "l1_cohort_outliers": _BYRUN + """, one AS (SELECT experiment_id, run_id, variable, arg_max(value, (time_h, observation_id)) AS final, max(value) AS peak, arg_max(time_h, (value, time_h)) AS time_to_peak FROM k2 GROUP BY ALL),
 long AS (SELECT experiment_id, run_id, variable, unnest([{'feature': 'final', 'x': final}, {'feature': 'peak', 'x': peak}, {'feature': 'time_to_peak', 'x': time_to_peak}], recursive := true) FROM one),
 c AS (SELECT experiment_id, variable, feature, avg(x) AS mean, stddev_samp(x) AS sd, count(*) AS n_runs FROM long GROUP BY ALL) SELECT experiment_id, run_id, variable, feature, x, n_runs, round((x - mean) / sd, 4) AS z FROM long JOIN c USING (experiment_id, variable, feature) WHERE n_runs >= 2 AND sd > 0 AND abs(round((x - mean) / sd, 4)) >= 2""",
    "l2_contradictions": _PAIR + " SELECT experiment_id, run_id, variable, grid_idx, count(*) AS n, min(value) AS low, max(value) AS high FROM k2 GROUP BY ALL HAVING abs(min(value) - max(value)) / greatest(abs(min(value)), abs(max(value)), 1.0) > CAST(0.001 AS DOUBLE)",
    "l3_mass_balance": _PAIR + " SELECT *, round(abs(a - b * CAST(1.02 AS DOUBLE)) / greatest(abs(a), 1.0), 6) AS error FROM pair WHERE error > 0.1",
    "l4_pairs": p._BASE + ", pairs(first, second, max_lag) AS (VALUES " + ", ".join(f"('{x}', '{y}', {z}::DOUBLE)" for x, y, z in PAIRS) + ") SELECT first, second, x.experiment_id, x.run_id, x.observation_id AS a_id, min(y.time_h) AS b_time, round(min(y.time_h) - any_value(x.time_h), 6) AS lag_h FROM pairs JOIN kept x ON x.variable = first JOIN kept y ON y.variable = second AND x.experiment_id = y.experiment_id AND x.run_id = y.run_id AND y.time_h > x.time_h AND y.time_h - x.time_h <= max_lag GROUP BY ALL",
    "l5_sliding_fit": p._BASE + ", f AS (SELECT experiment_id, run_id, variable, observation_id, time_h, count(*) OVER w AS n, var_pop(time_h) OVER w AS v, round(regr_slope(ln(value), time_h) OVER w, 6) AS slope FROM kept WHERE value > 0 WINDOW w AS (PARTITION BY experiment_id, run_id, variable ORDER BY time_h RANGE BETWEEN 24 PRECEDING AND CURRENT ROW)) SELECT * EXCLUDE (v) FROM f WHERE n >= 3 AND v >= 0.25",
    "l4_precedes": p._BASE + " SELECT x.experiment_id, x.run_id, x.observation_id AS a_id, min(y.time_h) AS b_time, round(min(y.time_h) - any_value(x.time_h), 6) AS lag_h FROM kept x JOIN kept y ON x.experiment_id = y.experiment_id AND x.run_id = y.run_id AND y.time_h > x.time_h AND y.time_h - x.time_h <= 2 WHERE x.variable = 'view' AND y.variable = 'purchase' GROUP BY ALL",
    "l5_kinetic_fit": p._BASE + " SELECT experiment_id, run_id, variable, CAST(floor(time_h / 120) AS INTEGER) AS window_idx, count(*) AS n, round(regr_slope(ln(value), time_h), 6) AS slope, round(regr_r2(ln(value), time_h), 6) AS r2 FROM kept WHERE value > 0 GROUP BY ALL HAVING count(*) >= 3",
    "l6_prior_violations": p._BASE + ", pr(variable, low, high) AS (VALUES ('click', 0::DOUBLE, 120::DOUBLE), ('view', 1::DOUBLE, 150::DOUBLE)) SELECT experiment_id, observation_id, low, high FROM kept JOIN pr USING (variable) WHERE value < low OR value > high",
    "l7_trend_direction": p._PTS + """, r AS (SELECT experiment_id, run_id, variable, grid_idx, (value - lag(value) OVER w) / (time_h - lag(time_h) OVER w) AS rate FROM points WHERE observation_id IS NOT NULL WINDOW w AS (PARTITION BY experiment_id, run_id, variable ORDER BY grid_idx)),
 t AS (SELECT experiment_id, run_id, variable, CAST(sum(CASE WHEN turn THEN 1 ELSE 0 END) AS BIGINT) AS turns FROM (SELECT *, sign(rate) * sign(lag(rate) OVER (PARTITION BY experiment_id, run_id, variable ORDER BY grid_idx)) < 0 AS turn FROM r WHERE rate IS NOT NULL) GROUP BY ALL),
 s AS (SELECT experiment_id, run_id, variable, count(*) AS n, round(regr_slope(value, time_h), 6) AS slope FROM points WHERE observation_id IS NOT NULL GROUP BY ALL)
 SELECT experiment_id, run_id, variable, n, turns, slope, CASE WHEN turns * 2 > n - 2 THEN 'oscillating' WHEN abs(slope) <= 0.001 THEN 'plateau' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM s JOIN t USING (experiment_id, run_id, variable) WHERE n >= 3""",
    "l8_cross_run_delta": p._BASE + """, r AS (SELECT experiment_id, run_id, variable, CAST(sum(CAST(round(value * 1e6) AS HUGEINT)) AS HUGEINT) AS s, count(*) AS n FROM kept GROUP BY ALL),
 m AS (SELECT *, sign(s) * ((2000 * abs(s) + n) // (2 * n)) AS m FROM r), e AS (SELECT *, count(*) OVER w AS runs, m * count(*) OVER w - CAST(sum(m) OVER w AS HUGEINT) AS off FROM m WINDOW w AS (PARTITION BY experiment_id, variable))
 SELECT experiment_id, run_id, variable, CAST(sign(m) * ((2 * abs(m) + 100000) // 200000) AS DOUBLE) / 1e4 AS mean, CAST(sign(off) * ((2 * abs(off) + 100000 * runs) // (200000 * runs)) AS DOUBLE) / 1e4 AS delta FROM e""",
    "l9_edges": p._BASE + " SELECT 'measured_on' AS kind, observation_id AS src, experiment_id || '/' || run_id AS dst FROM kept UNION ALL SELECT 'measures', observation_id, variable FROM kept",
    "l10_stored": "SELECT event_id AS id, last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM events",
    "l10_latest_ids": "SELECT event_id AS id, last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM events",
    "l11_relationship": _PAIR + " SELECT *, round(a / nullif(b, 0), 6) AS ratio FROM pair WHERE ratio < 0.2 OR ratio > 5",
}
