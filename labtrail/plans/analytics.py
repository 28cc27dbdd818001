"""Queries of the observation analytics over ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.operators import findings as f
from labtrail.operators import series, summary
from labtrail.sources.adapters import OBS_SQL, SPECS_SQL, observations, specs

RUN10, RUNS = "user_id % 10", "user_id"


def _rows(spark, d, run=RUN10):
    return summary.summary(observations(spark, d, run))


def _spec_rows(spark, d):
    return summary.with_specs(_rows(spark, d), specs(spark))


def _violations(spark, d):
    return f.violations(_spec_rows(spark, d))


def _findings(spark, d):
    return f.findings(f.rollup(_violations(spark, d)))


def _evidence(spark, d):
    return f.evidence(_findings(spark, d), _violations(spark, d))


def _points(spark, d):
    return series.grid_points(_rows(spark, d, RUNS), 12.0, 720.0)


def _quality10(spark, d):
    return series.series_quality(series.grid_points(_rows(spark, d), 12.0, 720.0))


def _joined(df, *names):
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), "|") for n in names})


def b12_dropped(spark, d):
    return summary.split_summary(observations(spark, d)).where("reason is not null").select("experiment_id", "observation_id", "reason")


def c5_merge_specs(spark, d):
    """Defaults are the specs; overrides come from the events: means as nominals, for clicks a spread too, views cleared."""
    rows = _rows(spark, d).groupBy("variable").agg(F.round(F.avg("value"), 2).alias("nominal"))
    has = F.col("variable").isin("click", "error", "purchase")
    overrides = rows.select("variable", F.when(has, F.col("nominal")).alias("nominal"), F.when(F.col("variable").isin("click", "error"), 5.0).alias("std_dev"), F.lit(True).alias("has_nominal"), F.col("variable").isin("click", "error").alias("has_std_dev"))
    return summary.merge_specs(specs(spark), overrides)


def d7_trajectories(spark, d):
    """The arrays themselves, as texts: hours, hundredths of values (- for missing ones), flags and ids."""
    own = series.trajectories(_points(spark, d))
    cents = F.transform("values", lambda x: F.coalesce(F.round(x * 100).cast("long").cast("string"), F.lit("-")))
    texts = {"time_grid": F.transform("time_grid", lambda x: x.cast("long").cast("string")), "values": cents, "imputation_flags": F.transform("imputation_flags", lambda x: x.cast("int").cast("string")), "source_observation_ids": F.col("source_observation_ids")}
    return own.withColumns({n: F.array_join(c, "|") for n, c in texts.items()})


QUERIES = {
    "b12_dropped": b12_dropped,
    "c4_with_specs": lambda s, d: _spec_rows(s, d),
    "c5_merge_specs": c5_merge_specs,
    "d6_extent_sets": lambda s, d: _joined(summary.extent_sets(_rows(s, d)), "run_ids", "variables"),
    "d12_spec_coverage": lambda s, d: summary.spec_coverage(_spec_rows(s, d)),
    "d13_extent": lambda s, d: summary.extent(_rows(s, d)),
    "d17_stats": lambda s, d: summary.stats(_rows(s, d)),
    "b13_violations": lambda s, d: _violations(s, d).select("experiment_id", "observation_id", "run_id", "variable", "time_h", "value", "sigmas", "severity", "confidence"),
    "b15_deviations": lambda s, d: f.deviations(_spec_rows(s, d)),
    "d9_rollup": lambda s, d: f.rollup(_violations(s, d)).drop("order_sigmas"),
    "d9_evidence": _evidence,
    "f2_findings": _findings,
    "f3_timeline": lambda s, d: f.timeline(_findings(s, d)),
    "c6_caveats": lambda s, d: f.with_caveat(_violations(s, d), _quality10(s, d)).select("experiment_id", "observation_id", "quality", "caveat"),
    "c14_open_questions": lambda s, d: f.open_questions(_findings(s, d), _quality10(s, d)),
    "d10_severity_rollup": lambda s, d: f.severity_rollup(_findings(s, d)),
    "f4_top_findings": lambda s, d: f.top_findings(_findings(s, d)).select("experiment_id", "finding_id", "place", "severity", "aggregated"),
    "b17_filter_findings": lambda s, d: f.filter_findings(_findings(s, d), variable="signup", severity="minor").select("experiment_id", "finding_id", "run_id", "total", "place", "truncated"),
    "d11_process_flags": lambda s, d: f.process_flags(_rows(s, d), _quality10(s, d), summary.spec_coverage(_spec_rows(s, d))),
    "e1_grid_points": _points,
    "e4_last_at_point": lambda s, d: series.last_at_point(series.snap(_rows(s, d, RUNS), 12.0)),
    "d8_series_quality": lambda s, d: series.series_quality(_points(s, d)),
    "d7_trajectories": d7_trajectories,
    "e9_rates": lambda s, d: series.rates(_points(s, d)),
    "b19_timecourse": lambda s, d: series.timecourse(_points(s, d), "RUN-0007", "click", 0.0, 480.0, 20),
}

_BASE = f"WITH {OBS_SQL.format(run=RUN10)}, {SPECS_SQL}, kept AS (SELECT * FROM obs WHERE value IS NOT NULL AND run_id IS NOT NULL)"
_SPEC = _BASE + ", s AS (SELECT kept.*, nominal AS expected, std_dev AS expected_std_dev FROM kept LEFT JOIN specs USING (variable))"
_VIOL = _SPEC + """, v0 AS (SELECT *, round((value - expected) / expected_std_dev, 6) AS sigmas FROM s WHERE expected IS NOT NULL),
 v AS (SELECT *, CASE WHEN abs(sigmas) < 3 THEN 1 WHEN abs(sigmas) < 5 THEN 2 ELSE 3 END AS severity_rank FROM v0 WHERE abs(sigmas) >= 2),
 viol AS (SELECT *, CASE severity_rank WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END AS severity, CASE severity_rank WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.95::DOUBLE ELSE 0.99::DOUBLE END AS confidence FROM v)"""
_ROLL = _VIOL + """, counted AS (SELECT *, count(*) OVER (PARTITION BY experiment_id, run_id, variable) AS n FROM viol),
 cand AS (SELECT experiment_id, run_id, variable, severity_rank, severity, confidence, time_h AS t_start, time_h AS t_end, value AS observed_min, value AS observed_max, abs(sigmas) AS max_abs_sigmas, CAST(1 AS BIGINT) AS n_violations, false AS aggregated, abs(sigmas) AS order_sigmas, observation_id FROM counted WHERE n <= 100
 UNION ALL BY NAME SELECT experiment_id, run_id, variable, max(severity_rank) AS severity_rank, arg_max(severity, severity_rank) AS severity, max(confidence) AS confidence, min(time_h) AS t_start, max(time_h) AS t_end, min(value) AS observed_min, max(value) AS observed_max, max(abs(sigmas)) AS max_abs_sigmas, count(*) AS n_violations, true AS aggregated, CAST(0 AS DOUBLE) AS order_sigmas, min(observation_id) AS observation_id FROM counted WHERE n > 100 GROUP BY experiment_id, run_id, variable)"""
_FIND = _ROLL + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY severity_rank DESC, order_sigmas DESC, run_id, t_start, variable, observation_id) AS seq FROM cand),
 found AS (SELECT * EXCLUDE (order_sigmas), printf('F-%04d', seq) AS finding_id FROM numbered)"""

_EVID = _FIND + """, evid AS (SELECT experiment_id, finding_id, observation_id FROM found WHERE NOT aggregated
 UNION ALL SELECT experiment_id, finding_id, viol.observation_id FROM found JOIN viol USING (experiment_id, run_id, variable) WHERE aggregated)"""


def _grid(base: str, run: str) -> str:
    return base + f""", o2 AS (SELECT experiment_id, observation_id, CASE WHEN CAST(substr(observation_id, 3) AS BIGINT) % 89 <> 0 THEN run2 END AS run_id, time_h, variable, value, unit FROM (SELECT obs.*, printf('RUN-%04d', {run}) AS run2 FROM obs JOIN events ON event_id = CAST(substr(observation_id, 3) AS BIGINT))),
 k2 AS (SELECT *, CAST(floor(time_h / 12) AS INTEGER) AS grid_idx FROM o2 WHERE value IS NOT NULL AND run_id IS NOT NULL),
 real AS (SELECT experiment_id, run_id, variable, grid_idx, value, observation_id, unit FROM k2 QUALIFY row_number() OVER (PARTITION BY experiment_id, run_id, variable, grid_idx ORDER BY time_h DESC, observation_id DESC) = 1),
 pts AS (SELECT k.*, CAST(g AS INTEGER) AS grid_idx FROM (SELECT DISTINCT experiment_id, run_id, variable FROM real) k, range(61) t(g)),
 filled AS (SELECT p.*, r.value AS own, r.observation_id, last_value(r.value IGNORE NULLS) OVER (PARTITION BY p.experiment_id, p.run_id, p.variable ORDER BY p.grid_idx ROWS UNBOUNDED PRECEDING) AS value FROM pts p LEFT JOIN real r USING (experiment_id, run_id, variable, grid_idx)),
 points AS (SELECT experiment_id, run_id, variable, grid_idx, CAST(grid_idx * 12 AS DOUBLE) AS time_h, value, own IS NULL AND value IS NOT NULL AS imputed, value IS NULL AS missing, observation_id FROM filled),
 quality AS (SELECT experiment_id, run_id, variable, round(avg(CAST(observation_id IS NOT NULL AS INTEGER)), 6) AS quality, round(avg(CAST(imputed AS INTEGER)), 6) AS pct_imputed, round(avg(CAST(missing AS INTEGER)), 6) AS pct_missing FROM points GROUP BY ALL)"""


_PTS = _grid(_BASE, RUNS)
SQL = {
    "b12_dropped": _BASE + " SELECT experiment_id, observation_id, CASE WHEN value IS NULL THEN 'missing observation_id or value' ELSE 'locator missing run_id or timestamp_h' END AS reason FROM obs WHERE value IS NULL OR run_id IS NULL",
    "c4_with_specs": _SPEC + " SELECT * FROM s",
    "c5_merge_specs": _BASE + """, m AS (SELECT variable, round(avg(value), 2) AS mean FROM kept GROUP BY 1), o AS (SELECT variable, CASE WHEN variable IN ('click', 'error', 'purchase') THEN mean END AS nominal, CASE WHEN variable IN ('click', 'error') THEN 5.0::DOUBLE END AS std_dev, variable IN ('click', 'error') AS hs FROM m),
 j AS (SELECT variable, CASE WHEN o.variable IS NOT NULL THEN o.nominal ELSE specs.nominal END AS nominal, CASE WHEN coalesce(hs, false) THEN o.std_dev ELSE specs.std_dev END AS std_dev, CASE WHEN o.variable IS NULL THEN 'schema' WHEN hs THEN 'dossier' ELSE 'merged' END AS provenance FROM specs FULL JOIN o USING (variable)) SELECT * FROM j WHERE nominal IS NOT NULL AND std_dev IS NOT NULL""",
    "d6_extent_sets": _BASE + " SELECT experiment_id, string_agg(DISTINCT run_id, '|' ORDER BY run_id) AS run_ids, string_agg(DISTINCT variable, '|' ORDER BY variable) AS variables FROM kept GROUP BY 1",
    "d12_spec_coverage": _SPEC + " SELECT experiment_id, variable, bool_or(expected IS NOT NULL) AS has_spec FROM s GROUP BY ALL",
    "d13_extent": _BASE + " SELECT experiment_id, count(DISTINCT run_id) AS n_runs, count(*) AS n_observations, min(time_h) AS t_min, max(time_h) AS t_max FROM kept GROUP BY 1",
    "d17_stats": _BASE + " SELECT experiment_id, run_id, variable, count(*) AS n, CAST(sign(sum(CAST(round(value * 1e6) AS HUGEINT))) * ((2 * abs(CAST(sum(CAST(round(value * 1e6) AS HUGEINT)) AS HUGEINT)) + 100 * count(*)) // (200 * count(*))) AS DOUBLE) / 1e4 AS mean, min(value) AS low, max(value) AS high FROM kept GROUP BY ALL",
    "b13_violations": _VIOL + " SELECT experiment_id, observation_id, run_id, variable, time_h, value, sigmas, severity, confidence FROM viol",
    "b15_deviations": _SPEC + " SELECT experiment_id, run_id, variable, observation_id, time_h, value, round(value - expected, 6) AS residual, round((value - expected) / expected_std_dev, 6) AS sigmas FROM s WHERE expected IS NOT NULL",
    "d9_rollup": _ROLL + " SELECT * EXCLUDE (order_sigmas) FROM cand",
    "d9_evidence": _EVID + " SELECT * FROM evid",
    "f2_findings": _FIND + " SELECT * FROM found",
    "f3_timeline": _FIND + """, t AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY t_start, severity_rank DESC, run_id, variable, finding_id) AS place FROM found),
 g AS (SELECT *, round((lead(t_start) OVER (PARTITION BY experiment_id, run_id ORDER BY place) - t_start) * 3600, 6) AS gap FROM t) SELECT experiment_id, place AS seq, finding_id, run_id, variable, t_start, severity, CASE WHEN gap > 0 THEN gap END AS lag_s FROM g""",
    "c6_caveats": _grid(_VIOL, RUN10) + " SELECT experiment_id, observation_id, quality, coalesce(quality < 0.8, false) AS caveat FROM viol LEFT JOIN quality USING (experiment_id, run_id, variable)",
    "c14_open_questions": _grid(_FIND, RUN10) + " SELECT experiment_id, run_id, variable, count(*) AS n_findings, min(finding_id) AS first_finding, quality FROM found JOIN quality USING (experiment_id, run_id, variable) WHERE quality < 0.8 GROUP BY ALL",
    "d10_severity_rollup": _FIND + " SELECT experiment_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'critical') AS critical FROM found GROUP BY 1",
    "f4_top_findings": _FIND + " SELECT experiment_id, finding_id, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY severity_rank DESC, aggregated DESC, seq) AS INTEGER) AS place, severity, aggregated FROM found QUALIFY place <= 10",
    "b17_filter_findings": _FIND + " SELECT experiment_id, finding_id, run_id, count(*) OVER (PARTITION BY experiment_id) AS total, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY seq) AS INTEGER) AS place, count(*) OVER (PARTITION BY experiment_id) > 100 AS truncated FROM found WHERE variable = 'signup' AND severity = 'minor' QUALIFY place <= 100",
    "d11_process_flags": _grid(_SPEC, RUN10) + """, a AS (SELECT experiment_id, count(*) AS n, count(DISTINCT run_id) AS runs FROM kept GROUP BY 1), b AS (SELECT experiment_id, bool_or(quality < 0.8) AS low FROM quality GROUP BY 1),
 c AS (SELECT experiment_id, avg(CASE WHEN has THEN 0.0 ELSE 1.0 END) > 0.5 AS unspecified FROM (SELECT experiment_id, variable, bool_or(expected IS NOT NULL) AS has FROM s GROUP BY ALL) GROUP BY 1)
 SELECT experiment_id, concat_ws(',', CASE WHEN low THEN 'LOW_QUALITY_TRAJECTORY' END, CASE WHEN runs > 1 THEN 'MULTI_RUN' END, CASE WHEN n < 20 THEN 'SPARSE_DATA' END, CASE WHEN unspecified THEN 'SPECS_MOSTLY_MISSING' END) AS flags FROM a JOIN b USING (experiment_id) JOIN c USING (experiment_id)""",
    "e1_grid_points": _PTS + " SELECT * FROM points",
    "e4_last_at_point": _PTS + " SELECT * FROM real",
    "d8_series_quality": _PTS + " SELECT * FROM quality",
    "d7_trajectories": _PTS + " SELECT experiment_id, run_id, variable, string_agg(CAST(CAST(time_h AS BIGINT) AS VARCHAR), '|' ORDER BY grid_idx) AS time_grid, string_agg(coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '-'), '|' ORDER BY grid_idx) AS values, string_agg(CAST(CAST(imputed AS INTEGER) AS VARCHAR), '|' ORDER BY grid_idx) AS imputation_flags, string_agg(observation_id, '|' ORDER BY grid_idx) AS source_observation_ids, CASE WHEN bool_or(imputed) THEN 'carry_forward' ELSE 'none' END AS imputation_method FROM points GROUP BY ALL",
    "e9_rates": _PTS + " SELECT experiment_id, run_id, variable, grid_idx, (value - lag(value) OVER w) / (time_h - lag(time_h) OVER w) AS rate FROM points WHERE observation_id IS NOT NULL WINDOW w AS (PARTITION BY experiment_id, run_id, variable ORDER BY grid_idx)",
    "b19_timecourse": _PTS + " SELECT experiment_id, run_id, variable, grid_idx, time_h, value, imputed, count(*) OVER () > 20 AS truncated FROM points WHERE run_id = 'RUN-0007' AND variable = 'click' AND time_h BETWEEN 0 AND 480 QUALIFY row_number() OVER (ORDER BY grid_idx) <= 20",
}
