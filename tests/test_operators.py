"""Operators on small inputs whose results are known."""

import datetime
import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators import checks, claims, findings, ingest, narratives, numbering, prose, scans, series, substrings, trends, units
from labtrail.sources import files, stored
from labtrail.streaming import streams


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_names_of_files(spark):
    names = ["data_R5.csv", "experiment_42.csv", "trial-9.tsv", "EXP_2024_run4.csv", "data.csv", "in/x y.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.run_from_filename(F.col("n")).alias("r"), S.synthetic_run(F.col("n")).alias("s"))
    got = {r.n: (r.r, r.s) for r in df.collect()}
    assert [got[n][0] for n in names] == ["RUN-0005", "RUN-0042", "RUN-0009", "RUN-2024", None, None]
    assert got["in/x y.csv"][1] == "RUN-FROM-x_y"


def test_units(spark):
    rows = [(14.2, "mg/mL", "g/L"), (86.0, "degF", "degC"), (7.0, "pH", "pH"), (1.0, "flerbs", "g/L"), (None, "g/L", "g/L"), (3.0, "g·L⁻¹·h⁻¹", "g/(L*h)"), (1.0, "g", "L"), (1.0, "g", None)]
    got = {(r.unit_raw, r.unit_canonical): (r.converted and round(r.converted, 9), r.status) for r in units.convert(spark.createDataFrame(rows, "value double, unit_raw string, unit_canonical string")).collect()}
    assert got == {("mg/mL", "g/L"): (14.2, "converted"), ("degF", "degC"): (30.0, "converted"), ("pH", "pH"): (7.0, "identity"), ("flerbs", "g/L"): (None, "failed"), ("g/L", "g/L"): (None, "failed"), ("g·L⁻¹·h⁻¹", "g/(L*h)"): (3.0, "converted"), ("g", "L"): (None, "failed"), ("g", None): (None, "not_applicable")}
    named = units.normalize_units(spark.createDataFrame([("OD600",), ("µg/100mg of pellet",), ("g/L",)], "unit string"))
    assert values(named.select("unit", "action")) == [("OD600", "dimensionless"), ("g/L", "unconvertible"), ("µg/100mg of pellet", "rewrite")]


@pytest.mark.parametrize("a, b, gone", [(5.0, 5.0, True), (5.0, 5.004, True), (5.0, 5.2, False), (0.0, 0.0005, True), (1e6, 1.0009e6, True), (-3.0, 3.0, False)])
def test_values_that_a_table_has(spark, a, b, gone):
    c = spark.createDataFrame([("f", "x", a)], "file_id string, variable string, value double")
    o = spark.createDataFrame([("f", "x", b)], "file_id string, variable string, value double")
    assert prose.drop_table_duplicates(c, o).isEmpty() is gone


def test_dimension_checks(spark):
    specs = spark.createDataFrame([("a", 1.0, 0.1), ("b", float("nan"), -1.0)], "variable string, nominal double, std_dev double")
    assert values(checks.check_dictionary(specs)) == [("b", "nominal_finite"), ("b", "std_dev_not_negative")]
    registry = spark.createDataFrame([("p", ["X"], ["a"], []), ("q", ["x"], ["zz"], ["b"])], "process_id string, aliases array<string>, required array<string>, forbidden array<string>")
    assert values(checks.check_registry(registry, specs)) == [("x", "alias_unique"), ("zz", "variable_known")]
    priors = spark.createDataFrame([("o", "a", 2.0, 1.0, "s"), ("o", "b", 1.0, 2.0, " ")], "organism string, variable string, low double, high double, source string")
    assert values(checks.check_priors(priors)) == [("o", "a", "low_to_high"), ("o", "b", "source_present")]


def test_strict_citations_raise(spark):
    c = spark.createDataFrame([("e", "D-F-0001", ["F-0009"], [])], "experiment_id string, claim_id string, cited_finding_ids array<string>, cited_trajectories array<struct<run_id: string, variable: string>>")
    none = spark.createDataFrame([], "experiment_id string, finding_id string, run_id string, variable string")
    with pytest.raises(ValueError):
        claims.drop_unknown(c, none, none, strict=True)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('Time (h), X [g]\n0, 1.5\n1,"2,5"\n2,\n')
    (tmp_path / "in/b.tsv").write_text("Run\tY\nr1\t4\n")
    got = files.scan_delimited(spark, str(tmp_path / "in")).select(F.regexp_extract("table_id", "[^/]*$", 0), "row_idx", "raw_header", "raw_value")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a.csv", 0, "Time (h)", "0"), ("a.csv", 0, "X [g]", "1.5"), ("a.csv", 1, "Time (h)", "1"), ("a.csv", 1, "X [g]", "2,5"), ("a.csv", 2, "Time (h)", "2"), ("a.csv", 2, "X [g]", None), ("b.tsv", 0, "Run", "r1"), ("b.tsv", 0, "Y", "4")], key=str)
    obs = spark.createDataFrame([("E", "x", "o1", "r", 1.0, 2.0, "g"), ("E", "y", "o2", "r", 1.0, None, "g")], "experiment_id string, variable string, observation_id string, run_id string, time_h double, value double, unit string")
    files.write_dossiers(obs, str(tmp_path / "d"))
    assert sorted(map(str, map(tuple, files.read_dossiers(spark, str(tmp_path / "d")).select(obs.columns).collect()))) == sorted(map(str, map(tuple, obs.collect())))
    points = spark.createDataFrame([("E", "r", "x", 0.0, 1.5, False), ("E", "r", "x", 12.0, None, False)], "experiment_id string, run_id string, variable string, time_h double, value double, imputed boolean")
    files.write_points(points, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 2


def test_ingest_stream_adds_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([("e", 1, "a"), ("e", 2, "a"), ("e", 3, "b")], [("e", 4, "a"), ("f", 5, "a")])):
        spark.createDataFrame(rows, "experiment_id string, file_id long, content string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("experiment_id string, file_id long, content string").parquet(source)
        streams.ingest_stream(stream, target, str(tmp_path / "state")).awaitTermination()
    assert values(spark.read.parquet(target).select("experiment_id", "file_id")) == [("e", 1), ("e", 3), ("f", 5)]


def test_narrative_items(spark):
    items = [
        (1, 0, '{"tag": " Deviation ", "text": " low ", "run_id": 7, "time_h": "1e999", "confidence": 0.99, "affected_variables": ["pH", " "]}'),
        (1, 1, '{"tag": "gossip", "text": "x"}'),
        (1, 2, '{"tag": "observation", "text": " "}'),
        (1, 3, "no object"),
        (1, 4, None),
        (1, 5, '{"tag": "observation", "text": "seen", "time_h": 24, "confidence": "high", "affected_variables": "pH"}'),
    ]
    got = narratives.coerce_items(spark.createDataFrame(items, "doc_id long, item_idx int, item string")).orderBy("item_idx").collect()
    assert [tuple(r)[2:] for r in got] == [("deviation", "low", "RUN-0007", None, 0.85, ["pH"]), ("observation", "seen", None, 24.0, 0.6, ["pH"])]


def test_narratives_are_filtered_and_named_anew(spark):
    rows = [("e", f"N-{k:04d}", "deviation" if k % 2 else "conclusion", "r", ["pH"] if k < 9 else [], k) for k in range(12)] + [("f", None, "observation", "r", [], 3)]
    own = spark.createDataFrame(rows, "experiment_id string, narrative_id string, tag string, run_id string, affected_variables array<string>, position int")
    got = narratives.filter_narratives(own, tag="deviation", variable="pH", limit=3)
    assert values(got.select("experiment_id", "narrative_id", "total", "truncated")) == [("e", "N-0001", 4, True), ("e", "N-0003", 4, True), ("e", "N-0005", 4, True)]
    assert {tuple(r.tags_present) for r in got.collect()} == {("conclusion", "deviation")}
    named = {r.narrative_id for r in narratives.rekey(own.where("position = 3")).collect()}
    assert named == {"e-N-0003", "f-N-0003"}


def test_ids_and_vocabularies(spark):
    ids = ["F-0001", "N-00012", "D-F-0003", "D-0004", "F-1", "x", None]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    assert [r.k for r in df.select(S.id_kind(F.col("id")).alias("k")).collect()] == ["finding", "narrative", "claim", "deviation", None, None, None]
    rows = spark.createDataFrame([(1, "minor"), (2, "dire"), (3, None)], "id int, severity string")
    assert values(checks.check_vocabularies(rows, ["id"], {"severity": checks.SEVERITIES})) == [(2, "severity_known"), (3, "severity_known")]


def test_flags_of_facts(spark):
    rows = spark.createDataFrame([("a", "r")] * 25 + [("b", "r")] * 25, "experiment_id string, run_id string")
    quality = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "experiment_id string, quality double")
    coverage = spark.createDataFrame([("a", True), ("b", True)], "experiment_id string, has_spec boolean")
    facts = spark.createDataFrame([("a", ["1.0"], 80, "unknown", " "), ("b", [], 49, "manifest", "yeast"), ("c", [], 90, None, "yeast")], "experiment_id string, stale array<string>, coverage_pct long, provenance string, organism string")
    assert values(findings.process_flags(rows, quality, coverage)) == [("a", ""), ("b", "")]
    assert values(findings.process_flags(rows, quality, coverage, facts)) == [("a", "STALE_SCHEMA_OBSERVATIONS,UNKNOWN_ORGANISM,UNKNOWN_PROCESS"), ("b", "SPARSE_DATA"), ("c", "SPARSE_DATA")]


def test_narrative_citations(spark):
    kind = "experiment_id string, claim_id string, cited_finding_ids array<string>, cited_trajectories array<struct<run_id: string, variable: string>>, cited_narrative_ids array<string>, affected_variables array<string>"
    c = spark.createDataFrame([("e", "1", ["F-1"], [], ["N-1"], []), ("e", "2", ["F-1"], [], ["N-9"], []), ("e", "3", ["F-1"], [], [], ["y", "x"]), ("e", "4", [], [], [], ["z", "y", "x"]), ("e", "5", [], [], None, ["z"]), ("f", "6", [], [], [], ["x"]), ("e", "7", ["F-1"], [], [], ["z"])], kind)
    n = spark.createDataFrame([("e", "N-1", ["x"]), ("e", "N-2", ["y", "x"]), ("e", "N-3", [])], "experiment_id string, narrative_id string, affected_variables array<string>")
    found = spark.createDataFrame([("e", "F-1")], "experiment_id string, finding_id string")
    none = spark.createDataFrame([], "experiment_id string, run_id string, variable string")
    assert values(claims.drop_unknown(c, found, none, narratives=n).select("claim_id")) == [(k,) for k in "134567"]
    assert values(claims.drop_unknown(c, found, none).select("claim_id")) == [(k,) for k in "34567"]
    got = {r["claim_id"]: r["cited_narrative_ids"] for r in claims.backfill(c, none, n).collect()}
    assert got == {"1": ["N-1"], "2": ["N-9"], "3": ["N-2", "N-1"], "4": ["N-2"], "5": ["N-1", "N-2", "N-3"], "6": [], "7": []}


def test_texts_that_a_table_has(spark):
    kind = "file_id string, variable string, value string"
    c = spark.createDataFrame([("f", "x", " Red"), ("f", "x", "5.004"), ("f", "x", "5.2"), ("f", "y", "red"), ("f", "x", "blue"), ("f", "x", None)], kind)
    o = spark.createDataFrame([("f", "x", "red "), ("f", "x", "5.0"), ("f", "x", None)], kind)
    assert sorted(prose.drop_table_duplicates(c, o).collect(), key=str) == sorted(c.where("value is null or value in ('5.2', 'blue') or variable = 'y'").select("file_id", "variable", "value").collect(), key=str)


def test_counts_of_deduped_and_failed(spark):
    gated = spark.createDataFrame([(1, "ok"), (1, "ok"), (1, "no"), (2, "ok")], "doc_id long, verdict string")
    assert values(prose.gate_stats(gated, spark.createDataFrame([(1, "ok")], gated.schema)).select("doc_id", "kept", "rejected", "deduped")) == [(1, 1, 1, 1), (2, 0, 0, 1)]
    obs = spark.createDataFrame([("t", "x", 0.9, False, "table")], "table_id string, variable string, combined_confidence double, needs_review boolean, section string")
    files_ = spark.createDataFrame([("t", "ok"), ("t", "failed"), ("u", "failed")], "table_id string, status string")
    assert values(ingest.ingestion_summary(obs, 2, files_).select("table_id", "total", "n_failed")) == [("t", 1, 1), ("u", 0, 1)]


def test_sources_in_the_facts_graph(spark):
    obs = spark.createDataFrame([("e", "r", "x", "o1", "f"), ("e", "r", "x", "o2", "f")], "experiment_id string, run_id string, variable string, observation_id string, file_id string")
    vertices, edges = trends.facts_graph(obs)
    assert values(vertices.where("kind = 'source'")) == [("source", "f")]
    assert values(edges.where("kind = 'derived_from'")) == [("derived_from", "e/r", "f")]


def test_rollups_keep_all_evidence(spark):
    rows = [("e", "r", v, f"o{v}{i:03d}", float(i), 10.0, 0.0, 1.0) for v, n in (("x", 150), ("y", 3)) for i in range(n)]
    own = findings.violations(spark.createDataFrame(rows, "experiment_id string, run_id string, variable string, observation_id string, time_h double, value double, expected double, expected_std_dev double"))
    found = findings.findings(findings.rollup(own))
    got = findings.evidence(found, own)
    assert found.count() == 4 and sorted(r["observation_id"] for r in got.collect()) == sorted(r[3] for r in rows)
    assert sorted(r["count"] for r in got.groupBy("finding_id").count().collect()) == [1, 1, 1, 150]
    missing = checks.missing_references(got.withColumnRenamed("finding_id", "label"), own.where("observation_id <> 'ox149'"), "observation_id")
    assert [r["observation_id"] for r in missing.collect()] == ["ox149"]


def test_dossiers_are_written_in_bounded_parts(spark, tmp_path):
    rows = [("E", v, f"o{v}{i:02d}", "r", None if i == 3 else i % 7 / 2, None if i == 4 else float(i), "g") for v in "xy" for i in range(25)] + [(None, "z", "oz", "r", 1.0, 2.0, "g")]
    obs = spark.createDataFrame(rows, "experiment_id string, variable string, observation_id string, run_id string, time_h double, value double, unit string")
    files.write_dossiers(obs, str(tmp_path / "d"), part_rows=10)
    parts = spark.read.schema(files.DOSSIER).json(str(tmp_path / "d")).select(F.explode("golden_columns").alias("variable", "c")).select(F.size("c.observations"))
    assert sorted(r[0] for r in parts.collect()) == [1, 5, 5, 10, 10, 10, 10]
    assert sorted(files.read_dossiers(spark, str(tmp_path / "d")).select(obs.columns).collect(), key=str) == sorted(obs.collect(), key=str)


def test_totals_of_findings_need_no_window(spark):
    found = spark.createDataFrame([("e", k, "r") for k in range(1, 8)], "experiment_id string, seq int, run_id string")
    got = findings.filter_findings(found, limit=3)
    assert values(got.select("seq", "total", "place", "truncated")) == [(k, 7, k, True) for k in (1, 2, 3)]
    assert "count(1) windowspec" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_priors_by_index(spark):
    rows = [(f"organism {k}", [f"alias{k}x"], "batch", "v") for k in range(60)]
    priors = spark.createDataFrame(rows, "organism string, aliases array<string>, family string, variable string")
    asked = spark.createDataFrame([("ORGANISM 7",), ("alias33x",), ("none",)], "query string")
    whole = values(claims.resolve_priors(priors, asked, family="BATCH").select("query", "organism"))
    assert values(claims.resolve_priors(priors, asked).select("query", "organism")) == whole == [("ORGANISM 7", "organism 7"), ("alias33x", "organism 33")]


def test_contradictions_need_two_sources(spark):
    rows = [("e", "r", "x", 1.0, v, s) for v, s in ((1.0, "a"), (9.0, "a"))]  # one source with itself
    rows += [("e", "r", "y", 1.0, v, s) for v, s in ((1.0, "a"), (9.0, "a"), (9.0, "b"))]
    rows += [("e", "r", "z", 1.0, v, s) for v, s in ((5.0, "a"), (5.0, "b"))]
    df = spark.createDataFrame(rows, "experiment_id string, run_id string, variable string, time_h double, value double, source string")
    assert values(trends.source_contradictions(df, 12.0)) == [("e", "r", "y", 0, 2, 1.0, 9.0)]


def test_a_dimension_file_is_found_in_order(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / name).write_text(f'{{"table_id": "{name}", "run_id": "r"}}\n')
    found = lambda path: files.load_dimension(spark, path, "manifest", "LABTRAIL_TEST_MANIFEST", str(tmp_path / "c")).first()["table_id"]
    assert found(None) == "c"
    monkeypatch.setenv("LABTRAIL_TEST_MANIFEST", str(tmp_path / "b"))
    assert found(None) == "b" and found(str(tmp_path / "a")) == "a"
    with pytest.raises(ValueError):
        files.load_dimension(spark, None, "manifest")


def test_superscripts_and_stuff_of_units(spark):
    df = spark.createDataFrame([("g of dry cell weight/L",), ("m·s⁻¹²",), ("kg/m³",)], "unit string")
    got = {r.unit: r.plain for r in units.normalize_chain(df, units.normalize_units).collect()}
    assert got == {"g of dry cell weight/L": "g/L", "m·s⁻¹²": "m*s^-12", "kg/m³": "kg/m^3"}


def test_edges_need_both_ends(spark):
    edges = spark.createDataFrame([("of", "a", "b"), ("of", "a", "c"), ("in", None, "b")], "kind string, src string, dst string")
    vertices = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    assert sorted((tuple(r) for r in checks.missing_endpoints(edges, vertices).collect()), key=str) == [("in", "src", None), ("of", "dst", "c")]


def test_fits_name_their_observations(spark):
    rows = [("e", "r", "x", float(t), v, f"o{t}") for t, v in enumerate((1.0, 2.0, 0.0, 4.0, None, 8.0, 9.0))] + [("e", "r", "y", 0.0, 1.0, "o9")]
    df = spark.createDataFrame(rows, "experiment_id string, run_id string, variable string, time_h double, value double, observation_id string")
    assert values(trends.fit_evidence(df, 5.0)) == [("e", "r", "x", 0, "o0"), ("e", "r", "x", 0, "o1"), ("e", "r", "x", 0, "o3")]


def test_six_digits_of_the_whole_range(spark):
    draw = random.Random(3)
    xs = [0.0, -0.0, 1e-4, 9.999995e-5, 999999.5, 100000.5, 33333.35, 123.4375, 1e300, -1e-300, float("nan"), float("inf"), float("-inf")]
    xs += [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.randint(-300, 300) for _ in range(1000)]
    xs += [float(f"{draw.randint(100000, 999999)}5e{draw.randint(-305, 300)}") for _ in range(1000)]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.fmt_g(F.col("x"))).collect()
    assert [(r[0], r[1]) for r in found if r[1] != f"{r[0]:g}"] == []


def test_run_deltas_do_not_depend_on_the_order_of_rows(spark):
    draw = random.Random(3)
    rows = [("E", f"R{i % 3}", "v", round(draw.uniform(-60, 60), 4)) for i in range(400)] + [("E", "R9", "v", None)]
    seen = set()
    for n in (1, 3, 7):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "experiment_id string, run_id string, variable string, value double").repartition(n)
        seen.add(tuple(sorted(map(tuple, trends.cross_run_delta(df).collect()))))
    exact = {r: [Fraction(str(v)) for _, q, _, v in rows if q == r and v is not None] for r in ("R0", "R1", "R2")}
    means = {r: sum(v) / len(v) for r, v in exact.items()}
    assert len(seen) == 1
    for _, run, _, mean, delta in seen.pop():
        assert abs(means[run] - Fraction(str(mean))) <= Fraction(50001, 10**9) and abs(means[run] - sum(means.values()) / 3 - Fraction(str(delta))) <= Fraction(50002, 10**9)


def gappy(spark):
    """Series with stretches that have no rows, or none with a value."""
    draw = random.Random(7)
    rows = [(k, i, draw.choice([None, float(i)]) if i % 40 < 20 else None) for k in "abc" for i in range(300) if i % 50 > 12 and draw.random() < 0.6]
    return spark.createDataFrame(rows, "k string, i long, v double")


@pytest.mark.parametrize("length", [1, 4, 7, 1000])
def test_scans_in_stretches_equal_windows_over_the_series(spark, length):
    df = gappy(spark)
    w = W.partitionBy("k").orderBy("i")
    stretch = scans.stretches("i", length)
    assert values(scans.carried(df, ["k"], "i", stretch, "v", "c").select("k", "i", "c")) == values(df.select("k", "i", F.last("v", ignorenulls=True).over(w).alias("c")))
    for following, edge in ((False, F.lag), (True, F.lead)):
        found = scans.neighbour(df, ["k"], "i", stretch, ["i", "v"], "n", following=following)
        assert values(found.select("k", "i", F.col("n.i"), F.coalesce("n.v", F.lit(-1.0)))) == values(df.select("k", "i", edge("i").over(w), F.coalesce(edge("v").over(w), F.lit(-1.0))))


def test_no_window_runs_over_a_bare_series(spark):
    rows = spark.createDataFrame([("E", "R", "v", float(h), f"O-{h}", float(h % 5), "u") for h in range(60)], "experiment_id string, run_id string, variable string, time_h double, observation_id string, value double, unit string")
    points = series.grid_points(rows, 2.0, 80.0, length=8)
    assert values(series.rates(points, length=8)) == values(series.rates(series.grid_points(rows, 2.0, 80.0)))
    for df in (points, series.rates(points), trends.trend_direction(points)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        bare = [x for x in plan.split("\n") if "Window [" in x and "__stretch" not in x]
        assert bare == [], bare  # the short windows are ordered by __stretch, the others are in one


def test_numbering_by_ranges_splits_one_dense_value(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("e"), F.lit(1.0).alias("sigmas"), (F.col("id") * 7919 % 5003).alias("o"))
    df = df.unionByName(spark.sql("SELECT cast(null as long) e, 1.0D sigmas, id o FROM range(100)"))
    order = [F.desc("sigmas"), F.col("o")]
    found = numbering.number_by_range(df, order, ["e"])
    assert values(found.select(F.coalesce("e", F.lit(9)), "o", "seq")) == values(df.select(F.coalesce("e", F.lit(9)), "o", F.row_number().over(W.partitionBy("e").orderBy(*order)).cast("long").alias("seq")))
    assert numbering.number_by_range(df.where("false"), order, ["e"]).collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_line_ends_in_quoted_cells_over_several_splits(spark, tmp_path):
    draw = random.Random(5)
    cell = lambda: "".join(draw.choice(["a", "bc ", ",", "\n", "\n\n", '""', "é"]) for _ in range(draw.randint(1, 60))).strip() or "x"
    (tmp_path / "in").mkdir()
    head = 'Key,"Long\nname",Third\n'
    rows = [(i, cell(), cell().replace('""', "").replace(",", "").replace("\n", "") or "y") for i in range(800)]
    (tmp_path / "in/a.csv").write_text(head + "".join(f'{i},"{a}",{b}\n' + ("\n" if i % 9 == 0 else "") for i, a, b in rows))
    (tmp_path / "in/odd.csv").write_text('Size,N\n5" pipe,3\n6,4\n')
    (tmp_path / "in/t.tsv").write_text('Q\tR\na"b\t1\nc\t2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = [(r["table_id"].rsplit("/", 1)[1], r["row_idx"], r["raw_header"], r["raw_value"]) for r in files.scan_delimited(spark, str(tmp_path / "in")).collect()]
        assert spark.read.text(str(tmp_path / "in/a.csv")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    read = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/in/a.csv', all_varchar = true, header = true, quote = '\"', escape = '\"', delim = ',', null_padding = false)").fetchall()
    heads = ["Key", "Long\nname", "Third"]
    expected = [("a.csv", i, h, v.strip(" ") or None) for i, r in enumerate(read) for h, v in zip(heads, r, strict=True)]
    assert len(read) == 800 and sorted(x for x in found if x[0] == "a.csv") == sorted(expected)
    assert sorted(x for x in found if x[0] == "odd.csv") == [("odd.csv", 0, "N", "3"), ("odd.csv", 0, "Size", '5" pipe'), ("odd.csv", 1, "N", "4"), ("odd.csv", 1, "Size", "6")]
    assert sorted(x for x in found if x[0] == "t.tsv") == [("t.tsv", 0, "Q", 'a"b'), ("t.tsv", 0, "R", "1"), ("t.tsv", 1, "Q", "c"), ("t.tsv", 1, "R", "2")]


def test_a_hundred_thousand_priors(spark):
    rows = [(f"organism {k * 7919 % 100_003}", [f"alias{k}x", None] if k % 3 else None, "v") for k in range(100_000)] + [("dup", ["dup"], "v")] * 2 + [(None, ["ab"], "v")]
    asked = ["ORGANISM 777", "alias33x", "none of these", "a", "9x", "an organism 5 more", "dup", "the dup", "ab", "Ab", "日", None, "x" * 200]
    priors = spark.createDataFrame(rows, "organism string, aliases array<string>, variable string")
    found = claims.resolve_priors(priors, spark.createDataFrame([(q,) for q in asked], "query string")).where("length(query) > 1").select("query", F.coalesce("organism", F.lit("-")))
    fits = lambda q, n: n is not None and (q.lower() in n.lower() or n.lower() in q.lower())
    expected = [(q, o or "-") for q in asked if q and len(q) > 1 for o, al, _ in rows if any(fits(q, n) for n in [o, *(al or [])])]
    assert values(found) == sorted(expected) and len(expected) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_short_and_empty_needles(spark):
    texts = ["", "a", "ab", "abc", "xabcx", "ABC", "日本語", "本", None]
    df = lambda name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    known = [t for t in texts if t is not None]
    assert values(substrings.holding(df("needle"), df("whole"))) == sorted((n, w) for n in known for w in known if n in w)


RUNS = "experiment_id string, run_id string, variable string, observation_id string, time_h double, value double"


def test_pairs_of_events_with_lags_of_their_own(spark):
    draw = random.Random(2)
    rows = [("E", f"R{draw.randint(0, 1)}", draw.choice("abc"), f"O{i}", round(draw.uniform(0, 40), 1), 1.0) for i in range(300)] + [("E", "R0", "a", "late", None, 1.0)]
    pairs = [("a", "b", 2.0), ("b", "c", 0.5), ("a", "a", 7.0), ("a", "b", 1.0), (None, "c", 1.0), ("c", "a", 0.0)]
    found = values(trends.precedes_any(spark.createDataFrame(rows, RUNS), spark.createDataFrame(pairs, "first string, second string, max_lag double")).select("first", "second", "run_id", "a_id", "b_time"))
    expected = []
    for x, y, lag in [("a", "b", 2.0), ("b", "c", 0.5), ("a", "a", 7.0)]:
        for _, run, v, o, t, _ in rows[:300]:
            after = [r[4] for r in rows[:300] if r[1] == run and r[2] == y and t < r[4] and r[4] - t <= lag]
            expected += [(x, y, run, o, min(after))] if v == x and after else []
    assert found == sorted(expected)


def test_sliding_fits_equal_a_window_over_each_series(spark):
    draw = random.Random(4)
    rows = [("E", f"R{i % 2}", "v", f"O{i}", float(draw.randint(0, 90)) / 2 + (100 if i % 5 == 0 else 0), draw.choice([0.0, -1.0, *([draw.uniform(0.5, 9)] * 6)])) for i in range(250)]
    found = {r["observation_id"]: (r["n"], r["slope"]) for r in trends.sliding_fit(spark.createDataFrame(rows, RUNS), 6.0).collect()}
    expected = {}
    for _, run, _, o, t, v in rows:
        own = [(r[4], math.log(r[5])) for r in rows if r[1] == run and r[5] > 0 and t - 6 <= r[4] <= t]
        if v > 0 and len(own) >= 3:
            mt, my = sum(a for a, _ in own) / len(own), sum(b for _, b in own) / len(own)
            square = sum((a - mt) ** 2 for a, _ in own)
            if square / len(own) >= 0.25:
                expected[o] = (len(own), sum((a - mt) * (b - my) for a, b in own) / square)
    assert found.keys() == expected.keys() and len(found) > 50
    assert all(found[o][0] == n and abs(found[o][1] - s) < 1e-6 for o, (n, s) in expected.items())


def test_chunks_are_bounded_and_read_by_range(spark):
    points = spark.createDataFrame([("E", "R", "v", i, float(i), float(i) if i % 3 else None, i % 2 == 0, f"O{i}" if i % 2 else None) for i in range(100) if not 20 <= i < 40], "experiment_id string, run_id string, variable string, grid_idx int, time_h double, value double, imputed boolean, observation_id string")
    parts = series.chunks(points, 16)
    assert max(len(r["values"]) for r in parts.collect()) <= 16
    read = series.chunk_range(parts, 10, 50, 16).select("grid_idx", F.coalesce("value", F.lit(-1.0)), "imputed", F.coalesce("observation_id", F.lit("")))
    assert values(read) == values(points.where("grid_idx >= 10 and grid_idx < 50").select("grid_idx", F.coalesce("value", F.lit(-1.0)), "imputed", F.coalesce("observation_id", F.lit(""))))
    obs = spark.createDataFrame([("E", "R", "v", f"O{i:03}", float(i // 7), 1.0) for i in range(95)], RUNS)
    grouped = ingest.grouped_chunks(obs, 10).collect()
    assert sorted((r["chunk"], r["offset"], len(r["observations"])) for r in grouped) == [(k, 10 * k, 10 if k < 9 else 5) for k in range(10)]
    assert [o["observation_id"] for r in sorted(grouped, key=lambda r: r["chunk"]) for o in r["observations"]] == [f"O{i:03}" for i in range(95)]


def test_a_batch_rewrites_the_partitions_of_its_places_only(spark, tmp_path):
    schema = "experiment_id string, variable string, locator string, observation_id long, extracted_at long"
    rows = [("E", "v", f"L{i % 40}", i, i // 2) for i in range(200)] + [("E", None, "L0", 900, 1)]
    at = str(tmp_path / "stored")
    stored.supersede_stored(spark.createDataFrame(rows[:150] + rows[200:], schema), at, 16)
    files_of = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "stored").rglob("*.parquet")}
    before = files_of()
    more = spark.createDataFrame([("E", "v", "L3", 1000, 999), ("E", "v", "new", 1001, 1)], schema)
    for _ in range(2):  # a batch that runs again changes nothing
        touched = stored.supersede_stored(more, at, 16)
    after = files_of()
    assert 0 < len(touched) <= 2
    assert {f: t for f, t in before.items() if int(f.parent.name[7:]) not in touched} == {f: t for f, t in after.items() if int(f.parent.name[7:]) not in touched}
    every = spark.createDataFrame(rows[:150], schema).unionByName(more)
    key = lambda df: values(df.select("observation_id", F.coalesce("superseded_by", F.lit(-1))))
    assert key(spark.read.parquet(at)) == key(ingest.supersede(every))
    assert stored.supersede_stored(more.where("false"), at, 16) == []


def test_roll_ups_of_a_stream_that_is_restarted_equal_the_batch(spark, tmp_path):
    schema = "experiment_id string, run_id string, variable string, observation_id string, value double, event_time timestamp"
    day = datetime.datetime(2024, 1, 1)
    rows = [("E", f"R{i % 3}", "v", f"O{i:03}", float(i % 50), day + datetime.timedelta(minutes=i)) for i in range(120)]
    specs = spark.createDataFrame([("v", 10.0, 5.0)], "variable string, nominal double, std_dev double")
    part = lambda k, some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    out = str(tmp_path / "out")

    def run():
        obs = spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
        told = streams.rollup_stream(obs, specs, threshold=20, late="1 hour")
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(told.schema).parquet(out)

    part(0, rows[:40])
    run()
    part(1, rows[40:70])
    part(2, rows[70:100])
    run()
    part(3, [*rows[100:], ("E", "R0", "v", "LATE", 49.0, day)])
    told = run()
    bad = [r for r in rows if abs(r[4] - 10) / 5 >= 2]
    expected = []
    for run_id in ("R0", "R1", "R2"):
        own = [r for r in bad if r[1] == run_id]
        sigma = lambda r: abs(r[4] - 10) / 5
        expected += [(run_id, len(own), max(map(sigma, own)), "")] if len(own) > 20 else [(run_id, 1, sigma(r), r[3]) for r in own]
    assert values(streams.settled(told).select("run_id", "n_violations", "max_abs_sigmas", F.coalesce("observation_id", F.lit("")))) == sorted(expected)
    assert [r["observation_id"] for r in told.where("kind = 'late'").collect()] == ["LATE"]
    assert len(expected) == 3


def test_expectations_are_met_by_claims_that_cite_what_they_ask_for(spark):
    c = spark.createDataFrame(
        [("E", "Growth is low", ["F-1", "F-2"], 0.9), ("E", "growth is low", ["F-2", "F-2"], 0.9), ("E", "feed", [], 0.9), ("E", "yield", ["F-3"], 0.5), ("X", "growth", None, 0.9)],
        "experiment_id string, summary string, cited_finding_ids array<string>, confidence double",
    )
    e = spark.createDataFrame(
        [("E", ["growth"], ["F-1"], 0.8), ("E", ["growth"], ["F-2", "F-1"], 0.8), ("E", ["growth"], ["F-2", "F-3"], 0.8), ("E", ["feed"], [], 0.8), ("E", ["yield"], ["F-3"], 0.8), ("X", ["growth"], [], 0.8), ("X", ["growth"], ["F-1"], 0.8)],
        "experiment_id string, keywords array<string>, must_cite array<string>, min_confidence double",
    )
    found = claims.score(c, e)
    assert values(found) == [("E", 5, 0.6), ("X", 2, 0.5)]


def test_ids_of_several_collections(spark):
    a = spark.createDataFrame([("E", "1"), ("E", "2"), ("X", "1"), ("E", None), ("E", None)], "experiment_id string, id string")
    b = spark.createDataFrame([("E", "1"), ("E", "3"), ("E", "3")], "experiment_id string, id string")
    assert values(checks.ids_used_twice(("a", a), ("b", b))) == [("E", "1", 2, "a|b"), ("E", "3", 2, "b")]


def test_pointers_move_with_the_ends_of_their_chains(spark, tmp_path):
    at = str(tmp_path / "pointers")
    batches = [[("a", "b"), ("b", "c"), ("x", None), ("p", "q")], [("c", "d"), ("n", "x")], [("c", "d"), ("n", "x")], [("d", "e"), ("q", "r"), ("x", "y"), (None, "z")]]
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "pointers").rglob("*.parquet")}
    every = []
    for k, batch in enumerate(batches):
        before = stamps() if k else {}
        touched = stored.extend_chains(spark.createDataFrame(batch, "id string, superseded_by string"), at, 32)
        assert all(stamps().get(f) == t for f, t in before.items() if int(f.parent.name[7:]) not in touched)
        every += batch
    ahead = {a: b for a, b in every if a and b}
    ids = {x for pair in every if pair[0] for x in pair if x}

    def end(x):
        return end(ahead[x]) if x in ahead else x

    assert values(stored.pointers(spark, at)) == sorted((x, end(x)) for x in ids)
    assert stored.extend_chains(spark.createDataFrame([], "id string, superseded_by string"), at) == []


def test_residual_of_every_kind(spark):
    cells = [(t, 0, c, h, f"{t}{c}") for t in "abc" for c, h in ((0, "x"), (1, "y"), (2, "y"))]
    cells = spark.createDataFrame(cells, "table_id string, row_idx long, col_idx int, raw_header string, raw_value string")
    routed = [("a", "x", 0, "mapped"), ("a", "y", 2, "low_confidence"), ("a", "z", None, "header_not_in_table"), ("b", "x", 0, "no_mapping"), ("b", "z", None, "no_mapping")]
    routed = spark.createDataFrame(routed, "table_id string, raw_header string, col_idx int, route string")
    blocks = spark.createDataFrame([(7, 3, "prose")], "doc_id long, paragraph_idx int, text string")
    assert values(ingest.residual(routed, cells).where("table_id = 'a'").select("col_idx", "kind")) == [(1, "tables_partial"), (2, "tables_partial")]
    found = ingest.whole_residual(routed, cells, blocks).fillna("-").fillna(-1)
    assert values(found.select("kind", "table_id", "row_idx", "col_idx", "raw_header", "raw_value", "reason", "doc_id", "paragraph_idx", "text")) == [
        ("narrative", "-", -1, -1, "-", "-", "prose", 7, 3, "prose"),
        ("tables_partial", "a", -1, -1, "z", "-", "header_not_in_table", -1, -1, "-"),
        # of two columns with one header the mapping has the last
        ("tables_partial", "a", 0, 1, "y", "a1", "no_mapping_returned", -1, -1, "-"),
        ("tables_partial", "a", 0, 2, "y", "a2", "low_confidence", -1, -1, "-"),
        ("tables_unmapped", "b", -1, -1, "z", "-", "no_mapping", -1, -1, "-"),
        ("tables_unmapped", "b", 0, 0, "x", "b0", "no_mapping", -1, -1, "-"),
        ("tables_unmapped", "b", 0, 1, "y", "b1", "no_mapping_returned", -1, -1, "-"),
        ("tables_unmapped", "b", 0, 2, "y", "b2", "no_mapping_returned", -1, -1, "-"),
        ("tables_unmapped", "c", 0, 0, "x", "c0", "no_mapping_returned", -1, -1, "-"),
        ("tables_unmapped", "c", 0, 1, "y", "c1", "no_mapping_returned", -1, -1, "-"),
        ("tables_unmapped", "c", 0, 2, "y", "c2", "no_mapping_returned", -1, -1, "-"),
    ]
