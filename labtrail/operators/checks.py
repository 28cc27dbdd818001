"""Data-quality checks: each returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import scalars as S

SEVERITIES = ("info", "minor", "major", "critical")
BASES = ("process_priors", "schema_only", "cross_run")


def _broken(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``keys`` and ``rule`` for each rule that a row breaks; a rule that gives null is broken."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return rows.select(*keys, F.explode(found).alias("rule"))


def _finite(c: Column) -> Column:
    return c.isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))


def check_dictionary(specs: DataFrame) -> DataFrame:
    return _broken(specs, ["variable"], {"nominal_finite": _finite(F.col("nominal")), "std_dev_finite": _finite(F.col("std_dev")), "std_dev_not_negative": F.col("std_dev").isNull() | (F.col("std_dev") >= 0)})


def check_registry(registry: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids that occur twice, aliases of several processes, and fingerprint variables that the dictionary lacks."""
    ids = registry.groupBy(F.col("process_id").alias("what")).count().where("count > 1").select("what", F.lit("id_unique").alias("rule"))
    aliases = registry.select("process_id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("what")).agg(F.count_distinct("process_id").alias("n")).where("n > 1").select("what", F.lit("alias_unique").alias("rule"))
    names = registry.select(F.explode(F.concat("required", "forbidden")).alias("variable")).distinct().join(dictionary, "variable", "left_anti")
    return ids.unionByName(aliases).unionByName(names.select(F.col("variable").alias("what"), F.lit("variable_known").alias("rule")))


def check_priors(priors: DataFrame) -> DataFrame:
    return _broken(priors, ["organism", "variable"], {"low_to_high": F.col("low") <= F.col("high"), "source_present": F.trim("source") != ""})


def check_trajectories(series: DataFrame) -> DataFrame:
    """Arrays of one length, and shares that add up to 1."""
    total = F.col("quality") + F.col("pct_imputed") + F.col("pct_missing")
    same = (F.size("time_grid") == F.size("values")) & (F.size("values") == F.size("imputation_flags"))
    return _broken(series, ["experiment_id", "run_id", "variable"], {"one_length": same, "shares_add_up": F.abs(total - 1) <= 0.001})


def check_findings(found: DataFrame) -> DataFrame:
    """Id shape, evidence, confidence and severity; with ``output_id`` that it prefixes the id, with ``extracted_via`` the cap of what a model judged."""
    own = r"F-\d{4,}$"
    shape = F.col("finding_id").rlike(f"^{own}")
    if "output_id" in found.columns:
        head = F.concat("output_id", F.lit(":"))
        shape = F.col("finding_id").startswith(head) & F.substr("finding_id", F.length(head) + 1).rlike(f"^{own}")
    rules = {"id_shape": shape, "evidence": F.col("observation_id").isNotNull(), "confidence": F.col("confidence").between(0, 1), "severity": F.col("severity").isin(*SEVERITIES)}
    if "extracted_via" in found.columns:
        rules["judged_cap"] = (F.col("extracted_via") != "llm_judged") | (F.col("confidence") <= 0.85)
    return _broken(found, ["experiment_id", "finding_id"], rules)


def _cited(claims: DataFrame) -> Column:
    """At least one citation; analyses and questions need a finding or a narrative."""
    n = F.size("cited_finding_ids")
    if "cited_narrative_ids" in claims.columns:
        n = n + F.size("cited_narrative_ids")
    every = n + F.size("cited_trajectories") > 0
    return F.when(F.col("kind").isin("analysis", "question"), n > 0).otherwise(every) if "kind" in claims.columns else every


def check_claims(claims: DataFrame) -> DataFrame:
    """Id shape, at least one citation, capped confidence, known basis, and no wording of cause; with ``kind`` the id and citations of that kind."""
    letter = {"failure": "F", "trend": "T", "analysis": "A", "question": "Q"}
    prefix = F.create_map(*(F.lit(x) for k in letter.items() for x in k))[F.col("kind")] if "kind" in claims.columns else None
    rules = {
        "id_shape": F.col("claim_id").rlike(r"^D-[FTA]-\d{4,}$") if prefix is None else F.regexp_extract("claim_id", r"^D-([FTAQ])-\d{4,}$", 1) == prefix,
        "citation": _cited(claims),
        "confidence": F.col("confidence").between(0, 0.85),
        "basis": F.col("confidence_basis").isin(*BASES),
        "no_cause": F.size(S.causal_phrases(F.col("summary"))) == 0,
    }
    return _broken(claims, ["experiment_id", "claim_id"], rules)


def check_vocabularies(rows: DataFrame, keys: list[str], closed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with a value outside its column's closed list; nulls are outside."""
    return _broken(rows, keys, {f"{c}_known": F.col(c).isin(*names) for c, names in closed.items()})


def check_wording(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries that claim a cause: a warning."""
    return _broken(texts, keys, {"no_cause": F.size(S.causal_phrases(F.coalesce("summary", F.lit("")))) == 0})


def check_version(outputs: DataFrame, current: str) -> DataFrame:
    return _broken(outputs, ["output_id"], {"version_current": F.col("version") == current})


def check_priors_version(outputs: DataFrame, current: str | None) -> DataFrame:
    """Outputs made with priors of another version; unset on either side is no fault."""
    return _broken(outputs, ["output_id"], {"priors_version_current": F.col("priors_version").isNull() | F.lit(current is None) | (F.col("priors_version") == F.lit(current))})


def check_errors(outputs: DataFrame, claims: DataFrame) -> DataFrame:
    """``outputs(output_id, error)`` that report an error and have claims all the same."""
    failed = outputs.where("error is not null").select("output_id")
    return failed.join(claims.select("output_id"), "output_id", "left_semi").select("output_id", F.lit("error_has_no_claims").alias("rule"))


def ids_used_twice(*collections: tuple[str, DataFrame]) -> DataFrame:
    """``experiment_id, id, n, collections`` of ids that an experiment uses more than once, in one collection or in several; frames of ``(experiment_id, id)``."""
    every = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("collection"), "experiment_id", "id") for name, df in collections))
    found = every.where("id is not null").groupBy("experiment_id", "id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("collection")), "|").alias("collections"))
    return found.where("n > 1")


def duplicate_ids(*collections: tuple[str, DataFrame]) -> DataFrame:
    """``collection, id, n`` of ids that occur more than once in their collection; each frame has a column ``id``."""
    parts = [df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("collection"), "id", "n") for name, df in collections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_references(references: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    """``references(experiment_id, label, <id>)`` whose id the experiment doesn't have."""
    return references.join(known.select("experiment_id", id_column).distinct(), ["experiment_id", id_column], "left_anti").select("experiment_id", "label", id_column)


def missing_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``kind, end, id`` of the ends of ``edges(kind, src, dst)`` that are no vertex; an end without id counts among them."""
    ends = F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in ("src", "dst"))))
    return edges.select("kind", ends.alias("x")).select("kind", "x.*").join(vertices.select("id").distinct(), "id", "left_anti").select("kind", "end", "id")
