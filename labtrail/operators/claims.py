"""Claims held against findings, series and priors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.operators.ingest import small
from labtrail.operators.substrings import holding

ID = ["experiment_id", "claim_id"]


def unknown_citations(claims: DataFrame, findings: DataFrame, series: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """``experiment_id, claim_id, cited`` of citations that nothing stands behind; without ``narratives`` no cited narrative is known."""
    f = claims.select(*ID, F.explode("cited_finding_ids").alias("cited")).join(findings.select("experiment_id", F.col("finding_id").alias("cited")), ["experiment_id", "cited"], "left_anti").select(*ID, "cited")
    t = claims.select(*ID, F.explode("cited_trajectories").alias("x")).select(*ID, "x.*").join(series.select("experiment_id", "run_id", "variable").distinct(), ["experiment_id", "run_id", "variable"], "left_anti")
    out = f.unionByName(t.select(*ID, F.concat_ws("/", "run_id", "variable").alias("cited")))
    if "cited_narrative_ids" in claims.columns:
        n = claims.select(*ID, F.explode("cited_narrative_ids").alias("cited"))
        if narratives is not None:
            n = n.join(narratives.select("experiment_id", F.col("narrative_id").alias("cited")), ["experiment_id", "cited"], "left_anti").select(*ID, "cited")
        out = out.unionByName(n)
    return out


def drop_unknown(claims: DataFrame, findings: DataFrame, series: DataFrame, strict: bool = False, narratives: DataFrame | None = None) -> DataFrame:
    """Claims all of whose citations are known; ``strict`` raises if any is not."""
    bad = unknown_citations(claims, findings, series, narratives)
    if strict and not bad.isEmpty():
        raise ValueError("claims cite what does not exist")
    return claims.join(bad.select(*ID).distinct(), ID, "left_anti")


def backfill(claims: DataFrame, series: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """Claims that cite nothing get all series of their variables; with ``narratives``, those without narratives get some after that."""
    bare = claims.where((F.size("cited_finding_ids") == 0) & (F.size("cited_trajectories") == 0))
    known = series.select("experiment_id", "run_id", "variable").distinct().groupBy("experiment_id", "variable").agg(F.collect_list(F.struct("run_id", "variable")).alias("x"))
    filled = bare.select(*ID, F.explode(F.array_distinct("affected_variables")).alias("variable")).join(known, ["experiment_id", "variable"])
    filled = filled.groupBy(*ID).agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("__filled"))
    out = claims.join(filled, ID, "left").withColumn("cited_trajectories", F.coalesce("__filled", "cited_trajectories")).drop("__filled")
    return out if narratives is None else _backfill_narratives(out, narratives)


def _backfill_narratives(claims: DataFrame, narratives: DataFrame) -> DataFrame:
    """Beside other citations the narratives of all variables of a claim, else those of its first variable that has some, else all of the experiment."""
    ids = F.sort_array(F.collect_list("narrative_id")).alias("ids")
    known = narratives.select("experiment_id", "narrative_id", F.explode(F.array_distinct("affected_variables")).alias("variable")).groupBy("experiment_id", "variable").agg(ids)
    every = narratives.groupBy("experiment_id").agg(ids).withColumnRenamed("ids", "__every")
    none = F.array().cast("array<string>")
    cited = F.coalesce("cited_narrative_ids", none)
    met = claims.where(F.size(cited) == 0).select(*ID, F.posexplode("affected_variables").alias("at", "variable")).join(known, ["experiment_id", "variable"])
    own = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])))
    met = met.groupBy(*ID).agg(own.alias("__own"), F.min_by("ids", "at").alias("__first"))
    other = (F.coalesce(F.size("cited_finding_ids"), F.lit(0)) > 0) | (F.coalesce(F.size("cited_trajectories"), F.lit(0)) > 0)
    filled = F.when(F.size(cited) > 0, cited).when(other, F.coalesce("__own", none)).otherwise(F.coalesce("__first", "__every", none))
    return claims.join(met, ID, "left").join(every, "experiment_id", "left").withColumn("cited_narrative_ids", filled).drop("__own", "__first", "__every")


def downgrade(claims: DataFrame, prior_variables: DataFrame, unknown: DataFrame) -> DataFrame:
    """Claims on priors keep that basis if a variable of theirs has a prior and the experiment isn't ``unknown``.

    ``prior_variables(variable)`` hold for all experiments, ``(experiment_id, variable)``, as of ``organism_priors``, for their own.
    """
    on = [c for c in ("experiment_id", "variable") if c in prior_variables.columns]
    grounded = claims.where("confidence_basis = 'process_priors'").select(*ID, F.explode("affected_variables").alias("variable")).join(prior_variables.select(*on).distinct(), on, "left_semi")
    grounded = grounded.join(unknown, "experiment_id", "left_anti").select(*ID).distinct().withColumn("__grounded", F.lit(True))
    down = (F.col("confidence_basis") == "process_priors") & F.col("__grounded").isNull()
    own = claims.join(grounded, ID, "left").withColumn("provenance_downgraded", down)
    return own.withColumn("confidence_basis", F.when(down, "schema_only").otherwise(F.col("confidence_basis"))).drop("__grounded")


def resolve_priors(priors: DataFrame, queries: DataFrame, family: str | None = None, variable: str | None = None) -> DataFrame:
    """Priors whose organism or alias holds the query, or the other way round, whatever the case; of one family and variable, if asked.

    Queries and names meet by an index of trigrams, in either direction, whatever the number of priors; a prior comes once for a query
    however many of its names fit, equal priors come as often as they are. Null names fit nothing, an empty one fits all.
    """
    for name, value in (("family", family), ("variable", variable)):
        if value is not None:
            priors = priors.where(F.lower(name) == value.lower())
    asked = queries.where("query is not null").select("query").distinct().withColumn("__q", F.lower("query"))
    row = F.struct(*priors.columns)
    every = F.array_union(F.array(F.lower("organism")), F.coalesce(F.transform("aliases", F.lower), F.array().cast("array<string>")))
    named = priors.select(row.alias("__row"), every.alias("__names")).groupBy("__row", "__names").agg(F.count("*").alias("__n")).select("__row", "__n", F.explode("__names").alias("__name"))
    q, names = asked.select("__q").distinct(), named.where("__name is not null").select("__name").distinct()
    inner = holding(q.withColumnRenamed("__q", "needle"), names.withColumnRenamed("__name", "whole")).select(F.col("needle").alias("__q"), F.col("whole").alias("__name"))
    outer = holding(names.withColumnRenamed("__name", "needle"), q.withColumnRenamed("__q", "whole")).select(F.col("whole").alias("__q"), F.col("needle").alias("__name"))
    fits = inner.unionByName(outer).join(named, "__name").select("__q", "__row", "__n").distinct()
    return asked.join(fits, "__q").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select("query", "__row.*")


def organism_priors(priors: DataFrame, organisms: DataFrame) -> DataFrame:
    """``experiment_id`` and the priors of its organism, from ``organisms(experiment_id, organism)``; none for a blank one."""
    known = organisms.where("trim(organism) <> ''").select("experiment_id", F.col("organism").alias("query"))
    return known.join(resolve_priors(priors, known), "query").drop("query")


def fingerprint(candidates: DataFrame, registry: DataFrame, present: DataFrame) -> DataFrame:
    """``accepted``: the process's required variables are all present, and none of its forbidden ones."""
    own = candidates.join(small(registry), "process_id").join(present, "experiment_id", "left")
    have = F.coalesce("present", F.array().cast("array<string>"))
    return own.withColumn("accepted", (F.size(F.array_except("required", have)) == 0) & ~F.arrays_overlap(F.coalesce("forbidden", F.array().cast("array<string>")), have))


def prior_violations(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Rows outside the soft range of a prior for their variable, and for their experiment where ``priors`` are those of ``organism_priors``."""
    on = [c for c in ("experiment_id", "variable") if c in priors.columns]
    return rows.join(priors.select(*on, "low", "high"), on).where("value < low or value > high")


def score(claims: DataFrame, expectations: DataFrame) -> DataFrame:
    """Recall of each experiment: expectations that some claim meets in keywords and citations, one of these in confidence, and of these each ``tags`` entry one by its ``domain_tags``."""
    none = F.array().cast("array<string>")
    tagged = "tags" in expectations.columns
    e = expectations.select("experiment_id", "keywords", "must_cite", "min_confidence", F.coalesce("tags", none).alias("tags") if tagged else none.alias("tags"))
    e = e.withColumn("__id", F.xxhash64("keywords", "must_cite", "min_confidence", "tags"))
    c = claims.select("experiment_id", F.lower("summary").alias("summary"), F.coalesce("cited_finding_ids", none).alias("cited_finding_ids"), "confidence", F.coalesce("domain_tags", none).alias("own_tags") if tagged else none.alias("own_tags")).distinct()
    hit = F.forall("keywords", lambda k: F.col("summary").contains(F.lower(k))) & (F.size(F.array_except("must_cite", "cited_finding_ids")) == 0)
    # What must be cited is met by claims that cite it; only expectations that ask for none are held against all claims of their experiment.
    citing = e.where("size(must_cite) > 0").withColumn("__cited", F.get("must_cite", F.lit(0)))
    by_citation = c.withColumn("__cited", F.explode(F.array_distinct("cited_finding_ids"))).join(citing, ["experiment_id", "__cited"]).drop("__cited")
    both = by_citation.unionByName(c.join(e.where("size(must_cite) = 0"), "experiment_id"))
    met = both.where(hit).groupBy("experiment_id", "__id").agg(F.max(F.col("confidence") >= F.col("min_confidence")).alias("sure"), F.first("tags").alias("tags"), F.flatten(F.collect_set("own_tags")).alias("own_tags"))
    met = met.where(F.col("sure") & (F.size(F.array_except("tags", "own_tags")) == 0)).select("experiment_id", "__id", F.lit(1.0).alias("met"))
    return e.join(met, ["experiment_id", "__id"], "left").groupBy("experiment_id").agg(F.count("*").alias("n_expected"), F.round(F.avg(F.coalesce("met", F.lit(0.0))), 4).alias("recall"))
