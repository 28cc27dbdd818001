"""Findings on series, cohorts and pairs of variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators.ingest import small
from labtrail.operators.scans import neighbour, stretches
from labtrail.operators.series import KEY, last_at_point, rates, snap
from labtrail.sources.shared import discard, written


def cohort_outliers(rows: DataFrame, min_runs: int = 2, z: float = 2.0) -> DataFrame:
    """Runs whose last value, peak or time to peak is ``z`` or more deviations off the mean of all runs."""
    at = F.struct("time_h", "observation_id")
    one = rows.groupBy(*KEY).agg(F.max_by("value", at).alias("final"), F.max("value").alias("peak"), F.max_by("time_h", F.struct("value", "time_h")).alias("time_to_peak"))
    long = one.select(*KEY, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("final", "peak", "time_to_peak")))).alias("s")).select(*KEY, "s.*")
    group = ["experiment_id", "variable", "feature"]
    cohort = long.groupBy(*group).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n_runs")).where((F.col("n_runs") >= min_runs) & (F.col("sd") > 0))
    return long.join(cohort, group).withColumn("z", F.round((F.col("x") - F.col("mean")) / F.col("sd"), 4)).where(F.abs("z") >= z).select(*KEY, "feature", "x", "n_runs", "z")


def contradictions(rows: DataFrame, dt: float, tolerance: float = 1e-3) -> DataFrame:
    """Points of a series whose values disagree beyond ``tolerance``."""
    own = snap(rows, dt).groupBy(*KEY, "grid_idx").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return own.where(~S.values_match(F.col("low"), F.col("high"), tolerance))


def source_contradictions(rows: DataFrame, dt: float, tolerance: float = 1e-3) -> DataFrame:
    """Points of a series where values of two different ``source``s disagree beyond ``tolerance``.

    Each source counts by its extremes. If one source has both the lowest and the highest value of a point, the extremes
    of the others are held against these.
    """
    point = [*KEY, "grid_idx"]
    own = snap(rows, dt).groupBy(*point, "source").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = own.groupBy(*point).agg(F.count("*").alias("n_sources"), F.min(F.struct("lo", "source")).alias("a"), F.max(F.struct("hi", "source")).alias("b")).where("n_sources > 1")
    other = own.join(ends, point).groupBy(*point, "n_sources", "a", "b").agg(F.max(F.when(F.col("source") != F.col("a.source"), F.col("hi"))).alias("hi"), F.min(F.when(F.col("source") != F.col("b.source"), F.col("lo"))).alias("lo"))
    apart = ~S.values_match(F.col("a.lo"), F.col("hi"), tolerance) | ~S.values_match(F.col("lo"), F.col("b.hi"), tolerance)
    return other.where(apart).select(*point, "n_sources", F.col("a.lo").alias("low"), F.col("b.hi").alias("high"))


def _pair(rows: DataFrame, dt: float, first: str, second: str) -> DataFrame:
    """Values ``a`` and ``b`` of two variables at one point of one run, from one grouping."""
    points = last_at_point(snap(rows.where(F.col("variable").isin(first, second)), dt))
    pick = lambda v: F.max(F.when(F.col("variable") == v, F.col("value")))
    return points.groupBy("experiment_id", "run_id", "grid_idx").agg(pick(first).alias("a"), pick(second).alias("b")).where("a is not null and b is not null")


def mass_balance(rows: DataFrame, dt: float, weight: str, volume: str, density: float, tolerance: float) -> DataFrame:
    """Points where a weight isn't its volume times ``density`` to a relative ``tolerance``."""
    error = F.abs(F.col("a") - F.col("b") * density) / F.greatest(F.abs("a"), F.lit(1.0))
    return _pair(rows, dt, weight, volume).withColumn("error", F.round(error, 6)).where(F.col("error") > tolerance)


def relationship_checks(rows: DataFrame, dt: float, first: str, second: str, low: float, high: float) -> DataFrame:
    """Points where the ratio of two variables is outside [low, high]."""
    return _pair(rows, dt, first, second).withColumn("ratio", F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6)).where((F.col("ratio") < low) | (F.col("ratio") > high))


def precedes(rows: DataFrame, first: str, second: str, max_lag: float) -> DataFrame:
    """Each ``first`` of a run with the earliest ``second`` within ``max_lag`` hours after it."""
    pair = rows.sparkSession.createDataFrame([(first, second, float(max_lag))], "first string, second string, max_lag double")
    return precedes_any(rows, pair).drop("first", "second")


def precedes_any(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``first, second`` of ``pairs(first, second, max_lag)``, and each ``first`` of a run with the earliest ``second`` within that lag after it.

    All pairs in one pass, each joined by stretches of time as wide as its lag; a pair that is listed twice counts once, with its longest lag.
    """
    pairs = small(pairs.where("first is not null and second is not null and max_lag > 0").groupBy("first", "second").agg(F.max("max_lag").alias("max_lag")))
    own = rows.select("experiment_id", "run_id", "variable", "observation_id", F.col("time_h").alias("t")).where("t is not null")
    place = F.floor(F.col("t") / F.col("max_lag"))
    a = own.join(pairs, own["variable"] == pairs["first"]).withColumn("stretch", place)
    b = own.join(pairs, own["variable"] == pairs["second"]).withColumn("stretch", place)
    key = ["first", "second", "experiment_id", "run_id", "stretch"]
    # Within a stretch only its earliest later event counts: the next one in time order, else the first of the next stretch.
    first_of = b.groupBy(*key).agg(F.min("t").alias("earliest")).withColumn("stretch", F.col("stretch") - 1)
    mixed = a.select(*key, "max_lag", F.col("observation_id").alias("a_id"), "t", F.lit(0).alias("is_b")).unionByName(b.select(*key, "max_lag", F.lit(None).cast("string").alias("a_id"), "t", F.lit(1).alias("is_b")))
    w = W.partitionBy(*key).orderBy("t", F.desc("is_b")).rowsBetween(1, W.unboundedFollowing)
    after = mixed.withColumn("inside", F.min(F.when(F.col("is_b") == 1, F.col("t"))).over(w)).where("is_b = 0")
    met = after.join(first_of, key, "left").withColumn("b_time", F.coalesce("inside", "earliest"))
    met = met.where((F.col("b_time") > F.col("t")) & (F.col("b_time") - F.col("t") <= F.col("max_lag")))
    return met.select("first", "second", "experiment_id", "run_id", "a_id", "b_time", F.round(F.col("b_time") - F.col("t"), 6).alias("lag_h"))


def kinetic_fit(rows: DataFrame, window: float) -> DataFrame:
    """Least squares of ln(value) on time in windows of ``window`` hours."""
    own = rows.where("value > 0").withColumn("window_idx", F.floor(F.col("time_h") / window).cast("int")).withColumn("y", F.ln("value"))
    fit = own.groupBy(*KEY, "window_idx").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "time_h"), 6).alias("slope"), F.round(F.regr_r2("y", "time_h"), 6).alias("r2"))
    return fit.where("n >= 3")


def sliding_fit(rows: DataFrame, window: float, least: int = 3, spread: float = 0.5) -> DataFrame:
    """``observation_id, time_h, n, slope``: least squares of ln(value) on time over the ``window`` hours up to each observation, both ends included.

    Such a window lies in the observation's stretch of ``window`` hours and the one before: its sums are the stretch's
    up to the observation, and the earlier stretch's whole sums less those before the window's start, all from running sums of
    moments around the stretch's start. No window of rows is wider than a stretch, and no pair of rows is joined. A fit needs ``least``
    rows and times that deviate by ``spread`` hours (root of their mean square). Only rows of ``value > 0`` count.
    """
    key, names = [*KEY, "stretch"], ("n", "t", "y", "tt", "ty")
    own = rows.where("value > 0 and time_h is not null").select(*KEY, "observation_id", "time_h", F.ln("value").alias("log")).withColumn("stretch", F.floor(F.col("time_h") / window))
    at, log = F.col("time_h") - F.col("stretch") * window, F.col("log")
    moments = F.struct(*(x.alias(n) for n, x in zip(names, (F.lit(1.0), at, log, at * at, at * log), strict=True)))
    own = own.withColumn("m", moments)
    # A probe stands where the window starts, a stretch earlier and before the rows of its own time.
    probes = own.select(*KEY, "observation_id", "time_h", (F.col("stretch") - 1).alias("stretch"), (F.col("time_h") - window).alias("t"), F.lit(0).alias("is_row"), F.lit(None).cast("struct<n:double,t:double,y:double,tt:double,ty:double>").alias("m"))
    mixed = own.select(*KEY, "observation_id", "time_h", "stretch", F.col("time_h").alias("t"), F.lit(1).alias("is_row"), "m").unionByName(probes)
    upto = W.partitionBy(*key).orderBy("t", "is_row").rangeBetween(W.unboundedPreceding, W.currentRow)
    mixed = mixed.select(*key, "observation_id", "time_h", "is_row", *(F.coalesce(F.sum(f"m.{n}").over(upto), F.lit(0.0)).alias(n) for n in names), *(F.coalesce(F.sum(f"m.{n}").over(W.partitionBy(*key)), F.lit(0.0)).alias(f"all_{n}") for n in names))
    head = mixed.where("is_row = 1").select(*KEY, "observation_id", "time_h", *names)
    tail = mixed.where("is_row = 0").select(*KEY, "observation_id", "time_h", *(F.col(f"all_{n}") - F.col(n) for n in names)).toDF(*KEY, "observation_id", "time_h", *(f"old_{n}" for n in names))
    both = head.join(tail, [*KEY, "observation_id", "time_h"])
    old = {n: F.col(f"old_{n}") for n in names}
    # The earlier stretch's times, seen from the start of the later one.
    seen = {"n": old["n"], "t": old["t"] - old["n"] * window, "y": old["y"], "tt": old["tt"] - 2 * window * old["t"] + old["n"] * window * window, "ty": old["ty"] - window * old["y"]}
    sums = both.select(*KEY, "observation_id", "time_h", *((F.col(n) + x).alias(n) for n, x in seen.items()))
    square = F.col("tt") - F.col("t") * F.col("t") / F.col("n")
    fit = sums.where((F.col("n") >= least) & (square / F.col("n") >= spread * spread))
    return fit.select(*KEY, "observation_id", "time_h", F.col("n").cast("long").alias("n"), F.round((F.col("ty") - F.col("t") * F.col("y") / F.col("n")) / square, 6).alias("slope"))


def fit_evidence(rows: DataFrame, window: float) -> DataFrame:
    """The observations behind each fit of ``kinetic_fit``: its key, ``window_idx`` and ``observation_id``."""
    own = rows.where("value > 0").withColumn("window_idx", F.floor(F.col("time_h") / window).cast("int"))
    return own.join(kinetic_fit(rows, window).select(*KEY, "window_idx"), [*KEY, "window_idx"], "left_semi").select(*KEY, "window_idx", "observation_id")


def kinetic_anomalies(fit: DataFrame, specs: DataFrame) -> DataFrame:
    """Fits whose slope leaves the range of ``specs(variable, slope_low, slope_high)``."""
    return fit.join(specs, "variable").where("slope < slope_low or slope > slope_high").select(*KEY, "window_idx", "slope", "slope_low", "slope_high")


def trend_direction(points: DataFrame, flat: float = 1e-3) -> DataFrame:
    """``oscillating`` where the rate changes sign in over half of its steps, else by the slope."""
    slope = points.where("observation_id is not null").groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.regr_slope("value", "time_h"), 6).alias("slope"))
    r = neighbour(rates(points).where("rate is not null"), KEY, "grid_idx", stretches("grid_idx"), ["rate"], "before")
    r = r.withColumn("turn", (F.signum("rate") * F.signum("before.rate") < 0).cast("int"))
    turns = r.groupBy(*KEY).agg(F.sum(F.coalesce("turn", F.lit(0))).alias("turns"))
    own = slope.where("n >= 3").join(turns, KEY)
    label = F.when(F.col("turns") * 2 > F.col("n") - 2, "oscillating").when(F.abs("slope") <= flat, "plateau").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return own.select(*KEY, "n", "turns", "slope", label.alias("direction"))


def cross_run_delta(rows: DataFrame) -> DataFrame:
    """Each run's mean against the mean of all runs' means of the variable, to four places, halves away from zero.

    Values are summed in whole millionths and means held in billionths, so that no order of summing changes a result;
    a mean beyond 9e9 doesn't fit and fails.
    """
    whole = S.millionths(F.col("value"))
    runs = rows.groupBy(*KEY).agg(F.sum(whole).alias("s"), F.count(whole).alias("n")).where("n > 0").select(*KEY, S.ratio_half_up(F.col("s") * 1000, F.col("n")).alias("m"))
    every = runs.groupBy("experiment_id", "variable").agg(F.sum(F.col("m").cast("decimal(38,0)")).alias("of_all"), F.count("*").alias("runs"))
    off = F.col("m").cast("decimal(38,0)") * F.col("runs") - F.col("of_all")
    places = lambda a, b: S.ratio_half_up(a, b).cast("double") / 1e4
    both = runs.join(every, ["experiment_id", "variable"])
    return both.select(*KEY, places(F.col("m"), F.lit(100_000)).alias("mean"), places(off, F.col("runs") * 100_000).alias("delta"))


def facts_graph(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(kind, id)`` and edges ``(kind, src, dst)``: samples, measurements and the variables they measure; where ``obs`` has ``file_id``, the samples' source files too."""
    sample, what = F.concat_ws("/", "experiment_id", "run_id"), F.col("variable")
    node = lambda kind, c: obs.select(F.lit(kind).alias("kind"), c.alias("id")).where("id is not null")
    vertices = node("sample", sample).distinct().unionByName(node("condition", what).distinct()).unionByName(node("measurement", F.col("observation_id")))
    edge = lambda kind, a, b: obs.select(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst")).where("src is not null and dst is not null")
    edges = edge("measured_on", F.col("observation_id"), sample).unionByName(edge("measures", F.col("observation_id"), what))
    if "file_id" in obs.columns:
        source = F.col("file_id").cast("string")
        vertices = vertices.unionByName(node("source", source).distinct())
        edges = edges.unionByName(edge("derived_from", sample, source).distinct())
    return vertices, edges


def latest_ids(links: DataFrame) -> DataFrame:
    """The end of each chain of ``links(id, superseded_by)``: pointers double each round, so rounds grow with the chain's logarithm."""
    now = written(links.select("id", F.coalesce("superseded_by", "id").alias("latest")), "chain")
    spent = now
    while True:
        step = now.alias("a").join(now.select(F.col("id").alias("latest"), F.col("latest").alias("next")), "latest", "left")
        nxt = written(step.select("id", F.coalesce("next", "latest").alias("latest"), (F.col("next") != F.col("latest")).alias("moved")), "chain")
        discard(spent)
        if nxt.where("moved").isEmpty():
            return nxt.select("id", "latest")
        spent, now = nxt, nxt.select("id", "latest")
