"""Units: rewriting, reading and conversion, all on distinct unit pairs; values see one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import scalars as S
from labtrail.operators.ingest import small

#: Units without a dimension (fixed values).
DIMENSIONLESS = ("od600", "od_600", "a600", "ph", "fold change", "fold_change", "log cfu/ml", "log_cfu_per_ml", "%", "% w/w", "% v/v", "percent")
RAISED = "⁻⁰¹²³⁴⁵⁶⁷⁸⁹"
#: Symbol, factor to SI, offset, and exponents of mass, length, time, amount, temperature.
ATOMS = [
    *((p + "g", f * 1e-3, 0.0, 1, 0, 0, 0, 0) for p, f in (("", 1.0), ("k", 1e3), ("m", 1e-3), ("µ", 1e-6), ("u", 1e-6), ("n", 1e-9))),
    *((p + "m", f, 0.0, 0, 1, 0, 0, 0) for p, f in (("", 1.0), ("c", 1e-2), ("m", 1e-3), ("µ", 1e-6))),
    *((p + x, f * 1e-3, 0.0, 0, 3, 0, 0, 0) for x in ("L", "l") for p, f in (("", 1.0), ("m", 1e-3), ("µ", 1e-6))),
    ("s", 1.0, 0.0, 0, 0, 1, 0, 0), ("min", 60.0, 0.0, 0, 0, 1, 0, 0), ("h", 3600.0, 0.0, 0, 0, 1, 0, 0), ("d", 86400.0, 0.0, 0, 0, 1, 0, 0),
    ("mol", 1.0, 0.0, 0, 0, 0, 1, 0), ("mmol", 1e-3, 0.0, 0, 0, 0, 1, 0), ("M", 1e3, 0.0, 0, -3, 0, 1, 0), ("mM", 1.0, 0.0, 0, -3, 0, 1, 0),
    ("rpm", 1 / 60, 0.0, 0, 0, -1, 0, 0), ("Pa", 1.0, 0.0, 1, -1, -2, 0, 0), ("bar", 1e5, 0.0, 1, -1, -2, 0, 0), ("cP", 1e-3, 0.0, 1, -1, -1, 0, 0),
    ("K", 1.0, 0.0, 0, 0, 0, 0, 1), ("degC", 1.0, 273.15, 0, 0, 0, 0, 1), ("degF", 5 / 9, 459.67 * 5 / 9, 0, 0, 0, 0, 1),
]
DIMS = ("mass", "length", "time", "amount", "temperature")
TOKEN = r"([*/]?)(\d*)([A-Za-zµ]+)(?:\^(-?\d+))?"


def dimensionless(unit: Column) -> Column:
    return F.trim(F.substring_index(F.lower(F.trim(unit)), "(", 1)).isin(*DIMENSIONLESS)


def rewrite_unit(unit: Column) -> Column:
    """Plain spelling: no ``of ...``, superscripts as powers, products as ``*``: dots, and blanks that stand between two units or brackets."""
    stuff = F.regexp_replace(F.trim(unit), r"(?i)\sof\s[^*/·()]*", "")
    u = F.translate(F.regexp_replace(F.trim(stuff), f"([{RAISED}]+)", "^$1"), RAISED, "-0123456789")
    ends, begins = r"(?<=\p{Alpha}|\)|\])", r"(?=\p{Alpha}|\(|\[)"
    return F.regexp_replace(F.replace(u, F.lit("·"), F.lit("*")), ends + r"\s+" + begins, "*")


def normalize_units(units: DataFrame) -> DataFrame:
    """``action`` (dimensionless, rewrite, unconvertible), ``plain`` and ``confidence`` of distinct ``unit`` strings."""
    u, plain = F.col("unit"), rewrite_unit(F.col("unit"))
    action = F.when(dimensionless(u), "dimensionless").when(plain != F.trim(u), "rewrite").otherwise("unconvertible")
    out = units.withColumn("action", action).withColumn("plain", F.when(F.col("action") == "rewrite", plain))
    return out.withColumn("confidence", F.when(F.col("action") == "dimensionless", 0.95).when(F.col("action") == "rewrite", 0.85).otherwise(0.0))


def normalize_chain(units: DataFrame, *steps) -> DataFrame:
    """Of several normalizers of distinct ``unit`` strings, each like ``normalize_units``, the first that doesn't call one unconvertible wins."""
    out = units.select("unit").distinct()
    for k, step in enumerate(steps):
        own = step(units.select("unit").distinct()).where("action <> 'unconvertible'").select("unit", F.struct(F.lit(k).alias("step"), "action", "plain", "confidence").alias(f"s{k}"))
        out = out.join(own, "unit", "left")
    out = out.withColumn("s", F.coalesce(*(f"s{k}" for k in range(len(steps)))))
    return out.select("unit", "s.step", F.coalesce("s.action", F.lit("unconvertible")).alias("action"), "s.plain", F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"))


def known_units(table: DataFrame):
    """A normalizer by ``table(unit, plain)``."""
    return lambda units: units.join(small(table), "unit").withColumns({"action": F.lit("rewrite"), "confidence": F.lit(0.8)})


def read_units(units: DataFrame) -> DataFrame:
    """``factor``, ``offset`` and dimension exponents of those distinct ``unit`` strings that can be read."""
    spark = units.sparkSession
    atoms = spark.createDataFrame(ATOMS, "symbol string, f double, o double, " + ", ".join(f"{d} int" for d in DIMS))
    plain = F.regexp_replace(F.regexp_replace(rewrite_unit(F.col("unit")), r"\s+", ""), r"/\(([^()*/]+)\*([^()*/]+)\)", "/$1/$2")
    groups = [F.regexp_extract_all("plain", F.lit(TOKEN), F.lit(k)) for k in range(5)]
    own = units.select("unit").distinct().withColumn("plain", plain).select("unit", "plain", *(g.alias(f"g{k}") for k, g in enumerate(groups)))
    own = own.where((F.size("g0") > 0) & (F.array_join("g0", "") == F.col("plain")))
    own = own.select("unit", F.size("g0").alias("n"), F.explode(F.arrays_zip("g1", "g2", "g3", "g4")).alias("t"))
    sign = F.when(F.col("t.g1") == "/", -1).otherwise(1)
    power = sign * F.coalesce(F.nullif(F.col("t.g4"), F.lit("")).cast("int"), F.lit(1))
    prefix = F.pow(F.coalesce(F.nullif(F.col("t.g2"), F.lit("")).cast("double"), F.lit(1.0)), sign)
    own = own.select("unit", "n", power.alias("power"), prefix.alias("prefix"), F.col("t.g3").alias("symbol")).join(F.broadcast(atoms), "symbol")
    read = own.groupBy("unit", "n").agg(F.count("*").alias("found"), F.product(F.col("prefix") * F.pow("f", "power")).alias("factor"), F.max("o").alias("o"), F.max("power").alias("p"), *(F.sum(F.col(d) * F.col("power")).alias(d) for d in DIMS))
    bare = (F.col("n") == 1) & (F.col("p") == 1)
    return read.where("found = n").select("unit", "factor", F.when(bare, F.col("o")).otherwise(0.0).alias("offset"), *DIMS)


def conversions(pairs: DataFrame) -> DataFrame:
    """``scale`` and ``shift`` of distinct ``(unit_raw, unit_canonical)`` pairs, null where they don't convert."""
    pairs = pairs.where("unit_raw is not null and unit_canonical is not null").distinct()
    units = read_units(pairs.select(F.col("unit_raw").alias("unit")).union(pairs.select("unit_canonical")))
    a, b = (units.select(F.col("unit").alias(u), F.struct(*DIMS).alias(f"{k}_dims"), F.col("factor").alias(f"{k}_f"), F.col("offset").alias(f"{k}_o")) for u, k in (("unit_raw", "a"), ("unit_canonical", "b")))
    both = pairs.join(a, "unit_raw", "left").join(b, "unit_canonical", "left")
    same = F.col("a_dims") == F.col("b_dims")
    return both.select("unit_raw", "unit_canonical", F.when(same, F.col("a_f") / F.col("b_f")).alias("scale"), F.when(same, (F.col("a_o") - F.col("b_o")) / F.col("b_f")).alias("shift"))


def convert(obs: DataFrame) -> DataFrame:
    """``obs`` with ``converted`` and ``status``: not_applicable, identity, converted or failed."""
    pairs = conversions(obs.select("unit_raw", "unit_canonical"))
    own = obs.join(pairs, ["unit_raw", "unit_canonical"], "left")
    same = F.col("unit_raw").isNull() | (F.col("unit_raw") == F.col("unit_canonical")) | dimensionless(F.col("unit_raw"))
    status = F.when(F.col("unit_canonical").isNull(), "not_applicable").when(F.col("value").isNull(), "failed").when(same, "identity").when(F.col("scale").isNotNull(), "converted").otherwise("failed")
    own = own.withColumn("status", status)
    value = F.when(F.col("status") == "identity", F.col("value")).when(F.col("status") == "converted", F.col("value") * F.col("scale") + F.col("shift"))
    return own.withColumn("converted", value).drop("scale", "shift")
