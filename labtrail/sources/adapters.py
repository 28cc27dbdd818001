"""The driver's tables in the engine's own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, run: str = "user_id % 10") -> DataFrame:
    """Observations of ``events``: one value of one variable in one run at one hour; some lack a value or a run."""
    e = load(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return e.select(
        F.concat(F.lit("EXP-"), (F.col("user_id") % 2).cast("string")).alias("experiment_id"),
        F.format_string("O-%09d", "event_id").alias("observation_id"),
        F.when(F.col("event_id") % 89 != 0, F.format_string("RUN-%04d", F.expr(run))).alias("run_id"),
        hours.alias("time_h"),
        F.col("event_type").alias("variable"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"),
        F.lit("u").alias("unit"),
    )


OBS_SQL = """obs AS (SELECT 'EXP-' || (user_id % 2) AS experiment_id, printf('O-%09d', event_id) AS observation_id,
  CASE WHEN event_id % 89 <> 0 THEN printf('RUN-%04d', {run}) END AS run_id,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(3.6e9 AS DOUBLE) AS time_h,
  event_type AS variable, CASE WHEN event_id % 97 <> 0 THEN value END AS value, 'u' AS unit FROM events)"""

#: variable, nominal, standard deviation (none for ``error``, which has no spec).
SPECS = (("click", 50.0, 10.0), ("purchase", 35.0, 10.0), ("signup", 50.0, 25.0), ("view", 50.0, 49.0))


def specs(spark: SparkSession) -> DataFrame:
    """The specs as a local relation: Spark knows their size, and no Python worker starts for them."""
    rows = ", ".join(f"('{v}', double({n}), double({s}))" for v, n, s in SPECS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(variable, nominal, std_dev)")


SPECS_SQL = "specs(variable, nominal, std_dev) AS (VALUES " + ", ".join(f"('{v}', CAST({n} AS DOUBLE), CAST({s} AS DOUBLE))" for v, n, s in SPECS) + ")"

#: variable, unit, type, synonyms: ``name`` has no unit and is no observation; the later variable has a shared synonym.
DICTIONARY = (("size", "cm", "float", ["p size"]), ("list_price", "EUR", "float", ["price", "retail price"]), ("retail_price", "USD", "float", ["retail price"]), ("name", None, "string", ["p name"]))


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(DICTIONARY)], "ord int, variable string, unit string, data_type string, synonyms array<string>")


def wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as wide tables of text, one for each type; some sizes are blank or no number."""
    k = F.col("p_partkey")
    size = F.when(k % 23 == 0, "nan").when(k % 29 == 0, "").when(k % 31 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), "p_type").alias("table_id"),
        k.alias("row_idx"),
        F.expr("p_partkey div 40").cast("string").alias("Batch_ref.1"),
        (k % 40).cast("string").alias("Time (h)"),
        F.col("p_name").alias("P Name"),
        size.alias("P Size [mm]"),
        F.col("p_retailprice").cast("string").alias("Retail Price (USD):"),
        F.col("p_brand").alias("Brand"),
    )


CELLS_SQL = """cells AS (SELECT 'part/' || p_type AS table_id, p_partkey AS row_idx, unnest([
  {'col_idx': 0, 'raw_header': 'Batch_ref.1', 'raw_value': CAST(p_partkey // 40 AS VARCHAR)},
  {'col_idx': 1, 'raw_header': 'Time (h)', 'raw_value': CAST(p_partkey % 40 AS VARCHAR)},
  {'col_idx': 2, 'raw_header': 'P Name', 'raw_value': p_name},
  {'col_idx': 3, 'raw_header': 'P Size [mm]', 'raw_value': CASE WHEN p_partkey % 23 = 0 THEN 'nan' WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END},
  {'col_idx': 4, 'raw_header': 'Retail Price (USD):', 'raw_value': CAST(p_retailprice AS VARCHAR)},
  {'col_idx': 5, 'raw_header': 'Brand', 'raw_value': p_brand}], recursive := true) FROM part)"""


def evidence_candidates(blocks: DataFrame) -> DataFrame:
    """Quotations of 40 characters from each block, reversed for one document in four, with a value for one in three."""
    quote = F.substring("text", 3, 40)
    return blocks.select("doc_id", "paragraph_idx", F.when(F.col("doc_id") % 4 == 0, F.reverse(quote)).otherwise(quote).alias("evidence"), F.when(F.col("doc_id") % 3 == 0, "7").alias("value"))
