"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain, language, source. A token budget goes down it by weight: at each node the children share the node's
budget in proportion to their weights, no child gets more than its subtree can give (its tokens times ``epochs``), and
what one lacks goes to its siblings first; only what the whole node can't hold is shared out higher up. Each leaf then
takes whole epochs of its texts and, of the next epoch in a seeded order, the longest prefix within what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table

LEVELS = ("domain", "lang", "source")
#: A leaf's order is cut in so many buckets (three hex digits), so that a large leaf is never ordered in one task.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def default_domain() -> Column:
    """Four domains by the number at the end of the source's name; ``other`` without one."""
    number = F.try_to_number(F.nullif(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long")
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("other"))


def default_weights() -> dict[str, Column]:
    """Integer weights of the children of any node, by level."""
    return {
        "domain": F.when(F.col("domain") == "domain0", 4).when(F.col("domain") == "domain1", 3).when(F.col("domain") == "domain2", 2).otherwise(1),
        "lang": F.when(F.col("lang") == "en", 3).otherwise(2),
        "source": F.lit(1),
    }


def _share(children: DataFrame, level: str, weight: Column) -> DataFrame:
    """``budget`` of each child from its node's ``budget``; ``most`` is what the child can give."""
    node = W.partitionBy(*LEVELS[: LEVELS.index(level)])
    rank = node.orderBy(F.col("most").cast("double") / F.col("w"), level)
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    c = children.withColumn("w", weight.cast("long"))
    c = c.withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("w_all", F.sum("w").over(node))
    c = c.withColumn("full", F.col("most").cast("double") * (F.col("w_all") - F.col("w_before")) <= F.col("w").cast("double") * (F.col("budget") - F.col("full_before")))
    c = c.withColumn("full_sum", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(node)).withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(node))
    part = F.floor(F.col("w").cast("double") * (F.col("budget") - F.col("full_sum")) / F.col("open_w"))
    own = F.when(F.col("full"), F.col("most")).otherwise(F.greatest(part, F.lit(0)))
    return c.select(*LEVELS[: LEVELS.index(level) + 1], own.cast("long").alias("budget"))


def budgets(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, Column]) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of each leaf of ``leaves(domain, lang, source, tokens)``."""
    above = leaves.agg(budget.cast("long").alias("budget"))
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).alias("most"))
        children = children.join(above, keys[:-1]) if depth else children.withColumn("__one", F.lit(1)).join(above.withColumn("__one", F.lit(1)), "__one")
        above = _share(children, level, weights[level])
    return leaves.join(above, list(LEVELS))


def _named(docs: DataFrame, domain: Column | None, tokens: Column | None) -> list[Column]:
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("none")).alias(c) for c in ("lang", "source"))
    return [(default_domain() if domain is None else domain).alias("domain"), lang, source, (n_words(docs["text"]) if tokens is None else tokens).alias("n_tokens")]


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, share: float = 0.6, epochs: int = 2, seed: int = 17, domain: Column | None = None, weights: dict[str, Column] | None = None, tokens: Column | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, n_tokens``: a row for each text and epoch that the mix takes.

    The budget is ``share`` of all tokens (words, unless ``tokens`` counts otherwise), rounded down. Nulls in lang and
    source are the name ``none``; null and empty texts have no tokens and come with a prefix that passes them. The order of
    an epoch is that of ``md5(seed:epoch:doc_id)``, then doc_id, then tokens; rows that are equal in all are interchangeable.
    Further columns are ignored, an empty table gives an empty table.
    """
    return _mix(docs, share, epochs, seed, domain, weights, tokens)[0]


def take(docs: DataFrame, share: float = 0.6, epochs: int = 2, seed: int = 17, domain: Column | None = None, weights: dict[str, Column] | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with all their columns, once for each epoch.

    A prefix ends at one row, so each leaf needs its whole epochs and that row's place in the order: a table of a row for
    each leaf, and no text is shuffled. Rows that are equal in doc_id and tokens are taken together.
    """
    taken, given = _mix(docs, share, epochs, seed, domain, weights, tokens)
    leaf, place = list(LEVELS), lambda e, i, n: F.struct(_key(seed, e, i).alias("key"), i.alias("doc_id"), n.alias("n"))
    last = taken.join(given.select(*leaf, "whole"), leaf).where("epoch = whole")
    cuts = last.groupBy(*leaf).agg(F.max(place(F.col("epoch"), F.col("doc_id"), F.col("n_tokens"))).alias("cut"))
    cuts = materialise(given.select(*leaf, "whole").join(cuts, leaf, "left"), "mix-cuts")
    own = F.struct(*_named(docs, domain, tokens)).alias("__own")
    marked = docs.select("*", own)
    cuts = cuts.select(F.struct(*leaf).alias("__leaf"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    same = [F.col(f"__own.{k}") == F.col(f"__leaf.{k}") for k in leaf]
    marked = marked.join(F.broadcast(cuts) if cuts.count() <= 100_000 else cuts, same)
    inside = place(F.col("__whole"), docs["doc_id"], F.col("__own.n_tokens")) <= F.col("__cut")
    times = F.col("__whole") + F.coalesce(inside.cast("int"), F.lit(0))
    marked = marked.withColumn("__times", times).where("__times > 0")
    return marked.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*(docs[c] for c in docs.columns))


def _mix(docs: DataFrame, share: float, epochs: int, seed: int, domain: Column | None, weights: dict[str, Column] | None, tokens: Column | None) -> tuple[DataFrame, DataFrame]:
    rows = materialise(docs.select("doc_id", *_named(docs, domain, tokens)), "mix-rows")
    leaves = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    per_mille = round(share * 1000)
    given = budgets(leaves, F.floor(F.sum("tokens") * per_mille / 1000), epochs, weights or default_weights())
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    given = given.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).drop("tokens", "budget")
    given = materialise(given, "mix-budgets")

    leaf = list(LEVELS)
    planned = rows.join(F.broadcast(given) if leaves.count() <= 100_000 else given, leaf)
    out = ["doc_id", *leaf, "epoch", "n_tokens"]
    full = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*out)

    last = planned.withColumn("key", _key(seed, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).withColumn("epoch", F.col("whole"))
    sums = last.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest_of"))
    # running sums in two levels, so that no task orders all buckets of a leaf
    sums = materialise(sums.withColumn("stretch", F.substring("bucket", 1, 1)), "mix-sums")
    before = F.sum("stretch_held").over(W.partitionBy(*leaf).orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("stretch_held")
    stretches = sums.groupBy(*leaf, "stretch").agg(F.sum("held").alias("stretch_held")).withColumn("before", before).drop("stretch_held")
    upto = F.col("before") + F.sum("held").over(W.partitionBy(*leaf, "stretch").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.join(stretches, [*leaf, "stretch"]).withColumn("upto", upto).where("upto - held <= rest_of").select(*leaf, "bucket", "upto", (F.col("upto") - F.col("held")).alias("passed"))
    last = last.join(materialise(sums, "mix-buckets"), [*leaf, "bucket"])
    inside = last.where("upto <= rest").select(*out)
    run = F.sum("n_tokens").over(W.partitionBy(*leaf, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    edge = last.where("upto > rest").withColumn("run", run).where("passed + run <= rest").select(*out)
    return full.unionByName(inside).unionByName(edge), given


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _level(depth: int, weight: str) -> str:
    level, keys = LEVELS[depth], ", ".join(LEVELS[: depth + 1])
    part = f"PARTITION BY {', '.join(LEVELS[:depth])}" if depth else ""
    above = f"JOIN b{depth - 1} USING ({', '.join(LEVELS[:depth])})" if depth else "CROSS JOIN b"
    return f"""
c{depth} AS (SELECT {keys}, CAST(sum(tokens) * 2 AS BIGINT) AS most FROM leaves GROUP BY {keys}),
d{depth} AS (SELECT c{depth}.*, budget, CAST({weight} AS BIGINT) AS w FROM c{depth} {above}),
e{depth} AS (SELECT *, coalesce(sum(most) OVER p, 0) AS full_before, coalesce(sum(w) OVER p, 0) AS w_before, sum(w) OVER n AS w_all FROM d{depth}
  WINDOW n AS ({part}), p AS ({part} ORDER BY CAST(most AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, CAST(most AS DOUBLE) * CAST(w_all - w_before AS DOUBLE) <= CAST(w AS DOUBLE) * CAST(budget - full_before AS DOUBLE) AS is_full FROM e{depth}),
g{depth} AS (SELECT *, sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ({part}) AS full_sum, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS open_w FROM f{depth}),
b{depth} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN most ELSE greatest(floor(CAST(w AS DOUBLE) * CAST(budget - full_sum AS DOUBLE) / CAST(open_w AS DOUBLE)), 0) END AS BIGINT) AS budget FROM g{depth})"""


OP7_SQL = rf"""
WITH rows AS (SELECT doc_id, coalesce('domain' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'other') AS domain,
  coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows GROUP BY ALL),
b AS (SELECT CAST(floor(CAST(sum(tokens) * 600 AS DOUBLE) / 1000) AS BIGINT) AS budget FROM leaves),
{_level(0, "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END")},
{_level(1, "CASE lang WHEN 'en' THEN 3 ELSE 2 END")},
{_level(2, "1")},
given AS (SELECT leaves.*, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS INTEGER) ELSE 0 END AS whole, budget FROM leaves JOIN b2 USING (domain, lang, source)),
planned AS (SELECT rows.*, whole, budget - whole * tokens AS rest, md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM rows JOIN given USING (domain, lang, source)),
last AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM planned)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM planned)
UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM last WHERE run <= rest
"""
