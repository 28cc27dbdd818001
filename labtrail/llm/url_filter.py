"""URL filters: fixed host and path rules first, association rules for what these leave open.

Labelled pages are item sets: tokens of their urls, and whether the label calls them bad. FP-growth mines token combinations
that imply a bad page; rules below the confidence, or with fewer bad pages than the least support, are pruned, and so are rules
that hold all items of a shorter one, for they block nothing more: tokens that are rules alone, and all but one of those that always occur
together, don't enter the search. The rules that stay are matched by an inverted index under their rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BAD = "=bad"


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(own_host: Column, own_path: Column) -> Column:
    """The longest rule that fits, like ``net/es/``; null without one."""
    out = None
    for name, start, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((own_host == name) | own_host.endswith("." + name)) & own_path.startswith(start)
        out = F.when(fits, name + start) if out is None else out.when(fits, name + start)
    return out


def tokens(url: Column) -> Column:
    """The url's items: scheme, host labels with their place from the right, path segments and query keys; digits are ``0``."""
    scheme = F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    labels = F.transform(F.reverse(F.split(host(url), r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    parts = F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.lower(F.regexp_extract(x, "^([^=]*)", 1))))
    return F.array_distinct(F.concat(F.array(scheme), labels, parts, keys))


def _compact(pages: DataFrame, labels: DataFrame, confidence: float, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """Minimal rules ``items, confidence, support``, and ``item, rep``: an item that stands for all that occur in the same labelled pages.

    Single items are counted first: those that are rules need no search, and those of too few bad pages are in no rule. Items
    of the same pages are one item of the baskets, so the paths that a site's pages share cost as much as one segment.
    FP-growth lists every combination of what is left; of k items that share ``least_pages`` bad pages, though not the
    same ones, these are two to the power of k.
    """
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
    bad = bad.agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    known = pages.select("page_id", "url").where("url is not null").join(bad, pages["page_id"] == bad["doc_id"])
    every = materialise(known.select(F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("items"), "bad"), "baskets")
    long = every.select("id", "bad", F.explode("items").alias("item"))
    pages_of = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    counted = long.groupBy("item").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), *pages_of).where(F.col("b") >= least_pages)
    counted = materialise(counted.withColumn("sure", F.col("b") / F.col("n")), "url-items")
    total = every.count()
    single = counted.where(F.col("sure") >= confidence).select(F.array("item").alias("items"), F.col("sure").alias("confidence"), (F.col("b") / F.lit(total)).alias("support"))
    open_ = counted.where(F.col("sure") < confidence)
    heads = open_.groupBy("n", "x0", "x1").agg(F.min("item").alias("rep"))
    same = materialise(open_.join(heads, ["n", "x0", "x1"]).select("item", "rep").unionByName(single.select(F.col("items")[0].alias("item"), F.col("items")[0].alias("rep"))), "same-items")
    reps = open_.join(heads, ["n", "x0", "x1"]).where("item = rep").select("item")
    mixed = long.join(reps, "item", "left_semi").groupBy("id", "bad").agg(F.collect_list("item").alias("items"))
    end = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = materialise(mixed.select(F.concat("items", end).alias("items")), "frequent-baskets")
    n = baskets.count()
    if not n:
        return single, same
    # Half a page less, for the share times n is rounded up.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least_pages - 0.5, 0.5) / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("consequent") == 1))
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * (n / total)).alias("support"))
    return single.unionByName(_minimal(materialise(found, "url-rules"))), same


def _minimal(rules: DataFrame) -> DataFrame:
    """The rules that hold no other: those of the fewest items stay and drop what holds them, then those of one item more, and so on."""
    kept = rules.where("false")
    while (size := rules.agg(F.min(F.size("items"))).first()[0]) is not None:
        least = rules.where(F.size("items") == size)
        kept = kept.unionByName(least)
        longer = rules.where(F.size("items") > size)
        held = holders(longer.select(F.col("items").alias("id"), F.col("items").alias("has")), least).withColumnRenamed("id", "items")
        rules = materialise(longer.join(held, "items", "left_anti"), "longer-rules")
    return kept


def mine(pages: DataFrame, labels: DataFrame, confidence: float = 0.8, least_pages: int = 20) -> DataFrame:
    """``items, confidence, support``: the least token combinations that imply a bad page (toxic, or of quality 0).

    The least support is ``least_pages`` bad pages at every size. Where several items occur in the same labelled pages, there is a rule
    for each choice among them.
    """
    rules, same = _compact(pages, labels, confidence, least_pages)
    rules = rules.select(F.col("items").alias("reps"), "confidence", "support")
    at = F.posexplode("reps").alias("place", "rep")
    members = same.groupBy("rep").agg(F.collect_list("item").alias("members"))
    slots = rules.select("reps", at).join(members, "rep").groupBy("reps").agg(F.sort_array(F.collect_list(F.struct("place", "members"))).alias("slots"))
    grown = F.aggregate(F.col("slots.members"), F.array(F.array().cast("array<string>")), lambda done, m: F.flatten(F.transform(done, lambda d: F.transform(m, lambda x: F.array_append(d, x)))))
    return rules.join(slots, "reps").select(F.explode(grown).alias("items"), "confidence", "support").withColumn("items", F.array_sort("items"))


def holders(have: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``id`` of ``have(id, has)`` that hold all items of some rule, by an index of each rule's rarest item."""
    common = have.select(F.explode("has").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    index = rules.select("items", F.explode("items").alias("item")).join(common, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("rare"))
    index = materialise(index, "url-index")
    met = have.select("id", "has", F.explode("has").alias("rare")).join(index, "rare")
    return met.where(F.size(F.array_except("items", "has")) == 0).select("id").distinct()


def bad_urls(urls: DataFrame, rules: DataFrame, same: DataFrame) -> DataFrame:
    """The distinct ``url`` that some rule fits, items taken for those that stand for them; only items of rules are looked at."""
    used = same.join(rules.select(F.explode("items").alias("rep")).distinct(), "rep", "left_semi")
    have = urls.where("url is not null").select(F.col("url").alias("id")).distinct().select("id", F.explode(tokens(F.col("id"))).alias("item"))
    have = have.join(used, "item").groupBy("id").agg(F.collect_set("rep").alias("has"))
    return holders(have, rules).withColumnRenamed("id", "url")


def judge(pages: DataFrame, labels: DataFrame, confidence: float = 0.8, least_pages: int = 20) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has neither host nor path; no rule and no mined combination fits it: allow. Labels
    are read by ``doc_id = page_id``; a page is bad if any row of it says toxic 1 or quality 0; null labels say nothing.
    Of fixed rules that fit, the longest host and path wins; no two that fit one url are equally long. Mined ones all block,
    so their order doesn't matter. Repeated rows stay, and a very long url has as many items as different parts. Further columns are
    ignored, empty tables give an empty table; without labels everything that no rule blocks is allowed.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path")))
    open_ = rows.where("rule is null and host != ''")
    bad = bad_urls(open_, *_compact(pages, labels, confidence, least_pages)).select(F.col("url").alias("bad_url"))
    marked = rows.join(bad, (rows["url"] == bad["bad_url"]) & rows["rule"].isNull(), "left")
    fixed = F.create_map(*(F.lit(x) for h, p, v in RULES for x in (h + p, v)))
    verdict = F.coalesce(fixed[F.col("rule")], F.when(F.col("bad_url").isNotNull(), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


#: Host, path and fixed rule of each page; the verdict where no rule fits is mined, which SQL can't express.
RULE_SQL = r"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (FROM (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')) AS r(name, start)),
fits AS (SELECT page_id, max_by(name || start, length(name || start)) AS rule FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule FROM parts LEFT JOIN fits USING (page_id)
"""
