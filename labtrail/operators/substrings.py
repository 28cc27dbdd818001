"""Which strings hold which others, by an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(text: str) -> Column:
    """The distinct substrings of up to three characters, the empty one too."""
    of = lambda n: F.expr(f"transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), i -> substring({text}, i, {n}))")
    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(SIZE)))


def holding(needles: DataFrame, whole: DataFrame) -> DataFrame:
    """The distinct pairs ``needle, whole`` of ``needles(needle)`` and ``whole(whole)`` where whole contains needle.

    A needle is looked up by the one of its trigrams that the fewest strings hold, and by itself if it is shorter than
    three characters; strings found by a trigram are verified. A needle with a trigram that no string holds is in none. Null strings
    hold nothing and are in nothing; the empty string is in every string.
    """
    n = needles.where("needle is not null").select("needle").distinct()
    w = whole.where("whole is not null").select("whole").distinct().select("whole", F.explode(_grams("whole")).alias("gram"))
    own = F.when(F.length("needle") < SIZE, F.array("needle")).otherwise(F.expr(f"array_distinct(transform(sequence(1, greatest(length(needle) - {SIZE - 1}, 1)), i -> substring(needle, i, {SIZE})))"))
    keys = n.select("needle", F.size(own).alias("size"), F.explode(own).alias("gram"))
    used = w.join(keys.select("gram").distinct(), "gram", "left_semi")
    held = used.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(held, "gram").groupBy("needle", "size").agg(F.count("*").alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("known = size")
    return used.join(rarest.select("needle", "gram"), "gram").where(F.col("whole").contains(F.col("needle"))).select("needle", "whole")
