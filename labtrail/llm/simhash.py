"""SimHash near-duplicates through an inverted index of byte positions, with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most three bits differ in at most three bytes, so at
least five positional bytes are equal: the guaranteed minimum. Posting lists of single bytes would hold 1/256 of all rows
each, so the index is keyed by four positional bytes at once. Positions are numbered 0 to 7 as the points of a cube; the 14
sets of four whose numbers have an exclusive-or of zero are its planes, any three positions lie in one of them, and the
plane opposite is then free of differing bytes: 14 keys for a fingerprint, at every size.

For each pair in a posting list the equal positional bytes are tallied; pairs that reach the minimum are retained and
verified on all bits. A list of more than ``list_rows`` fingerprints is cut by longer keys first: its free bits are dealt in
one part more than bits may differ, so one part of them is equal in every linked pair. Fingerprints are distinct, so a
list with few free bits left is short. A list returns a forest of its links, which grows with its rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.llm.common import discard, materialise, table
from labtrail.llm.components import components
from labtrail.llm.words import Words, blocks, xxh64

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once, and pairs that are compared at once.
SLICE = 1 << 17


def _fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """Signed 64-bit fingerprints; texts are lower-cased UTF-8."""
    words = Words([b" ".join(t.split()) for t in texts])
    count = np.diff(words.first)
    size = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    row = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(row)) + np.repeat(words.first[:-1] - (np.cumsum(size) - size), size)
    last = np.minimum(at + width, words.first[row + 1]) - 1
    ones = np.zeros((len(texts), 64), np.int64)
    for lo in range(0, len(row), SLICE):
        part = slice(lo, lo + SLICE)
        h, own = xxh64(words.joined, words.start[at[part]], words.end[last[part]], 42), row[part]
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64-bit SimHash of a text's shingles as a long; null and blank texts give zero. A very long text is one block of one task, its shingles hashed in slices."""

    @F.pandas_udf(T.LongType())
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(t or "").encode().translate(LOWER) for t in part]
            own = [_fingerprints(texts[a:b], width) for a, b in blocks([len(t) for t in texts])]
            yield pd.Series(np.concatenate(own) if own else [], dtype="int64")

    return simhash(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(max_bits: int) -> list[int]:
    """Sets of positional bytes to index together: one of them at least is equal in every linked pair."""
    if not 0 <= max_bits < 8:
        raise ValueError("max_bits must be from 0 to 7")
    planes = (p for p in combinations(range(8), 4) if reduce(int.__xor__, p) == 0)
    return [_signed(sum(0xFF << 8 * i for i in p)) for p in (planes if max_bits == 3 else combinations(range(8), 8 - max_bits))]


def _longer(mask: int, max_bits: int) -> list[int]:
    """Masks of a list's longer keys."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [_signed(mask % (1 << 64) | sum(1 << int(b) for b in part)) for part in np.array_split(free, max_bits + 1)]


def _forest(max_bits: int):
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of each fingerprint to the least that it is connected with in its list."""
        for part in parts:
            lists = list(part["fps"])
            size = np.array([len(x) for x in lists])
            found = []
            for n in np.unique(size).tolist():
                every = np.stack([lists[i] for i in np.flatnonzero(size == n)])
                step = max(1, SLICE // (n * n))
                for lo in range(0, len(every), step):
                    fp = np.sort(every[lo : lo + step], axis=1)
                    differ = fp[:, :, None] ^ fp[:, None, :]
                    tally = (differ[..., None].view(np.uint8) == 0).sum(-1)
                    linked = (tally >= 8 - max_bits) & (np.bitwise_count(differ.view(np.uint64)) <= max_bits)
                    least, before = np.broadcast_to(np.arange(n), fp.shape), None
                    while before is None or (least != before).any():
                        before = least
                        least = np.where(linked, least[:, None, :], n).min(2)
                        least = np.take_along_axis(least, least, 1)
                    row, at = np.nonzero(least != np.arange(n))
                    found.append(np.stack([fp[row, at], fp[row, least[row, at]]], 1))
            yield pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["x", "y"])

    return compare


def links(prints: DataFrame, max_bits: int = 3, list_rows: int = 1024) -> DataFrame:
    """Links ``(x, y)`` that connect all distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits.

    Every pair within the distance is linked, directly or through a chain of such pairs of its posting list. No list of
    more than ``list_rows`` fingerprints (at least ``2 ** max_bits``) is compared in one place.
    """
    list_rows = max(list_rows, 1 << max_bits)
    spark, masks = prints.sparkSession, _masks(max_bits)
    index = prints.select("fp").distinct().select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found, done = None, None
    while True:
        index = index.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = index.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        postings = materialise(index.join(materialise(sizes, "posting-sizes"), ["mask", "key"]), "postings")
        if done is not None:
            discard(done)
        short = postings.where(F.col("n") <= list_rows).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        forest = materialise(short.mapInPandas(_forest(max_bits), "x long, y long"), "posting-links")
        found = forest if found is None else found.unionByName(forest)
        long = postings.where(F.col("n") > list_rows)
        masks = [r["mask"] for r in long.select("mask").distinct().collect()]  # at most 14 * 4 ** round
        if not masks:
            return found.distinct()
        cut = spark.createDataFrame([(m, _longer(m, max_bits)) for m in masks], "mask long, masks array<long>")
        index = long.select("fp", "mask").join(F.broadcast(cut), "mask").select("fp", F.explode("masks").alias("mask")).distinct()
        done = postings


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``; further columns are ignored.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows stay, with equal results.
    A row without doc_id gets the component of its fingerprint, null if no row there has one. An empty table gives an
    empty table.
    """
    return _grouped(docs.select("doc_id", "text"), width, max_bits).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, th``, one of each group of near-duplicates with a doc_id: the smallest, of its texts the one of the smallest fingerprint; th is a hash of the text."""
    found = _grouped(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), width, max_bits)
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "th")).alias("x"))
    return first.select("x.doc_id", "x.th").distinct()


def _grouped(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    prints = materialise(docs.select(*(c for c in docs.columns if c != "text"), fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes, max_bits), "x", "y")
    # by fingerprint; then the smallest doc_id of each component
    members = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    members = materialise(members, "members")
    smallest = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = materialise(members.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(by_print, "fp")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
