"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector to a few groups of eight dimensions and decodes each group to the nearest point of the
E8 lattice; the points together are the vector's cell. A vector is indexed under its own cell and looks in that and in
the cells that exchange one group's point for one of the nearest neighbouring lattice points. Pairs that meet in any
table, and whose sign sketches are no further apart than those of linked vectors come to be, are verified by their cosine
in double precision. Cells with very many candidate pairs are compared block by block, and give counts and a forest of
their links instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table
from labtrail.llm.components import components
from labtrail.llm.vectors import by_length, classes, cosine, unit
from labtrail.llm.words import mix


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even coordinate sum."""
    point = np.rint(x)
    off = x - point
    row = np.flatnonzero(point.sum(1) % 2 != 0)
    at = np.argmax(np.abs(off[row]), axis=1)
    point[row, at] += np.where(off[row, at] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: integer points of even sum, or these shifted by a half everywhere."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _named(points: np.ndarray, place: int) -> np.ndarray:
    h = np.full(len(points), place, np.uint64)
    for c in (2 * points).astype(np.int64).view(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def cells(x: np.ndarray, tables: int, groups: int, scale: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of each unit vector's own cell in every table, and of the neighbouring cells it probes."""
    draw = np.random.default_rng([seed, x.shape[1]])
    own, near = [], []
    for t in range(tables):
        names, others = [], []
        for g in range(groups):
            axes = np.linalg.qr(draw.normal(size=(max(8, x.shape[1]), 8)))[0][: x.shape[1]]
            y = x @ axes * (scale * np.sqrt(x.shape[1] / 64))
            point = nearest_e8(y)
            best = np.argpartition(-((y - point) @ ROOTS.T), probes, axis=1)[:, :probes]
            names.append(_named(point, t * groups + g))
            others.append([_named(point + ROOTS[best[:, k]], t * groups + g) for k in range(probes)])
        whole = np.bitwise_xor.reduce(names)
        own.append(whole)
        near += [whole ^ names[g] ^ o for g in range(groups) for o in others[g]]
    return np.stack(own, 1).view(np.int64), np.stack(near, 1).view(np.int64)


#: Sign bits of random projections that go with each index entry.
SKETCH = 128


def sketch(x: np.ndarray, seed: int) -> np.ndarray:
    """SKETCH sign bits of each unit vector as longs."""
    axes = np.random.default_rng([seed, x.shape[1], 1]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ axes > 0, axis=1).view(np.int64)


def sketch_limit(least: float) -> int:
    """Differing sign bits that two vectors of cosine ``least`` stay within: the mean and five standard deviations."""
    p = float(np.arccos(min(1.0, least)) / np.pi)
    return int(np.ceil(SKETCH * p + 5 * np.sqrt(SKETCH * p * (1 - p))))


def _meets(own: np.ndarray, look: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether one of the vectors i and j, row by row, looks in the other's cell of a table."""
    return (own[i, table, None] == look[j, table]).any(1) | (own[j, table, None] == look[i, table]).any(1)


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each node's least known relative) after the links i to j."""
    while True:
        while (root[root] != root).any():
            root = root[root]
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _compare(least: float, tables: int, near: int):
    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of a hot cell: for each vector how many it has, counted in the first cell where a pair meets, and a relative."""
        cell, out = key[0], []
        for rows, raw in by_length(list(part["vec"])).values():
            some = part.iloc[rows]
            x, rep, copies, block = unit(raw), some["rep"].to_numpy(), some["copies"].to_numpy(), some["block"].to_numpy()
            table, owner = int(some["table"].iat[0]), some["owner"].to_numpy()
            marks = np.zeros((len(some), tables * (1 + near)), np.int64)  # 0: not a hot cell
            marks[np.repeat(np.arange(len(some)), some["ats"].map(len)), np.concatenate(list(some["ats"]))] = np.concatenate(list(some["hot"]))
            own = marks[:, :tables]
            look = np.concatenate([own[:, :, None], marks[:, tables:].reshape(len(some), tables, near)], 2)
            look = np.where(look == 0, 1, look)
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            root, others = np.arange(len(some)), np.zeros(len(some), np.int64)
            for lo in range(0, len(left), 128):
                mine = left[lo : lo + 128]
                cosines = x[mine] @ x[right].T
                i, j = np.nonzero(cosines >= least - 1e-9)
                close = cosines[i, j]
                i, j = mine[i], right[j]
                keep = (owner[i] | owner[j]) & ((i < j) | (key[1] != key[2]))
                i, j, close = i[keep], j[keep], close[keep]
                edge = np.flatnonzero(close < least + 1e-9)
                keep = np.ones(len(i), bool)
                keep[edge] = cosine(raw[i[edge]], raw[j[edge]]) >= least
                i, j = i[keep], j[keep]
                root = _roots(root, i, j)
                for earlier in range(table):
                    new = ~_meets(own, look, i, j, earlier)
                    i, j = i[new], j[new]
                a, b = own[i, table], own[j, table]
                there = np.where((b[:, None] == look[i, table]).any(1), b, cell)
                here = np.where((a[:, None] == look[j, table]).any(1), a, cell)
                first = np.minimum(there, here) == cell
                i, j = i[first], j[first]
                np.add.at(others, i, copies[j])
                np.add.at(others, j, copies[i])
            has = np.flatnonzero((others > 0) | (root != np.arange(len(root))))
            out.append(pd.DataFrame({"a": rep[has], "b": rep[root[has]], "n": others[has]}))
        return pd.concat(out)

    return compare


def _hot_links(own: DataFrame, looks: DataFrame, hot: DataFrame, least: float, tables: int, near: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b, n)`` of the hot cells, block by block, and ``(rep, owned, looked)``: the hot cells of each vector."""
    members = looks.join(F.broadcast(hot), "cell") if hot.count() <= 100_000 else looks.join(hot, "cell")
    members = materialise(members.select("cell", "rep", "at"), "hot-members")
    marks = members.groupBy("rep").agg(F.collect_list(F.struct("at", "cell")).alias("m"))
    owned = F.transform(F.filter("m", lambda x: x["at"] < tables), lambda x: x["cell"])
    marks = materialise(marks.select("rep", owned.alias("owned"), F.col("m.at").alias("ats"), F.col("m.cell").alias("hot")), "hot-marks")
    members = members.join(members.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    table = F.when(F.col("at") < tables, F.col("at")).otherwise(((F.col("at") - tables) / near).cast("int"))
    rows = members.select("cell", "rep", table.alias("table"), (F.col("at") < tables).alias("owner"), parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("block"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.struct(F.least(b, "block").alias("p"), F.greatest(b, "block").alias("q")))
    rows = rows.withColumn("pair", F.explode(pair)).select("cell", "pair.p", "pair.q", "rep", "table", "owner", "block")
    rows = rows.join(own.join(marks.select("rep", "ats", "hot"), "rep"), "rep")
    return rows.groupBy("cell", "p", "q").applyInPandas(_compare(least, tables, near), "a long, b long, n long"), marks.select("rep", "owned", F.col("hot").alias("looked"))


def links(own: DataFrame, least: float = 0.9, tables: int = 16, groups: int = 3, scale: float = 3.0, probes: int = 2, seed: int = 11, hot_rows: int = 64, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Links of distinct vectors ``(rep, copies, vec)`` whose cosine is at least ``least``, as far as the tables find them.

    First ``(a, b)`` of the pairs that meet in cells of up to ``hot_rows`` own vectors and in none of more. The hot cells'
    pairs don't come one by one: they are verified in blocks of up to ``block_rows`` vectors, which give second
    ``(a, b, n)``: n more links of a (those to copies counted each), b a vector that a is connected with.
    """

    def name(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, x in by_length(list(part["vec"])).values():
                for i in range(0, len(rows), 2048):
                    mine, near = cells(unit(x[i : i + 2048]), tables, groups, scale, probes, seed)
                    bits = sketch(unit(x[i : i + 2048]), seed)
                    yield pd.DataFrame({"rep": part["rep"].to_numpy()[rows[i : i + 2048]], "s": bits[:, 0], "t": bits[:, 1], "cells": list(np.concatenate([mine, near], 1))})

    named = materialise(own.select("rep", "vec").mapInPandas(name, "rep long, s long, t long, cells array<long>"), "cells")
    looks = named.select("rep", "s", "t", F.posexplode("cells").alias("at", "cell"))
    mine = named.select(F.explode(F.slice("cells", 1, tables)).alias("cell"))
    hot = materialise(mine.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("cell"), "hot-cells")
    some_hot = not hot.isEmpty()

    index = looks.where(F.col("at") < tables).select(F.col("rep").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta"), "cell")
    if some_hot:
        index = index.join(hot, "cell", "left_anti")
    look = looks.select(F.col("rep").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb"), "cell")
    differ = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ta").bitwiseXOR(F.col("tb")))
    met = index.join(look, "cell").where("a != b").where(differ <= sketch_limit(least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    counted = own.sparkSession.createDataFrame([], "a long, b long, n long")
    if some_hot:
        counted, marks = _hot_links(own, looks, hot, least, tables, groups * probes, block_rows)
        met = met.join(marks.toDF("a", "oa", "la"), "a", "left").join(marks.toDF("b", "ob", "lb"), "b", "left")
        also_hot = F.arrays_overlap("oa", "lb") | F.arrays_overlap("ob", "la")
        met = met.where(~F.coalesce(also_hot, F.lit(False))).select("a", "b")
    met = materialise(met, "met")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            same = part[part["va"].map(len) == part["vb"].map(len)]
            for rows, x in by_length(list(same["va"])).values():
                y = np.stack([same["vb"].iat[i] for i in rows])
                yield same[["a", "b"]].iloc[rows[cosine(x, y) >= least]]

    one = own.select(F.col("rep").alias("a"), F.col("vec").alias("va"))
    two = own.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))
    return met.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInPandas(verify, "a long, b long"), counted


def near_duplicates(vectors: DataFrame, least: float = 0.9, **options: float) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``; further columns are ignored.

    Equal vectors are one class, linked within (cosine 1) and compared once. Vectors that are null, empty, zero or hold null
    or non-finite components, and vectors of different lengths, link with nothing; a row without vec_id neither, and it
    isn't kept. Repeated rows stay, each counting as a vector. An empty table gives an empty table. A cell of n different vectors
    beyond ``hot_rows`` is compared in blocks of ``block_rows``: (n / block_rows) squared block products and n / block_rows copies of each of its vectors.
    """
    own, members = classes(vectors)
    found, counted = links(own, least, **options)
    found, counted = materialise(found, "verified"), materialise(counted, "hot-links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = own.select("rep", "copies")
    count = both.join(copies.withColumnRenamed("rep", "b"), "b").select("a", F.col("copies").alias("n")).unionByName(counted.select("a", "n"))
    count = count.groupBy("a").agg(F.sum("n").alias("others"))
    root = components(found.unionByName(counted.select("a", "b")))
    info = copies.join(count, copies["rep"] == count["a"], "left").join(root, copies["rep"] == root["node"], "left")
    info = info.select("rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    info = materialise(members.join(info, "rep").select("vec_id", "n_links", "component_id").distinct(), "vector-links")
    out = vectors.select("vec_id").join(info, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
