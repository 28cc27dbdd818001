"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Shards hold at most about ``shard_rows`` distinct vectors, dealt by a hash. Each becomes one graph: levels of geometrically
fewer nodes, on each a node's diverse near neighbours (a candidate is taken if it is nearer to the node than to those
taken before) and the nearest nodes that chose it, kept as flat arrays of neighbour numbers, ``width`` for each node and
-1 for none. Nodes are numbered from the highest down, so a level is a prefix. The nodes of a level are compared with each other in blocks, at
every size. A search goes down greedily from the top and keeps a
beam on the lowest level, all queries of a block in step. Queries stream past each shard's graph, each shard gives its best
classes, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table
from labtrail.llm.vectors import classes, cosine, unit

GRAPH = "shard int, dims int, reps array<long>, vectors binary, sizes array<int>, near binary"
#: Distinct vectors of a shard, about: so many are compared with each other.
SHARD_ROWS = 1 << 14
BATCH = 1024


def _diverse(x: np.ndarray, best: np.ndarray, to: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (numbers and cosines, nearest first, -inf for none); those passed over fill what is left."""
    between = x[best] @ x[best].transpose(0, 2, 1)
    taken = np.zeros(best.shape, bool)
    for j in range(best.shape[1]):
        shut = (taken[:, :j] & (between[:, j, :j] > to[:, j, None])).any(1)
        taken[:, j] = ~shut & (to[:, j] > -np.inf) & (taken[:, :j].sum(1) < degree)
    rank = np.argsort(~taken, axis=1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(to, rank, 1) > -np.inf, np.take_along_axis(best, rank, 1), -1)


def _nearest_first(best: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-to, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(best, order, 1), np.take_along_axis(to, order, 1)


class _Level:
    """A level under construction: ``degree`` chosen neighbours of each node, and as many as fit of those that chose it."""

    def __init__(self, x: np.ndarray, rows: int, degree: int, width: int):
        self.x, self.degree = x, degree
        self.near = np.full((rows, width), -1, np.int32)
        self.back = np.full((rows, width - degree), -np.inf, np.float32)

    def add(self, own: np.ndarray, best: np.ndarray, to: np.ndarray) -> None:
        """Link the nodes ``own`` to their candidates, and these back."""
        chosen = np.concatenate([_diverse(self.x, best[i : i + 256], to[i : i + 256], self.degree) for i in range(0, len(own), 256)])
        self.near[own, : chosen.shape[1]] = chosen
        twice = (self.near[own, self.degree :, None] == chosen[:, None, :]).any(2)
        self.near[own, self.degree :] = np.where(twice, -1, self.near[own, self.degree :])
        self.back[own] = np.where(twice, -np.inf, self.back[own])
        row, col = np.nonzero(chosen >= 0)
        at, by = chosen[row, col], own[row]
        new = ~(self.near[at, : self.degree] == by[:, None]).any(1)
        at, by = at[new], by[new]
        score = np.einsum("nd,nd->n", self.x[at], self.x[by])
        order = np.lexsort((-score, at))
        at, by, score = at[order], by[order], score[order]
        node, head = np.unique(at, return_index=True)
        place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        fits = place < self.back.shape[1]
        slot = np.repeat(np.arange(len(node)), np.diff(np.append(head, len(at))))[fits], place[fits]
        number, value = np.full((len(node), self.back.shape[1]), -1, np.int32), np.full((len(node), self.back.shape[1]), -np.inf, np.float32)
        number[slot], value[slot] = by[fits], score[fits]
        number, value = np.concatenate([self.near[node, self.degree :], number], 1), np.concatenate([self.back[node], value], 1)
        self.near[node, self.degree :], self.back[node] = _nearest_first(number, value, self.back.shape[1])


def build(vectors: np.ndarray, degree: int = 16, candidates: int = 64, seed: int = 3, compared: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order in which the vectors are numbered, and the neighbour table of each level, the lowest with all nodes first.

    All nodes of a level are compared with each other; with ``compared``, only so many of the first, and the others are inserted.
    """
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / np.log(degree)).astype(int)
    order = np.argsort(-height, kind="stable")
    x = unit(vectors[order]).astype(np.float32)
    levels: list[np.ndarray] = []
    for high in range(int(height.max(initial=0)), -1, -1):
        rows = int((height >= high).sum())
        wide = degree * 2 if high == 0 else degree
        level = _Level(x, rows, wide, wide + degree)
        start = rows if compared is None else min(rows, max(compared, len(levels[0]) if levels else 0))
        for lo in range(0, start if start > 1 else 0, 256):
            own = np.arange(lo, min(lo + 256, start))
            near = x[own] @ x[:start].T
            near[np.arange(len(own)), own] = -np.inf
            k = min(candidates, start - 1)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            level.add(own, *_nearest_first(best, np.take_along_axis(near, best, 1), k))
        for lo in range(start, rows, BATCH):
            own = np.arange(lo, min(lo + BATCH, rows))
            best, to = search(x, [level.near, *levels], x[own], candidates)
            with_each = x[own] @ x[own].T
            with_each[np.arange(len(own)), np.arange(len(own))] = -np.inf
            k = min(degree, len(own) - 1)
            if k:
                here = np.argpartition(-with_each, k - 1, axis=1)[:, :k]
                best, to = np.concatenate([best, own[here]], 1), np.concatenate([to, np.take_along_axis(with_each, here, 1)], 1)
            level.add(own, *_nearest_first(best, to, candidates))
        levels.insert(0, level.near)
    return order, levels


def search(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and cosines of up to ``beam`` near vectors of each query, nearest first, -1 and -inf for none; x and queries are of unit length."""
    q = len(queries)
    rows = np.arange(q)
    at = np.zeros(q, np.int64)
    for near in levels[:0:-1]:
        here = (queries * x[at]).sum(1)
        while True:
            around = near[at]
            score = np.where(around >= 0, np.einsum("qd,qwd->qw", queries, x[around]), -np.inf)
            best = score.argmax(1)
            better = score[rows, best] > here
            if not better.any():
                break
            at = np.where(better, around[rows, best], at)
            here = np.where(better, score[rows, best], here)
    near = levels[0]
    seen = np.zeros((q, len(near)), bool)
    seen[rows, at] = True
    number = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, np.float32)
    number[:, 0], score[:, 0] = at, (queries * x[at]).sum(1)
    open_ = np.zeros((q, beam), bool)
    open_[:, 0] = True
    live = rows
    while len(live):
        first = np.where(open_[live], score[live], -np.inf).argmax(1)
        open_[live, first] = False
        around = near[number[live, first]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        r, c = np.nonzero(fresh)
        seen[live[r], around[r, c]] = True
        new = np.full(around.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", queries[live[r]], x[around[r, c]])
        all_score = np.concatenate([score[live], new], axis=1)
        all_number = np.concatenate([number[live], around], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        order = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[live], number[live], open_[live] = (np.take_along_axis(v, order, 1) for v in (all_score, all_number, all_open))
        live = live[open_[live].any(1)]
    number, score = _nearest_first(number, score, beam)
    return np.where(score > -np.inf, number, -1), score


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = 1 << 17, beam: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of ``vectors(vec_id, embedding)`` by cosine, for each row of ``queries(vec_id)``.

    A query is a row of vectors, which is no candidate for itself. Ties go to the smaller vec_id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, rows without vec_id neither; a query among them has no
    rows. Equal vectors are one node of a graph, and their rows come from the class. Vectors of different lengths aren't
    compared. A vec_id that occurs twice counts once. Fewer than ``k`` candidates all come. Further columns are ignored; an
    empty table gives an empty table. Shards, and so results, depend on the rows alone, not on the cluster. A graph is copied
    once for each ``block_rows`` queries, a query once for each shard.
    """
    own, members = classes(vectors)
    members = materialise(members.distinct(), "members")
    asked = materialise(members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id"), "asked")
    rows = own.count()
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-asked.select("rep").distinct().count() // block_rows))
    keep = k + 1

    def graph(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        x = np.stack(list(part["vec"]))
        order, levels = build(x)
        sizes = [v for near in levels for v in near.shape]
        near = np.concatenate([near.ravel() for near in levels]).astype(np.int32)
        return pd.DataFrame([(key[0], key[1], part["rep"].to_numpy()[order], x[order].tobytes(), sizes, near.tobytes())], columns=["shard", "dims", "reps", "vectors", "sizes", "near"])

    placed = own.select("rep", "vec", F.size("vec").alias("dims"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    graphs = materialise(placed.groupBy("shard", "dims").applyInPandas(graph, GRAPH), "graphs")
    key = ["shard", "dims", "block"]

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by key, each key's graph before its queries."""
        held = None
        for part in parts:
            starts = np.flatnonzero(part["rep"].isna())
            for a, b in zip([0, *starts], [*starts, len(part)], strict=True):
                if a == b:
                    continue
                if pd.isna(part["rep"].iat[a]):
                    g = part.iloc[a]
                    near, tables, done = np.frombuffer(g["near"], np.int32), [], 0
                    for n, width in np.asarray(g["sizes"]).reshape(-1, 2).tolist():
                        tables.append(near[done : done + n * width].reshape(n, width))
                        done += n * width
                    raw = np.frombuffer(g["vectors"]).reshape(len(g["reps"]), -1)
                    held, reps, x = tuple(g[key]), np.asarray(g["reps"]), unit(raw).astype(np.float32)
                    a += 1
                rest = part.iloc[a:b]
                rest = rest[(rest[key] == held).all(axis=1)] if held and len(rest) else rest.iloc[:0]
                for lo in range(0, len(rest), 512):
                    asking = np.stack(list(rest["vec"].iloc[lo : lo + 512]))
                    number, _ = search(x, tables, unit(asking).astype(np.float32), max(beam, keep))
                    row, col = np.nonzero(number >= 0)
                    hit = number[row, col]
                    out = pd.DataFrame({"query": rest["rep"].to_numpy(np.int64)[lo + row], "rep": reps[hit], "score": cosine(asking[row], raw[hit])})
                    yield out.sort_values(["query", "score", "rep"], ascending=[True, False, True]).groupby("query").head(keep)

    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = own.join(asked.select("rep").distinct(), "rep").select("rep", "vec", F.size("vec").alias("dims"), F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows_of = left.unionByName(right, allowMissingColumns=True).repartition(shards * blocks, *key).sortWithinPartitions(*key, F.asc_nulls_first("rep"))
    found = rows_of.mapInPandas(ask, "query long, rep long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = materialise(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n"), "found")

    few = W.partitionBy("rep").orderBy("vec_id")
    few = materialise(members.withColumn("n", F.row_number().over(few)).where(F.col("n") <= keep).drop("n"), "class-heads")
    hits = asked.withColumnRenamed("rep", "query").join(found, "query").join(few, "rep").where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
