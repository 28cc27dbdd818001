"""Hard-negative mining over a multiway hyperplane tree with distance ranges.

A node of the tree has a few split points; a vector belongs to the nearest of them, and so on down to a leaf. For each pair of a
node's split points (i, j) the tree stores the range of distances from i to all vectors below j. Vectors are raised to one
length by one more component, so that an inner product with an anchor is a distance from it, and a window of scores is an annulus
around it. On the way down an annulus drops every subtree j that lies, seen from any split point i, nearer or farther than the
annulus reaches. The vectors of the leaves that are left are compared exactly, in blocks.

The split points come from a bounded sample; every vector is placed, and ranges are taken over all of them. Each search looks into
the anchor's own leaf first: what it finds there narrows the window with which the tree is then searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import discard, materialise, table

#: Vectors that the split points are chosen from: about so many, whatever the size of the table; fewer if they have more than
#: ``SAMPLE_DIMS`` components, so that sample and tree hold at most about 8 million numbers.
SAMPLE = 1 << 15
SAMPLE_DIMS = 1 << 8
#: Vectors of a leaf that are compared at once, and questions that one copy of them serves.
LEAF_ROWS = 1 << 12
QUESTIONS = 1 << 10
DEGREE = 8
#: A subtree is dropped only if it lies outside by more than this share of the lengths: distances are rounded.
SLACK = 1e-6


class Tree:
    """Split points of the vectors of one length, chosen from a sample; ``first`` numbers its leaves among those of all trees."""

    def __init__(self, sample: np.ndarray, share: float, longest: float, first: int, leaf_rows: int, degree: int):
        self.longest, self.first, self.leaves = longest, first, 0
        self.splits: list[np.ndarray] = []
        self.below: list[list[int]] = []
        draw = np.random.default_rng(5)
        self.root = self._grow(self.raised(sample), share, leaf_rows, degree, draw)
        self.near = [np.full((len(s), len(s)), np.inf) for s in self.splits]
        self.far = [np.full((len(s), len(s)), -np.inf) for s in self.splits]

    def raised(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, share: float, leaf_rows: int, degree: int, draw: np.random.Generator) -> int:
        """The number of a node, or a negative one of a leaf."""
        if len(x) <= max(leaf_rows * share, 2 * degree):
            return self._leaf()
        some = x[draw.permutation(len(x))[: 3 * degree]]
        chosen = [0]
        away = distances(some, some)
        while len(chosen) < degree:  # far from those chosen before
            least = away[chosen].min(0)
            if not least.max() > 0:
                break
            chosen.append(int(least.argmax()))
        if len(chosen) < 2:
            return self._leaf()
        node = len(self.splits)
        self.splits.append(some[chosen])
        self.below.append([])
        own = distances(x, some[chosen]).argmin(1)
        if (own == own[0]).all():
            self.splits.pop()
            self.below.pop()
            return self._leaf()
        self.below[node] = [self._grow(x[own == j], share, leaf_rows, degree, draw) for j in range(len(chosen))]
        return node

    def place(self, x: np.ndarray, seen: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """The leaf of each vector; ``seen`` takes the least and largest distances of each pair of split points met on the way."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        x = self.raised(x)
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = self.first - node - 1
                continue
            away = distances(x[rows], self.splits[node])
            own = away.argmin(1)
            for j, child in enumerate(self.below[node]):
                if not len(part := np.flatnonzero(own == j)):
                    continue
                todo.append((child, rows[part]))
                if seen is not None:
                    m = len(self.splits[node])
                    low, high = seen.setdefault(node, (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
                    low[:, j] = np.minimum(low[:, j], away[part].min(0))
                    high[:, j] = np.maximum(high[:, j], away[part].max(0))
        return leaf

    def search(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Questions and leaves that may hold vectors whose inner product with the question's lies in its window."""
        size = (x * x).sum(1)
        outer = np.sqrt(np.maximum(size + self.longest - 2 * low, 0))
        inner = np.sqrt(np.maximum(size + self.longest - 2 * high, 0))
        raised = np.concatenate([x, np.zeros((len(x), 1))], 1)
        slack = SLACK * (np.sqrt(size) + np.sqrt(self.longest) + 1)
        found, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                found.append((rows, np.full(len(rows), self.first - node - 1)))
                continue
            away = distances(raised[rows], self.splits[node])
            least = np.maximum(away - outer[rows, None], inner[rows, None] - away) - slack[rows, None]
            most = away + outer[rows, None] + slack[rows, None]
            out = (self.far[node][None] < least[:, :, None]) | (self.near[node][None] > most[:, :, None])
            for j, child in enumerate(self.below[node]):
                if len(live := rows[~out[:, :, j].any(1)]):
                    todo.append((child, live))
        return np.concatenate([r for r, _ in found] or [np.zeros(0, int)]), np.concatenate([n for _, n in found] or [np.zeros(0, int)])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def _by_length(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for dims, rows in part.groupby("dims").indices.items():
        yield int(dims), rows, np.array([part["vec"].iat[r] for r in rows], np.float64).reshape(len(rows), -1)


class _Index:
    """Trees, placed rows and their blocks. ``rows(vec_id, label, vec, dims)`` are usable and have distinct ids."""

    def __init__(self, rows: DataFrame, sample: int, leaf_rows: int, degree: int):
        self.spark = rows.sparkSession
        self.temporary: list[DataFrame] = []
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        lengths = {r["dims"]: r for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()}
        total = sum(r["n"] for r in lengths.values())
        numbers = sum(r["n"] * r["dims"] for r in lengths.values())
        share = min(1.0, sample / max(total, 1), sample * SAMPLE_DIMS / max(numbers, 1))
        drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vec_id", "dims", "vec").toPandas().sort_values("vec_id")
        vectors = {d: x for d, _, x in _by_length(drawn)} if len(drawn) else {}
        trees: dict[int, Tree] = {}
        first = 0
        for dims, r in sorted(lengths.items()):
            trees[dims] = Tree(vectors.get(dims, np.zeros((0, dims))), share, float(r["longest"]), first, leaf_rows, degree)
            first += trees[dims].leaves
        fixed = self.spark.sparkContext.broadcast(trees)

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                leaf = np.zeros(len(part), np.int64)
                for dims, at, x in _by_length(part):
                    leaf[at] = fixed.value[dims].place(x)
                yield part.assign(leaf=leaf)

        def ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[int, dict] = {}
            for part in parts:
                for dims, _, x in _by_length(part):
                    fixed.value[dims].place(x, seen.setdefault(dims, {}))
            for dims, nodes in seen.items():
                for node, (low, high) in nodes.items():
                    i, j = np.nonzero(high >= low)
                    yield pd.DataFrame({"dims": dims, "node": node, "i": i, "j": j, "low": low[i, j], "high": high[i, j]})

        self.placed = self._keep(rows.mapInPandas(place, "vec_id long, label long, vec array<double>, dims int, leaf long"), "placed")
        # One row for each pair of split points: the trees are bounded by the sample, whatever the table's size.
        spread = self.placed.mapInPandas(ranges, "dims int, node int, i int, j int, low double, high double")
        for r in spread.groupBy("dims", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            trees[r["dims"]].near[r["node"]][r["i"], r["j"]] = r["low"]
            trees[r["dims"]].far[r["node"]][r["i"], r["j"]] = r["high"]
        self.trees = self.spark.sparkContext.broadcast(trees)
        self.parts = {r["leaf"]: -(-r["count"] // leaf_rows) for r in self.placed.groupBy("leaf").count().collect()}
        of = self.spark.createDataFrame(sorted(self.parts.items()), "leaf long, parts long")
        split = self.placed.join(F.broadcast(of), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        self.blocks = self._keep(split.groupBy("leaf", "block").applyInPandas(_pack, "leaf long, block long, ids array<long>, labels array<long>, vectors binary"), "blocks")

    def _keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.temporary.append(out := materialise(df, tag))
        return out

    def leaves(self, questions: DataFrame) -> DataFrame:
        """A row for each leaf that a question's window reaches."""
        trees = self.trees

        def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for lo in range(0, len(part), 1024):
                    some = part.iloc[lo : lo + 1024]
                    for dims, at, x in _by_length(some):
                        q, leaf = trees.value[dims].search(x, some["low"].to_numpy()[at], some["high"].to_numpy()[at])
                        yield some.iloc[at[q]].assign(leaf=leaf)

        return questions.mapInPandas(route, questions.schema)

    def best(self, asked: DataFrame, k: int) -> DataFrame:
        """``anchor_id, slot, rank, vec_id, score``: the first ``k`` rows in each question's window, from the leaves it names."""
        asked = materialise(asked, "asked")
        copies = [(r["leaf"], self.parts[r["leaf"]], -(-r["count"] // QUESTIONS)) for r in asked.groupBy("leaf").count().collect()]
        plan = lambda: F.broadcast(self.spark.createDataFrame(copies, "leaf long, parts long, chunks long"))
        here = asked.join(plan(), "leaf").withColumn("chunk", F.pmod(F.xxhash64("anchor_id", "slot"), F.col("chunks"))).withColumn("block", F.explode(F.expr("sequence(0L, parts - 1)")))
        there = self.blocks.join(plan(), "leaf").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        key = ["leaf", "block", "chunk"]

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"anchor_id": [], "slot": [], "vec_id": [], "score": []})
            b = right.iloc[0]
            ids, labels = np.asarray(b["ids"], np.int64), np.asarray(b["labels"], np.int64)
            x = np.array(list(left["vec"]), np.float64).reshape(len(left), -1)
            score = x @ np.frombuffer(b["vectors"]).reshape(len(ids), -1).T
            like = labels[None] == left["label"].to_numpy()[:, None]
            fits = (like == left["same"].to_numpy()[:, None]) & (ids[None] != left["anchor_id"].to_numpy()[:, None])
            fits &= (score >= left["low"].to_numpy()[:, None]) & (score <= left["high"].to_numpy()[:, None])
            score = np.where(fits, score, -np.inf)
            if len(ids) > k:
                fits &= score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
            row, col = np.nonzero(fits)
            out = pd.DataFrame({"anchor_id": left["anchor_id"].to_numpy()[row], "slot": left["slot"].to_numpy()[row], "vec_id": ids[col], "score": score[row, col]})
            return out.sort_values(["anchor_id", "slot", "score", "vec_id"], ascending=[True, True, False, True]).groupby(["anchor_id", "slot"]).head(k)

        found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(compare, "anchor_id long, slot int, vec_id long, score double")
        first = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        out = self._keep(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "found")
        discard(asked)
        return out

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """The first ``k`` rows in each question's window: those of its own leaf narrow the window first."""
        own = self.best(questions, k)
        bound = own.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("bound"))
        narrow = questions.join(bound, ["anchor_id", "slot"], "left").withColumn("low", F.greatest("low", "bound")).select(questions.columns)
        return self.best(self.leaves(narrow), k)


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("vec_id")
    data = np.array(list(part["vec"]), np.float64).tobytes()
    return pd.DataFrame([(part["leaf"].iat[0], part["block"].iat[0], part["vec_id"].to_numpy(), part["label"].to_numpy(), data)], columns=["leaf", "block", "ids", "labels", "vectors"])


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, degree: int = DEGREE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors ``(vec_id)`` among ``vectors(vec_id, label, vec)``.

    ``vec`` holds whole numbers as doubles; a score is the inner product, exact up to 2**53 and that of double arithmetic beyond. The
    positives are the first ``positives`` other rows of the anchor's label by score, ties by smaller vec_id. The negatives are the first
    ``negatives`` rows of another label whose score is at most the positive's and at least ``percent`` hundredths of it.

    Rows without vec_id or label and vectors that are null or hold null or non-finite components take no part, an anchor among them
    has no rows. Vectors of different lengths aren't compared. A vec_id on several rows counts once, with the least label and vector.
    Equal vectors are rows of their own. Fewer positives or negatives all come. Further columns are ignored; an empty table gives an
    empty table. A leaf that holds many rows is compared in blocks of about ``leaf_rows``.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and vec is not null").where(finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "vec")).alias("r")).select("vec_id", "r.*", F.size("r.vec").alias("dims"))
    rows = materialise(rows, "usable")
    index = _Index(rows, sample, leaf_rows, degree)
    anchor = index.placed.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "anchor_id")
    columns = ["anchor_id", "slot", "label", "vec", "dims", "low", "high", "same", "leaf"]
    ask = anchor.select("*", F.lit(0).alias("slot"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(True).alias("same"))
    near = index.search(ask.select(columns), positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high"))
    least = F.ceil(F.col("high") * percent / 100).cast("double")
    windows = anchor.join(near, "anchor_id").withColumn("low", least).withColumn("same", F.lit(False)).where("low <= high")
    found = index.search(windows.select(columns), negatives)
    out = found.join(near, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("high").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score")
    )
    out = materialise(out, "negatives")
    discard(rows, *index.temporary)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vec")), rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
