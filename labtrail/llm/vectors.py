"""Embedding vectors as classes of equal ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import materialise


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rep, copies, vec)`` of each distinct usable vector, rep its smallest vec_id, and ``(vec_id, rep)`` of the rows.

    Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite components, are in neither.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(finite).where(some)
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.reverse("embedding"), F.size("embedding")).alias("h2")]
    rows = rows.select("vec_id", *key, F.col("embedding").cast("array<double>").alias("vec"))
    own = materialise(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    members = materialise(rows.select("vec_id", "h1", "h2").join(own.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep"), "vector-members")
    return own.select("rep", "copies", "vec"), members


def by_length(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    size = np.array([len(v) for v in vectors])
    return {int(n): (i := np.flatnonzero(size == n), np.stack([vectors[k] for k in i]).astype(np.float64)) for n in np.unique(size)}


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x and of y, in double precision; rows are scaled by powers of two first, so that no product overflows."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
