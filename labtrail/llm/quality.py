"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space.

Terms are hashed words and word shapes (end and start bytes, case, length, repetition of the word before). A bounded
sample of labelled texts (``sample`` rows, half of either label where there are so many) gives term weights and the
leading singular directions of its term matrix; the sample's vectors in that space, at most ``sample`` x ``dims``
numbers, are broadcast. Each text's vector is multiplied with all of them in blocks, and the ``neighbours`` of largest
cosine, and those as near as the last of them, vote with the fourth power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.llm.common import table
from labtrail.llm.words import Words, blocks, mix

TERMS = 1024
WORD_TERMS = 512
THRESHOLD = 0.3


def _terms(texts: list[bytes]) -> np.ndarray:
    """Square roots of the term shares of each text."""
    words = Words(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(words.first))
    if not len(row):
        return np.zeros((n, TERMS), np.float32)
    h = words.hashes(3)
    size = words.end - words.start
    head, tail = words.buf[words.start].astype(np.int64), words.buf[words.end - 1].astype(np.int64)
    upper = (words.buf >= 65) & (words.buf <= 90)
    uppers = np.concatenate([[0], np.cumsum(upper)])
    loud = (uppers[words.end] - uppers[words.start]) * 2 > size
    double = (size > 1) & (words.buf[np.maximum(words.end - 2, 0)] == words.buf[words.end - 1]) & (tail < 65)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    letter = ((tail | 32) >= 97) & ((tail | 32) <= 122) | (tail >= 128)
    start = np.where(head >= 128, 0, np.where((head >= 65) & (head <= 90), 1, np.where((head >= 97) & (head <= 122), 2, head)))
    shape = np.where(letter, 0, tail) + 256 * (start + 256 * (np.minimum(size, 9) // 3 + 4 * (loud + 2 * double + 4 * again)))
    shape = WORD_TERMS + (mix(shape.astype(np.uint64)) >> np.uint64(16)).astype(np.int64) % (TERMS - WORD_TERMS)
    word = (h >> np.uint64(16)).astype(np.int64) % WORD_TERMS
    count = np.bincount(np.concatenate([row * TERMS + word, row * TERMS + shape]), minlength=n * TERMS).reshape(n, TERMS)
    return np.sqrt(count / np.maximum(np.diff(words.first), 1)[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts outside the held-out fold, chosen by a hash of doc_id."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = own.where(~held_out(F.col("doc_id")))
    by = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    picked = own.where("y = 0").orderBy(*by).limit(sample // 2).unionByName(own.where("y = 1").orderBy(*by).limit(sample // 2))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, dims: int = 48) -> dict:
    """Term weights, directions and the labelled vectors."""

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t.encode() for t in part["text"]]
            for a, b in blocks([len(t) for t in texts]):
                x = _terms(texts[a:b])
                yield pd.DataFrame({"doc_id": part["doc_id"][a:b], "y": part["y"][a:b], "x": [r.tobytes() for r in x]})

    rows = _labelled(docs, labels, sample).mapInPandas(terms, "doc_id long, y int, x binary").orderBy("doc_id").limit(2 * sample).toPandas()
    if rows.empty:
        return {"y": np.zeros(0), "prior": 1.0}
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]])
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _unit(x * weight)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = vectors[:, ::-1][:, :dims].astype(np.float32)
    y = rows["y"].to_numpy(np.float64)
    return {"weight": weight[:, None] * axes, "near": _unit(x @ axes), "y": y, "prior": float(y.mean())}


def _vote(model: dict, terms: np.ndarray, neighbours: int) -> np.ndarray:
    if not len(model["y"]):
        return np.full(len(terms), model["prior"])
    out = np.full(len(terms), model["prior"])
    for lo in range(0, len(terms), 1024):
        near = _unit(terms[lo : lo + 1024] @ model["weight"]) @ model["near"].T
        k = min(neighbours, near.shape[1])
        last = np.maximum(np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k], np.finfo(np.float32).tiny)
        row, at = np.nonzero(near >= last[:, None])
        w = near[row, at].astype(np.float64) ** 4
        total = np.bincount(row, w, minlength=len(near))
        some = np.flatnonzero(total)
        out[lo + some] = np.bincount(row, w * model["y"][at], minlength=len(near))[some] / total[some]
    return out


def score(text: Column, model: dict, spark: SparkSession, neighbours: int = 15) -> Column:
    """A column from 0 to 1, higher where label 1 is likelier. Null and empty texts have no terms and score the sample's share of label 1 (1 if nothing is labelled), and so does a text without a labelled one on its side of the space. A very long text is one block of one task; blocks are otherwise bounded."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def vote(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(t or "").encode() for t in part]
            out = [_vote(shared.value, _terms(texts[a:b]), neighbours) for a, b in blocks([len(t) for t in texts], 1 << 19)]
            yield pd.Series(np.clip(np.concatenate(out), 0, 1) if out else [], dtype="float64")

    return vote(text)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    Only ``doc_id`` and ``text`` of docs and ``doc_id`` and ``quality`` of labels are read; labels of one doc_id that
    differ count as 0, null labels not at all. Repeated rows stay. A row without doc_id isn't held out. Empty tables give
    empty tables.
    """
    model = fit(docs, labels, sample)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
