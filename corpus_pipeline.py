"""A training corpus from ``documents``: five operators in a row, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm import mixing, pieces, pii, quality, simhash
from labtrail.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score at or above the threshold), with all their columns, whatever their names.

    Null and empty texts score the labelled sample's share of good texts; very long texts are scored whole. Repeated rows
    and rows without doc_id stay or go by their text alone. An empty table gives an empty table.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs["text"], model, spark) >= quality.THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates; all columns stay, whatever their names.

    Rows of equal doc_id and text count as one document: of those that differ in other columns, the one of least JSON
    stays. Rows without doc_id stay, for they can't be named. Null and blank texts are one group. Very long texts are
    fingerprinted whole. An empty table gives an empty table.
    """
    kept = simhash.representatives(docs).withColumnRenamed("th", "__th")
    # Sorted on both sides at every size: the list of kept ids grows with the documents, and rows that share a doc_id are then already together.
    named = docs.where("doc_id is not null").withColumn("__th", F.xxhash64("text"))
    rest = F.to_json(F.struct(*(docs[c] for c in docs.columns if c not in ("doc_id", "text"))))
    row = F.struct(*(docs[c] for c in docs.columns))
    one = named.join(kept.hint("merge"), ["doc_id", "__th"], "left_semi").groupBy("doc_id", "__th").agg(F.min_by(row, rest).alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the name of its kind; ``n_chars`` follows the new text.

    Odd rows are those of ``pii.redact``: every row stays, null texts stay null (and have a null ``n_chars``).
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each epoch that takes one, those without doc_id too.

    Odd rows are those of ``mixing.take``: null and empty texts have no tokens, null languages and sources are one of
    their own, repeated rows are taken together.
    """
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to, a row for each row of docs.

    Odd rows are those of ``pieces.encode_decode``: null texts are empty, very long ones are encoded whole.
    """
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_distinct),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]
#: Classifier, fingerprints and pieces are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
