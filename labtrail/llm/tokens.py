"""Token counts, with overlapping chunks for huge documents.

Texts of up to ``chunk`` characters are encoded whole. Longer ones are cut in chunks, spread over the cluster, that overlap
by ``overlap`` characters. Two neighbours are spliced at a boundary that both encodings have inside the overlap and that is
proven stable: a single space between two other characters. No pre-token can hold it except at its start, so what stands
on either side of it is encoded alike whatever is further away. Documents whose chunks don't align so are cut
anew with overlaps twice as wide, at last with a single chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table

LIMIT = 1024
#: The byte-level pre-tokeniser's pattern, a fixed value of this vocabulary type.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern above knows it, in runs too long for its engine, which keeps a state for each character.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
STABLE = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Characters at a chunk's cut ends that are never trusted.
MARGIN = 64
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the merges of a byte-level BPE file in the tokenizers library's JSON; its special tokens are found in texts as that library does by default."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], _byte_letters()
        special = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t.get("special")}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        pre = data.get("pre_tokenizer") or {}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer") or [vocab[m] for m in merges] != sorted(vocab[m] for m in merges):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary in merge order")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def ids_of(own: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text. A long run of white space is cut out: the pattern takes it whole at the end of a text or before a special token, else up to its last character."""
    if not LONG_RUN.search(text):
        return own.encode(text, allowed_special="all")
    out: list[int] = []
    special = "|".join(map(re.escape, sorted(own.special_tokens_set, key=len, reverse=True)))
    for part in re.split(f"({special})", text) if special else [text]:
        done = 0
        for m in LONG_RUN.finditer(part):
            end = m.end() if m.end() == len(part) else m.end() - 1
            out += own.encode(part[done : m.start()], allowed_special="all")
            out += own._encode_single_piece(part[m.start() : end])
            done = end
        out += own.encode(part[done:], allowed_special="all")
    return out


def _count_whole(texts: DataFrame, path: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [len(ids_of(own, t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    return texts.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _stable(text: str, lo: int, hi: int, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Stable boundaries of a chunk in [lo, hi): their places, and how many tokens end there or before. ends: byte ends of the tokens."""
    places, counts = [], []
    done, size = lo, len(text[:lo].encode())
    for m in STABLE.finditer(text, lo, max(lo, hi)):
        size += len(text[done : m.start()].encode())
        done = m.start()
        i = int(np.searchsorted(ends, size))
        if i < len(ends) and ends[i] == size:
            places.append(m.start())
            counts.append(i + 1)
    return places, counts


def _splice(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``sha, n_tokens`` of distinct long texts; n_tokens is null where a pair of chunks has no common boundary."""
    pieces = F.greatest(F.lit(1), F.ceil((F.col("chars") - overlap) / chunk)).cast("int")
    cut = long.withColumn("pieces", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    size = F.when(F.col("k") == F.col("pieces") - 1, F.col("chars")).otherwise(F.lit(chunk + overlap)).cast("int")
    cut = cut.select("sha", "k", "pieces", F.substring("text", F.col("k") * chunk + 1, size).alias("text")).repartition("sha", "k")

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for part in parts:
            out = []
            for r in part.itertuples():
                tokens = ids_of(own, r.text)
                ends = np.cumsum([len(own.decode_single_token_bytes(t)) for t in tokens])
                head = _stable(r.text, MARGIN, min(overlap, len(r.text)) - MARGIN, ends) if r.k else ([], [])
                tail = _stable(r.text, chunk + MARGIN, chunk + overlap - MARGIN, ends) if r.k < r.pieces - 1 else ([], [])
                out.append((r.sha, r.k, r.pieces, len(tokens), *head, [p - chunk for p in tail[0]], tail[1]))
            yield pd.DataFrame(out, columns=["sha", "k", "pieces", "n", "head_at", "head_n", "tail_at", "tail_n"])

    parts = cut.mapInPandas(encode, "sha string, k int, pieces int, n long, head_at array<int>, head_n array<long>, tail_at array<int>, tail_n array<long>")
    order = W.partitionBy("sha").orderBy("k")
    parts = parts.withColumn("left_at", F.lag("tail_at").over(order)).withColumn("left_n", F.lag("tail_n").over(order))
    place = F.array_min(F.array_intersect("left_at", "head_at"))
    before = F.expr("element_at(left_n, cast(array_position(left_at, place) as int))")
    skipped = F.expr("element_at(head_n, cast(array_position(head_at, place) as int))")
    parts = parts.withColumn("place", F.when(F.col("k") > 0, place))
    # to the left chunk's tokens up to the place come those of this chunk after it
    own = F.when(F.col("k") == 0, F.lit(0)).when(F.col("place").isNotNull(), before - skipped)
    step = parts.select("sha", "k", "pieces", "n", own.alias("own"), F.when(F.col("k") == F.col("pieces") - 1, F.col("n")).otherwise(0).alias("last"))
    return step.groupBy("sha").agg(F.when(F.count("own") == F.count("*"), F.sum("own") + F.sum("last")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, chunk: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs(doc_id, text)``.

    Counts are those of the tokenizers library for the vocabulary file ``path``, without begin, end or added special
    tokens. Null texts are empty and have no tokens; very long texts are cut in chunks, except that one without a stable
    boundary, such as a single word or run of white space, is at last one chunk of one task; repeated rows and null doc_ids stay; further columns are ignored; an
    empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text", F.length("text").alias("chars"))
    short = _count_whole(docs.where(F.coalesce("chars", F.lit(0)) <= chunk), path)
    long = docs.where(F.col("chars") > chunk).withColumn("sha", F.sha2(F.col("text"), 256))
    open_texts = long.groupBy("sha").agg(F.first("text").alias("text"), F.first("chars").alias("chars"))
    longest = long.agg(F.max("chars")).first()[0]
    if longest is None:
        return short
    done, wide = None, overlap
    while True:
        got = materialise(_splice(open_texts, path, max(chunk, wide), wide), "spliced")
        ok = got.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        if got.where("n_tokens is null").isEmpty():
            break
        open_texts = open_texts.join(got.where("n_tokens is null").select("sha"), "sha", "left_semi")
        wide *= 2
    spliced = long.join(done, "sha").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
    return short.unionByName(spliced)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
