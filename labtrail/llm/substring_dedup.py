"""Substring deduplication by recompression.

Each text becomes a sequence of word names. Rounds of recompression then shorten it: runs of one symbol get a name,
then pairs whose left symbol falls in one half of that round's alphabet and whose right one in the other half. A name
depends on the named symbols and the round alone, so it is the same in every task of the cluster, with no dictionary to
exchange. Every symbol keeps the range of words that its rounds have looked at; a symbol whose range lies within a
window is there in every equal window. Such a shared high-level symbol is the window's anchor (a long one of least hash),
and consecutive windows with one anchor form a segment, the unit that is shuffled: its anchor's name and a 128-bit
fingerprint of its words.

1. Anchor names that occur in two documents reveal the repeats; the other segments, most of them, go no further.
2. Segments that are equal as a whole are settled by their smallest doc_id.
3. Where an anchor has several variants (a repeat begins or ends there), the windows of one copy of each variant are
   compared one by one by their fingerprints.
4. Covered words are removed from each text.

Windows without any such symbol, as in long runs of a word, are segments of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm.common import discard, materialise, table
from labtrail.llm.words import Spans, Words, blocks, mix

ROUNDS = 4
#: Symbols of more words than this aren't paired any more, so that a window always holds whole ones.
LONGEST = 12
#: Anchors are preferred by their words divided by this.
STEP = 2
SEGMENTS = "doc_id long, th long, name long, f1 long, f2 long, p int, n int"
RANGES = "array<struct<p:int,n:int>>"


def _recompress(name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of the last round: name, start, end, range of words looked at (from, to), as indexes into the words."""
    n = len(name)
    start = np.arange(n)
    end = start + 1
    seen_from, seen_to = start.copy(), end.copy()
    bounds = first[1:-1]
    for turn in range(2 * ROUNDS):
        if len(name) < 2:
            break
        cut = np.zeros(len(name), bool)  # the symbol is the first of its text
        at = np.searchsorted(start, bounds)
        cut[at[at < len(name)]] = True
        cut[0] = True
        last = np.append(cut[1:], True)
        # what a decision sees on either side; beyond a text's end it sees the end
        left_seen = np.where(cut, start - 1, np.roll(seen_from, 1))
        right_seen = np.where(last, end + 1, np.roll(seen_to, -1))
        if turn % 2 == 0:
            joins = np.zeros(len(name), bool)
            joins[1:] = (name[1:] == name[:-1]) & ~cut[1:]
            if not joins.any():
                seen_from, seen_to = left_seen, right_seen
                continue
            head = np.flatnonzero(~joins)
            tail = np.append(head[1:], len(name)) - 1
            size = tail - head + 1
            name = np.where(size > 1, mix(name[head] + mix(size.astype(np.uint64) + np.uint64(turn))), name[head])
            start, end = start[head], end[tail]
            seen_from, seen_to = left_seen[head], right_seen[tail]
        else:
            size = end - start
            left = (mix(name ^ np.uint64(0xA5A5 + turn)) >> np.uint64(63)).astype(bool)
            pairs = np.zeros(len(name), bool)
            pairs[:-1] = left[:-1] & ~left[1:] & ~cut[1:] & (size[:-1] + size[1:] <= LONGEST)
            second = np.roll(pairs, 1)
            second[0] = False
            alone_left, alone_right = left & ~pairs, ~left & ~second
            seen_from = np.where(alone_right, left_seen, seen_from)
            seen_to = np.where(alone_left, right_seen, seen_to)
            head = np.flatnonzero(~second)
            tail = head + pairs[head]
            name = np.where(pairs[head], mix(name[head] * np.uint64(0x9E3779B97F4A7C15) + mix(name[tail] + np.uint64(turn))), name[head])
            start, end, seen_from, seen_to = start[head], end[tail], seen_from[head], seen_to[tail]
    return name, start, end, seen_from, seen_to


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least key, the first among equals, in each range [lo, hi); ranges aren't empty."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    best = np.arange(len(key))
    out = np.empty(len(lo), np.int64)
    for j in range(int(level.max(initial=0)) + 1):
        if j:
            step = 1 << (j - 1)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(key[b] < key[a], b, a)
        here = np.flatnonzero(level == j)
        if len(here):
            a, b = best[lo[here]], best[hi[here] - (1 << j)]
            out[here] = np.where(key[b] < key[a], b, a)
    return out


def _order(name: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least is a window's anchor: a long symbol, for short ones are shared by chance, of least hash."""
    return (np.uint64(15) - np.minimum(size, 15).astype(np.uint64) // np.uint64(STEP)) << np.uint64(60) | mix(name + np.uint64(7)) >> np.uint64(4)


def _windows(words: Words, window: int) -> np.ndarray:
    """Index of the first word of each window."""
    size = np.maximum(np.diff(words.first) - window + 1, 0)
    begin = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(size.sum()) + begin


def _segments(words: Words, window: int) -> dict[str, np.ndarray]:
    """Segments of a block: text (row), p (first window's word in its text), n (windows), name, f1, f2."""
    at = _windows(words, window)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("row", "p", "n", "name", "f1", "f2")}
    h1 = words.hashes(1)
    one, two = Spans(h1), Spans(words.hashes(2))
    name, start, end, seen_from, seen_to = _recompress(h1, words.first)
    # lo: first symbol whose range begins in the window; hi: first whose range ends beyond it
    lo = np.searchsorted(seen_from, at)
    hi = np.searchsorted(seen_to, at + window, side="right")
    anchor = np.full(len(at), -1)
    some = np.flatnonzero(hi > lo)
    if len(some):
        anchor[some] = _least(_order(name, end - start), lo[some], hi[some])
    row = np.searchsorted(words.first, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    begin, of = at[head], anchor[head]
    f1, f2 = one.of(begin, begin + size + window - 1), two.of(begin, begin + size + window - 1)
    shift = np.where(of >= 0, start[of] - begin, 0).astype(np.uint64)
    label = np.where(of >= 0, name[of], mix(f1 ^ np.uint64(3)))
    f2 = mix(f2 + shift)
    return {"row": row[head], "p": begin - words.first[row[head]], "n": size, "name": label.view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64)}


def _batch(columns: dict[str, object], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in like], schema=like)


_SEGMENT_BATCH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("name", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("p", pa.int32()), ("n", pa.int32())])


def segments(docs: DataFrame, window: int) -> DataFrame:
    """All segments of ``docs(doc_id, th, text)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            ids, th = batch.column("doc_id").to_numpy(False), batch.column("th").to_numpy(False)
            for a, b in blocks([len(x) for x in texts.to_pylist()]):
                found = _segments(Words(texts[a:b].to_pylist()), window)
                row = found.pop("row") + a
                yield _batch(found | {"doc_id": ids[row], "th": th[row]}, _SEGMENT_BATCH)

    return docs.mapInArrow(cut, SEGMENTS)


def _windows_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``doc_id, name, f1, f2, k, w1, w2``: fingerprint of the k-th window of each wanted segment."""
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("k", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_numpy(False)
            lists = batch.column("parts")
            for a, b in blocks([len(x) for x in texts]):
                words = Words(texts[a:b])
                one, two = Spans(words.hashes(1)), Spans(words.hashes(2))
                own = lists[a:b]
                flat, size = own.flatten(), own.value_lengths().to_numpy(False)
                row = np.repeat(np.arange(b - a), size)
                p, n, name, f1, f2 = (flat.field(k).to_numpy(False) for k in ("p", "n", "name", "f1", "f2"))
                pick = np.repeat(np.arange(len(p)), n)
                k = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
                at = words.first[row[pick]] + p[pick] + k
                w1, w2 = one.of(at, at + window).view(np.int64), two.of(at, at + window).view(np.int64)
                yield _batch({"doc_id": ids[a:b][row[pick]], "name": name[pick], "f1": f1[pick], "f2": f2[pick], "k": k, "w1": w1, "w2": w2}, schema)

    parts = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("p", "n", "name", "f1", "f2")).alias("parts"))
    return docs.join(parts, ["doc_id", "th"]).select("doc_id", "text", "parts").mapInArrow(expand, "doc_id long, name long, f1 long, f2 long, k int, w1 long, w2 long")


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, th, ranges``: windows (first word p, number n) whose words also start in a smaller doc_id."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    every = materialise(segments(keyed, window), "segments")

    shared = every.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("name")
    shared = materialise(shared, "shared-symbols")
    found = materialise(every.join(shared, "name", "left_semi"), "shared-segments")
    discard(every)

    segment = ["name", "f1", "f2"]
    variants = materialise(found.groupBy(segment).agg(F.min(F.struct("doc_id", "th", "p", "n")).alias("one")).select(*segment, "one.*"), "variants")
    many = materialise(variants.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "branching")
    wanted = variants.join(many, "name", "left_semi")
    windows = materialise(_windows_of(keyed, wanted, window), "windows")
    earlier = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("w1", "w2", "a")
    earlier = materialise(earlier, "earlier")
    partly = windows.join(earlier, ["w1", "w2"]).where("doc_id > a").groupBy(segment).agg(F.sort_array(F.collect_set("k")).alias("ks"))

    first = materialise(variants.join(partly, segment, "left").select(*segment, F.col("doc_id").alias("source"), "ks"), "settled")
    discard(windows)
    hits = found.join(first, segment).select("doc_id", "th", F.when(F.col("doc_id") > F.col("source"), F.array(F.struct("p", "n"))).otherwise(F.transform("ks", lambda k: F.struct((F.col("p") + k).alias("p"), F.lit(1).alias("n")))).cast(RANGES).alias("r"))
    return hits.where("size(r) > 0").groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs(doc_id, text)``; further columns are ignored.

    A word goes if a window of ``window`` consecutive words over it also starts in a document of smaller doc_id; windows
    are those of the input. Kept words are joined by one space. Null texts have no words. Repeated rows stay and are no
    source for each other, having one doc_id. A row without doc_id is neither a source nor cut. An empty table gives an
    empty table. Texts of fewer than ``window`` words stay whole.
    """
    docs = docs.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column("text").cast(pa.binary()), batch.column("ranges")
            sizes = [len(x.as_py() or b"") for x in texts]
            for a, b in blocks(sizes):
                n_words, n_removed, kept = [], [], []
                for text, own in zip(texts[a:b].to_pylist(), ranges[a:b], strict=True):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    gone = 0
                    if own.is_valid and len(own):
                        depth = np.zeros(len(words) + 1, np.int64)
                        p, n = own.values.field("p").to_numpy(False), own.values.field("n").to_numpy(False)
                        np.add.at(depth, p, 1)
                        np.add.at(depth, p + n + window - 1, -1)
                        stay = np.cumsum(depth)[:-1] == 0
                        gone = len(words) - int(stay.sum())
                        words = [words[i] for i in np.flatnonzero(stay)]
                    n_removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield _batch({"doc_id": batch.column("doc_id")[a:b], "n_words": n_words, "n_removed": n_removed, "kept": kept}, schema)

    marked = docs.withColumn("th", F.xxhash64("text")).join(repeats(docs, window), ["doc_id", "th"], "left")
    return marked.select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
