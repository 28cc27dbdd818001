"""Prefix trie of conversations, built as a burst trie.

A turn's id is 20 bytes: an MD5 of its role and text, and the number of the text's code points. A conversation is the string of its
ids, and equal conversations are one. Containers hold suffixes of these strings under the trie node that they share (their head).
A container of more than ``burst`` turns is burst: its head, and the turns that all its suffixes go on with, become nodes, and each
suffix moves on to the container of its next id. The containers that are left are dealt to shards, sorted there and swept into
nodes, one container after the other. What a subtree sums up goes from the containers to the burst nodes above them, the last burst
first.

Conversations of over ``piece`` turns are cut: a later piece is a suffix whose head is known beforehand by a hash of all turns
before it, so that all pieces of all conversations are containers like the others, and no row holds more than a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import discard, materialise, table

UNIT = 20
BURST = 1 << 14
PIECE = 1 << 16
#: Conversation ids that one row of a node's ends holds.
ENDS = 4096
#: Copies of a burst head's row, among which the suffixes of its container are dealt.
SALT = 32
NONE = hashlib.sha256(b"").hexdigest()
ROW = "head string, above string, depth long, last int, parent_conv_id long, path binary, rep long, copies long, ends string, x_children long, x_leaves long, x_saved long"
NODE = "head string, above string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in NODE.split(", "))])


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, part, before, upto, n, unit``: each distinct row of ``turns(conv_id, turn, role, text)``, its ``n`` copies in the conversation's
    places ``before + upto - n`` and on, for ``before`` from ``offsets``. A conversation may stretch over many parts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    unit = F.unhex(F.concat(name, F.lpad(F.hex(F.length(text)), 8, "0")))
    key = ["conv_id", "turn", "role", "start", "unit"]
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.substring(role, 1, 32).alias("role"), F.substring(text, 1, 32).alias("start"), unit.alias("unit"))
    rows = rows.groupBy(*key).agg(F.count("*").alias("n")).repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    return materialise(rows, "turns")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conv_id)`` and ``(conv_id, pos, unit)``: conversations whose first ``h`` turns are those of the first of their ``group``, h = crc32(conv_id) % most."""
    rows = ordered(turns)
    sizes = rows.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("conv_id", "part", "n", before.alias("before"))
    total = sizes.groupBy("conv_id").agg(F.sum("n").alias("total"))
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = total.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), borrowed.alias("h"))
    convs = convs.join(total.select(F.col("conv_id").alias("base"), "total"), "base", "left").withColumn("taken", F.least("h", F.coalesce("total", F.lit(0))))
    convs = materialise(convs.select("conv_id", "base", "h", "taken"), "conversations")
    local = F.sum("n").over(W.partitionBy("conv_id", "part").orderBy("turn", "role", "start", "unit").rowsBetween(W.unboundedPreceding, 0))
    shifts = sizes.join(convs, "conv_id").select("conv_id", "part", "before", "h", "taken")
    first = F.col("before") + F.col("upto") - F.col("n")
    own = rows.withColumn("upto", local).join(shifts, ["conv_id", "part"]).select("conv_id", "h", "taken", "unit", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("pos"))
    own = materialise(own, "own")
    heads = own.where(F.col("pos") < most - 1).where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), "pos", "unit")
    given = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "unit")
    rest = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "unit")
    out = materialise(given.unionByName(rest), "rebuilt")
    discard(rows, own)
    return convs, out


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and conv_id to rows of up to ``ENDS`` ids of a class."""
    for part in parts:
        cols = {n: part.column(n).to_pylist() for n in ("turns", "x", "y", "conv_id")}
        keys, ids = list(zip(cols["turns"], cols["x"], cols["y"], strict=True)), cols["conv_id"]
        out, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or keys[i] != keys[start] or i - start == ENDS:
                out.append((*keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64()] * 4 + [pa.string()], strict=True)], ["turns", "x", "y", "first", "ids"])


def _digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and first id to a digest of each class; a class goes through in a stream, whatever its size."""
    last, digest = None, None
    done: list[tuple] = []

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], ["turns", "x", "y", "ends"])
        done.clear()
        return out

    for part in parts:
        for *key, ids in zip(*(part.column(n).to_pylist() for n in ("turns", "x", "y", "ids")), strict=True):
            if key != last:
                if digest is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield emit()
    if digest is not None:
        done.append((*last, digest.hexdigest()))
        yield emit()


def classes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``turns, x, y, rep, copies, ends``: equal conversations, the smallest of them, and the digest of their ids in order."""
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.bit_xor(F.xxhash64("unit", "pos")).alias("x"), F.bit_xor(F.xxhash64("pos", "unit")).alias("y"))
    of = convs.select("conv_id").join(sums, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("turns", "x", "y")))
    of = materialise(of, "classes-of")
    key = ["turns", "x", "y"]
    runs = of.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_joined, "turns long, x long, y long, first long, ids string")
    ends = runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digested, "turns long, x long, y long, ends string")
    out = materialise(of.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")).join(ends, key), "classes")
    discard(of)
    return out


def _pieces(own: DataFrame, rows: DataFrame, piece: int) -> DataFrame:
    """A row for each piece of each class, in the columns of ``ROW``, with ``piece`` and the head of the next one."""
    # A conversation that ends with a piece has an empty one after it: the next containers know all members of their heads.
    last = F.expr(f"turns div {piece}")
    parts = own.select("rep", "copies", "ends", "turns", last.alias("final"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    units = rows.select(F.col("conv_id").alias("rep"), F.expr(f"pos div {piece}").alias("piece"), "pos", "unit")
    units = units.join(parts.select("rep", "piece"), ["rep", "piece"]).groupBy("rep", "piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("unit").alias("unit")))), lambda s: s["unit"]), "")
    units = units.agg(F.unhex(text).alias("path"), F.bit_xor(F.xxhash64("unit", "pos")).alias("x"), F.bit_xor(F.xxhash64("pos", "unit")).alias("y"))
    upto = W.partitionBy("rep").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)
    rows = parts.join(units, ["rep", "piece"], "left").withColumns({"x": F.bit_xor("x").over(upto), "y": F.bit_xor("y").over(upto)})
    name = F.concat_ws(":", F.col("piece") + 1, "x", "y")
    order = W.partitionBy("rep").orderBy("piece")
    return rows.withColumn("next", F.when(F.col("piece") < F.col("final"), name)).select(
        F.coalesce(F.lag(name).over(order), F.lit("0")).alias("head"),
        F.lit(None).cast("string").alias("above"),
        (F.col("piece") * piece).alias("depth"),
        F.lit(0).alias("last"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.coalesce("path", F.lit("").cast("binary")).alias("path"),
        "rep",
        "copies",
        F.when(F.col("turns") <= (F.col("piece") + 1) * piece, F.col("ends")).alias("ends"),
        "next",
        "piece",
    )


class _Container:
    """Nodes of one container, in the order in which sorted suffixes open them: a node's parent comes before it."""

    def __init__(self, row: dict):
        self.head, self.above, self.over = row["head"], row["above"], row["parent_conv_id"]
        self.path, self.stack = b"", [0]
        self.depth, self.chars, self.parent, self.convs, self.least, self.children, self.leaves, self.saved, self.ends = [row["depth"]], [row["last"]], [-1], [0], [None], [0], [0], [0], [NONE]

    def add(self, row: dict) -> None:
        path, old, same = row["path"], self.path, 0
        most = min(len(path), len(old)) // UNIT
        while same < most and path[same * UNIT : same * UNIT + UNIT] == old[same * UNIT : same * UNIT + UNIT]:
            same += 1
        del self.stack[same + 1 :]
        for k in range(same, len(path) // UNIT):
            for column, value in ((self.depth, self.depth[0] + k + 1), (self.chars, int.from_bytes(path[k * UNIT + 16 : k * UNIT + UNIT])), (self.parent, self.stack[-1]), (self.convs, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, NONE)):
                column.append(value)
            self.stack.append(len(self.depth) - 1)
        at, self.path = self.stack[-1], path
        self.convs[at] += row["copies"]
        self.least[at] = row["rep"] if self.least[at] is None else min(self.least[at], row["rep"])
        if row["ends"] is not None:
            self.ends[at] = row["ends"]
        if row["x_children"] is not None:
            self.children[at], self.leaves[at], self.saved[at] = row["x_children"], row["x_leaves"], row["x_saved"]

    def rows(self) -> list[list]:
        n = len(self.depth)
        for i in range(n - 1, -1, -1):
            self.saved[i] += (self.convs[i] - 1) * self.chars[i]
            if not self.children[i]:
                self.leaves[i] = 1
            if (p := self.parent[i]) >= 0:
                self.convs[p] += self.convs[i]
                self.least[p] = self.least[i] if self.least[p] is None else min(self.least[p], self.least[i])
                self.children[p] += 1
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]
        head = [self.head] + [None] * (n - 1)
        above = [self.above] + [None] * (n - 1)
        parents = [self.over, *(self.least[p] for p in self.parent[1:])]
        return [head, above, self.least, self.depth, parents, self.convs, self.children, self.leaves, self.saved, self.ends]


def _swept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head and path to nodes."""
    open_: _Container | None = None
    out: list[list] = [[] for _ in _NODE]

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODE, strict=True)], schema=_NODE)
        for c in out:
            c.clear()
        return batch

    def close() -> None:
        if open_ is not None:
            for column, values in zip(out, open_.rows(), strict=True):
                column.extend(values)

    for part in parts:
        for row in part.to_pylist():
            if open_ is None or row["head"] != open_.head:
                close()
                open_ = _Container(row)
                if len(out[0]) > 10_000:
                    yield emit()
            open_.add(row)
    close()
    yield emit()


def _sweep(rows: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in ROW.split(", ")]
    return rows.select(names).repartition("head").sortWithinPartitions("head", "path").mapInArrow(_swept, NODE)


def _units(column: str) -> Column:
    return F.expr(f"length({column}) div {UNIT}")


def _level(rows: DataFrame, burst: int, spent: list[DataFrame]) -> DataFrame:
    """Nodes of the containers of ``rows``, their heads included (these with ``head``); ``spent`` gets the tables written."""
    done: list[DataFrame] = []
    bursts: list[DataFrame] = []
    shared = f"coalesce(array_position(transform(sequence(0, least(length(lo), length(hi)) div {UNIT}), i -> substring(lo, i * {UNIT} + 1, {UNIT}) = substring(hi, i * {UNIT} + 1, {UNIT}) and (i + 1) * {UNIT} <= least(length(lo), length(hi))), false), 1) - 1"
    while True:
        sizes = rows.groupBy("head").agg(F.count("*").alias("n"), F.sum(_units("path") + 1).alias("weight"), F.min("path").alias("lo"), F.max("path").alias("hi"), F.min("rep").alias("least"))
        sizes = materialise(sizes.where((F.col("weight") > burst) & (F.col("n") > 1)).select("head", "least", F.expr(shared).cast("int").alias("p")), "burst")
        spent.append(sizes)
        if sizes.isEmpty():
            break
        # A third of all suffixes may share a head: they are dealt among copies of its row.
        dealt = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = materialise(rows.withColumn("salt", F.pmod(F.hash("rep"), F.lit(SALT))).join(dealt, ["head", "salt"], "left").drop("salt"), "suffixes")
        spent.append(rows)
        done.append(rows.where("p is null").drop("p", "least"))
        inside = rows.where("p is not null").withColumn("ended", F.col("p") == _units("path"))
        here = {c: F.max(F.when(F.col("ended"), F.col(c))).alias(c) for c in ("ends", "x_children", "x_leaves", "x_saved")}
        heads = inside.groupBy("head").agg(
            *(F.min(c).alias(c) for c in ("above", "depth", "last", "parent_conv_id")), F.min(F.expr(f"substring(path, 1, p * {UNIT})")).alias("path"), F.min("rep").alias("rep"), F.sum("copies").alias("copies"), *here.values()
        )
        bursts.append(materialise(heads, "burst-heads"))
        next_id = f"substring(path, 1, (p + 1) * {UNIT})"
        moved = inside.where("not ended").select(
            F.md5(F.concat(F.col("head").cast("binary"), F.expr(next_id))).alias("head"),
            F.col("head").alias("above"),
            (F.col("depth") + F.col("p") + 1).alias("depth"),
            F.conv(F.hex(F.expr(f"substring(path, p * {UNIT} + 17, 4)")), 16, 10).cast("int").alias("last"),
            F.col("least").alias("parent_conv_id"),
            F.expr(f"substring(path, (p + 1) * {UNIT} + 1)").alias("path"),
            "rep", "copies", "ends", "x_children", "x_leaves", "x_saved",
        )
        rows = moved
    done.append(rows)
    names = [c.split()[0] for c in ROW.split(", ")]
    spent += bursts
    found = [materialise(_sweep(reduce(DataFrame.unionByName, [d.select(names) for d in done])), "nodes")]
    for heads in reversed(bursts):
        below = reduce(DataFrame.unionByName, found).where("head is not null and above is not null")
        below = below.groupBy(F.col("above").alias("head")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = [F.coalesce(a, b).alias(a) for a, b in (("x_children", "k"), ("x_leaves", "l"), ("x_saved", "s"))]
        joined = heads.join(below, "head", "left")
        found.append(materialise(_sweep(joined.select(*(c for c in names if not c.startswith("x_")), *more)), "burst-nodes"))
    spent += found
    return reduce(DataFrame.unionByName, found)


def trie(convs: DataFrame, rows: DataFrame, burst: int = BURST, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of the conversations ``convs(conv_id)`` of the turns ``rows(conv_id, pos, unit)``, numbered from 0.

    ``conv_id``, the smallest member, and ``depth`` name a node. Conversations without turns are members of the root. Equal
    conversations are held once, with the number of their copies; a container of over ``burst`` turns is burst, a
    conversation of over ``piece`` turns is cut. No conversations: no nodes.
    """
    own = classes(convs, rows)
    pieces = materialise(_pieces(own, rows, piece), "pieces")
    levels = (pieces.agg(F.max("piece")).first()[0] or 0) + 1
    totals, nodes, spent = None, [], []
    for level in reversed(range(levels)):
        here = pieces.where(F.col("piece") == level)
        here = here.join(totals, "next", "left") if totals is not None else here.withColumns({c: F.lit(None).cast("long") for c in ("x_children", "x_leaves", "x_saved")})
        found = _level(here.drop("piece", "next"), burst, spent)
        start = F.col("depth") == level * piece
        totals = found.where(start).select(F.col("head").alias("next"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
        nodes.append(found if level == 0 else found.where(~start))
    out = materialise(reduce(DataFrame.unionByName, nodes).drop("head", "above"), "trie")
    discard(own, pieces, *spent)
    return out


def conversation_trie(conversations: DataFrame, burst: int = BURST, piece: int = PIECE) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Turns are in the order of ``turn``, null first; those of one turn by role, text (both by their first 32 characters) and MD5. Null roles and texts are empty.
    Rows without conv_id take no part. Repeated rows are turns of their own. Texts of any length are held by their MD5 alone. Further columns are ignored; an empty table gives no nodes.
    """
    convs, rows = rebuilt(conversations)
    out = trie(convs, rows, burst, piece)
    discard(convs, rows)
    return out


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS m,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list(m ORDER BY pos) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h FROM k),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN k b ON b.conv_id = c.base),
p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, len(path) AS size, md5(path[1:depth]::VARCHAR || '|' || depth) AS node, md5(path[1:depth - 1]::VARCHAR || '|' || (depth - 1)) AS parent,
        coalesce(length(path[depth]['text']), 0) AS chars FROM p),
n AS (SELECT node, depth, CASE WHEN depth > 0 THEN any_value(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
    FROM m GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
up AS (SELECT a.node AS top, w.node, w.n_children, (w.n_convs - 1) * w.chars AS saved FROM w JOIN m b ON b.node = w.node AND b.conv_id = w.conv_id AND b.depth = w.depth JOIN m a ON a.conv_id = w.conv_id AND a.depth <= w.depth),
sums AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY top)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN sums USING (node) LEFT JOIN w q ON q.node = w.parent"""
