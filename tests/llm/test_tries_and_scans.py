"""Conversation tries, hard negatives and license scans against their SQL and plain versions, on odd rows and on the small tables."""

import collections
import re

import duckdb
import numpy as np
import pytest

from labtrail.llm import hard_negatives, licenses, prefix_trie
from labtrail.llm.common import table
from labtrail.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

#: name clashes with columns that the operators make.
TURNS = "conv_id long, turn long, role string, text string, head int, pos string, path string"


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_hard_negatives", "op13_license_scan"])
def test_small_tables(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == ""


def turns(spark, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS), con


ODD_TURNS = [
    (0, None, "u", "a"), (0, 0, None, None), (0, 1, "u", "b"), (0, 1, "u", "b"), (0, 2, "v", "é日"), (1, 0, "u", "q"), (3, 5, None, "z"), (3, 6, "a", None),
    (3, None, None, None), (None, 1, "u", "a"), (-5, 0, "u", "a"), (-150, 0, "x", "a"), (250, 0, "u", "a"), (251, 0, "u", "a"), (251, 1, "u", "a"), (252, 0, "u", "a"),
    (252, 0, "u", "a"), (5, 1, "r", "t" * 30_000), *((i, j, "u", "a") for i in range(300, 340) for j in range(6)),
]


def test_odd_conversations(spark):
    df, con = turns(spark, ODD_TURNS)
    assert differences(prefix_trie.conversation_trie(df), con, SQL["op11_conversation_trie"]) == ""
    assert prefix_trie.conversation_trie(df.where("false")).collect() == []


def test_burst_containers_and_cut_conversations_give_the_same_nodes(spark):
    long = [(100, i, "u", f"t{i % 3}") for i in range(60)] + [(i, j, "u", f"t{j % 3}") for i in (101, 102, 120, 205) for j in range(i - 95)]
    df, con = turns(spark, [r for r in ODD_TURNS if r[0] is not None] + long)
    assert differences(prefix_trie.conversation_trie(df, burst=100, piece=16), con, SQL["op11_conversation_trie"]) == ""


def test_a_trie_of_hot_copies_bursts_nothing(spark):
    df, con = turns(spark, [(1000 * i, j, "u", f"t{j}") for i in range(200) for j in range(3)])
    assert differences(prefix_trie.conversation_trie(df, burst=10), con, SQL["op11_conversation_trie"]) == ""


def vectors(rows):
    """The rows' negatives, each pair of rows compared."""
    live = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live[i] = min(live.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in live.items():
        if a % 100:
            continue
        score = {b: int(sum(x * y for x, y in zip(v, w, strict=True))) for b, (_, w) in live.items() if b != a and len(w) == len(v)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if live[b][0] == label][:5]:
            fits = [b for b in order if live[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fits[:5])]
    return sorted(out)


VECTORS = "vec_id long, label int, vec array<double>, low string, leaf string, slot int"


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, df.where("vec_id % 100 = 0"), **how).collect())


def test_hard_negatives_of_a_deep_tree_are_exact(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 60, (12, 6))
    rows = [(i, int(draw.integers(3)), np.floor(centres[i % 12] + draw.normal(0, 12, 6)).tolist()) for i in range(2000)]
    rows += [(2000 + i, i % 3, rows[100][2]) for i in range(300)]  # equal vectors, ties all the way
    assert mined(spark, rows, sample=600, leaf_rows=40, degree=4) == vectors(rows)


def test_the_tree_drops_leaves_that_a_window_cannot_reach(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 100, (10, 8))
    x = np.floor(centres[np.arange(1000) % 10] + draw.normal(0, 3, (1000, 8)))
    tree = hard_negatives.Tree(x, 1.0, float((x * x).sum(1).max()), 0, 50, 4)
    seen = {}
    leaf = tree.place(x, seen)
    for node, (low, high) in seen.items():
        tree.near[node], tree.far[node] = low, high
    score = x @ x[:10].T
    low, high = np.sort(score, axis=0)[-60], np.sort(score, axis=0)[-20]
    q, found = tree.search(x[:10], low, high)
    reached = collections.defaultdict(set)
    for a, b in zip(q, found, strict=True):
        reached[int(a)].add(int(b))
    for k in range(10):
        assert set(leaf[(score[:, k] >= low[k]) & (score[:, k] <= high[k])].tolist()) <= reached[k]
    assert len(found) < 10 * tree.leaves / 2


def test_odd_vectors(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0, 2.0]), (3, None, [1.0, 2.0]), (4, 1, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0])]
    rows += [(None, 1, [1.0, 2.0]), (8, 2, [0.0, 0.0]), (100, 2, [0.0, 0.0]), (200, 1, [-5.0, 3.0]), (9, 2, [1.0, 2.0]), (9, 2, [1.0, 2.0]), (9, 2, [1.0, 3.0]), (10, 1, [1.0]), (300, 1, [2.0]), (11, 2, [1.0]), (400, 3, [])]
    assert mined(spark, rows) == vectors(rows)
    df = spark.createDataFrame([], "vec_id long, label int, vec array<double>")
    assert hard_negatives.hard_negatives(df, df).collect() == []


WORDS = re.compile(licenses.WORD)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def scanned(text):
    """The plain version: base places word by word, and for each notice the covered words around each diagonal."""
    w = WORDS.findall(lowered(text))
    places, labels, best = [], set(), 0.0
    for label, phrase in licenses.PHRASES:
        p = WORDS.findall(lowered(phrase))
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    for label, notice in licenses.NOTICES:
        t = WORDS.findall(lowered(notice))
        seen = collections.defaultdict(set)
        for i in range(len(w) - 2):
            for j in range(len(t) - 2):
                if w[i : i + 3] == t[j : j + 3]:
                    seen[i - j].add(j)
        for d in seen:
            near = [e for e in seen if abs(e - d) <= licenses.SLACK]
            if max(near, key=lambda e: (len(seen[e]), -e)) == d:
                share = len({j + k for e in near for j in seen[e] for k in range(3)}) / len(t)
                best = max(best, share)
                labels |= {label} if share >= licenses.SHARE else set()
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels | set(base))), 1.0 if places else best)


def test_odd_texts_of_licenses(spark):
    mit = licenses.NOTICES[0][1]
    altered = " ".join(x for i, x in enumerate(mit.split()) if i % 17)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "under the"), (5, "UNDER THE MIT-LICENSE, under the mit license under the mit license"), (5, "UNDER THE MIT-LICENSE, under the mit license under the mit license"), (None, "cc by-nc"), (None, None)]
    rows += [(6, "cc by nc " * 3000), (7, "x " * 5000 + mit + " y" * 5000), (8, altered), (9, " ".join(mit.split()[:10])), (10, "the rights to use copy " * 2000), (11, "Apache License, Version 2.0\x00é under the mit licensé"), (12, "w" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, a int, label string")
    found = licenses.scan(df).drop("spans").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(((i, *scanned(t)) for i, t in rows), key=key)
    assert licenses.scan(df.where("false")).collect() == []


def test_notices_add_labels_of_their_own_with_their_spans(spark):
    mit = licenses.NOTICES[0][1]
    altered = " ".join(x for i, x in enumerate(mit.split()) if i % 17)
    df = spark.createDataFrame([(1, "a b " + altered + " c"), (2, "clean text of the software and so on")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert (found[1]["base_labels"], found[1]["labels"]) == ("", "mit") and licenses.SHARE <= found[1]["score"] < 1
    assert [(s["start"], s["label"]) for s in found[1]["spans"]] == [(2, "mit")]
    assert (found[2]["labels"], found[2]["spans"]) == ("", [])
    with pytest.raises(ValueError):
        licenses.scan(df, phrases=[("x", "two words")])


def test_scan_shuffles_no_text(spark, sf_dir):
    plan = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\([^)]*text#", plan)
