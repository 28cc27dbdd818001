"""Each operator against a plain version, on odd rows and on the small tables."""

import collections
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labtrail.llm import embedding_dedup, mixing, neighbours, pieces, pii, quality, simhash, substring_dedup, tokens, url_filter
from labtrail.llm.common import table
from labtrail.llm.components import components
from labtrail.llm.vectors import unit
from labtrail.llm.words import xxh64
from tests.compare import connect, differences
from tests.llm import plain

MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
DOCS = "doc_id long, text string, name string, p int, fp long, kind int, epoch int"
LONG = " ".join(f"w{i % 700}" for i in range(6_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (5, "A B  c"), (6, LONG), (7, "x " + LONG), (8, "z " * 300), (9, "z " * 120), (10, "word" * 8_000),
    (11, " ".join(f"w{i % 700}" for i in range(500, 640))), (11, " ".join(f"w{i % 700}" for i in range(500, 640))), (None, "a b c"), (None, None),
    (12, "▁ a▁b  \x00 � <s></s> <0x41> 日本 🎉<|endoftext|>"), (13, "mail a.b@c.example.org, 10.0.0.255 or 4041894974608795 +1 (456) 555-2186 1.2.3.999 x@y"), (14, "a b " * 8_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "n", 1, 2, 3, 4) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def same(found, expected):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(map(tuple, expected), key=key)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_substring_dedup(which, request):
    df = request.getfixturevalue(which)
    found = substring_dedup.remove_repeats(df)
    same(found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)), plain.substring_dedup(pairs(df)))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    found = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    same(found, plain.simhash(pairs(df)))


def test_long_posting_lists_lose_no_link(spark):
    prints = [(i * 7) & 0xFF | (i & 3) << 40 for i in range(300)] + [1 << 63 >> k for k in range(64)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    linked = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    at = {p: i for i, p in enumerate(prints)}
    expected = {p: min(prints[i] for i in g) for p, g in zip(prints, plain.groups(len(prints), [(at[a], at[b]) for a, b in linked]), strict=True)}
    found = {r["node"]: r["component"] for r in components(simhash.links(df, list_rows=8), "x", "y").collect()}
    assert {p: found.get(p, p) for p in prints} == expected


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(public_tokenizers.path(BYTES))
    rows = pairs(df)
    counts = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    same(tokens.count_tokens(df, public_tokenizers.path(BYTES), chunk=4096, overlap=256), [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, counts, strict=True)])


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_sentencepiece(which, request):
    df = request.getfixturevalue(which)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    rows = pairs(df)
    ids = library.encode([t or "" for _, t in rows], add_eos=True)
    expected = [(i, len(x), plain.sha(" ".join(map(str, x))), plain.sha(library.decode(x))) for (i, _), x in zip(rows, ids, strict=True)]
    same(pieces.digests(pieces.encode_decode(df, public_tokenizers.path(MODEL))), expected)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_base_spans(which, request):
    df = request.getfixturevalue(which)
    same(pii.find(df).select("doc_id", pii._listed("base")), [(i, plain.base_spans(t or "")) for i, t in pairs(df)])


def test_bootstrap_discovers_unseen_identifiers(spark):
    seen = [(i, f"please call me on +1 (456) 555-{2000 + i} any day") for i in range(12)]
    seen += [(20 + i, f"the code was {1000 + i}-44 or +1 (456) 555-{3000 + i} once") for i in range(3)]
    rows = [*seen, (50, "please call me on 456-555-7777 any day"), (51, "the price was 456-555-7778 once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert [tuple(s) for s in spans[50]] == [(3, 18, 30)] and spans[51] == []
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[50] == "please call me on [PHONE] any day"


def test_bootstrap_leaves_unknown_values_neutral(spark):
    rows = [(i, f"her phone: +1 (456) 555-{2000 + i}, ask") for i in range(20)] + [(100 + i, f"her phone: 456-555-{3000 + i}, ask") for i in range(60)]
    # Contexts that speak against the kind: cards among the phones, dates among the phones, wrong check digits among the cards.
    rows += [(300 + i, f"we noted +1 (456) 556-{2000 + i} there") for i in range(6)] + [(320 + i, f"we noted {n} there") for i, n in enumerate(["4041894974608795", "4111111111111111", "5500005555555559"])]
    rows += [(340, "we noted 456-556-7777 there")]
    rows += [(400 + i, f"seen on +1 (456) 557-{2000 + i} here") for i in range(6)] + [(420 + i, f"seen on 2024-05-{10 + i} here") for i in range(6)]
    numbers = [str(4041894974600000 + i) for i in range(100)]
    rows += [(500 + i, f"the order {n} went") for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect()}
    assert all(found[100 + i] == [(3, 11, 23)] for i in range(60))
    assert found[340] == [] and not any(found[420 + i] for i in range(6))
    assert all(bool(found[500 + i]) == pii.luhn(n) for i, n in enumerate(numbers))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[159] == "her phone: [PHONE], ask" and masked[420] == "seen on 2024-05-10 here"


def test_overlapping_spans_are_masked_as_one(spark):
    text = "call +1 456 555 2186@mail.example.org x"
    spans = [s[1:] for s in pii.base_spans(text)]
    assert any(a < c < b < d for a, b in spans for c, d in spans)
    got = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == "call [PHONE] x"


def test_mix_equals_its_sql(spark, docs, odd, sf_dir):
    assert differences(mixing.mix(docs), connect(sf_dir), mixing.OP7_SQL) == ""
    rows = odd.select("doc_id", F.when(F.length("text") < 1000, F.col("text")).alias("text"), F.concat(F.lit("src"), F.col("doc_id")).alias("source"), F.lit(None).cast("string").alias("lang"))
    con = connect("/nowhere")
    con.register("small", rows.toPandas())
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source, CAST(lang AS VARCHAR) AS lang FROM small")
    assert differences(mixing.mix(rows), con, mixing.OP7_SQL) == ""


def test_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 10), ("d", "en", "b", 1000), ("d", "de", "c", 1000), ("e", "en", "f", 1000)], "domain string, lang string, source string, tokens long")
    one = {k: F.lit(1) for k in mixing.LEVELS}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(800), 1, one).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "f": 400}


def test_url_rules(spark):
    urls = ["http://Example.com/en/x", "https://www.example.com/en/y?z", "http://a.net/es/", "ftp://net/fr/q#t", "http://xnet/fr/", None, "no scheme", "http://b.com", "http://b.com/x"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, doc_id int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/y", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("b.com", "", None, "allow") and got[8][2:] == ("com/", "allow")


def test_mined_url_rules_block_what_they_imply(spark):
    rows = [(i, f"http://h{i}.org/{'spam' if i % 2 else 'good'}/page{i}") for i in range(200)]
    pages = spark.createDataFrame([*rows, (900, "http://q.org/spam/new"), (901, "http://q.org/good/new")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert got[900] == "block" and got[901] == "allow"


def test_least_support_of_url_rules_is_absolute(spark):
    own = F.when(F.col("id") < 20, "http://evil.org/a").when(F.col("id") < 39, "http://rare.org/a").otherwise(F.concat(F.lit("http://h"), F.col("id") % 997, F.lit(".org/a")))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), own.alias("url"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") < 39).cast("int").alias("toxic"))
    rules = url_filter.mine(pages, labels).collect()
    assert all("h1:evil" in r["items"] and r["confidence"] == 1.0 and round(r["support"], 9) == 0.001 for r in rules) and rules
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).where("page_id < 60").collect()}
    assert got == {i: "block" if i < 20 else "allow" for i in range(60)}


def test_quality_on_the_held_out_fold(spark, docs, sf_dir):
    labels = table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows["predicted"] == rows["quality"]).mean()) > 0.95 and rows["score"].between(0, 1).all()


def test_quality_of_odd_rows_and_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(odd, none).collect()} == {1.0}
    some = spark.createDataFrame([(4, 1), (8, 0), (9, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(odd, some).where("score is null or score < 0 or score > 1").count() == 0


def test_long_runs_are_counted_as_the_library_does(spark):
    n = 2_000_000
    texts = [" " * n, "\n" * n + "x", "x" + " " * n + "y", "a" * n, "!" * n, "a \u3000\n" * 5_000 + "\u3000" * 9_000, "<|endoftext|>" + "\t" * 9_000 + "<|endoftext|> b", " " * 5_000 + "'s" + "\x1c" * 9_000, "\x85" * 5_000 + " 1"]
    library = Tokenizer.from_file(public_tokenizers.path(BYTES))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    expected = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    same(tokens.count_tokens(df, public_tokenizers.path(BYTES)), expected)
    short = df.where("doc_id > 4")
    same(tokens.count_tokens(short, public_tokenizers.path(BYTES), chunk=1 << 20), expected[5:])


def test_shingle_hashes_are_xxh64():
    draw = np.random.default_rng(2)
    texts = [draw.bytes(n) for n in [*range(1, 150), 1000, 40_000]]
    end = np.cumsum([len(t) for t in texts])
    got = xxh64(b"".join(texts) + bytes(8), end - [len(t) for t in texts], end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def test_dense_fingerprints_lose_no_link(spark):
    draw = np.random.default_rng(3)
    near = [int(sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False))) for _ in range(900)]
    prints = np.unique(np.array([*near, *(x << 32 for x in range(200)), *draw.integers(0, 1 << 63, 200)], np.uint64))
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    signed = prints.view(np.int64).tolist()
    linked = list(zip(*(x.tolist() for x in np.nonzero(close)), strict=True))
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for list_rows in (8, 64, 1024):
        edges = [(r["x"], r["y"]) for r in simhash.links(df, list_rows=list_rows).collect()]
        at = {p: i for i, p in enumerate(signed)}
        assert plain.groups(len(signed), [(at[a], at[b]) for a, b in edges]) == plain.groups(len(signed), linked)


def embeddings(draw, base, copies, noise):
    x = draw.normal(size=(base, 64))
    return np.concatenate([x, x[: base // 3].repeat(copies, 0) + draw.normal(size=(base // 3 * copies, 64)) * noise, x[:5]]).tolist()


ODD_VECTORS = [(900_000, None), (900_001, [0.0] * 64), (900_002, [float("nan")] * 64), (900_003, [float("inf")] + [1.0] * 63), (900_004, [None] + [1.0] * 63), (900_005, []), (900_006, [1.0, 2.0]), (900_007, [2.0, 4.0]), (900_008, [1e200] * 64), (900_009, [2e200] * 64), (900_010, [1e-200] * 63 + [0.0])]


def vectors(spark, x):
    rows = [*enumerate(x), *ODD_VECTORS, (None, x[0])]
    return spark.createDataFrame([(i, v, 1, 2, 3, "s") for i, v in rows], "vec_id long, embedding array<double>, rep long, copies long, a long, cell string").repartition(6)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 2, "block_rows": 16}, {"hot_rows": 4}])
def test_embedding_links_and_components_are_exact(spark, options):
    x = embeddings(np.random.default_rng(1), 150, 4, 0.05)
    df = vectors(spark, x)
    every = {i: v for i, v in [*enumerate(x), *ODD_VECTORS[8:]]}
    ids = list(every)
    c = plain.cosines([np.array(v) / max(np.abs(v)) for v in every.values()])
    linked = [(i, j) for i in range(len(ids)) for j in range(i) if c[i, j] >= 0.9]
    groups = plain.groups(len(ids), linked)
    expected = {ids[i]: (int((c[i] >= 0.9).sum()) - 1, min(ids[k] for k in g)) for i, g in enumerate(groups)}
    small = {900_006: (1, 900_006), 900_007: (1, 900_006)}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, **options).collect()}
    assert len(got) == df.count()
    for i, r in got.items():
        n, top = (expected | small).get(i, (0, i))
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, top, i is not None and i == top), i


@pytest.mark.parametrize("hot", [64, 1])
def test_embedding_links_reach_their_recall(spark, hot):
    x = embeddings(np.random.default_rng(1), 300, 1, 0.33)
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    c = plain.cosines(x)
    true = (c >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, hot_rows=hot, block_rows=7).collect()}
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum()


def test_neighbours_ranks_ties_and_recall(spark):
    x = embeddings(np.random.default_rng(1), 300, 1, 0.33)
    df = vectors(spark, x)
    c = plain.cosines(x)
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0 or vec_id > 900000")).toPandas()
    assert set(got["query_id"]) == {i for i in range(len(x)) if i % 50 == 0} | {900_006, 900_007, 900_008, 900_009, 900_010}
    assert got["score"].between(-1.0000001, 1.0000001).all()
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1)) and q not in set(rows["vec_id"])
        assert rows.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == rows["vec_id"].tolist()
    assert got[got["query_id"] == 900_006][["vec_id", "rank"]].to_numpy().tolist() == [[900_007, 1]]
    # vectors of the ordinary rows only, for which all cosines are at hand
    own = df.where(f"vec_id < {len(x)}")
    for options in ({}, {"shard_rows": 100, "block_rows": 3}):
        rows = neighbours.nearest(own, own.where("vec_id % 50 = 0"), **options).toPandas().sort_values(["query_id", "rank"])
        hits = 0
        for q, part in rows.groupby("query_id"):
            near = np.where(np.arange(len(x)) == q, -2, c[q])
            hits += len(set(np.lexsort((np.arange(len(x)), -near.round(12)))[:5]) & set(part["vec_id"]))
            assert np.allclose(part["score"], c[q][part["vec_id"]], atol=1e-12, rtol=0)
        assert hits >= 0.9 * len(rows) and len(rows) == 5 * len(range(0, len(x), 50))


def test_inserted_nodes_are_found():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(1500, 64)), draw.normal(size=(1, 64)) + draw.normal(size=(1500, 64)) * 0.05])
    order, levels = neighbours.build(x, compared=256)
    u = unit(x[order]).astype(np.float32)
    number, _ = neighbours.search(u, levels, u[::10], 64)
    best = np.argsort(-(u[::10] @ u.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(best, number, strict=True)]) >= 0.9
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in levels[0])


def plain_bootstrap(rows, rounds=3, least=5, confidence=0.8):
    """kind, value -> score, from (kind, value, seed, doubt, patterns)."""
    edges = collections.defaultdict(lambda: [False, False])
    for kind, value, seed, doubt, patterns in rows:
        for p in patterns:
            e = edges[kind, value, p]
            edges[kind, value, p] = [e[0] or seed, e[1] or doubt]
    values = collections.defaultdict(set)
    for _, v, p in edges:
        values[p].add(v)
    is_ = lambda k, v, p, x: edges[k, v, p][x] if (k, v, p) in edges else False
    known = {}
    for _ in range(rounds):
        trusted = {}
        for p, vs in values.items():
            for k in range(4):
                seeds = sum(is_(k, v, p, 0) for v in vs)
                own = {(v, j): 1.0 if is_(j, v, p, 0) else 0.0 if is_(j, v, p, 1) else known.get((j, v), 0.0) for v in vs for j in range(4)}
                good = sum(own[v, k] for v in vs)
                bad = sum(max([float(is_(k, v, p, 1) and not is_(k, v, p, 0)), *(own[v, j] for j in range(4) if j != k)]) for v in vs)
                if seeds >= least and (c := good / (good + bad + 1)) >= confidence:
                    trusted[p, k] = c
        miss = collections.defaultdict(lambda: 1.0)
        for (k, v, p), (seed, _) in edges.items():
            if not seed and (p, k) in trusted:
                miss[k, v] *= 1 - trusted[p, k]
        known = {key: 1 - m for key, m in miss.items()}
    return {key: s for key, s in known.items() if s >= confidence}


def test_bootstrap_equals_a_plain_one(spark):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(900):
        kind, true = int(draw.integers(4)), draw.random() < 0.6
        patterns = sorted({f"p{kind * 5 + int(draw.integers(5))}" if draw.random() < 0.97 else f"p{int(draw.integers(20))}" for _ in range(3)})
        rows.append((kind, f"v{int(draw.integers(700))}", bool(true), bool(not true and draw.random() < 0.1), patterns))
    found = {(r["kind"], r["value"]): r["score"] for r in pii.bootstrap(spark.createDataFrame(rows, "kind int, value string, seed boolean, doubt boolean, patterns array<string>")).collect()}
    expected = plain_bootstrap(rows)
    assert found.keys() == expected.keys() and len(found) > 20
    assert all(abs(found[k] - s) < 1e-9 for k, s in expected.items())


def test_neighbours_do_not_depend_on_the_cluster(spark, sf_dir, monkeypatch):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    found = []
    for cores, parts in ((2, 3), (64, 8)):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _, n=cores: n))
        found.append(sorted(map(tuple, neighbours.nearest(rows.repartition(parts), asked, shard_rows=120).collect())))
    assert found[0] == found[1] and len(found[0]) == 50


def test_votes_are_those_of_the_nearest_labelled_texts(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    texts = [t or "" for _, t in pairs(docs)]
    terms = np.concatenate([quality._terms([t.encode()]) for t in texts])
    space = terms.astype(np.float64) @ model["weight"]
    near = model["near"].astype(np.float64)
    own, expected = {}, []
    for v in space:
        size = np.linalg.norm(v)
        c = near @ (v / size) if size else np.zeros(len(near))
        best = np.argsort(-c)[:15]
        w = np.maximum(c[best], 0) ** 4
        expected.append((w * model["y"][best]).sum() / w.sum() if w.sum() else model["prior"])
    got = docs.select("doc_id", quality.score(F.col("text"), model, spark).alias("s")).collect()
    # neighbours that are equally near in single precision may change places
    off = np.abs(np.array([r["s"] for r in got]) - expected)
    assert (off < 1e-3).mean() > 0.97 and np.median(off) < 1e-5
    assert not {r["doc_id"] for r in quality._labelled(docs, labels, 4000).collect()} & {r["doc_id"] for r in docs.where(quality.held_out(F.col("doc_id"))).collect()}


def test_votes_of_all_that_are_as_near_as_the_last():
    near = np.array([[1, 0], [1, 0], [1, 0], [0, 1]], np.float32)
    model = {"weight": np.eye(2, dtype=np.float32), "near": near, "y": np.array([1.0, 0.0, 0.0, 1.0]), "prior": 0.5}
    assert quality._vote(model, np.array([[2, 0], [0, 0], [-1, -1]], np.float32), 2).tolist() == [1 / 3, 0.5, 0.5]


def test_deep_urls_cost_no_more_than_flat_ones(spark):
    deep = "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    bad = [(i, f"http://spam.org/{deep}/{'abc'[i % 3]}") for i in range(40)]
    mixed = [(100 + i, f"http://mixed.org/{deep}/m/{'n' if i < 30 else 'o'}/{chr(97 + i % 7)}") for i in range(60)]
    pages = spark.createDataFrame([*bad, *mixed], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, int(i >= 130), 0) for i, _ in mixed], "doc_id long, quality int, toxic int")
    rules = {tuple(r["items"]): r["confidence"] for r in url_filter.mine(pages, labels).collect()}
    assert rules == {("h1:spam",): 1.0, ("p:n",): 1.0}
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert [i for i, v in verdicts.items() if v == "block"] and all((v == "block") == (i < 130) for i, v in verdicts.items())


def test_a_combination_fits_by_any_of_the_items_that_always_occur_together(spark):
    ways = [("http://a.b/one/two", 0), ("http://c.d/one/two", 1), ("http://a.b/three/two", 1)]
    pages = [(i, ways[i % 3][0]) for i in range(90)]
    labels = spark.createDataFrame([(i, ways[i % 3][1], 0) for i, _ in pages], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([*pages, (900, "http://x.b/one"), (901, "http://a.q/one"), (902, "http://x.q/one")], "page_id long, url string")
    rules = {tuple(r["items"]) for r in url_filter.mine(pages, labels).collect()}
    assert rules == {("h0:b", "p:one"), ("h1:a", "p:one")}
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).where("page_id >= 900").collect()}
    assert verdicts == {900: "block", 901: "block", 902: "allow"}


def test_url_host_path_and_rule_equal_their_sql(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    got = url_filter.judge(table(spark, big, "pages"), table(spark, big, "labels"))
    assert differences(got.select("page_id", "host", "path", "rule"), connect(big), url_filter.RULE_SQL) == ""


def test_mined_url_rules_equal_plain_enumeration(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    pages, labels = table(spark, big, "pages"), table(spark, big, "labels")
    bad = {}
    for r in labels.collect():
        bad[r["doc_id"]] = bad.get(r["doc_id"], False) or r["toxic"] == 1 or r["quality"] == 0
    sets = {r["page_id"]: (r["url"], frozenset(r["t"])) for r in pages.select("page_id", "url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    known = [(items, bad[i]) for i, (_, items) in sets.items() if i in bad]
    count = collections.Counter(c for items, b in known if b for n in range(1, len(items) + 1) for c in itertools.combinations(sorted(items), n))
    least, confidence = 5, 0.4
    rules = {}
    for c, n in count.items():
        if n >= least and (share := n / sum(set(c) <= items for items, _ in known)) >= confidence:
            rules[c] = share
    rules = {c: s for c, s in rules.items() if not any(set(d) < set(c) for d in rules)}
    assert rules
    got = {tuple(r["items"]): r["confidence"] for r in url_filter.mine(pages, labels, confidence, least).collect()}
    assert got.keys() == rules.keys() and all(abs(got[c] - rules[c]) < 1e-12 for c in rules)
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels, confidence=confidence, least_pages=least).collect()}
    blocked = {i for i, (rule, verdict) in verdicts.items() if rule is None and verdict == "block"}
    assert blocked == {i for i, (_, items) in sets.items() if verdicts[i][0] is None and any(set(c) <= items for c in rules)} and blocked


def test_personal_data_query(spark, sf_dir):
    rows = pairs(table(spark, sf_dir, "documents"))
    found = {r["doc_id"]: r for r in pii.op5_pii(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        base = plain.base_spans(t or "")
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        r = found[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [kinds.count(k) for k in pii.KINDS]
        assert r["base_sha256"] == plain.sha(base) and set(base.split(",")) <= {*r["spans"].split(","), ""}
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert order == sorted(order)


def test_queries_return_their_columns(spark, sf_dir):
    from labtrail.llm.queries import QUERIES

    columns = {
        "op1_substring_dedup": "doc_id n_words n_removed kept_sha256", "op2_embedding_near_dedup": "vec_id n_links component_id kept", "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op4_nearest_neighbours": "query_id rank vec_id score", "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7_mix_sources": "doc_id domain lang source epoch n_tokens", "op8_simhash_near_dedup": "doc_id fingerprint component_id", "op9_url_filter": "page_id host path rule verdict", "op10_quality_classifier": "doc_id held_out score predicted",
        "op11_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op13_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    }
    rows = {t: table(spark, sf_dir, t).count() for t in ("documents", "embeddings", "pages")}
    for name, query in QUERIES.items():
        got = query(spark, sf_dir)
        assert got.columns == columns[name].split()
        if name.split("_")[0] not in ("op4", "op7", "op11", "op12"):
            assert got.count() == rows["embeddings" if name[:3] == "op2" else "pages" if name[:3] == "op9" else "documents"]


def test_empty_tables(spark, odd):
    none, path = odd.limit(0), public_tokenizers.path
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    sourced = none.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for df in (
        substring_dedup.remove_repeats(none), simhash.near_duplicates(none), tokens.count_tokens(none, path(BYTES)), pieces.encode_decode(none, path(MODEL)), pii.find(none), pii.redact(none),
        mixing.mix(sourced), url_filter.judge(pages, labels), quality.score_documents(none, labels), embedding_dedup.near_duplicates(vectors), neighbours.nearest(vectors, vectors),
    ):
        assert df.collect() == []
