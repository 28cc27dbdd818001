"""The pipeline's stages against plain versions of what they decide."""

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from labtrail.llm import mixing, quality
from labtrail.llm.common import materialise, table
from tests.llm import plain


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf_dir), "stage"))
    assert all(df.columns == columns for df in kept[:-1])
    ids = [[r[0] for r in df.select("doc_id").collect()] for df in kept]

    scores = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, table(spark, sf_dir, "labels")).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if scores[i])

    rows = [tuple(r) for r in kept[1].select("doc_id", "text").collect()]
    assert sorted(ids[2]) == sorted({r[2] for r in plain.simhash(rows)})

    before, after = (dict(tuple(r) for r in df.select("doc_id", "text").collect()) for df in kept[2:4])
    assert all(plain.base_spans(t) == "" for t in after.values())
    assert all(after[i] == t for i, t in before.items() if plain.base_spans(t) == "")

    taken = [r[0] for r in mixing.mix(kept[3]).select("doc_id").collect()]
    assert sorted(ids[4]) == sorted(taken)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [tuple(r) for r in kept[4].select("doc_id", "text").collect()]
    expected = sorted((i, len(x), plain.sha(" ".join(map(str, x)))) for i, t in texts for x in [library.encode(t, add_eos=True)])
    assert sorted(tuple(r) for r in kept[5].select("doc_id", "n_tokens", "ids_sha256").collect()) == expected


def test_odd_rows_pass(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, "", "en", "src1", 0), (None, "a b", None, "x", 3), (2, "b " * 500, "en", "src1", 1000), (2, "b " * 500, "en", "src1", 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("th", F.lit(1)).withColumn("score", F.lit("s"))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "odd-stage")
    assert docs.count() <= len(rows)
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, sf_dir), "empty-stage")
    assert empty.count() == 0


def test_texts_of_one_id_and_rows_without_id_stay(spark, sf_dir):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd", "ef")]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (6, texts[0]), (7, texts[1]), (None, texts[2])]
    docs = spark.createDataFrame([(*r, "en", "src1", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_distinct(spark, docs, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, texts[0]), (5, texts[1]), (None, texts[2])], key=str)
    only = docs.where("doc_id is null").unionByName(docs.where("doc_id is null").withColumn("text", F.lit(texts[1])))
    assert corpus_pipeline.mix_sources(spark, only, sf_dir).count() > 0
