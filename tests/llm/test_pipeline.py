"""The pipeline stage by stage against plain Python on the smallest tables."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cliplens.llm.language import identify
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_lines import brute as line_dedup
from tests.llm.test_similar import survivors


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["language"] for r in identify(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect()
                  if lang[r["doc_id"]]["score"] >= corpus_pipeline.MIN_SCORE)
    left = line_dedup(rows)
    rows = [(i, left[i][0]) for i, _ in rows if not left[i][2] or left[i][0].strip()]
    alone = set(survivors(rows))
    rows = [(i, t) for i, t in rows if i in alone]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not contamination(t, items)[1]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < docs.count()


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(-1, "...", None, "s", 3), (-2, None, None, "s", 0)], docs.schema)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(more)
    kept = corpus_pipeline.language_id(spark, unlabelled, SF)
    assert kept.count() == 60 and kept.columns == docs.columns
    assert corpus_pipeline.language_id(spark, docs.unionByName(more), SF).where("doc_id < 0").count() == 0
