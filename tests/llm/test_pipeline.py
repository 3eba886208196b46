"""The pipeline's stages against plain expectations on the small tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from prosemill.llm import mixing
from prosemill.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == start.columns
    language, good, unique, mixed, _ = counts
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert language > 0.98 * start.count() and good < language and unique < good and mixed > unique
    # Nearly all documents marked as good are kept by the first two stages.
    kept = corpus_pipeline.good(spark, corpus_pipeline.language(spark, start, SF), SF)
    assert kept.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() > 0.97 * start.join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_mixed_documents_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.exceptAll(docs.unionByName(docs)).count() == 0  # no source is taken more than twice
    words = out.select("source", mixing.n_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    plan = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("size").alias("most"))
    assert plan.join(words, "source").filter("abs(n - t) <= most / 2").count() == plan.count()
