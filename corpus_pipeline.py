"""A corpus pipeline over documents: each stage takes what the one before it kept, all of it.

Languages are identified and texts without one go, low quality goes, one document of each group of near copies stays, the
sources are mixed to their targets, and what is left is packed into training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import langid, mixing, packing, quality, simhash
from prosemill.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from labels of documents at hand, scores 1/2 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of 5-word shingles are at least 0.8 alike."""
    return simhash.drop_near_copies(docs, n=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's threshold is whole or left out."""
    return mixing.repeated(docs, weights=(3, 1, 2), share=1.5, cap=2.0, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the token pieces of all documents lie in the windows, with checksums of the ids there."""
    return packing.digests(written(sequences(docs), "sequences"))


def sequences(docs: DataFrame) -> DataFrame:
    """Windows of 1024 ids, padded, with the token pieces of all documents."""
    import public_tokenizers

    return packing.sequences_of(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good), ("near_copies", unique), ("mix", mix), ("pack", pack)]

#: Learnt models and tokenisers are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
