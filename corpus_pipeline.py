"""A training corpus from raw documents: five stages, each of one operator, with a table written between them.

All but the last return whole rows of ``documents``. Null and empty texts are texts without words: no classifier has
anything against them, of several one stays as a near duplicate, and each gets its end of text in the packing. Rows of a null
doc_id go through every stage but the toxicity's and the packing's untouched, as nothing tells them apart; repeated rows of
a doc_id are judged alike until the near duplicates leave one. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from darkslide.llm import decontam, langid, packing, shingles, toxicity
from darkslide.llm.common import table, written

#: SQL can't express the classifiers and the tokenizer; the operators' tests hold them against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_declared_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't surely in another language than the one they declare."""
    return langid.keep_declared(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 of their five-word shingles in common."""
    return shingles.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all texts that are left."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_declared_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads the table that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else written(out)
    return docs
