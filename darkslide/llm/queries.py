"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, html, langid, lattice, licences, packing, simhash, toxicity
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(langid.page_rows(table(spark, sf_dir, "pages")), langid.fit_text_model(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("page_id"), "language", "probability", "text_language", "declared")


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = ctw.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(table(spark, sf_dir, "documents"), licences.fit_licences())


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), html.fit_extractor())


#: Schemas of the tools that the transcripts may call.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}},
    "calculator": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), TOOLS)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_langid": op2_langid, "op3_lattice": op3_lattice, "op4_ctw": op4_ctw, "op5_simhash": op5_simhash, "op6_licences": op6_licences, "op7_html": op7_html, "op8_chat": op8_chat, "op9_decontam": op9_decontam, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    """The others are learnt models, tokenizers and hashes, which SQL lacks; tests/llm has plain versions of them."""
    return {
        "op3_lattice": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(i, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.j, r.c FROM r JOIN l ON l.i = r.i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT r.i AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, min(r.c) = r.i AS kept FROM r LEFT JOIN n ON n.i = r.i GROUP BY r.i""",
    }
