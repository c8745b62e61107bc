"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import byte_bpe, chat_prefix, phrase_arrays, pivot_index, prefix_tokens, quality_ngram, residual_packing, secret_links, shard_split, simhash_trie, source_mix, svd_whitening, warc_seq
from quillstack.llm.oracles import SQL
from quillstack.shipping import ensure_on_workers

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.sql("SELECT -1L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"text": text})
    return chat_prefix.read_back(chat_prefix.format_examples(turns.unionByName(added)))


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_ngram.judged(docs, keep=["doc_id"])


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return source_mix.mixed(docs.select("doc_id", "source", "text")).drop("text")


def op5_pivot_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_seq.round_trip(_table(spark, sf_dir, "pages"))


def op7_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.report(_table(spark, sf_dir, "documents"))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return prefix_tokens.with_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, TOKEN_LIMIT, keep=["doc_id"], steps=True)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_split.shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svd_whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_phrase_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_arrays.collocations(_table(spark, sf_dir, "documents"))


def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_on_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_chat_prefix_targets,
        op2_simhash_trie,
        op3_ngram_quality,
        op4_temperature_mix,
        op5_pivot_distance_topk,
        op6_warc_sequential,
        op7_matrix_bpe,
        op8_secret_links,
        op9_prefix_token_counts,
        op10_sampled_splitters,
        op11_svd_whitening,
        op12_phrase_arrays,
        op13_residual_packing,
    )
}

__all__ = ["QUERIES", "SQL"]
