"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input, under their names and with their values, whatever the names are:
columns that a stage doesn't need are set aside in one column of their own. In all stages a null or empty text, a null doc_id, language or
source, repeated rows, ties and very long texts have a defined result, stated with the stage, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import byte_bpe, quality_ngram, secret_links, simhash_trie, source_mix
from quillstack.llm._tables import aside, by_name, written
from quillstack.shipping import ensure_on_workers


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go.

    Null and empty texts fail; a null language is a language of its own; repeated rows and equal scores fare alike; long texts are judged whole."""
    slim, back = aside(docs, "doc_id", "text", "lang")
    return quality_ngram.judged(slim).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null, empty and blank texts are one group; a null doc_id comes last; of repeated rows one stays; long texts are compared whole."""
    slim, back = aside(docs, "doc_id", "text")
    return simhash_trie.keep_one(slim).select(*back)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are replaced by a mark, and ``n_chars`` follows; every row stays.

    A null text stays null with 0 characters; repeated rows are redacted alike; long texts are scanned whole."""
    slim, back = aside(docs, "doc_id", "text")
    clean = secret_links.redact(slim).select(*back)
    size = F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])
    return clean.withColumn("n_chars", size).select(*by_name(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read once; small sources are read up to twice. Rows are written in the order of reading: by epoch, and within it
    by their place in the permutation, so the files in order of their names are the mixture.

    A null source is a source; null and empty texts have no tokens and are read once or more like any other; a null doc_id is known by its
    text; repeated rows are taken or left together; ties in place are in order of nothing else."""
    slim, back = aside(docs, "doc_id", "text", "source")
    mixed = source_mix.mixed(slim, max_epochs=2.0)
    return mixed.repartitionByRange("epoch", "place").sortWithinPartitions("epoch", "place").select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number, and the digest of what they decode to; other columns are left behind.

    A null text is empty and has no ids; repeated rows are encoded alike; long texts are whole."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    slim = docs.select("doc_id", "lang", "source", "text")
    both = byte_bpe.encode(slim, path, pattern, keep=["doc_id", "lang", "source"], decoded=True)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Fingerprints, perplexity and byte-pair merges have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_on_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
