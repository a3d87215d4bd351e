"""A training-corpus pipeline over the documents table.

Each stage takes what the one before it kept, written as Parquet and read again, and its decisions take effect:
documents that the quality rules reject go, one document of each near-duplicate group stays, repeated passages
are cut out of the texts, sources are dropped or repeated to reach their weights, and the texts are encoded.

Nulls and edge cases: a null or empty text fails the quality rules' least number of words, so no later stage of ``run`` meets one,
though each takes them; null languages and sources are groups of their own; rows without doc_id are judged by their text
and never merged; repeated rows lose all but one in the second stage; ties go by the least doc_id, then by hashes of the row; texts of
any length are taken whole; an empty table gives an empty result; columns other than those of documents are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsmith.llm import bpe, minhash_dedup, mixing, quality_rules, suffix_dedup
from crawlsmith.llm._store import Tables, read

NEAR_PERCENT = 80  # of word shingles; the 85 of op1 is that query's contract


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the fixed rules and are no outliers of their language and source."""
    return quality_rules.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group; rows without words or doc_id stay."""
    return minhash_dedup.keep_one(docs, NEAR_PERCENT)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of passages that also lie anywhere else; a text may become empty."""
    return suffix_dedup.remove(docs, suffix_dedup.PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy in the mix; rows without words are in none."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit), a row for each copy in the mix."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs, path, bpe.corpus_lexicon(docs, path))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("minhash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("mix sources", mix_sources), ("bpe", encode)]

#: Near-duplicate components, byte-level cuts and BPE merges have no SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is dropped when the next one's is written, but for the last that is read."""
    docs, last = read(spark, sf_dir, "documents"), Tables(spark)
    try:
        for name, stage in STAGES[:-1]:
            now = Tables(spark)
            docs = now.write(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            last.drop()
            last = now
    except BaseException:
        last.drop()
        raise
    return STAGES[-1][1](spark, docs, sf_dir)
