"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsmith.llm import bpe, fingerprints, hard_negatives, html_text, lexical_search, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, token_counts, token_store
from crawlsmith.llm._store import fresh_path, read, shared_dir


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-shards")
    manifest = token_store.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return token_store.read(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs, path, bpe.corpus_lexicon(docs, path))
    count = (F.octet_length("ids") / 4).cast("bigint")
    return out.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One cache for each corpus: counting it again encodes only what is new.
    cache = f"{shared_dir(spark)}/token-counts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(read(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.assess(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_ALL = (op1_minhash_dedup, op2_html_text, op3_token_shards, op4_source_mixing, op5_bpe, op6_token_counts, op7_quality_classifier, op8_suffix_dedup, op9_document_fingerprints, op10_quality_rules, op11_license_scan, op12_hard_negatives, op13_lexical_search)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": mixing.ORACLE_SQL,
    "op9_document_fingerprints": fingerprints.ORACLE_SQL,
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_license_scan": license_scan.oracle_sql(),
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
