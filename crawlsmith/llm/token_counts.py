"""Token counts through a cache of digests.

Each text is normalised (null to empty; nothing else, as every byte can change the count) and digested;
the digest, with that of the tokenizer's file and the library's version, is joined to the stored counts.
Only distinct texts whose digest is not stored are encoded, and their counts are appended to the cache, a
Parquet folder.

Nulls and edge cases: a null text counts as empty, with 0 tokens; repeated rows are counted once and each
returned; null doc_ids are kept; very long texts are encoded whole; an empty table appends nothing; other
columns are ignored. Two runs that append the same digest leave equal rows, of which one is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._arrow import chunks, text_bytes, texts

CACHE = "digest string, version string, n_tokens bigint"
LIMIT = 4096


class Counter:
    """Counts ids as the file's own library gives them, without added tokens."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda batch: [len(x) for x in model.encode(batch, num_threads=1, add_bos=False, add_eos=False)]
        else:
            model = tokenizers.Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self.count = lambda batch: [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def version(path: str) -> str:
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    return f"{digest}/sentencepiece-{sentencepiece.__version__}/tokenizers-{tokenizers.__version__}"


def _stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:  # the cache's first use
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("version") == tokenizer).select("digest", "n_tokens")


def append_missing(docs: DataFrame, path: str, cache: str) -> None:
    """Encode the distinct texts of ``docs`` that the cache lacks, and append their counts to it."""
    current = version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            digests, column = batch.column(0), batch.column(1)
            for a, b in chunks(text_bytes(column)[0]):
                counts = own.count(texts(column.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([digests.slice(a, b - a), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    digested = _digested(docs)
    missing = digested.groupBy("digest").agg(F.first("text").alias("text"))  # copies go before the shuffle
    missing = missing.join(_stored(docs, cache, current), "digest", "left_anti")
    counted = missing.mapInArrow(run, "digest string, n_tokens bigint")
    counted.select("digest", F.lit(current).alias("version"), "n_tokens").write.mode("append").parquet(cache)


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, the cache having been brought up to date."""
    append_missing(docs, path, cache)
    stored = _stored(docs, cache, version(path)).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return _digested(docs).drop("text").join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
