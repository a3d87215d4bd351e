"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

Tokens are runs of letters and digits or of other marks, lower-cased; features are hashes of one and two
consecutive tokens into 2**18 buckets, and of markers for a token that equals the one 1 to REPEATS places back,
as which word is repeated says little. A text's value of a feature is its share of the text's n-grams times
SCALE, so the score is a sparse dot product through the logistic function. Training takes a bounded sample of
labelled texts, in the order of a hash of their ids. Their features lie in PARTS parts in the shared folder; each pass of the
follow-the-regularised-leader updates reads one part after the other, so the driver holds one. The weights (2 MB) are
broadcast for scoring.

Nulls and edge cases: null and empty texts have no features and get the score of the intercept; null labels
are not learnt from; a null doc_id is not held out; of rows that share id, text and label one is learnt from, and conflicting
labels all are, the lesser first; very long texts have at most 2**18 distinct features; ties in the order go by id; without
labelled rows all weights are 0 and scores 0.5; other columns are ignored, labels, lang and source included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._arrow import chunks, text_bytes
from crawlsmith.llm._hashing import combine, finish, lower_table, words
from crawlsmith.llm._store import Tables

TRAIN_ROWS = 20_000  # bound on the labelled rows that are learnt from
PARTS = 8
BITS = 18
REPEATS = 4
SCALE = 100.0
PASSES = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.1
THRESHOLD = 0.7


def token_classes() -> np.ndarray:
    """0: white space; 1: ASCII letters, digits and bytes of other characters; 2: other ASCII."""
    table = np.full(256, 2, np.uint8)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    table[[*range(9, 14), 32]] = 0
    return table


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows a..b: buckets of all n-grams, and the first of each row (and the end)."""
    offsets, data = text_bytes(column)
    table, classes = lower_table(), token_classes()
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        one, first = words(table[data[offsets[a] : offsets[b]]], own, classes)
        if not len(one):
            yield a, b, np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64)
            continue
        row = np.repeat(np.arange(b - a), np.diff(first))
        both = np.empty((len(one), 2 + REPEATS), np.uint64)
        keep = np.zeros(both.shape, bool)
        both[:, 0], keep[:, 0] = one, True
        both[: len(one) - 1, 1], keep[: len(one) - 1, 1] = combine(one, 2), row[1:] == row[:-1]
        for k in range(1, REPEATS + 1):
            both[:, 1 + k] = finish(np.array([k], np.uint64))
            keep[k:, 1 + k] = (one[k:] == one[:-k]) & (row[k:] == row[:-k])
        before = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
        yield a, b, (both[keep] >> np.uint64(64 - BITS)).astype(np.uint32), before[first]


def train(parts: Callable[[], Iterator[list[tuple[np.ndarray, np.ndarray, int]]]]) -> np.ndarray:
    """Weights and, last, the intercept, from (distinct buckets, their counts, label) rows; ``parts`` gives them once a pass."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(PASSES):
        for rows in parts():
            for buckets, count, label in rows:
                at = np.append(buckets.astype(np.int64), bias)
                x = np.append(count * (SCALE / max(int(count.sum()), 1)), 1.0)
                zi, ni = z[at], n[at]
                w = weights(zi, ni)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
    return weights(z, n).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from at most TRAIN_ROWS labelled texts that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_ROWS)
    order = [F.xxhash64("doc_id"), "doc_id", "quality", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buckets, first in features(batch.column(3)):
                pairs = [np.unique(buckets[i:j], return_counts=True) for i, j in zip(first, first[1:], strict=False)]
                packed = [pa.array([x[k].astype(np.uint32).tobytes() for x in pairs], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), *packed], ["doc_id", "quality", "digest", "buckets", "counts"])

    with Tables(docs.sparkSession) as tables:
        # Both lists are bounded by TRAIN_ROWS, so they may be broadcast.
        digested = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
        labelled = digested.join(F.broadcast(known), "doc_id")
        chosen = tables.write(labelled.select("doc_id", "quality", "digest").distinct().orderBy(*order).limit(TRAIN_ROWS), "classifier-rows")
        texts = labelled.join(F.broadcast(chosen), ["doc_id", "quality", "digest"], "left_semi").dropDuplicates(["doc_id", "quality", "digest"])
        rows = texts.select("doc_id", "quality", "digest", "text").mapInArrow(run, "doc_id bigint, quality int, digest string, buckets binary, counts binary")
        rows = tables.write(rows.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(PARTS)).cast("int")), "classifier-features")

        def parts() -> Iterator[list[tuple[np.ndarray, np.ndarray, int]]]:
            for k in range(PARTS):
                own = rows.where(F.col("part") == k).select("h", "doc_id", "quality", "digest", "buckets", "counts").toArrow()
                own = sorted(zip(*(own[c].to_pylist() for c in own.column_names), strict=True))
                yield [(np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint32), y) for _, _, y, _, b, c in own]

        return train(parts)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b, buckets, first in features(batch.column(1)):
                sums = np.concatenate([[0.0], np.cumsum(own[buckets], dtype=np.float64)])
                dot = (sums[first[1:]] - sums[first[:-1]]) * (SCALE / np.maximum(np.diff(first), 1)) + own[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-dot)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``, learnt from its labelled rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
