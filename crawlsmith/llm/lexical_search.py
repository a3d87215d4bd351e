"""Ranked lexical search: the best documents of each item of a stated query set, by NRA over impact-sorted lists.

1. A pass over the documents keeps, for each, its number of terms and the frequencies of those terms that items ask for.
2. Their counts give the terms' weights and the corpus' totals.
3. Documents are searched in shards. A shard has a list for each asked term, sorted by impact, and lists are read in sequence, a batch of growing depth
   at a time. A document's lower bound is the sum of the impacts read; its upper bound adds the next impact of each list in
   which it has not been met. Reading goes on until no document outside the best could still join or tie with them and
   the scores of the best are final; a list that no candidate waits for is left. What a shard's best documents score is where the next shard of the task begins.
4. The best of all tasks are ranked by score and doc_id.

The items are taken in blocks of about ITEM_BYTES of text, so what is sent to every task is bounded; each block meets all documents.

Nulls and edge cases: a null text, of a document or an item, has no term; items without terms, or whose terms no document holds, have no result;
rows without doc_id are documents and come last among equal scores; documents that share an id are apart; an item's repeated rows count
once, and different texts under one item_id are items of their own; very long texts are taken whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm import _hashing
from crawlsmith.llm._arrow import chunks, give_back, text_bytes
from crawlsmith.llm._store import Tables

#: Parameters.
TOP = 10
ITEM_BYTES = 4 << 20
SHARD_DOCS = 16_384
FIRST_BATCH = 64  # entries of a list that are read at first; each next batch is as long as all before
NO_ID = np.iinfo(np.int64).max

_RESULT = "item int, doc_id bigint, score bigint"


def term_classes() -> np.ndarray:
    """1 for bytes of terms: 0-9, A-Z, a-z, and all of other scripts."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = 1
    return table


class Terms:
    """The asked terms: found in texts by hash, and confirmed byte by byte."""

    def __init__(self, words: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum([0, *map(len, words)])
        hashes = _hashing.spans(_hashing.prefixes(self.data), self.ends[:-1], self.ends[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words data[start : end] are asked for, and as which term."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = _hashing.spans(_hashing.prefixes(data), start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[word]]
        size = end[word] - start[word]
        same = size == self.ends[term + 1] - self.ends[term]
        word, term, size = word[same], term[same], size[same]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = data[np.repeat(start[word], size) + step] == self.data[np.repeat(self.ends[term], size) + step]
        good = np.logical_and.reduceat(equal, first) if len(first) else np.zeros(0, bool)
        return word[good], term[good]


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a text column: lower-cased bytes, starts and ends of terms, and the first term of each text (and the end)."""
    offsets, data = text_bytes(column)
    lower, classes = _hashing.lower_table(), term_classes()
    for a, b in chunks(offsets):
        part = lower[data[offsets[a] : offsets[b]]]
        within = offsets[a : b + 1] - offsets[a]
        start, end = _hashing.runs(classes[part], within) if len(part) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield part, start, end, np.searchsorted(start, within)


def frequencies(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in ``words``) and how often the document holds each; all texts whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Terms(words)
        for batch in batches:
            n, sizes, terms, counts = [], [], [], []
            for part, start, end, first in _words(batch["text"]):
                word, term = asked.find(part, start, end)
                doc = np.searchsorted(first, word, side="right") - 1
                pair, k = np.unique(doc * len(words) + term, return_counts=True)
                n.append(np.diff(first))
                sizes.append(np.bincount(pair // max(len(words), 1), minlength=len(first) - 1))
                terms.append(pair % max(len(words), 1))
                counts.append(k)
            offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat(x, kind)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(flat(n, np.int64)), listed(terms, np.int32), listed(counts, np.int64)], ["doc_id", "n", "terms", "counts"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Item:
    """An item's terms and how often it holds each."""

    def __init__(self, terms: np.ndarray, repeats: np.ndarray) -> None:
        self.terms, self.repeats = terms, repeats


class Shard:
    """Impact-sorted lists of some documents; places order as doc_id does."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, docs: int, length: int) -> None:
        self.size = len(n)
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 75 + (75 * n * docs) // max(length, 1)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[doc]))
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, item: Item, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the best, at least all of the shard's TOP that score ``enough``."""
        first, last = self.start[item.terms], self.start[item.terms + 1]
        some = first < last
        first, last, repeats = first[some], last[some], item.repeats[some]
        k = len(first)
        if not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, met = np.zeros(self.size, np.int64), np.zeros((k, self.size), bool)
        touched, at, waits = np.zeros(self.size, bool), first.copy(), np.ones(k, bool)
        depth = FIRST_BATCH
        while True:
            for t in np.flatnonzero(waits & (at < last)):
                upto = min(at[t] + depth, last[t])
                doc = self.doc[at[t] : upto]
                lower[doc] += repeats[t] * self.impact[at[t] : upto]  # a document is in a list once
                met[t, doc] = touched[doc] = True
                at[t] = upto
            depth *= 2
            ahead = np.where(at < last, repeats * self.impact[np.minimum(at, len(self.impact) - 1)], 0)
            known = np.flatnonzero(touched)
            low = lower[known]
            tenth = max(enough, int(np.partition(low, -TOP)[-TOP])) if len(low) >= TOP else enough
            high = low + ahead @ ~met[:, known]
            able = (high >= tenth) & (high > 0)
            open_ = able & (high > low)
            new = int(ahead.sum())
            if not open_.any() and (new < tenth or new == 0):
                return known[able], low[able]
            # Lists that only documents wait for that are out of the race are left.
            waits = (ahead > 0) & ((new >= tenth) | ~met[:, known[open_]].all(1))


def search(found: DataFrame, items: list[Item], weights: np.ndarray, docs: int, length: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: the best of each task's shards, from a table of ``frequencies``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while rows + len(b) >= SHARD_DOCS:
                cut = SHARD_DOCS - rows
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held, rows, b = [], 0, b.slice(cut)
            held, rows = [*held, b], rows + len(b)
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for t in shards(batches):
            t = t.sort_by([("doc_id", "ascending")]).combine_chunks()
            get = lambda name: np.asarray(t[name].combine_chunks().flatten())  # noqa: B023, E731
            sizes = np.diff(np.asarray(t["terms"].combine_chunks().offsets)) if len(t) else np.zeros(0, np.int64)
            ids = t["doc_id"].fill_null(NO_ID).to_numpy()
            shard = Shard(t["n"].to_numpy(), sizes, get("terms"), get("counts"), weights, docs, length)
            for i, item in enumerate(items):
                had_ids, had = best[i]
                place, score = shard.best(item, int(had[-1]) if len(had) == TOP else 1)
                all_ids, scores = np.r_[had_ids, ids[place]], np.r_[had, score]
                order = np.lexsort((all_ids, -scores))[:TOP]
                best[i] = all_ids[order], scores[order]
        sizes = [len(x[0]) for x in best]
        if sum(sizes):
            ids = np.concatenate([x[0] for x in best])
            columns = [pa.array(np.repeat(np.arange(len(items)), sizes).astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([x[1] for x in best]))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])
        give_back()

    return found.mapInArrow(run, _RESULT)


def item_blocks(items: DataFrame, tables: Tables) -> Iterator[DataFrame]:
    """``items`` (item_id, text, without repeats) in parts of about ITEM_BYTES; a longer item is one by itself at least."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // ITEM_BYTES)
    dealt = tables.write(items.withColumn("part", F.expr(f"pmod(xxhash64(item_id, text), {max(parts, 1)})")), "search-items")
    for part in range(parts):
        yield dealt.where(F.col("part") == part).drop("part")


def rank(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of each item."""
    spark = documents.sparkSession
    asked = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    out = []
    with Tables(spark) as tables:
        for block in item_blocks(asked, tables):
            rows = block.orderBy("item_id", "text").collect()  # ITEM_BYTES bound it
            column, words = pa.array([r["text"] for r in rows]), {}
            per: list[np.ndarray] = []
            for part, start, end, first in _words(column):
                raw = part.tobytes()
                places = np.array([words.setdefault(raw[a:b], len(words)) for a, b in zip(start, end, strict=True)], np.int64)
                per += np.split(places, first[1:-1]) if len(first) > 1 else []
            queries = [Item(*np.unique(x, return_counts=True)) for x in per]
            found = tables.write(frequencies(documents, [*words]), "search-frequencies")
            total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            held = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each asked term
            weights = np.zeros(len(words), np.int64)
            for term, df in held:
                weights[term] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1)))
            best = search(found, queries, weights, total[0], total[1])
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
            out.append(tables.keep(top.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-ranked"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = q.term, c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {TOP}
"""
