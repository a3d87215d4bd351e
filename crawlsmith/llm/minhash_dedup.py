"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. Each text becomes the set of hashes of its five-word shingles, a digest of the set, and the K least hashes
   as its sketch. Equal sets (copies) form a class with one representative; only those go on.
2. Inverted lists of retained values give candidates. A linked pair shares at least ``least_common`` of its
   retained values, so it shares one among each side's first K - least_common + 1, in any common
   order; the rarest come first, so passages that many documents share are hardly ever looked up.
3. Short lists are joined by value. Long lists are dealt out by value, size band (linked sets differ little
   in size) and block, compared within a task through the sketches, and only pairs that the estimate passes leave
   it. In the first round each block gives a spanning forest of its estimated links, and the components of several
   lists meet; once its links are confirmed, all estimated pairs that are still in different components follow,
   from every two blocks that do not lie in one component: their full sets come along, so that links are confirmed
   in the task and only a spanning forest of them leaves it. No task holds more than two blocks, which rows and bytes bound.
4. The estimate counts, among the K least values of both sketches together, those in both.
5. Exact Jaccard of the full sets confirms links; components are found by rewriting links to stars.

A class with only few candidates never moves its text: full sets are made anew for candidates alone.

Nulls and edge cases: a null or empty text has an empty set, size 0, and is linked with nothing; a null doc_id
has a null component and is kept; rows that share a doc_id count as one document with several texts, whose links
are joined; ties between values of one frequency go by value; very long texts are hashed one at a time; an empty table gives
an empty result; other columns, whatever their names, are ignored, or passed on by ``keep_one``. A pair at the threshold is missed
if its sketches share fewer than ``least_common`` values, which has a probability of at most MISSED.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm._arrow import chunks, give_back, text_bytes
from crawlsmith.llm._graph import components
from crawlsmith.llm._hashing import combine, finish, lower_table, space_classes, words
from crawlsmith.llm._store import Tables

SHINGLE = 5
K = 64
PERCENT = 85  # links have 100 * intersection >= percent * union; the contract of op1
MISSED = 1e-6  # probability that a pair at the threshold is missed
LIKELY = 0.92  # estimates from here on are almost surely of links
LONG_LIST = 12  # longer lists are compared within tasks, so that pairs to be joined stay few
BLOCK = 2048  # rows of a long list that are compared with each other or with another block in one go
BLOCK_BYTES = 16 << 20  # and bytes of their full sets
THIN = 200_000  # pairs of a spanning forest in the making
BROADCAST_IDS = 200_000  # at most 2 MB of ids are broadcast; more are joined by a shuffle
_TOP = np.uint64(1 << 63)
SIGNATURE = "doc_id bigint, n bigint, digest binary, sketch array<bigint>"


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For ranges of rows: the first row, and each row's sorted distinct shingle hashes (unsigned)."""
    offsets, data = text_bytes(column)
    lower, classes = lower_table(), space_classes()
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        hashes, first = words(lower[data[offsets[a] : offsets[b]]], own, classes)
        whole = combine(hashes, SHINGLE)
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= SHINGLE:
                out.append(np.unique(whole[i : j - SHINGLE + 1]))
            elif j > i:
                out.append(finish(combine(hashes[i:j], j - i) + np.uint64(j - i)))
            else:
                out.append(whole[:0])
        yield a, out


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's longs, in the same order."""
    return (values ^ _TOP).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, digest of the set (null: empty) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1)):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                low = [signed(s[:K]) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), sketches], ["doc_id", "n", "digest", "sketch"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def least_common(percent: int) -> int:
    """How many of the K least values of a linked pair's union both sets hold at least; sketches share these."""
    p, t, missed = percent / 100, 0, 0.0
    while (missed := missed + comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISSED:
        t += 1
    return t


def prefix_length(size: str, n: str, percent: int) -> str:
    """How many values, rarest first, must be looked up so that no linked set is missed."""
    # Short sets are linked through fewer common values: through ``percent`` of their own, and no sketch of a set
    # that may link to one of them leaves any out.
    return f"{size} - least({least_common(percent)}, CAST(ceil({percent} * {n} / 100) AS INT)) + 1"


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """v, rep, n, df: the values under which each representative is looked up, with their number of sets."""
    held = classes.select("rep", "ver", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    common = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(common, "v").groupBy("rep", "ver", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Values of one set only come first in the order; no list needs them.
    shared = shared.withColumn("take", F.expr(f"{prefix_length('s', 'n', percent)} - (s - size(vs))")).where("take > 0")
    return shared.select("rep", "n", F.explode(F.slice("vs", F.lit(1), F.col("take").cast("int"))).alias("x")).select("rep", "n", "x.v", "x.df")


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that share a short list and whose sizes allow a link."""
    sizes_fit = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    short = lists.where(f"df <= {LONG_LIST}").select("v", "rep", "n")
    return short.alias("a").join(short.alias("b"), F.expr(f"a.v = b.v AND a.rep < b.rep AND {sizes_fit}")).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def union_sketch(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> float:
    """Jaccard estimate from the least values of the union of two sketches; exact for whole sets."""
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    distinct = len(both) - len(twice)
    if nx == len(x) and ny == len(y) or distinct <= K and nx <= K and ny <= K:
        return len(twice) / distinct
    k = min(K, distinct)
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    last = both[keep][k - 1]
    return int((twice <= last).sum()) / k


def estimate(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, est of the pairs whose estimate allows a link."""
    least = least_common(percent) / K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            sa, sb = (batch.column(c) for c in (3, 5))
            ea, eb = sa.offsets.to_numpy(), sb.offsets.to_numpy()
            va, vb = sa.values.to_numpy(), sb.values.to_numpy()
            est = np.array([union_sketch(va[ea[i] : ea[i + 1]], na[i], vb[eb[i] : eb[i + 1]], nb[i]) for i in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est, pa.float64())], ["a", "b", "est"]).filter(pa.array(est >= least))

    own = classes.select("rep", "n", "sketch")
    with_a = pairs.join(own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return with_b.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def spanning_forest(est: np.ndarray, i: np.ndarray, j: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs of 0..n make up a spanning forest: likely links first, about the least ids (``low``), then by estimate.

    Stars about few ids become components in few rounds.
    """
    root, kept, left = list(range(n)), [], n - 1

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    likely = est >= LIKELY
    order = np.lexsort((j, i, low, np.where(likely, 0.0, -est), ~likely))
    for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            kept.append(k)
            left -= 1
            if not left:
                break
    return np.array(kept, np.int64)


def values_ahead(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the long lists that each row is in and that come before this one, and where each row's begin."""
    df, v = int(part["df"].iloc[0]), int(part["v"].iloc[0])
    rows = [[x["v"] for x in own if (x["df"], x["v"]) < (df, v)] for own in part["own"]]
    flat = np.array([x for own in rows for x in own], np.int64)
    return np.unique(flat, return_inverse=True)[1].astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


_PART = ["v", "at", "left", "right", "inner"]


def blocks(lists: DataFrame, labels: DataFrame | None, tables: Tables) -> DataFrame:
    """v, df, rep, n, component, home and the part (_PART) of each row of the long lists that is compared there.

    A set is at home in its size band and visits the next one, which holds the sizes it may link to.
    """
    tag = "minhash-blocks"
    most = f"greatest(1, least({BLOCK}, {BLOCK_BYTES} div (8 * big)))"  # rows of a block of sets of at most ``big`` hashes
    part = lambda k: F.pmod(F.xxhash64("v", "rep", "n"), F.coalesce(k, F.lit(1)))
    visits = F.explode(F.array(F.struct(F.col("band").alias("at"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("at"), F.lit(False).alias("home"))))
    many = lambda sizes: sizes.where(f"k > {most}").withColumn("k", F.expr(f"CAST(ceil(k / {most}) AS BIGINT)")).drop("big")
    counted = [F.count(F.lit(1)).alias("k"), F.max("n").alias("big")]
    if labels is None:
        long = lists.withColumn("component", F.col("rep")).withColumn("x", visits).select("v", "df", "rep", "n", "component", "x.at", "x.home")
        large = many(long.groupBy("v", "at").agg(*counted))
        return long.join(large, ["v", "at"], "left").withColumn("left", part(F.col("k"))).withColumn("right", F.col("left")).withColumn("inner", F.lit(True)).drop("k")
    long = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = tables.write(long.groupBy("v", "band", "component").agg(*counted), tag)
    # Large components have blocks of their own; the rest of a list shares some.
    own = many(sizes).withColumnRenamed("k", "ko")
    rest = many(sizes.where(f"k <= {most}").groupBy("v", "band").agg(F.sum("k").alias("k"), F.max("big").alias("big")))
    long = long.join(own, ["v", "band", "component"], "left").join(rest, ["v", "band"], "left")
    long = long.withColumn("block", F.when(F.col("ko").isNotNull(), F.xxhash64("component", part(F.col("ko")))).otherwise(part(F.col("k"))))
    long = tables.write(long.select("v", "df", "band", "rep", "n", "component", "block"), tag)
    held = tables.write(long.groupBy("v", "band", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")), tag)
    # Every two blocks of a band and the next, but for those that lie in one component.
    near = held.withColumn("x", visits).select("v", F.col("block").alias("left"), "x.at", F.col("x.home").alias("same"), F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = near.join(held.withColumnRenamed("band", "at").withColumnRenamed("block", "right"), ["v", "at"])
    pairs = pairs.where("NOT (a = b AND low = high AND a = low) AND (NOT same OR left <= right)").withColumn("inner", F.expr("same AND left = right"))
    # The left block's own band tells it from one of the same number in the next band.
    side = lambda block, band, home: F.struct(F.col(block).alias("block"), band.alias("band"), F.lit(home).alias("home"))
    left, right = side("left", F.expr("IF(same, at, at - 1)"), False), side("right", F.col("at"), True)
    sides = pairs.withColumn("x", F.explode(F.when(F.col("inner"), F.array(right)).otherwise(F.array(left, right))))
    sides = sides.select("v", "at", F.xxhash64("left", "same").alias("left"), "right", "inner", "x.block", "x.band", "x.home")
    return long.join(sides, ["v", "band", "block"]).select("v", "df", "rep", "n", "component", "home", "at", "left", "right", "inner")


def full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, n, hashes: the full set of each of ``classes`` whose representative is among ``nodes`` (rep), made anew from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in shingle_sets(batch.column(1)):
                raw = [s.tobytes() for s in found]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(found)), pa.array(digests, pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array(raw, pa.binary())], ["rep", "digest", "n", "hashes"])
        give_back()

    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(nodes, "rep", "left_semi")
    full = texts.mapInArrow(sets, "rep bigint, digest binary, n bigint, hashes binary").withColumn("ver", F.xxhash64("digest"))
    # A representative may have other texts, and copies of its own.
    return full.join(classes.select("rep", "ver"), ["rep", "ver"], "left_semi").groupBy("rep", "ver").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")).drop("ver")


def links_between(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links of rows i and j are needed to join all components (``label``) that they join."""
    codes = np.unique(label, return_inverse=True)[1]
    root, kept = list(range(int(codes.max(initial=-1)) + 1)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, x, y in zip(range(len(i)), codes[i].tolist(), codes[j].tolist(), strict=True):
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def long_pairs(lists: DataFrame, classes: DataFrame, labels: DataFrame | None, percent: int, tables: Tables, docs: DataFrame | None = None) -> DataFrame:
    """a, b, est of pairs that share a long list and whose estimate allows a link.

    Without ``labels`` a spanning forest of them in each block of a list. With ``labels`` (node, component) and ``docs`` all
    estimated pairs of different components are confirmed on full sets where they are found, and what leaves a task is a
    spanning forest of its links between components.
    """
    least, spanning = least_common(percent) / K, labels is None
    width = -float(np.log(percent / 100))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # Visitors come first; what is compared is one range of those at home, by size.
        part = part.sort_values(["home", "n", "rep"], kind="stable")
        n, rep, label = (part[c].to_numpy() for c in ("n", "rep", "component"))
        visitors = int((~part["home"]).sum())
        if not spanning:
            full = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
            full_start = np.concatenate([[0], np.cumsum([len(x) for x in full])])
            full_values, full_codes = np.unique(np.concatenate(full), return_inverse=True)
            mine_too = np.zeros(len(full_values), bool)
            sketches = [signed(x[:K]) for x in full]
        else:
            sketches = part["sketch"].to_list()
        length = np.array([len(x) for x in sketches])
        start = np.concatenate([[0], np.cumsum(length)])
        values, codes = np.unique(np.concatenate(sketches), return_inverse=True)
        if not spanning:
            ahead, ahead_start = values_ahead(part)
            seen = np.zeros(int(ahead.max(initial=-1)) + 1, bool)
        place = np.arange(len(codes)) - np.repeat(start[:-1], length)  # of a value within its sketch
        at = np.full(len(values), -1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def thinned(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            est, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = spanning_forest(est, i, j, np.minimum(rep[i], rep[j]), len(n))
            return est[keep], i[keep], j[keep]

        home = n[visitors:]
        for i in range(len(n) if part["inner"].iloc[0] else visitors):
            low = i + 1 if i >= visitors else visitors + int(np.searchsorted(home, -(-n[i] * percent // 100)))
            high = visitors + int(np.searchsorted(home, n[i] * 100 // percent, side="right"))
            if high <= low:
                continue
            mine = codes[start[i] : start[i + 1]]
            at[mine] = np.arange(len(mine))
            span = slice(start[low], start[high])
            hit = np.flatnonzero(at[codes[span]] >= 0)
            other = np.searchsorted(start, hit + start[low], side="right") - 1
            first = np.searchsorted(other, np.arange(low, high))
            nth = np.arange(1, len(hit) + 1) - first[other - low]  # how many common values up to this one
            # Rank of a common value in the union: those before it on either side, common ones counted once.
            rank = at[codes[span][hit]] + place[span][hit] + 2 - nth
            at[mine] = -1
            shared = np.bincount(other - low, minlength=high - low)
            k = np.minimum(K, length[i] + length[low:high] - shared)
            est = np.bincount(other - low, rank <= k[other - low], minlength=high - low) / np.maximum(k, 1)
            ok = (est >= least) & (rep[low:high] != rep[i])
            if not spanning:
                ok &= label[low:high] != label[i]
                # A pair that shares several lists is looked at in the first of them only.
                seen[ahead[ahead_start[i] : ahead_start[i + 1]]] = True
                before = np.concatenate([[0], np.cumsum(seen[ahead[ahead_start[low] : ahead_start[high]]])])
                bounds = ahead_start[low : high + 1] - ahead_start[low]
                ok &= before[bounds[1:]] == before[bounds[:-1]]
                seen[ahead[ahead_start[i] : ahead_start[i + 1]]] = False
                if ok.any():  # how much of the full sets is common
                    mine_too[full_codes[full_start[i] : full_start[i + 1]]] = True
                    upto = np.concatenate([[0], np.cumsum(mine_too[full_codes[full_start[low] : full_start[high]]])])
                    mine_too[full_codes[full_start[i] : full_start[i + 1]]] = False
                    ends = full_start[low : high + 1] - full_start[low]
                    both = upto[ends[1:]] - upto[ends[:-1]]
                    ok &= 100 * both >= percent * (n[i] + n[low:high] - both)
            if (j := np.flatnonzero(ok)).size:
                found.append((est[j], np.full(j.size, i, np.int32), (j + low).astype(np.int32)))
                pending += j.size
            if spanning and pending > THIN:
                found, pending = [thinned(found)], 0
        if not found:
            return pd.DataFrame({"a": [], "b": [], "est": []}).astype({"a": "int64", "b": "int64", "est": "float64"})
        if spanning:
            est, i, j = thinned(found)
        else:
            est, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            kept = links_between(label, i, j)
            est, i, j = est[kept], i[kept], j[kept]
        return pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "est": est})

    long = lists.where(f"df > {LONG_LIST}").withColumn("band", F.floor(F.log("n") / width))
    parts = blocks(long, labels, tables)
    if labels is None:
        parts = parts.join(classes.select("rep", "n", "sketch"), ["rep", "n"]).select(*_PART, "home", "rep", "n", "sketch", "component")
    else:
        parts = tables.write(parts, "minhash-block-rows")
        nodes = tables.write(parts.select("rep").distinct(), "minhash-nodes")
        full = tables.write(full_sets(docs, nodes, classes), "minhash-sets")
        parts = parts.join(long.groupBy("rep", "n").agg(F.collect_list(F.struct("df", "v")).alias("own")), ["rep", "n"]).join(full, ["rep", "n"])
        parts = parts.select(*_PART, "df", "home", "rep", "n", "hashes", "component", "own")
    return parts.groupBy(*_PART).applyInPandas(run, "a bigint, b bigint, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """a, b of the pairs (a, b) whose full sets are linked."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    pairs = tables.write(pairs.select("a", "b"), "minhash-pairs")
    nodes = tables.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "minhash-nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    full = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(nodes, "doc_id", "left_semi").mapInArrow(sets, "node bigint, hashes binary")
    full = tables.write(full, "minhash-sets")
    with_a = pairs.join(full.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    with_b = with_a.join(full.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return with_b.select("a", "b", "ha", "hb").mapInArrow(verify, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; links have a Jaccard of ``percent`` or more."""
    with Tables(docs.sparkSession) as tables:
        return tables.keep(grouped(docs, percent, tables), "minhash-groups")


def grouped(docs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """The rows of ``near_duplicates``, read from ``tables``."""
    signed_docs = tables.write(signatures(docs), "minhash-signatures")
    reps = signed_docs.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = tables.write(reps, "minhash-classes")
    # One row of each class: its representative's, which may come several times.
    classes = signed_docs.join(reps.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
    classes = classes.select("rep", F.xxhash64("digest").alias("ver"), "n", "sketch")
    repeated = signed_docs.where("digest IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 AND doc_id IS NOT NULL")
    classes = tables.write(classes.dropDuplicates(["rep", "ver"]) if repeated.limit(1).count() else classes, "minhash-reps")
    lists = tables.write(inverted_lists(classes, percent), "minhash-lists")
    candidates = estimate(short_pairs(lists, percent), classes, percent).union(long_pairs(lists, classes, None, percent, tables)).groupBy("a", "b").agg(F.max("est").alias("est"))
    candidates = tables.write(candidates, "minhash-candidates")
    # First each node's best pairs, of likely links those to the least ids, which soon meet in stars; what then still
    # parts components is confirmed pair by pair.
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("likely"), F.when(F.col("likely"), F.col("a")), F.desc("est"), "a", "b"))
    ends = candidates.select(F.col("a").alias("node"), "*").union(candidates.select(F.col("b").alias("node"), "*")).withColumn("likely", F.col("est") >= LIKELY)
    first = ends.withColumn("place", best).where("place <= 3").select("a", "b").distinct()
    same_id = signed_docs.where("doc_id IS NOT NULL").join(reps, "digest").join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    links = tables.write(confirmed(first, docs, percent, tables).union(same_id), "minhash-links")
    labels = components(links, tables)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    more = candidates.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    within = long_pairs(lists, classes, labels, percent, tables, docs).select("a", "b")
    more = tables.write(confirmed(more, docs, percent, tables).union(within).distinct(), "minhash-links")
    # Components that these links join are few: only their names go through the rounds again.
    joins = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    if more.limit(1).count():
        joined = components(joins, tables).select(F.col("node").alias("c_"), F.col("component").alias("joined"))
    else:
        joined = labels.where("false").select(F.col("node").alias("c_"), F.col("component").alias("joined"))
    out = signed_docs.join(reps, "digest", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = out.join(joined, F.col("component") == F.col("c_"), "left").withColumn("component", F.coalesce("joined", "component"))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of one document, that of the least doc_id, for each group of near-duplicates.

    A document goes if one of its texts is linked to one of a lesser doc_id. Of rows that share doc_id and text one stays,
    that with the least hash of all columns; rows without doc_id stay.
    """
    with Tables(docs.sparkSession) as tables:
        found = tables.write(grouped(docs, percent, tables), "minhash-groups")
        ids = found.where("doc_id IS NOT NULL")
        gone = tables.keep(ids.where("NOT kept").select("doc_id").distinct(), "minhash-gone")
        again = tables.keep(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "minhash-repeated")
        n_gone, n_again = gone.count(), again.count()
    bounded = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    left = docs.join(bounded(gone, n_gone), docs["doc_id"] == gone["doc_id"], "left_anti")
    if not n_again:
        return left
    repeated = left.join(bounded(again, n_again), left["doc_id"] == again["doc_id"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = repeated.select(F.col("doc_id").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"), row.alias("row")).groupBy("i", "t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return left.join(bounded(again, n_again), left["doc_id"] == again["doc_id"], "left_anti").unionByName(one.select("row.*"))
