"""Suffix-array dedup: every byte of a repeated string of a given length is removed, at each of its places.

A suffix array of the whole corpus would move many times its bytes, so suffixes are first parted into groups
that cannot share a long match with others. In each window of the least length the GRAM-byte string with the least
hash is the window's anchor; equal windows have equal anchors at the same place, so a repeated window lies around
an anchor string that occurs at least twice. Longer windows hold such windows. Several lengths are judged at once.

1. One scan finds each text's anchors and the offsets of the windows whose anchor each is, long texts in overlapping
   stretches. Equal anchors with equal surroundings inside a stretch are settled at once (runs of one word would else
   flood the next steps); equal texts are settled by their digest. From here on a text goes by a number, not its digest.
2. Anchor strings that occur once are dropped, and places of others of which no second one has the same bytes as far to the
   right, or to the left, as its windows reach in any case: (gram, number, place) are shuffled once, all counts are taken there.
   Of the others, the surroundings go to a group: what their own windows hold before the anchor and after, for longer windows
   those that begin like them; where these overlap for equal anchors of a text, they go as one region.
3. Within a group the suffixes at the anchors are merge-sorted. Two suffixes are compared through prefix
   polynomial hashes: binary search finds the length of their common extension, then one byte decides. So runs
   of suffixes that agree in the first r bytes lie together. For each offset o, windows of n bytes that start o bytes
   before an anchor are equal if their anchors are in one run for r = n - o and the o bytes before them are equal.
   Matches are verified byte by byte; a hash collision makes the group start anew without hashes.
4. A group holds about GROUP anchors. The places of one that has more than MOST are first split by what lies around
   them: windows at neighbouring offsets share bytes, and only places that agree in these bytes come together, one of
   each content. Such parts are sorted like the groups; a part that is still too large is split at single offsets,
   where bytes that agree are the window itself. No task holds all places of an anchor.

Nulls and edge cases: a null text counts as empty; shorter texts lose nothing; rows are judged by their
text, so null or repeated doc_ids need no care; equal texts of at least the length lose everything, each copy; an empty
table gives an empty result; a very long text is one row of its task, and scanned STRETCH bytes at a time; other
columns, whatever their names, are ignored, or passed on by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsmith.llm import _hashing
from crawlsmith.llm._arrow import chunks, give_back, text_bytes
from crawlsmith.llm._hashing import finish, prefixes, region_prefixes, spans
from crawlsmith.llm._store import Tables

LENGTH = 400  # the contract of op8
PASSAGE = 250  # bytes; nineteen of twenty passages of over 50 words are longer
GRAM = 64  # a shorter one makes fewer anchors, each of more windows
STRETCH = 1 << 20  # bytes of a long text that are scanned at a time
CACHED = 1 << 14  # hashes that a processor's cache holds
GROUP = 4_000  # anchors that a task sorts at a time, on average
MOST = 40_000  # places of one anchor that a task sorts; they take some 300 MB
BLOCK = 16  # neighbouring window offsets by whose common bytes an anchor's places are split
BROADCAST_IDS = 100_000  # at most about 10 MB of digests are broadcast; more are joined by a shuffle
BROADCAST_NUMBERS = 1_000_000  # the same of texts' numbers, some 20 MB
_HEX_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
ANCHORS = "digest string, settled array<struct<n:int,a:int,b:int>>, anchors array<struct<gram:bigint,pos:int,least:int,most:int,right:smallint,left:smallint>>"


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of values[i : i + width] for each i where that many are left, by doubling, in parts that stay in the cache."""
    out = np.empty(len(values) - width + 1, values.dtype)
    for a in range(0, len(out), CACHED):
        part, done = values[a : a + CACHED + width - 1], 1
        while done < width:
            step = min(done, width - done)
            part = best(part[: len(part) - step], part[step:])
            done += step
        out[a : a + CACHED] = part
    return out


def find_anchors(data: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of the anchors of the texts data[offsets[i] : offsets[i + 1]].

    Also four numbers of each anchor: the least and most offset before it at which windows start whose anchor it is, and 16 bits
    of the hash of what all its windows hold that start near it (the anchor and bytes after), and of those that start far
    before it (bytes before and the anchor); null, as -1, where it has none such.
    """
    none, reach = np.zeros(0, np.int64), shortest - GRAM
    if len(data) < shortest:
        return none, none, np.zeros(0, np.uint64), np.zeros((4, 0), np.int64)
    prefix = prefixes(data)
    hashes, inverse = np.empty(len(data) - GRAM + 1, np.uint64), _hashing.powers(len(prefix))[1]
    for a in range(0, len(hashes), CACHED):
        b = min(a + CACHED, len(hashes))
        hashes[a:b] = finish((prefix[a + GRAM : b + GRAM] - prefix[a:b]) * inverse[a:b])
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    least = _sliding(hashes, reach + 1, np.minimum)  # of the window that starts here
    least[row[: len(least)] != row[shortest - 1 :]] = 0  # windows that reach into the next text do not count
    padded = np.zeros(len(hashes) + reach, np.uint64)
    padded[reach : reach + len(least)] = least
    highest = _sliding(padded, reach + 1, np.maximum)  # over all windows that hold the place
    at = np.flatnonzero((highest == hashes) & (highest != 0))
    # An anchor's windows start side by side: in the first run of windows of its hash that begins no more than the reach before it.
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    ends = np.append(starts[1:], len(least)) - 1
    run = np.searchsorted(ends, at - reach)
    while len(other := np.flatnonzero(least[starts[run]] != hashes[at])):
        run[other] += 1
    low, high = at - np.minimum(ends[run], at), at - np.maximum(starts[run], at - reach)
    half = reach // 2
    right, left = np.full(len(at), -1), np.full(len(at), -1)
    near, far = np.flatnonzero(low <= half), np.flatnonzero(high >= half)
    right[near] = (spans(prefix, at[near], at[near] + shortest - half) >> np.uint64(49)).astype(np.int64)
    left[far] = (spans(prefix, at[far] - half, at[far] + GRAM) >> np.uint64(49)).astype(np.int64)
    return row[at].astype(np.int64), at, hashes[at], np.array([low, high, right, left])


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Ranges a..b of rows, and bytes x..y of their texts: rows together, or parts of one text of over STRETCH bytes.

    A part sees ``most`` bytes more on either side than the bytes start..end that are its own.
    """
    for a, b in chunks(offsets, STRETCH):
        n = int(offsets[b] - offsets[a])
        step = STRETCH if b - a == 1 else n
        for start in range(0, max(n, 1), max(step, 1)):
            end = min(n, start + step)
            yield a, b, max(0, start - most), min(n, end + most), start, end


def scan(column: pa.Array, lengths: Sequence[int]) -> Iterator[tuple[int, int, tuple[list, np.ndarray], list]]:
    """For ranges of rows: settled intervals, the numbers of each anchor, and remaining anchors of each text, at byte places within it."""
    offsets, data = text_bytes(column)
    shortest, longest = min(lengths), max(lengths)
    back = longest - GRAM
    parts: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b, x, y, start, end in stretches(offsets, longest):
        own = np.clip(offsets[a : b + 1] - offsets[a], x, y) - x
        bytes_ = data[offsets[a] + x : offsets[a] + y]
        row, at, gram, numbers = find_anchors(bytes_, own, shortest)
        whole = int(offsets[b] - offsets[a])
        if end - start < whole:
            mine = (at >= start - x) & (at < end - x)
            row, at, gram, numbers = row[mine], at[mine], gram[mine], numbers[:, mine]
        low, high = np.maximum(own[row], at - back), np.minimum(own[row + 1], at + longest)
        around = spans(prefixes(bytes_), low, high) + finish((at - low).astype(np.uint64)) if len(at) else gram
        order = np.lexsort((at, around, row))
        same = np.zeros(len(order), bool)  # as the one before
        same[1:] = (around[order][1:] == around[order][:-1]) & (row[order][1:] == row[order][:-1])
        for k in np.flatnonzero(same):  # verified, as a settled anchor goes no further
            i, j = order[k - 1], order[k]
            same[k] = high[i] - low[i] == high[j] - low[j] and np.array_equal(bytes_[low[i] : high[i]], bytes_[low[j] : high[j]])
        repeated = same.copy()
        repeated[:-1] |= same[1:]
        settled: list[list] = [[] for _ in range(b - a)]
        for i in np.sort(order[repeated & (high[order] - low[order] >= shortest)]):
            r, p, q = int(row[i]), int(low[i] - own[row[i]]) + x, int(high[i] - own[row[i]]) + x
            n = min(q - p, longest)  # windows of at most n bytes are repeated throughout
            if settled[r] and settled[r][-1]["n"] == n and settled[r][-1]["b"] >= p:
                settled[r][-1]["b"] = max(q, settled[r][-1]["b"])
            else:
                settled[r].append({"n": n, "a": p, "b": q})
        left = np.sort(order[~same])
        ends = np.searchsorted(row[left], np.arange(b - a + 1))
        places, grams = (at[left] - own[row[left]] + x).astype(np.int32), gram[left].view(np.int64)
        if end - start == whole:
            yield a, b, (settled, numbers[:, left]), [ends, places, grams]
            continue
        parts.append((settled[0], places, grams, numbers[:, left]))
        if end == whole:
            places, grams, numbers = (np.concatenate([part[k] for part in parts], axis=-1) for k in (1, 2, 3))
            yield a, b, ([[v for part in parts for v in part[0]]], numbers), [np.array([0, len(places)]), places, grams]
            parts = []


def anchored(docs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = pa.list_(pa.struct([("n", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for a, b, (settled, numbers), (ends, places, grams) in scan(batch.column(1), lengths):
                numbers = [pa.array(x.astype(kind), mask=x < 0) for x, kind in zip(numbers, (np.int32, np.int32, np.int16, np.int16), strict=True)]
                fields = pa.StructArray.from_arrays([pa.array(grams), pa.array(places), *numbers], ["gram", "pos", "least", "most", "right", "left"])
                anchors = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(settled, intervals), anchors], ["digest", "settled", "anchors"])
        give_back()

    return docs.where(F.octet_length("text") >= min(lengths)).select("digest", "text").mapInArrow(run, ANCHORS).where("size(settled) > 0 OR size(anchors) > 0")


class Suffixes:
    """The regions around a group's anchors, and comparisons of the suffixes that start at the anchors."""

    def __init__(self, gram: np.ndarray, first: np.ndarray, places: pa.ListArray, around: pa.Array, longest: int = LENGTH) -> None:
        offsets, data = text_bytes(around)
        self.bytes = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ends = places.offsets.to_numpy()
        region = np.repeat(np.arange(len(gram)), np.diff(ends))
        self.region, self.place = region, places.flatten().to_numpy().astype(np.int64)
        self.gram = gram[region]
        self.at = offsets[region] + self.place - first[region]
        self.left = np.minimum(self.at - offsets[region], longest - GRAM)
        self.right = np.minimum(offsets[region + 1] - self.at, longest)
        self.start = offsets[region]
        self.prefix = region_prefixes(self.bytes, offsets)
        self.inverse = _hashing.powers(int(np.diff(offsets).max(initial=1)) + 1)[1]

    def hashed(self, i: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes start..end in the regions of suffixes i."""
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start - self.start[i]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of two suffixes, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        x, y = self.at[i], self.at[j]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            equal = self.hashed(i, x, x + mid) == self.hashed(j, y, y + mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j: by anchor, then by bytes; a prefix comes first."""
        out = self.gram[i] < self.gram[j]
        if len(same := np.flatnonzero(self.gram[i] == self.gram[j])):
            i, j = i[same], j[same]
            n = self.common(i, j)
            shorter = n == np.minimum(self.right[i], self.right[j])
            last = len(self.bytes) - 1
            x, y = self.bytes[np.minimum(self.at[i] + n, last)], self.bytes[np.minimum(self.at[j] + n, last)]
            out[same] = np.where(shorter, self.right[i] < self.right[j], x < y)
        return out

    def sorted(self) -> np.ndarray:
        """Merge sort, all merges of a level at once: a suffix's place is its own plus its rank in the other run."""
        n = len(self.gram)
        order = np.argsort(self.gram, kind="stable")
        place, width = np.arange(n), 1
        while width < n:
            run = place // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            first = low.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) >> 1
                mine, theirs = order[active], order[mid]
                even = run[active] % 2 == 0
                ahead = np.empty(len(active), bool)
                ahead[even] = self.less(theirs[even], mine[even])
                ahead[~even] = ~self.less(mine[~even], theirs[~even])
                low[active] = np.where(ahead, mid + 1, low[active])
                high[active] = np.where(ahead, high[active], mid)
                active = active[low[active] < high[active]]
            to = (run // 2) * 2 * width + (place - run * width) + (low - first)
            merged = np.empty(n, np.int64)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether the n bytes from x and from y are the same, for all given places."""
        for k in range(0, len(n), 2000):
            a, b, m = x[k : k + 2000], y[k : k + 2000], n[k : k + 2000]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            if not (self.bytes[np.repeat(a, m) + within] == self.bytes[np.repeat(b, m) + within]).all():
                return False
        return True


def repeated_windows(s: Suffixes, lengths: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(anchor, length, least, most): offsets before the anchor at which repeated windows of that length start."""
    order = s.sorted()
    lcp = np.full(len(order), -1)
    same = np.flatnonzero(s.gram[order][1:] == s.gram[order][:-1]) + 1
    lcp[same] = s.common(order[same - 1], order[same])
    if not s.equal(s.at[order[same - 1]], s.at[order[same]], lcp[same]):
        return exact_windows(s, lengths)
    best = np.maximum(lcp, np.append(lcp[1:], -1))  # the longest extension that a suffix has in common with any other
    found = []
    for length in lengths:
        partner = np.full(len(order), -1)
        since = np.zeros(len(order), np.int64)
        for o in range(length - GRAM + 2):
            now = np.full(len(order), -1)
            if o <= length - GRAM:
                fits = np.flatnonzero((best >= length - o) & (s.left[order] >= o) & (s.right[order] >= length - o))
                if len(fits) > 1:
                    run = np.cumsum(lcp < length - o)[fits]
                    i = order[fits]
                    key = finish(s.hashed(i, s.at[i] - o, s.at[i])) + run.astype(np.uint64) * _hashing.SEED
                    by = np.argsort(key, kind="stable")
                    pair = np.flatnonzero((key[by][1:] == key[by][:-1]) & (run[by][1:] == run[by][:-1]))
                    now[fits[by[pair]]] = i[by[pair + 1]]
                    now[fits[by[pair + 1]]] = i[by[pair]]
            ended = np.flatnonzero((partner >= 0) & (now != partner))
            back = np.full(len(ended), o - 1)
            if not s.equal(s.at[order[ended]] - back, s.at[partner[ended]] - back, back):
                return exact_windows(s, lengths)
            for k in np.flatnonzero((partner >= 0) & (now < 0)):
                found.append((int(order[k]), length, int(since[k]), o - 1))
            since[(partner < 0) & (now >= 0)] = o
            partner = now
    return found


def exact_windows(s: Suffixes, lengths: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """The same by comparing whole windows, for groups in which hashes collide."""
    found = []
    data = s.bytes.tobytes()
    for length in lengths:
        for o in range(length - GRAM + 1):
            seen: dict[tuple[int, bytes], list[int]] = {}
            for i in np.flatnonzero((s.left >= o) & (s.right >= length - o)):
                start = int(s.at[i]) - o
                seen.setdefault((int(s.gram[i]), data[start : start + length]), []).append(int(i))
            found += [(i, length, o, o) for own in seen.values() if len(own) > 1 for i in own]
    return found


def surroundings(texts: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Regions around the anchors (list of gram, pos, least, most, hot) of texts, which go by their number (doc).

    A row has doc, gram, hot, first (the region's start in the text), places (of the anchors in the text) and around,
    the region's bytes.
    """
    longest = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            pos, gram, least, most = (flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "gram", "least", "most"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((pos, gram, row))
            row, pos, gram, hot = row[order], pos[order], gram[order], flat.field("hot").take(pa.array(order))
            at = offsets[row] + pos
            low, high = at - most[order], np.minimum(offsets[row + 1], at - least[order] + longest)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (low[1:] > high[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(row))
            for k in range(0, len(starts), 4000):
                i, j = starts[k : k + 4000], ends[k : k + 4000]
                around = pa.array([data[x:y].tobytes() for x, y in zip(low[i], high[j - 1], strict=True)], pa.binary())
                places = pa.ListArray.from_arrays(pa.array(np.append(i, j[-1]) - i[0], pa.int32()), pa.array(pos[i[0] : j[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[i])), pa.array(gram[i]), hot.take(pa.array(i)), pa.array(low[i] - offsets[row[i]], pa.int32()), places, around],
                    ["doc", "gram", "hot", "first", "places", "around"],
                )

    return texts.where("anchors IS NOT NULL").select("doc", "text", "anchors").mapInArrow(run, "doc bigint, gram bigint, hot boolean, first int, places array<int>, around binary")


def group_intervals(regions: DataFrame, n: int, lengths: Sequence[int]) -> DataFrame:
    """doc, n, a, b: repeated intervals found in groups of anchors; ``n`` is about the number of anchors."""

    def run(table: pa.Table) -> pa.Table:
        doc = table["doc"].combine_chunks()
        suffixes = Suffixes(table["gram"].to_numpy(), table["first"].to_numpy(), table["places"].combine_chunks(), table["around"].combine_chunks(), max(lengths))
        found = np.array(repeated_windows(suffixes, lengths), np.int64).reshape(-1, 4)
        i, length, least, most = found.T
        a, b = suffixes.place[i] - most, suffixes.place[i] - least + length
        return pa.table({"doc": doc.take(pa.array(suffixes.region[i])), "n": pa.array(length.astype(np.int32)), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})

    buckets = max(1, -(-n // GROUP))
    grouped = regions.select(F.pmod("gram", F.lit(buckets)).alias("bucket"), "doc", "gram", "first", "places", "around")
    return grouped.groupBy("bucket").applyInArrow(run, "doc bigint, n int, a int, b int")


def split(pieces: DataFrame, width: int) -> DataFrame:
    """The windows of ``pieces`` by ``width`` neighbouring offsets, keyed by the bytes that all of them share.

    A piece is a place (id) of an anchor string or part of its places (part) with windows of n bytes at offsets
    least..most before it, and the bytes around, of which ``before`` lie before the place. Blocks start at the same
    offsets everywhere, so places with a window in common have the shared bytes in common; ``content`` is of all bytes of the block.
    """
    digest = lambda *parts: F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)
    number = lambda c: F.encode(F.concat_ws("/", *c), "utf-8")
    slice_ = lambda start, end: F.substring(F.col("around"), F.col("before") - start + 1, start + F.col("n") - end)
    first, last = F.col("block") * width, F.col("block") * width + width - 1
    out = pieces.withColumn("block", F.explode(F.expr(f"sequence(CAST(least div {width} AS INT), CAST(most div {width} AS INT))")))
    out = out.withColumn("q", F.greatest("least", first)).withColumn("p", F.least("most", last))
    shared = digest(number([F.lit("s"), "part", "n", "block"]), slice_(first, last))
    content = digest(number([F.lit("c"), "part", "n", "q", "p"]), slice_(F.col("p"), F.col("q")))
    return out.select("id", "n", "q", "p", shared.alias("part"), content.alias("content"))


def split_intervals(hot: DataFrame, lengths: Sequence[int], tables: Tables) -> tuple[DataFrame, DataFrame]:
    """doc, n, a, b of repeated intervals around anchors with any number of places; and parts that are yet to be sorted."""
    at = hot.withColumn("pos", F.explode("places")).withColumn("low", F.greatest(F.col("first"), F.col("pos") - max(lengths) + GRAM))
    around = F.substring(F.col("around"), F.col("low") - F.col("first") + 1, F.col("pos") + max(lengths) - F.col("low"))
    at = at.select(F.substring(F.unhex(F.sha2(F.concat_ws("/", "doc", "pos", "gram"), 256)), 1, 16).alias("id"), F.col("gram").cast("string").alias("part"), "doc", "pos", (F.col("pos") - F.col("low")).alias("before"), around.alias("around"))
    at = tables.write(at, "suffix-places")
    n = F.explode(F.array(*map(F.lit, lengths)))
    least = F.greatest(F.lit(0), F.col("before") + F.col("n") - F.octet_length("around"))
    pieces = at.withColumn("n", n).withColumn("least", least).withColumn("most", F.least("before", F.col("n") - GRAM)).where("least <= most")
    blocks = tables.write(split(pieces, BLOCK), "suffix-blocks")
    contents = tables.write(blocks.groupBy("part", "content").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "n", "q", "p")).alias("one")), "suffix-contents")
    settled = blocks.join(contents.where("k > 1").select("content"), "content", "left_semi").select("id", "n", "q", "p")
    # One place of each content is enough for the others of a part to be held against.
    parts = contents.groupBy("part").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rest = contents.join(parts, "part").select("part", "held", "one.*").join(at.drop("part"), "id")
    cut = F.substring(F.col("around"), F.col("before") - F.col("p") + 1, F.col("p") - F.col("q") + F.col("n"))
    rest = tables.write(rest.select("id", "part", "held", "doc", "pos", "n", "q", "p", cut.alias("around")), "suffix-parts")
    large = rest.where(f"held > {MOST}").select("id", F.hex("part").alias("part"), "n", F.col("q").alias("least"), F.col("p").alias("most"), F.col("p").alias("before"), "around")
    single = tables.write(split(large, 1), "suffix-single")
    again = single.groupBy("content").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    settled = settled.union(single.join(again, "content", "left_semi").select("id", "n", "q", "p"))
    settled = settled.join(at.select("id", "doc", "pos"), "id").select("doc", "n", (F.col("pos") - F.col("p")).alias("a"), (F.col("pos") - F.col("q") + F.col("n")).alias("b"))
    small = rest.where(f"held <= {MOST}").select("doc", F.xxhash64("part").alias("gram"), (F.col("pos") - F.col("p")).alias("first"), F.array("pos").alias("places"), "around")
    return settled, small


def digested(docs: DataFrame) -> DataFrame:
    """``docs`` as structs (row), with text and digest beside them, whatever the columns are called."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def shared_anchors(scanned: DataFrame, tables: Tables) -> DataFrame:
    """doc, digest, settled and anchors (list of gram, pos, least, most, hot) of texts with an anchor that may be shared, or settled intervals.

    Each text has one row, and a number (doc) that stands for it. ``tables`` are no longer needed when the result is written.
    """
    scanned = tables.write(scanned.withColumn("doc", F.monotonically_increasing_id()), "suffix-scan")
    extra = scanned.select("doc", F.min("doc").over(Window.partitionBy("digest")).alias("least")).where("doc > least").select("doc")
    extra = tables.write(extra, "suffix-extra")
    scanned = scanned.join(F.broadcast(extra) if extra.count() <= BROADCAST_NUMBERS else extra, "doc", "left_anti")
    # One shuffle of narrow rows; grams that occur once go before any other count.
    places = scanned.select("doc", F.explode("anchors").alias("x")).select("doc", "x.*")
    places = places.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("k > 1")
    for side in ("right", "left"):
        places = places.withColumn(f"k_{side}", F.count(side).over(Window.partitionBy("gram", side)))
    flagged = places.where("k_right > 1 OR k_left > 1").groupBy("doc").agg(F.collect_list(F.struct("gram", "pos", "least", "most", (F.col("k") > MOST).alias("hot"))).alias("anchors"))
    return scanned.select("doc", "digest", "settled").join(flagged, "doc", "left").where("anchors IS NOT NULL OR size(settled) > 0")


def repeats(docs: DataFrame, lengths: Sequence[int], tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The number of copies of each text (digest, copies); and digest, text and spans of texts that occur once and lose bytes.

    Spans are a sorted array of n, a, b: bytes a..b of the text lie in repeated strings of n bytes.
    """
    plain = digested(docs.select("text")).select("digest", "text")
    copies = tables.write(plain.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "suffix-copies")
    with Tables(docs.sparkSession) as early:
        marked = tables.write(shared_anchors(anchored(plain, lengths), early), "suffix-marked")
    n, hot, held = marked.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)), F.coalesce(F.max(F.exists("anchors", lambda x: x.hot)), F.lit(False)), F.count(F.lit(1))).first()
    # The digests' shuffle brings each text once to its anchors, and there it stays.
    needed = marked.select("digest")
    texts = plain.join(F.broadcast(needed) if held <= BROADCAST_IDS else needed, "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = tables.write(texts.join(marked, "digest"), "suffix-texts")
    around = surroundings(texts, lengths)
    found = texts.select("doc", F.explode("settled").alias("x")).select("doc", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.col("x.n"))).alias("n"), "x.a", "x.b")
    regions = around.where("NOT hot").drop("hot")
    if hot:
        split_, parts = split_intervals(around.where("hot"), lengths, tables)
        found, regions, n = found.union(split_), regions.unionByName(parts), n + parts.count()
    found = found.union(group_intervals(regions, n, lengths))
    spans_ = found.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("n", "a", "b"))).alias("spans"))
    return copies, texts.where("copies = 1").select("doc", "digest", "text").join(spans_, "doc").drop("doc")


def cut(data: bytes, spans_: list[dict]) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the union of sorted spans, the bytes removed, and maximal removed runs."""
    out, at, removed, runs = [], 0, 0, 0
    end = -1
    for span in spans_:
        a, b = max(span["a"], at), span["b"]
        if span["a"] > end:
            runs += 1
        if b > at:
            out.append(data[at:a])
            removed += b - a
            at = b
        end = max(end, b)
    return b"".join([*out, data[at:]]), removed, runs


def trimmed(repeated: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """digest, and for each length n_removed, n_spans and the remaining bytes of each text in ``repeated``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for k in range(batch.num_rows):
                text, spans_ = data[offsets[k] : offsets[k + 1]].tobytes(), batch.column(2)[k].as_py()
                kept, removed, runs = zip(*(cut(text, [x for x in spans_ if x["n"] == n]) for n in lengths), strict=True)
                cols = [pa.array([removed], pa.list_(pa.int64())), pa.array([runs], pa.list_(pa.int64())), pa.array([kept], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *cols], ["digest", "n_removed", "n_spans", "remaining"])

    return repeated.select("digest", "text", "spans").mapInArrow(run, "digest string, n_removed array<bigint>, n_spans array<bigint>, remaining array<binary>")


def removals(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, by strings of ``length`` bytes.

    Also n_passage_bytes and n_passages, the bytes and maximal runs of repeated strings of ``passage`` bytes.
    """
    with Tables(docs.sparkSession) as tables:
        copies, repeated = repeats(docs, (length, passage), tables)
        done = trimmed(repeated, (length, passage)).withColumn("kept", F.sha2(F.col("remaining")[0], 256)).drop("remaining")
        done = tables.keep(copies.join(done, "digest", "left"), "suffix-removed")
    out = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).join(done, "digest")
    gone = lambda n: (F.col("copies") > 1) & (F.col("n_bytes") >= n)
    count = lambda n, whole, part: F.when(gone(n), whole).otherwise(F.coalesce(part, F.lit(0))).cast("bigint")
    return out.select(
        "doc_id", "n_bytes",
        count(length, F.col("n_bytes"), F.col("n_removed")[0]).alias("n_removed"),
        count(length, F.lit(1), F.col("n_spans")[0]).alias("n_spans"),
        F.when(gone(length), F.lit(_HEX_EMPTY)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        count(passage, F.col("n_bytes"), F.col("n_removed")[1]).alias("n_passage_bytes"),
        count(passage, F.lit(1), F.col("n_spans")[1]).alias("n_passages"),
    )


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the remaining text, and n_chars set anew where there is such a column.

    Characters of which bytes were removed are left out. No row goes.
    """
    with Tables(docs.sparkSession) as tables:
        copies, repeated = repeats(docs, (length,), tables)
        left = trimmed(repeated, (length,)).select("digest", F.col("remaining")[0].alias("remaining")).mapInArrow(_decoded, "digest string, remaining string")
        # Only texts that change are looked up.
        left = tables.keep(copies.where("copies > 1").select("digest", F.lit("").alias("remaining")).unionByName(left), "suffix-remaining")
    out = digested(docs).join(left.withColumnRenamed("digest", "other"), (F.col("digest") == F.col("other")) & (F.octet_length("text") >= length), "left")
    text = F.coalesce("remaining", "row.text")

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        return F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)

    return out.select(*map(column, docs.columns))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()], pa.string())], ["digest", "remaining"])
