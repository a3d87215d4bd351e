"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is two files in a folder. ``shard-N.bin`` holds nothing but ids, little-endian unsigned, 16-bit if every
id of the vocabulary fits and else 32-bit, its documents in ascending order of key. ``shard-N.idx``
(little-endian) holds

    magic, keys, rows, tokens, null-key rows, bytes of an id   6 x u64
    displacement of each bucket                  i32 x buckets (keys / 4, rounded up)
    fingerprint of the key of each slot          u32 x keys
    first row and number of rows of each slot    u32 x keys, twice
    first token of each row, and the end         u64 x (rows + 1)
    key of each row                              i64 x rows

A key's bucket is found by one hash; the bucket's displacement d gives its slot, directly (-d - 1) if the
bucket has one key, else by a second hash seeded with d. The fingerprint tells absent keys from present
ones; the row's own key then settles it. Both hashes are splitmix64 finalisers.

Encoding: texts are cut before every blank that a non-blank follows and around line ends, where the
tokenizer's pattern cuts them too; each distinct piece is given to the ``tokenizers`` library once and its ids
are remembered. Words of letters, which most pieces are, are merged in rounds over many at once (``byte_merges``) where the tokenizer is a plain byte-level
one; the ids are the library's. Texts with other white space, or with a special string, go to the library whole.

Nulls and edge cases: a null text counts as empty; rows with a null key come last, after all keys, in order of their text's hash, and can
be read but not looked up; rows that share a key are stored side by side in order of their text and looked up
together; an empty table gives no shard and an empty result; other columns are ignored; a very long text is one row.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlsmith.llm._arrow import chunks, text_bytes, texts
from crawlsmith.llm._store import materialize
from crawlsmith.llm.byte_merges import LONGEST, WORD, ByteMerges

MAGIC = 0x31584449_4E4B4F54
MEMO_PIECES = 500_000  # beyond this a worker's remembered pieces become the older of two generations
BUCKET = 4  # keys a bucket, on average
FEW = 32
_TRIES = np.arange(256)
MANIFEST = "shard string, part int, n_rows bigint, n_tokens bigint, low bigint, high bigint"

#: White space but for blanks and line ends, and the character that marks cuts; the first ones are ASCII.
_WHITE = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_WHITE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def odd(text: str) -> bool:
    """Whether a text has white space that is not one blank, or one or two line ends, between other characters."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n"):
        return True
    return any(c in text for c in _WHITE) or (not text.isascii() and any(c in text for c in _WIDE_WHITE))


def mix64(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """The splitmix64 finaliser of x plus a multiple of the seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and the slot of each of the distinct ``keys``: one slot a key, none free.

    Buckets are placed by size, the fullest first. All of a size try the same displacement at once; those whose
    slots are free and not wanted by a bucket before them stay, the others go on to the next one.
    """
    n = len(keys)
    buckets = -(-n // BUCKET)
    bucket = (mix64(keys, 0) % np.uint64(max(buckets, 1))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    displacement, slot, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        left = np.flatnonzero(sizes == size)
        own = order[starts[left][:, None] + np.arange(size)]
        d = 1
        while len(left) > FEW:
            places = (mix64(keys[own], d) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(places, axis=1)
            fits = np.flatnonzero(~taken[places].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
            wanted, first = np.unique(places[fits], return_index=True)
            won = np.bincount(first // size, minlength=len(fits)) == size
            fits = fits[won]
            displacement[left[fits]], slot[own[fits]] = d, places[fits]
            taken[places[fits]] = True
            stay = np.ones(len(left), bool)
            stay[fits] = False
            left, own, d = left[stay], own[stay], d + 1
        for b, few in zip(left, own, strict=True):  # each by itself, many displacements at once
            at = d
            while True:
                places = (mix64(keys[few][None, :], (at + _TRIES)[:, None]) % np.uint64(n)).astype(np.int64)
                ranked = np.sort(places, axis=1)
                fits = ~taken[places].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    displacement[b], slot[few] = at + k, places[k]
                    taken[places[k]] = True
                    break
                at += len(_TRIES)
    single = np.flatnonzero(sizes == 1)
    slot[order[starts[single]]] = np.flatnonzero(~taken)
    displacement[single] = -slot[order[starts[single]]] - 1
    return displacement, slot


class Index:
    """A shard's index file, and lookups in it."""

    def __init__(self, data: bytes) -> None:
        head = np.frombuffer(data, "<u8", 6)
        assert head[0] == MAGIC, "not an index of token shards"
        n, rows, self.n_tokens, self.null_rows, self.width = (int(x) for x in head[1:])
        at, parts = 48, []
        for kind, k in (("<i4", -(-n // BUCKET)), ("<u4", n), ("<u4", n), ("<u4", n), ("<u8", rows + 1), ("<i8", rows)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        self.n = n
        self.displacement, self.fingerprint, self.first, self.count, self.offset, self.key = parts

    @staticmethod
    def pack(keys: np.ndarray, offsets: np.ndarray, null_rows: int, width: int) -> bytes:
        """From the keys of the rows with one, ascending, and the token offsets of all rows."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        displacement, slot = build_hash(distinct)
        n = len(distinct)
        by_slot = np.empty(n, np.int64)
        by_slot[slot] = np.arange(n)
        fingerprint = (mix64(distinct, 2**32) >> np.uint64(32))[by_slot]
        head = np.array([MAGIC, n, len(offsets) - 1, offsets[-1], null_rows, width], "<u8")
        every = np.concatenate([keys, np.zeros(null_rows, np.int64)])
        parts = [displacement.astype("<i4"), fingerprint.astype("<u4"), first[by_slot].astype("<u4"), count[by_slot].astype("<u4"), offsets.astype("<u8"), every.astype("<i8")]
        return b"".join(x.tobytes() for x in (head, *parts))

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row (-1: absent) and number of rows of each key, in constant time a key."""
        if not self.n:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        d = self.displacement[(mix64(keys, 0) % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -d - 1, (mix64(keys, np.maximum(d, 0)) % np.uint64(self.n)).astype(np.int64))
        first = self.first[slot].astype(np.int64)
        there = (self.fingerprint[slot] == (mix64(keys, 2**32) >> np.uint64(32)).astype(np.uint32)) & (self.key[first] == keys)
        return np.where(there, first, -1), np.where(there, self.count[slot], 0).astype(np.int64)


class PieceEncoder:
    """Packed ids of texts; what the library gave for a piece is remembered in two generations of bounded size."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merges = ByteMerges.load(path)
        self.tails: dict[str, bytes] = {"": b""}

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of each piece."""
        out: dict[str, bytes] = {}
        rest = pieces
        if self.merges is not None:
            rest, own, words, tails = [], [], [], []
            match, known = WORD.fullmatch, self.tails
            for p in pieces:
                if len(p) * 2 <= LONGEST and (m := match(p)):
                    word, tail = m.groups()
                    own.append(p)
                    words.append(word.encode())
                    tails.append(tail)
                else:
                    rest.append(p)
            new = sorted(set(tails).difference(known))
            known.update(zip(new, self.library(new), strict=True))
            # Words with several tails are merged once for each: they are few.
            ids, at = self.merges.ids(words)
            raw, at = ids.astype("<u2" if self.width == 2 else "<u4").tobytes(), (at * self.width).tolist()
            out.update(zip(own, [raw[i:j] + known[t] for i, j, t in zip(at, at[1:], tails, strict=False)], strict=True))
        out.update(zip(rest, self.library(rest), strict=True))
        return out

    def library(self, texts_: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def encode(self, texts_: list[str]) -> list[bytes]:
        cuts = [None if odd(t) or any(s in t for s in self.special) else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t in texts_]
        if len(self.known) > MEMO_PIECES:
            self.known, self.old = {}, self.known
        wanted: set[str] = set()
        for cut in cuts:
            if cut is not None:
                wanted.update(cut)
        known, old = self.known, self.old
        new = []
        for piece in wanted.difference(known):
            if (ids := old.get(piece)) is None:
                new.append(piece)
            else:
                known[piece] = ids
        known.update(self.pieces(new))
        whole = iter(self.library([t for t, cut in zip(texts_, cuts, strict=True) if cut is None]))
        return [next(whole) if cut is None else b"".join(map(known.__getitem__, cut)) for cut in cuts]


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def wide(ids: bytes, width: int) -> bytes:
    """Stored ids as little-endian unsigned 32-bit ones."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes the shards of ``docs`` (doc_id, text) below ``folder`` and returns the manifest, a row a shard.

    A task writes to names of its own attempt and renames them, so a task that runs again leaves whole files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (batch := next(batches, None)) is None:
            return
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():05d}"
        own, keys, offsets, nulls = piece_encoder(tokenizer), [], [0], 0
        width, end = own.width, end_id.to_bytes(own.width, "little")
        with fs.open_output_stream(f"{base}/{name}.bin.{task.taskAttemptId()}") as out:
            while batch is not None:
                column = batch.column(1)
                nulls += batch.column(0).null_count
                keys.append(batch.column(0).drop_null().to_numpy())
                for a, b in chunks(text_bytes(column)[0], 4 << 20):
                    for ids in own.encode(texts(column.slice(a, b - a))):
                        ids += end
                        out.write(ids)
                        offsets.append(offsets[-1] + len(ids) // width)
                batch = next(batches, None)
        keys = np.concatenate(keys)
        with fs.open_output_stream(f"{base}/{name}.idx.{task.taskAttemptId()}") as out:
            out.write(Index.pack(keys, np.array(offsets, np.int64), nulls, width))
        for kind in ("bin", "idx"):
            fs.move(f"{base}/{name}.{kind}.{task.taskAttemptId()}", f"{base}/{name}.{kind}")
        row = [name, task.partitionId(), len(offsets) - 1, offsets[-1], *([int(keys[0]), int(keys[-1])] if len(keys) else [None, None])]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    # Rows without a key are dealt out by their text's hash, so that many of them are many shards.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("spread").asc_nulls_first()]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("spread").mapInArrow(run, MANIFEST), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the number of ids in all shards before; it has a row for each shard."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (packed) of each document, through the index, a task for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = Index(fs.open_input_file(f"{base}/{shard}.idx").read())
                known = len(index.key) - index.null_rows
                keys, at = np.unique(index.key[:known], return_index=True)
                first, count = index.rows(keys)
                if not (np.array_equal(first, at) and int(count.sum()) == known):
                    raise ValueError(f"{shard}: the index does not lead to its rows")
                rows = np.arange(len(index.key))
                rows[:known] = np.repeat(first, count) + rows[:known] - np.repeat(at, count)
                with fs.open_input_file(f"{base}/{shard}.bin") as f:
                    for a in range(0, len(rows), 2000):
                        part = rows[a : a + 2000]
                        low, high = index.offset[part].astype(np.int64), index.offset[part + 1].astype(np.int64)
                        ids = [wide(f.read_at(int(index.width * (h - l)), int(index.width * l)), index.width) for l, h in zip(low, high, strict=True)]  # noqa: E741
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.key[part], mask=part >= known), pa.array(start + low), pa.array(high - low), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    shards = placed(manifest).select("shard", "start")
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def lookup(manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids (packed) of the documents in ``keys`` (doc_id); absent and null keys give no row.

    Shards hold ranges of keys, and all rows of a key lie in one. So a key's shard is found by a binary search in the shards'
    least keys, of which there is one a shard, and a shard's index is opened once.
    """
    bounds = sorted((r.low, r.high, r.shard) for r in manifest.where("low IS NOT NULL").select("shard", "low", "high").toLocalIterator())
    lows, highs = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))
    shared = keys.sparkSession.sparkContext.broadcast((lows, highs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = np.searchsorted(low, key, side="right") - 1
            held = (at >= 0) & (key <= high[np.maximum(at, 0)]) if len(high) else np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], ["doc_id", "at"]).filter(pa.array(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        opened: tuple[int, Index] | None = None
        for batch in batches:
            out_keys, out_ids = [], []
            for key, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if opened is None or opened[0] != k:
                    opened = k, Index(fs.open_input_file(f"{base}/{names[k]}.idx").read())
                index = opened[1]
                (first,), (count,) = index.rows(np.array([key], np.int64))
                with fs.open_input_file(f"{base}/{names[k]}.bin") as f:
                    for row in range(int(first), int(first + count)) if first >= 0 else ():
                        a, b = int(index.offset[row]), int(index.offset[row + 1])
                        out_keys.append(key)
                        out_ids.append(wide(f.read_at(index.width * (b - a), index.width * a), index.width))
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.int64()), pa.array(out_ids, pa.binary())], ["doc_id", "ids"])

    names = [b[2] for b in bounds]
    wanted = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct().mapInArrow(place, "doc_id bigint, at int")
    return wanted.repartition("at").sortWithinPartitions("at", "doc_id").mapInArrow(run, "doc_id bigint, ids binary")
