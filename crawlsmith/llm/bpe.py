"""BPE encoding and decoding with a transducer lexicon of frequent words.

The tokenizer's file gives the vocabulary, the merges and the special strings. Words that are frequent among all words of
all texts, which are counted, and all words of letters that the vocabulary holds whole are compiled once, with their ids, into a minimal
acyclic transducer. Its few MB are broadcast; each executor writes them to one file of its own, which its workers memory-map.
All other words are merged exactly, lowest rank first. The lexicon only saves work: ids never depend on what is in it.

Covers files with: NFC, white space to a blank, lower case; words split by a pattern that no match of
which spans white space; byte-level alphabet; an end-of-word suffix; no decoder (tokens joined by blanks).

Nulls and edge cases: a null text counts as empty and has no ids; very long texts are taken whole, one at
a time; repeated rows and null doc_ids are encoded row by row; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._arrow import chunks, give_back, text_bytes, texts
from crawlsmith.llm._store import Tables
from crawlsmith.llm.lexicon import Lexicon, compile_words

MEMO_WORDS = 150_000  # bound on each of a worker's two generations of remembered words, which go with the task
FREQUENT = 1 << 18  # a word is frequent if it is one in FREQUENT / (its bytes) of all; by that, all frequent words have FREQUENT bytes at most
SCHEMA = "doc_id bigint, ids binary, decoded string"

_WHITE = "\t-\r \x85\xa0  -     　"
_SPLIT_WHITE = re.compile(f"[{_WHITE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() parts words at these, the tokenizer does not


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one free from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Encodes one pre-token at a time, by merges alone."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", _WHITE)).findall

    def merge(self, piece: bytes) -> list[int]:
        parts = [self.alphabet[b] for b in piece]
        parts[-1] += self.suffix
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return [self.vocab[p] for p in parts]


class Memo(dict):
    """Remembers values by key in two generations: the older one goes when the newer one is full."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder(Merger):
    """Whole texts to packed ids (little-endian unsigned 32-bit) and decoded text."""

    def __init__(self, path: str, lexicon: str | None) -> None:
        super().__init__(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.words = Memo(self.word, MEMO_WORDS)
        self.memo = Memo(self.piece, MEMO_WORDS // 2)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def forget(self) -> None:
        """Drops the remembered words."""
        for memo in (self.words, self.memo):
            memo.clear()
            memo.old = {}

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.lexicon.get(raw) if self.lexicon else None
        ids = self.merge(raw) if ids is None else ids
        return pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        return self.piece(word) if word.isalpha() else b"".join([self.memo[p] for p in self.pieces(word)])

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [w for w in _SPLIT_WHITE.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def part(self, text: str) -> bytes:
        """The ids of a text without special strings."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def parts(self, text: str) -> list[str]:
        """A text before, between and after its special strings, and these."""
        return self.splits.split(text) if self.splits and "<" in text else [text]

    def encode(self, text: str) -> bytes:
        if len(parts := self.parts(text)) > 1:
            return b"".join([pack("<I", self.special[p]) if p in self.special else self.part(p) for p in parts])
        return self.part(text)

    def looked_up(self, words: Counter[str]) -> Counter[str]:
        """How often each pre-token of these words is looked for in the lexicon."""
        found: Counter[str] = Counter()
        for word, n in words.items():
            for piece in (word,) if word.isalpha() else self.pieces(word):
                found[piece] += n
        return found

    def decode(self, ids: bytes) -> str:
        """The library's decoding without a decoder: all tokens, joined by blanks."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str, lexicon: bytes | None) -> Encoder:
    """The worker's encoder; its lexicon, if it has one, is a map of the executor's file of that name, which the first worker writes."""
    if (path, name) not in _encoders:
        _encoders.clear()
        if lexicon is None:
            return _encoders.setdefault((path, name), Encoder(path, None))
        folder = os.path.abspath(SparkFiles.getRootDirectory())  # executors name it "."; a rename needs both paths alike
        if not os.path.exists(own := os.path.join(folder, f"{name}.lexicon")):
            with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                f.write(lexicon)
            os.replace(f.name, own)  # never half written
        _encoders[path, name] = Encoder(path, own)
    return _encoders[path, name]


def whole_words(merger: Merger) -> list[str]:
    """All words of letters that the vocabulary holds whole; nothing is counted."""
    byte = {c: b for b, c in enumerate(merger.alphabet)}
    tokens = [t[: len(t) - len(merger.suffix)] for t in merger.vocab if t.endswith(merger.suffix)]
    words = [bytes(map(byte.__getitem__, t)).decode("utf-8", "replace") for t in tokens if set(t) <= set(byte)]
    return [w for w in words if w.isalpha()]


def compiled(merger: Merger, words: list[str]) -> bytes:
    """The transducer of these words."""
    return compile_words([(w, merger.merge(w)) for w in {unicodedata.normalize("NFC", w).encode() for w in words}])


def build_lexicon(docs: DataFrame, path: str) -> bytes:
    """The compiled transducer of the vocabulary's whole words alone, a few MB; the same for any ``docs``, which are not read."""
    merger = Merger(path)
    return compiled(merger, whole_words(merger))


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word and n: how often each pre-token of all texts is encoded. A task counts its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = encoder(path, "", None), Counter()

        def counted() -> pa.RecordBatch:
            found = own.looked_up(words)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            column = batch.column(0)
            for a, b in chunks(text_bytes(column)[0], 4 << 20):
                for text in texts(column.slice(a, b - a)):
                    for part in own.parts(text):
                        if part not in own.special:
                            words.update(own.split(part))
                if len(words) > 2 * MEMO_WORDS:
                    yield counted()
        yield counted()
        give_back()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str) -> list[str]:
    """Words that occur twice or more and are frequent among all words of all ``docs``: FREQUENT bytes at most, as shares add up to one."""
    with Tables(docs.sparkSession) as tables:
        counts = tables.write(word_counts(docs, path), "bpe-words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        frequent = counts.where((F.col("n") > 1) & (F.col("n") * float(FREQUENT) >= F.octet_length("word") * float(total)))
        return [r.word for r in frequent.select("word").toLocalIterator()]


def corpus_lexicon(docs: DataFrame, path: str) -> bytes:
    """The compiled transducer of the frequent words of ``docs`` and the vocabulary's whole words, a few MB."""
    merger = Merger(path)
    return compiled(merger, whole_words(merger) + frequent_words(docs, path))


def encode(docs: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and decoded text of each row of ``docs``."""
    name, shared = hashlib.sha256(lexicon).hexdigest(), docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, name, shared.value)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in chunks(text_bytes(column)[0], 4 << 20):
                packed = [own.encode(t) for t in texts(column.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(packed, pa.binary()), pa.array(map(own.decode, packed), pa.string())], ["doc_id", "ids", "decoded"])
        own.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
