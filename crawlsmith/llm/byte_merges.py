"""Byte-level merges of many words at once: one merge of each word a round, the one of lowest rank, leftmost of equal ones."""

from __future__ import annotations

import json
import re

import numpy as np

from crawlsmith.llm.bpe import byte_alphabet

#: Words that the tokenizer's pattern keeps whole: a blank or none, then letters (Latin ones, which every version of its tables knows), and a tail that is a piece of its own.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
LONGEST = 48  # bytes; longer words are rare and left to the library
_NONE = np.int32(2**31 - 1)
_BITS = 19


class ByteMerges:
    """The merges of a tokenizer's file, or None where it has features that these rounds do not know."""

    @classmethod
    def load(cls, path: str) -> ByteMerges | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "fuse_unk"))
        if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        return cls(model)

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left << 32 | right
        # Open addressing: a pair lies at its hash or a few places after it.
        self.keys, self.rank, self.made = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, _NONE, np.int32), np.zeros(1 << _BITS, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        self.reach = 0
        while len(todo):
            free = self.keys[at[todo]] == -1
            won = todo[free][np.unique(at[todo[free]], return_index=True)[1]]
            self.keys[at[won]], self.rank[at[won]], self.made[at[won]] = keys[won], won, made[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)
            self.reach += 1

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the table has each pair; a place without a pair (rank _NONE) where it has not."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        at = self._place(keys)
        for _ in range(self.reach):
            other = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
            if not len(other):
                break
            at[other] = (at[other] + 1) & ((1 << _BITS) - 1)
        return at.reshape(left.shape)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.find(left, right)
        return np.where(self.keys[at] == (left.astype(np.int64) << 32 | right), self.rank[at], _NONE)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin (and the end); words are taken by length, so that a round's arrays have no gaps."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            symbols = self.first[np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(-1, size)] if size else np.zeros((len(own), 0), np.int32)
            ranks = self.ranks(symbols[:, :-1], symbols[:, 1:])
            while len(own):
                if ranks.shape[1] == 0:
                    done = np.ones(len(own), bool)
                else:
                    at = ranks.argmin(axis=1)
                    done = ranks[np.arange(len(own)), at] == _NONE
                found.append((own[done], symbols[done]))
                if done.all():
                    break
                own, symbols, ranks, at = own[~done], symbols[~done], ranks[~done], at[~done]
                n, row = symbols.shape[1], np.arange(len(own))
                made = self.made[self.find(symbols[row, at], symbols[row, at + 1])]
                places = np.arange(n - 1)
                symbols = np.take_along_axis(symbols, places + (places > at[:, None]), axis=1)
                symbols[row, at] = made
                places = np.arange(n - 2)
                ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), axis=1)
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
                ranks[before, at[before] - 1] = self.ranks(symbols[before, at[before] - 1], symbols[before, at[before]])
                ranks[after, at[after]] = self.ranks(symbols[after, at[after]], symbols[after, at[after] + 1])
        counts = np.zeros(len(words), np.int64)
        for own, symbols in found:
            counts[own] = symbols.shape[1]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int32)
        for own, symbols in found:
            out[offsets[own][:, None] + np.arange(symbols.shape[1])] = symbols
        return out, offsets
