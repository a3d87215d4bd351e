"""A minimal acyclic transducer from words to token ids, stored flat so that it can be memory-mapped.

Sorted words are added one by one; when a branch is complete, equal states are merged, so suffixes are
shared. Each transition stores how many words come before it in its state: adding these along a word's path
gives the word's number, which indexes the id lists. That keeps the automaton minimal, as no output is
tied to a state.
"""

from __future__ import annotations

import mmap

import numpy as np

_MAGIC = 0x4C455831


def compile_words(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct ``entries``, as a file holds it."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # stored states: final, (label, target)

    def store(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], list(node[1])))
        return register[key]

    path_nodes: list[list] = [[False, []]]  # of the last word: final, (label, target) of finished branches
    last = b""

    def close(depth: int) -> None:
        while len(path_nodes) > depth + 1:
            target = store(path_nodes.pop())
            path_nodes[-1][1].append((last[len(path_nodes) - 1], target))

    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path_nodes.extend([False, []] for _ in word[shared:])
        path_nodes[-1][0] = True
        last = word
    close(0)
    root = store(path_nodes[0])
    words_below: list[int] = []
    for final, moves in states:  # targets are stored before the states that lead to them
        words_below.append(int(final) + sum(words_below[t] for _, t in moves))
    first, labels, targets, before = [0], [], [], []
    for final, moves in states:
        n = int(final)
        for label, target in moves:
            labels.append(label)
            targets.append(target)
            before.append(n)
            n += words_below[target]
        first.append(len(labels))
    id_first = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])]) if entries else np.zeros(1)
    parts = [first, targets, before, [f for f, _ in states], id_first, [i for _, ids in entries for i in ids]]
    head = [_MAGIC, root, max((len(w) for w, _ in entries), default=0), *map(len, parts)]
    return np.concatenate([np.asarray(x, np.int64) for x in (head, *parts)]).astype("<u4").tobytes() + bytes(labels)


class Lexicon:
    """Reads the file through a memory map, which the workers of an executor share."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        data = memoryview(self.map)
        head = data[:36].cast("I")
        assert head[0] == _MAGIC, f"{path} holds no lexicon"
        self.root, self.longest, at = head[1], head[2], 36
        parts = []
        for n in head[3:]:
            parts.append(data[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.labels_at = at
        self.first, self.targets, self.before, self.final, self.id_first, self.ids = parts

    def get(self, word: bytes) -> list[int] | None:
        if len(word) > self.longest:
            return None
        state, number, at = self.root, 0, self.labels_at
        first, find = self.first, self.map.find
        for i in range(len(word)):
            k = find(word[i : i + 1], at + first[state], at + first[state + 1]) - at
            if k < 0:
                return None
            number += self.before[k]
            state = self.targets[k]
        if not self.final[state]:
            return None
        return list(self.ids[self.id_first[number] : self.id_first[number + 1]])
