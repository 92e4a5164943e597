"""A word lexicon as a minimal acyclic transducer in one memory-mapped file: words in, token ids out.

The words are compiled, in byte order, into the smallest acyclic automaton that accepts them: a state is frozen when no later word can
reach it, and equal frozen states are one, so suffixes are shared. A transition carries an output; the outputs on a word's path
add up to the row of its ids. All transitions are one sorted array of (state, byte) keys; a whole batch of words walks them in
step, one binary search per byte position.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

_FIELDS = (("key", "<i8"), ("start", "<i8"), ("target", "<i4"), ("gain", "<i4"), ("ids", "<u4"), ("final", "u1"))


def compiled(words: Iterable[bytes], ids: dict[bytes, Sequence[int]]) -> bytes:
    """The file of the lexicon of ``words`` (each once, not empty) with the ids of each."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    reachable: list[int] = []  # accepted words from a frozen state
    stack: list[list] = [[False, [], []]]  # open states on the path of the last word: final, bytes, targets

    def freeze(node: list) -> int:
        shape = (node[0], bytes(node[1]), tuple(node[2]))
        state = register.get(shape)
        if state is None:
            state = register[shape] = len(reachable)
            reachable.append(node[0] + sum(reachable[t] for t in node[2]))
        return state

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            state = freeze(stack.pop())
            stack[-1][2].append(state)

    last = b""
    for word in ordered:
        same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close(same)
        for byte in word[same:]:
            stack[-1][1].append(byte)
            stack.append([False, [], []])
        stack[-1][0], last = True, word
    close(0)
    root = freeze(stack[0])
    key, target, gain, final = [], [], [], np.zeros(len(reachable), np.uint8)
    for (accepts, labels, targets), state in register.items():
        final[state], below = accepts, int(accepts)
        for label, t in zip(labels, targets, strict=True):
            key.append(state << 8 | label)
            target.append(t)
            gain.append(below)
            below += reachable[t]
    rows = [list(ids[w]) for w in ordered]
    start = np.cumsum([0] + [len(r) for r in rows])
    arrays = {"key": key, "start": start, "target": target, "gain": gain, "ids": [i for r in rows for i in r], "final": final}
    packed = [np.asarray(arrays[name], kind).tobytes() for name, kind in _FIELDS]
    sizes = [len(arrays[name]) for name, _ in _FIELDS]
    return np.array([root, max(map(len, ordered), default=0), *sizes], "<i8").tobytes() + b"".join(packed)


class Lexicon:
    """A compiled lexicon, mapped read-only: the workers of an executor share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, mode="r")
        head = raw[: 8 * (2 + len(_FIELDS))].view("<i8")
        self.root, self.longest = int(head[0]), int(head[1])
        at = head.nbytes
        for (name, kind), size in zip(_FIELDS, head[2:].tolist(), strict=True):
            width = np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size * width].view(kind))
            at += size * width

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self, words: Sequence[bytes]) -> np.ndarray:
        """Row of each word, -1 for words that are not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        row = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        if not len(live) or not len(self.key):
            return row
        wide = int(sizes[live].max())
        text = np.frombuffer(b"".join([words[k].ljust(wide, b"\0") for k in live.tolist()]), np.uint8).reshape(len(live), wide)
        state, total = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        walking = np.arange(len(live))
        for k in range(wide):
            walking = walking[sizes[live[walking]] > k]
            want = state[walking] << 8 | text[walking, k]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[at] == want
            state[walking[~found]] = -1
            walking, at = walking[found], at[found]
            total[walking] += self.gain[at]
            state[walking] = self.target[at]
        ends = state >= 0
        ends[ends] = self.final[state[ends]] > 0
        row[live[ends]] = total[ends]
        return row

    def packed(self, rows: np.ndarray) -> list[bytes]:
        """Ids of rows as little-endian 32-bit integers."""
        return [self.ids[a:b].tobytes() for a, b in zip(self.start[rows].tolist(), self.start[rows + 1].tolist(), strict=True)]
