"""A minimal acyclic transducer from words (bytes) to lists of ids, laid out for memory mapping.

Built from sorted words by incremental minimisation. The number of words below each state gives every
word its rank (a perfect hash), and the rank finds the ids: outputs need no place on the arcs, so
suffixes are shared whatever their ids are.
"""

from __future__ import annotations

import mmap

import numpy as np

MAGIC = 0x50414C31


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, state], in order of bytes
        self.final = False
        self.number = -1

    def signature(self):
        return (self.final, tuple((b, s.number) for b, s in self.arcs))


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file's bytes for (word, ids) entries; words must be distinct."""
    entries = sorted(entries)
    root, register, done = _State(), {}, []

    def settle(path: list[_State], down_to: int) -> None:
        while len(path) > down_to:
            state = path.pop()
            same = register.get(sig := state.signature())
            if same is None:
                state.number = len(done)
                done.append(state)
                register[sig] = state
            elif path or state is not root:
                (path[-1] if path else root).arcs[-1][1] = same

    path: list[_State] = []
    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(path, common)
        for byte in word[common:]:
            state = _State()
            (path[-1] if path else root).arcs.append([byte, state])
            path.append(state)
        (path[-1] if path else root).final = True
        last = word
    settle(path, 0)
    root.number = len(done)
    done.append(root)
    below: list[int] = []
    first, byte_of, goes, skip, final = [0], [], [], [], []
    for state in done:  # children come before their parents
        count = int(state.final)
        for b, s in state.arcs:
            byte_of.append(b)
            goes.append(s.number)
            skip.append(count)  # words of this state that come before those through the arc
            count += below[s.number]
        below.append(count)
        first.append(len(byte_of))
        final.append(int(state.final))
    ids = [x for _, xs in entries for x in xs]
    ends = np.cumsum([0, *(len(xs) for _, xs in entries)])
    parts = [np.array(x, "<i4") for x in (first, goes, skip, ends, ids)] + [np.array(x, "u1") for x in (byte_of, final)]
    head = np.array([MAGIC, len(done), len(byte_of), len(entries), len(ids)], "<i4")
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """Look-ups in a memory-mapped file of ``compile_lexicon``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, words, ids = np.frombuffer(self._map, "<i4", 5)
        if magic != MAGIC:
            raise ValueError("not a lexicon file")
        at = 20
        out = []
        for kind, n in (("<i4", states + 1), ("<i4", arcs), ("<i4", arcs), ("<i4", words + 1), ("<i4", ids), ("u1", arcs), ("u1", states)):
            out.append(np.frombuffer(self._map, kind, n, at))
            at += out[-1].nbytes
        self.first, self.goes, self.skip, self.ends, self.ids, byte_of, self.final = out
        self._bytes = byte_of.tobytes()
        self.root, self.words = int(states) - 1, int(words)

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it is not in the lexicon."""
        state, rank = self.root, 0
        first, goes, skip, arcs = self.first, self.goes, self.skip, self._bytes
        for byte in word:
            at = arcs.find(byte, first[state], first[state + 1])
            if at < 0:
                return None
            rank += int(skip[at])
            state = int(goes[at])
        return self.ids[self.ends[rank] : self.ends[rank + 1]].tolist() if self.final[state] else None
