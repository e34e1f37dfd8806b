"""A minimal acyclic transducer from words to id sequences, in one flat buffer that can be memory-mapped.

Words are byte strings, added in ascending order; equal suffixes are shared as they are completed (incremental
construction of the minimal acyclic automaton). Each arc carries an output, the number of accepted words that sort before
those behind it, so adding the outputs along a word's path gives its rank: a minimal perfect hash, pushed as far
towards the root as sharing allows. The rank leads to the word's ids.

Layout, little-endian int32: magic, number of states, arcs, words and ids; then ``first`` (arcs of a state: first[s] to
first[s + 1]), ``final`` (0 or 1 by state), ``label`` (byte), ``target`` and ``output`` by arc, ``at`` (first id of each
word, and the end) and ``ids``.
"""

from __future__ import annotations

import mmap
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np

MAGIC = 0x51544C31


class _Node:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final, self.number, self.words = False, -1, 0


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of (word, ids) entries; words distinct, in ascending order."""
    root = _Node()
    register: dict[tuple, _Node] = {}
    path: list[tuple[_Node, int]] = []  # the arcs of the last word that are not yet shared
    last = b""
    ids: list[int] = []
    at = [0]

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte = path.pop()
            child = parent.arcs[byte]
            key = (child.final, tuple((b, id(n)) for b, n in child.arcs.items()))
            parent.arcs[byte] = register.setdefault(key, child)

    for word, out in entries:
        if at[-1] or len(at) > 1:
            if word <= last:
                raise ValueError("words must be distinct and in ascending order")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        share(common)
        node = path[-1][0].arcs[path[-1][1]] if path else root
        for byte in word[common:]:
            child = node.arcs[byte] = _Node()
            path.append((node, byte))
            node = child
        node.final = True
        last = word
        ids += out
        at.append(len(ids))
    share(0)

    order: list[_Node] = []
    stack = [root]
    while stack:  # numbers in order of discovery; counts of words need children first, hence a second pass
        node = stack.pop()
        if node.number < 0:
            node.number = len(order)
            order.append(node)
            stack.extend(reversed(list(node.arcs.values())))
    done: set[int] = set()
    stack = [root]
    while stack:
        node = stack[-1]
        waiting = [c for c in node.arcs.values() if id(c) not in done]
        if waiting:
            stack.extend(waiting)
            continue
        stack.pop()
        node.words = node.final + sum(c.words for c in node.arcs.values())
        done.add(id(node))
    first, final, label, target, output = [0], [], [], [], []
    for node in order:
        before = int(node.final)
        for byte in sorted(node.arcs):
            child = node.arcs[byte]
            label.append(byte)
            target.append(child.number)
            output.append(before)
            before += child.words
        first.append(len(label))
        final.append(int(node.final))
    head = [MAGIC, len(order), len(label), len(at) - 1, len(ids)]
    return b"".join(np.asarray(x, dtype="<i4").tobytes() for x in (head, first, final, label, target, output, at, ids))


class Lexicon:
    """Lookup in a compiled transducer: bytes, or a file that is mapped into memory and so shared by processes."""

    def __init__(self, source: bytes | str):
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(source).cast("B").cast("i")
        magic, states, arcs, words, ids = view[:5]
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        parts, begin = [], 5
        for n in (states + 1, states, arcs, arcs, arcs, words + 1, ids):
            parts.append(view[begin : begin + n])
            begin += n
        self.first, self.final, self.label, self.target, self.output, self.at, self.all_ids = parts
        self.words = words
        # what the first arc leads to, so that a lookup starts with one step less
        self.start = {label: (self.target[a], self.output[a]) for a, label in enumerate(self.label[: self.first[1]])}

    def rank(self, word: bytes) -> int:
        """The word's number, or -1."""
        first, label = self.first, self.label
        state, rank = self.start.get(word[0], (-1, 0)) if word else (0, 0)
        if state < 0:
            return -1
        for byte in word[1:]:
            end = first[state + 1]
            arc = bisect_left(label, byte, first[state], end)
            if arc == end or label[arc] != byte:
                return -1
            rank += self.output[arc]
            state = self.target[arc]
        return rank if self.final[state] else -1

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None."""
        rank = self.rank(word)
        return None if rank < 0 else self.all_ids[self.at[rank] : self.at[rank + 1]].tolist()
