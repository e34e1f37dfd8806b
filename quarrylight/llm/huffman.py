"""Canonical length-limited Huffman coding of symbol ids, encoded and decoded by table with numpy.

Code lengths come from the package-merge algorithm, so they are optimal for the limit; codes are canonical (ordered by
length, then symbol), so lengths alone define them. Streams start on a byte boundary and carry, for every ``STEP``
symbols, the bit offset at which they begin; the decoder advances all such stretches of a block side by side.
"""

from __future__ import annotations

import numpy as np

#: Codes are at most this long, longer only if more symbols than this allows are in use.
MAX_BITS = 16
#: Symbols between two bit-offset checkpoints.
STEP = 64


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The code length of every symbol, 0 where its count is 0: at most ``limit``, or one more than the used symbols need."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        limit = int(len(used) - 1).bit_length() + 1
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, deep = 2 * len(order) - 2, np.zeros(len(order), dtype=np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        deep[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = deep
    return lengths


def canonical_codes(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(codes by symbol, as integers of their length; the symbols with a code, by length and then symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    width = np.int64(1) << (limit - lengths[order].astype(np.int64))  # each takes this much of the space of limit bits
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = (np.cumsum(width) - width) >> (limit - lengths[order].astype(np.int64))
    return codes, order


class Codec:
    """Encodes and decodes with the codes that ``lengths`` define."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(MAX_BITS, int(lengths.max(initial=0)))
        #: Bytes that hold a code wherever in a byte it begins.
        self.span = 3 if self.limit <= 17 else 4
        self.codes, order = canonical_codes(lengths, self.limit)
        width = 1 << (self.limit - self.lengths[order])
        self.symbol = np.zeros(1 << self.limit, dtype=np.uint32)
        self.length = np.ones(1 << self.limit, dtype=np.uint8)
        self.symbol[: width.sum()] = np.repeat(order, width)
        self.length[: width.sum()] = np.repeat(lengths[order], width)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Streams of consecutive runs of ids, run i having sizes[i]: (bytes, first byte of each run and the end, checkpoints).

        A checkpoint is the bit offset, from its run's first byte, of every STEP-th symbol of a run, runs one after another."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts = ends - n
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        bits = np.concatenate([ends, [0]])[first[1:] - 1] if len(ids) else np.zeros(len(sizes), np.int64)
        run_start = np.where(sizes > 0, np.concatenate([starts, [0]])[np.minimum(first[:-1], len(ids))], 0)
        run_bits = np.where(sizes > 0, bits - run_start, 0)
        at = np.concatenate([[0], np.cumsum((run_bits + 7) // 8)]).astype(np.int64)
        run = np.repeat(np.arange(len(sizes)), sizes)
        inside = starts - run_start[run]
        where = at[:-1][run] * 8 + inside
        value = self.codes[ids] << (8 * self.span - n - (where & 7))
        byte, total = where >> 3, int(at[-1]) + self.span
        out = np.bincount(byte, weights=value >> (8 * self.span - 8), minlength=total)
        for k in range(1, self.span):
            out += np.bincount(byte + k, weights=(value >> (8 * (self.span - 1 - k))) & 255, minlength=total)
        marks = inside[(np.arange(len(ids)) - first[:-1][run]) % STEP == 0]
        return out[: int(at[-1])].astype(np.uint8).tobytes(), at, marks.astype(np.uint32)

    def decode(self, data: bytes, at: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of all runs of a block, one after another."""
        stretches = -(-sizes // STEP)
        run = np.repeat(np.arange(len(sizes)), stretches)
        number = np.arange(len(run)) - np.concatenate([[0], np.cumsum(stretches)])[:-1][run]
        left = np.minimum(STEP, sizes[run] - number * STEP)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1][run] + number * STEP
        position = at[run] * 8 + marks.astype(np.int64)
        raw = np.frombuffer(data + bytes(self.span), dtype=np.uint8).astype(np.uint32)
        wide = np.zeros(len(raw) - self.span + 1, dtype=np.uint32)
        for k in range(self.span):
            wide = (wide << 8) | raw[k : k + len(wide)]
        spare, mask = 8 * self.span - self.limit, (1 << self.limit) - 1
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        order = np.argsort(-left, kind="stable")  # those that end first come last
        position, first = position[order], first[order]
        alive = np.searchsorted(-left[order], -np.arange(STEP), side="left")  # how many have more than i symbols
        for i in range(STEP):
            m = int(alive[i])
            if not m:
                break
            p = position[:m]
            window = (wide[p >> 3] >> (spare - (p & 7)).astype(np.uint32)) & mask
            out[first[:m] + i] = self.symbol[window]
            p += self.length[window]
        return out
