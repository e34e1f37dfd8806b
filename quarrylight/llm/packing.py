"""Arrays of integers as small binaries: byte planes of the width that the largest value needs, compressed together."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers, small non-negative ones taking least room."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype="<i8")
        top = int(x.view("<u8").max(initial=0))
        width = max(1, -(-top.bit_length() // 8))
        parts += [struct.pack("<BQ", width, len(x)), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    body = b"".join(parts)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", data)
    body, at, out = pa.decompress(data[8:], size, codec="zstd", asbytes=True), 0, []
    while at < size:
        width, n = struct.unpack_from("<BQ", body, at)
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += 9 + n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, the first being its first value; undone by cumsum."""
    return np.diff(x, prepend=0)


def pair_steps(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of pairs in ascending order: w starts anew with every u."""
    first = np.diff(u, prepend=-1) != 0
    return steps(u), np.where(first, w, np.diff(w, prepend=0))


def pairs_of(du: np.ndarray, dw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undoes pair_steps."""
    u, total = np.cumsum(du), np.cumsum(dw)
    first = np.flatnonzero(np.diff(u, prepend=-1) != 0)
    before = total[first] - dw[first]
    return u, total - np.repeat(before, np.diff(np.append(first, len(u))))
