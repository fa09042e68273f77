"""Vectorised text kernels shared by the corpus operators.

Every kernel works on one block of texts laid end to end in a byte array, with
an offsets array saying where each text starts.  Blocks are bounded in bytes, so
a worker's memory does not depend on how many rows Arrow puts into a batch.  A
single text larger than the block size is its own block and is processed whole.

Null texts are empty texts.  Substring hashes are polynomial in the ring of
64-bit integers: with ``P[i] = sum(b[j] * B**j for j < i)`` the hash of bytes
``s`` to ``e`` is ``(P[e] - P[s]) * B**-s``, so equal strings have equal hashes
wherever they stand and any substring costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pow[kind]
    if len(have) < n:
        step = np.full(n, BASE if kind == "up" else BASE_INV, dtype=U64)
        step[0] = 1
        have = _pow[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads polynomial hashes over all 64 bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        column = column.cast(pa.large_binary() if "binary" in str(column.type) else pa.large_string())
        wide = np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to at most ``most`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def batches(table: pa.RecordBatch, text: str = "text", most: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block of a record batch."""
    raw, at = utf8(table.column(text))
    for i, j in blocks(at, most or BLOCK_BYTES):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P of the module's docstring; bytes count from 1, so zeros are seen too."""
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers("up", max(1, len(raw)))[: len(raw)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans; the length is part of the hash."""
    down = _powers("down", max(1, len(p)))
    return (p[end] - p[start]) * down[start] + (end - start).astype(U64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true positions; no run goes over a text's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word."""
    start, end = runs(~_SPACE[raw], offsets)
    return start, end, np.searchsorted(start, offsets)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive word hashes that lie in one text.

    Returns the hashes and each text's first window; window k of a text starts
    at its word k.
    """
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    bound = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.arange(bound[-1]) - np.repeat(bound[:-1] - first[:-1], count)
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = out * U64(BASE) + mix(h[at + k] + U64(k + 1))
    return mix(out), bound


# Classes of code points, for word splitting beyond ASCII.
_classes: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """For each code point 1: letter, 2: number, 3: white space, 0: other."""
    if "all" not in _classes:
        import sys
        import unicodedata

        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(0x110000):
            if 0x3400 < c < 0x4DB5 or 0x4E00 < c < 0x9FF0 or 0xAC00 < c < 0xD7A3 or 0x20000 < c < 0x2A6D0:
                out[c] = 1
            elif c < 0x20000 or 0x2A6D0 <= c < 0x32000:
                kind = unicodedata.category(chr(c))[0]
                out[c] = 1 if kind == "L" else 2 if kind == "N" else 0
        out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        _classes["all"] = out
    return _classes["all"]


def folded() -> np.ndarray:
    """Lower case of each code point of the basic plane where that is one code point."""
    if "low" not in _classes:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x2FFF):
            s = chr(c).lower()
            if len(s) == 1:
                out[c] = ord(s)
        _classes["low"] = out
    return _classes["low"]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the texts' offsets among them."""
    first = (raw & 0xC0) != 0x80
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(first, out=total[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, total[offsets]


def point_hash(points: np.ndarray) -> np.ndarray:
    """As prefix_hash, over code points."""
    out = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * _powers("up", max(1, len(points)))[: len(points)], out=out[1:])
    return out


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, starts and ends of the runs of letters, each text's first run, and the runs' hashes."""
    points, at = code_points(raw, offsets)
    kind = classes()
    start, end = runs(kind[points] == 1, at)
    low = folded()[points]
    return low, start, end, np.searchsorted(start, at), mix(span_hash(point_hash(low), start, end))


class Interned:
    """Word hash to row of a table of floats, filled by a function for words not seen yet.

    ``make(list of words)`` returns an array with a row for each word.  The table
    is emptied when it would hold over ``most`` words, which bounds a worker's
    memory and changes no result.
    """

    def __init__(self, make, width: int, most: int = 300_000) -> None:
        self.make, self.most = make, most
        self.rows: dict[int, int] = {}
        self.values = np.zeros((1024, width), np.float32)

    def look(self, hashes: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of ``values`` for words given by hash and place."""
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.rows) + len(unique) > self.most:
            self.rows.clear()
        keys = unique.tolist()
        rows, base = self.rows, len(self.rows)
        got = np.fromiter((rows.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(got < 0)
        if len(new):
            at = where[new]
            words = [low[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            if base + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((max(base + len(new) - len(self.values), len(self.values)), self.values.shape[1]), np.float32)])
            self.values[base : base + len(new)] = self.make(words)
            got[new] = np.arange(base, base + len(new))
            rows.update(zip(unique[new].tolist(), got[new].tolist(), strict=True))
        return got[back]
