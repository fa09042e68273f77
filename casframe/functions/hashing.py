"""Keyed Blake3 over Arrow batches, and keyed chunk hashes.

Blake3 is computed for all 1024-byte chunks of a batch at once with NumPy; chunk
values merge into a tree level by level.  SHA-256 (native) stays the default
identity of chunks; Blake3 is for callers that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Initial words, word order and the protocol's keys.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
DATA_KEY = bytes([102, 151, 245, 119, 91, 149, 80, 222, 49, 53, 203, 172, 165, 151, 24, 28, 157, 228, 33, 16, 155, 235, 43, 88, 180, 208, 176, 75, 147, 173, 242, 41])
INTERNAL_NODE_KEY = bytes([1, 126, 197, 199, 165, 71, 41, 150, 253, 148, 102, 102, 180, 138, 2, 230, 93, 221, 83, 111, 55, 199, 109, 210, 248, 99, 82, 230, 74, 83, 113, 63])
VERIFICATION_KEY = bytes([127, 24, 87, 214, 206, 86, 237, 102, 18, 127, 249, 19, 231, 165, 195, 243, 164, 205, 38, 213, 181, 219, 73, 230, 65, 36, 152, 127, 40, 251, 148, 195])
FILE_KEY = bytes(32)
_START, _END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Eight output words for each column of (8, n) chaining values and (16, n) message words."""
    n = cv.shape[1]
    v = [cv[i] for i in range(8)] + [np.full(n, IV[i]) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[i] for i in range(16)]

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, (r, s) in ((x, (16, 12)), (y, (8, 7))):
            v[a] = v[a] + v[b] + word
            v[d] = _turn(v[d] ^ v[a], r)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], s)

    for step in range(7):
        for i in range(4):
            mix(i, i + 4, i + 8, i + 12, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if step < 6:
            m = [m[k] for k in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3(messages: list[bytes], key: bytes | None = None) -> list[bytes]:
    """32-byte digests; keyed if a 32-byte key is given."""
    if not messages:
        return []
    keyed = _KEYED if key is not None else 0
    base = np.frombuffer(key, "<u4").astype(np.uint32) if key is not None else IV
    sizes = np.array([len(m) for m in messages], np.int64)
    counts = np.maximum(1, -(-sizes // CHUNK))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    owner = np.repeat(np.arange(len(messages)), counts)
    number = np.arange(total) - np.repeat(first[:-1], counts)
    length = np.minimum(CHUNK, sizes[owner] - number * CHUNK)
    data = np.zeros((total, CHUNK), np.uint8)
    for k, m in enumerate(messages):
        data[first[k] : first[k + 1]].reshape(-1)[: len(m)] = np.frombuffer(m, np.uint8)
    words = data.view("<u4").reshape(total, 16, 16)
    blocks = np.maximum(1, -(-length // BLOCK))
    cv = np.repeat(base[:, None], total, axis=1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = keyed | (_START if b == 0 else 0) | np.where(last, _END, 0) | np.where(last & (counts[owner[live]] == 1), _ROOT, 0)
        cv[:, live] = _compress(cv[:, live], words[live, b].T, number[live], np.where(last, length[live] - b * BLOCK, BLOCK), flags)
    nodes = [cv[:, first[k] : first[k + 1]] for k in range(len(messages))]
    while any(x.shape[1] > 1 for x in nodes):
        todo = [k for k, x in enumerate(nodes) if x.shape[1] > 1]
        pairs = [nodes[k].shape[1] // 2 for k in todo]
        left = np.concatenate([nodes[k][:, : 2 * p : 2] for k, p in zip(todo, pairs, strict=True)], axis=1)
        right = np.concatenate([nodes[k][:, 1 : 2 * p : 2] for k, p in zip(todo, pairs, strict=True)], axis=1)
        root = np.concatenate([np.full(p, _ROOT if nodes[k].shape[1] == 2 else 0) for k, p in zip(todo, pairs, strict=True)])
        n = left.shape[1]
        up = _compress(np.repeat(base[:, None], n, axis=1), np.concatenate([left, right]), np.zeros(n, np.int64), np.full(n, BLOCK), keyed | _PARENT | root)
        at = 0
        for k, p in zip(todo, pairs, strict=True):
            odd = nodes[k][:, -1:] if nodes[k].shape[1] % 2 else nodes[k][:, :0]
            nodes[k] = np.concatenate([up[:, at : at + p], odd], axis=1)
            at += p
    return [x[:, 0].astype("<u4").tobytes() for x in nodes]


def blake3_column(key: bytes | None = None):
    """An Arrow-batched column function: digest of a binary column, NULL for NULL."""

    @F.pandas_udf(BinaryType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for i in range(0, len(part), 256):  # bounds the padded block
                rows = part.iloc[i : i + 256]
                done = iter(blake3([bytes(x) for x in rows if x is not None], key))
                out += [None if x is None else next(done) for x in rows]
            yield pd.Series(out, index=part.index, dtype=object)

    return run


def _split(level: list[tuple[bytes, int]], least: int, most: int, branching: int) -> tuple[list[list[tuple[bytes, int]]], list[tuple[bytes, int]]]:
    """Groups of children that are closed, whatever follows, and the open rest."""
    groups, own = [], []
    for child in level:
        own.append(child)
        if len(own) >= most or len(own) >= least and int.from_bytes(child[0][-8:], "little") % branching == 0:
            groups.append(own)
            own = []
    return groups, own


def _nodes(groups: list[list[tuple[bytes, int]]]) -> list[tuple[bytes, int]]:
    out = []
    for i in range(0, len(groups), 16384):  # bounds the padded block
        part = groups[i : i + 16384]
        texts = ["".join(f"{h.hex()} : {n}\n" for h, n in g).encode() for g in part]
        out += [(h, sum(n for _, n in g)) for h, g in zip(blake3(texts, INTERNAL_NODE_KEY), part, strict=True)]
    return out


def merkle_roots(lists: list[list[tuple[bytes, int]]], least: int = 2, most: int = 9, branching: int = 4) -> list[bytes]:
    """Root of each ordered list of (hash, size); the nodes that all lists have on a level are hashed together.

    Groups end after a child whose last hash word is a multiple of ``branching``,
    with ``least`` to ``most`` children, so that an edit moves few groups.  A node is
    the keyed hash of its children's ``hash : size`` lines.  The rule is this
    library's own; hashes of other systems are not reproduced.
    """
    levels = list(lists)
    while todo := [k for k, level in enumerate(levels) if len(level) > 1]:
        parts = []
        for k in todo:
            groups, own = _split(levels[k], least, most, branching)
            parts.append([*groups, own] if own else groups)
        nodes = iter(_nodes([g for part in parts for g in part]))
        for k, part in zip(todo, parts, strict=True):
            levels[k] = [next(nodes) for _ in part]
    return [level[0][0] if level else bytes(32) for level in levels]


def merkle_root(leaves: list[tuple[bytes, int]], least: int = 2, most: int = 9, branching: int = 4) -> bytes:
    return merkle_roots([leaves], least, most, branching)[0]


class MerkleFold:
    """A list that comes in parts: levels over ``room`` children are folded at once, so that it is never held whole."""

    def __init__(self, room: int, least: int = 2, most: int = 9, branching: int = 4) -> None:
        self.room, self.rule, self.levels = room, (least, most, branching), [[]]
        if least < 2:  # a single child that closes a group may be the root
            raise ValueError("least must be 2 or more")

    def add(self, leaves: list[tuple[bytes, int]]) -> None:
        self.levels[0] += leaves
        k = 0
        while k < len(self.levels) and len(self.levels[k]) > self.room:
            groups, self.levels[k] = _split(self.levels[k], *self.rule)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1] += _nodes(groups)
            k += 1

    def top(self) -> list[tuple[bytes, int]]:
        """The lowest level that is whole: its root is that of the list."""
        level = self.levels[0]
        for above in self.levels[1:]:
            groups, own = _split(level, *self.rule)
            level = above + _nodes([*groups, own] if own else groups)
        return level


def file_hashes(roots: list[bytes]) -> list[bytes]:
    out = []
    for i in range(0, len(roots), 16384):
        out += blake3(roots[i : i + 16384], FILE_KEY)
    return out


def file_hash(leaves: list[tuple[bytes, int]]) -> bytes:
    return file_hashes([merkle_root(leaves)])[0]


def range_hash(hashes: list[bytes]) -> bytes:
    return blake3([b"".join(hashes)], VERIFICATION_KEY)[0]
