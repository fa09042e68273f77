"""Packing along a space-filling curve.

Each document gets a vector: the mean, over its token ids, of a hashed random
direction of ``DIMS`` dimensions.  Vectors are cut into cells, a cell's position
on a Hilbert curve is the document's key, and documents are range-sorted by key.
Tokens are laid end to end along the curve and cut every ``length`` tokens, so a
sequence holds neighbours and only the last one is not full; its tail is cut
into sequences of falling powers of two, so nothing is padded.

Ids are the tokenizer's for the whole text, then ``END_ID``.  Null texts are
empty and hold ``END_ID`` alone.  Every row is packed, repeated rows and null and
repeated keys too: each row has its own place on the curve.

The pass over the text writes one row per document (row number, key, curve key,
ids) to the shared folder.  Only its numbers are range-sorted, by (curve key, key,
digest of the ids, row number), so no group of equal keys need be in one range.  A
running sum inside each range and the sums of the ranges before it, of which there
is one for ``RANGE_ROWS`` documents, give every document its first token's place;
with it ids are cut, each document by itself.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import common, kernel

LENGTH = 2048
END_ID = 1
DIMS = 4
CELL_BITS = 8
RANGE_ROWS = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CONTRACTED = np.array([ord(c) for c in "stmdrvl"], np.uint32)


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points, one per row.

    The axes' bits are turned, from the highest down, by the reflections and
    exchanges that the curve's sub-cubes undergo, then read crosswise as a Gray
    code.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def directions(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A hashed direction for each id: its coordinates are hash bytes around zero."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    return np.stack([(kernel.mix(ids * kernel.U64(dims) + kernel.U64(k + 1)) >> kernel.U64(40)).astype(float) / (1 << 23) - 1 for k in range(dims)], 1)


class Tokens:
    """Token ids of whole texts.

    Texts are cut where the vocabulary's own pattern always cuts them (vectorised
    over code points), and each distinct piece is encoded once while it stays in
    the table.  Texts in which the fast cut could differ from the pattern are encoded
    whole by the same vocabulary and pattern in a compiled library; those that spell
    a special token go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str, most: int = 250_000) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = table
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.path, self.slow, self.most = tokenizer, None, most
        self.rows: dict[int, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.rows.clear()
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def _add(self, pieces: list[bytes], base: int) -> None:
        encode, ranks = self.fast._encode_single_piece, self.ranks
        ids = [[r] if (r := ranks.get(w)) is not None else encode(w) for w in pieces]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.uint16)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        while base + len(n) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.count = np.concatenate([self.count, np.zeros(len(self.count), np.int64)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[base : base + len(n)] = self.used + np.cumsum(n) - n
        self.count[base : base + len(n)] = n
        self.used += len(flat)

    def block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts end to end, and the texts' offsets among them."""
        points, bound = kernel.code_points(raw, at)
        texts, n = len(at) - 1, len(points)
        if n == 0:
            return np.zeros(0, np.uint16), np.zeros(texts + 1, np.int64)
        kind = kernel.classes()[points]
        odd = np.zeros(texts, bool)
        # What the pattern treats apart: apostrophes, runs of white space other than one blank or newline, special tokens.
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        opens = bound[:-1][np.diff(bound) > 0]
        before[opens] = 9
        space = kind == 3
        after = np.zeros(n, np.uint32)
        after[:-1] = points[1:]
        quote = np.flatnonzero(points == 39)
        strange = (points == 60) & (after == 124)
        strange[quote] |= np.isin(after[quote], CONTRACTED)
        strange |= space & ((before == 3) | (points != 32) & (points != 10)) | (points > 0xFFFF) & (kind != 0)
        strange[opens] |= space[opens]
        last = bound[1:][np.diff(bound) > 0] - 1
        strange[last] |= space[last]
        at_odd = np.flatnonzero(strange)
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        if len(byte) != n + 1:  # not UTF-8: decoding has replaced bytes
            at_odd = opens
        # A blank is glued to what follows it; a newline stands alone.
        starts = (kind != before) & (before != 3) | (points == 10)
        glued = np.zeros(n, bool)
        glued[1:] = points[:-1] == 32
        glued[opens] = False
        starts |= (before == 3) & ~glued
        starts &= ~glued
        starts[opens] = True
        if len(at_odd):
            owner = np.unique(np.searchsorted(bound, at_odd, side="right") - 1)
            odd[owner] = True
        s = np.flatnonzero(starts)
        e = np.append(s[1:], n)
        text = np.searchsorted(bound, s, side="right") - 1
        if odd.any():
            keep = ~odd[text]
            s, e, text = s[keep], e[keep], text[keep]
        h = kernel.mix(kernel.span_hash(kernel.point_hash(points), s, e))
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.rows) + len(unique) > self.most:
            self._empty()
        rows, base = self.rows, len(self.rows)
        keys = unique.tolist()
        got = np.fromiter((rows.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(got < 0)
        if len(new):
            spots = where[new]
            body = raw.tobytes()
            self._add([body[a:b] for a, b in zip(byte[s[spots]].tolist(), byte[e[spots]].tolist(), strict=True)], base)
            got[new] = np.arange(base, base + len(new))
            rows.update(zip(unique[new].tolist(), got[new].tolist(), strict=True))
        row = got[back]
        n_ids = self.count[row]
        to = np.concatenate([[0], np.cumsum(n_ids)])
        ids = self.pool[np.arange(to[-1]) + np.repeat(self.start[row] - to[:-1], n_ids)]
        first = to[np.searchsorted(text, np.arange(texts + 1))]
        if not odd.any():
            return ids, first
        parts, size = [], np.zeros(texts + 1, np.int64)
        for k in range(texts):
            own = ids[first[k] : first[k + 1]]
            if odd[k]:
                body = raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")
                own = np.array(self._exact(body) if "<|" in body else self.fast.encode_ordinary(body), np.uint16)
            parts.append(own)
            size[k + 1] = len(own)
        return np.concatenate(parts), np.cumsum(size)


def encode(documents: DataFrame, paths: tuple[str, str], key: str = "doc_id", text: str = "text", dims: int = DIMS, bits: int = CELL_BITS) -> DataFrame:
    """key, n_tokens, curve and ids (little-endian 16-bit) of each row."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)
        table = directions(1 << 16, dims).astype(np.float32)
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                ids, first = tokens.block(raw, at)
                n = np.diff(first)
                total = np.zeros((len(ids) + 1, dims), np.float64)
                np.cumsum(table[ids], axis=0, dtype=np.float64, out=total[1:])
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None]
                # A mean of n directions spreads as 1 / sqrt(n); the root keeps cells evenly used.
                cell = np.clip((np.tanh(3 * mean) + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1)
                bodies = [ids[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(i, j - i), pa.array(n + 1), pa.array(hilbert(cell, bits)), pa.array(bodies, pa.binary())], ["key", "n_tokens", "curve", "ids"]
                )

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_tokens long, curve long, ids binary")


def cuts(total: int, length: int) -> list[int]:
    """Sizes of the sequences of the last ``total`` tokens: whole ones, then falling powers of two."""
    out = [length] * (total // length)
    rest = total % length
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def places(scratch: common.Scratch, encoded: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """(uid, at) of every row of ``encoded``: its first token's place on the curve; and the number of all tokens."""
    order = ["curve", "key", "digest", "uid"]
    numbers = encoded.select("uid", "curve", "key", F.xxhash64("ids").alias("digest"), "n_tokens")
    ranges = max(scratch.parts, -(-encoded.count() // range_rows))
    sorted_ = numbers.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("uid", "n_tokens", F.spark_partition_id().alias("part"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's first token in its range, as rows stream by in order."""
        done = 0
        for part in parts:
            n = part.column(1).to_numpy()
            ends = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ends - n), part.column(1)], ["uid", "part", "inside", "n_tokens"])
            done = int(ends[-1]) if len(n) else done

    placed = scratch.save(sorted_.mapInArrow(run, "uid long, part int, inside long, n_tokens long"), "places")
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    sums = np.cumsum([0, *(r["n"] for r in totals)]).tolist()
    first = scratch.spark.createDataFrame([(r["part"], at) for r, at in zip(totals, sums, strict=False)], "part int, first long")
    return placed.join(F.broadcast(first), "part").select("uid", (F.col("first") + F.col("inside")).alias("at")), sums[-1]


def pack(spark: SparkSession, documents: DataFrame, paths: tuple[str, str] | None = None, length: int = LENGTH, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``length`` must be a power of two.
    """
    scratch = common.Scratch(spark, "packing", documents)
    encoded = scratch.save(encode(documents, paths or vocabulary_paths(), key, text).withColumn("uid", F.monotonically_increasing_id()), "encoded")
    at, total = places(scratch, encoded, range_rows)
    whole = total // length * length
    tail, spot = [], whole
    for size in cuts(total - whole, length):
        tail.append(spot)
        spot += size
    tail_at = np.array([*tail, total], np.int64)
    kind = encoded.schema["key"].dataType.simpleString()
    columns = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, counts, bodies, first = part.column(0), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()
            rows, start, size, crc, whole_doc, seq, off = [], [], [], [], [], [], []
            for k, n in enumerate(counts):
                ids = np.append(np.frombuffer(bodies[k].as_buffer(), "<u2"), END_ID).astype("<u4")
                done = 0
                while done < n:
                    spot = first[k] + done
                    if spot < whole:
                        number, inside = divmod(spot, length)
                        room = length - inside
                    else:
                        t = int(np.searchsorted(tail_at, spot, side="right")) - 1
                        number, inside, room = whole // length + t, spot - int(tail_at[t]), int(tail_at[t + 1]) - spot
                    take = min(room, n - done)
                    rows.append(k)
                    start.append(done)
                    size.append(take)
                    crc.append(zlib.crc32(ids[done : done + take].tobytes()))
                    whole_doc.append(n)
                    seq.append(number)
                    off.append(inside)
                    done += take
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, whole_doc, seq, off))], columns)

    cut = encoded.join(at, "uid").select("key", "n_tokens", "ids", "at").mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return cut.withColumnRenamed("key", key).coalesce(scratch.parts)
