"""Byte-level operators on Arrow batches: content-defined chunks, frames, packing, probes.

Chunk lengths lie within ``least`` and ``most`` (the last may be shorter).  The gear
table comes from a seeded rule, so boundaries are stable here but are not those of
any other implementation.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions import frames, hashing
from casframe.schema import CHUNK_MAX, CHUNK_MIN, FRAME_HEADER

U64 = np.uint64


@dataclass(frozen=True)
class CdcParams:
    least: int = CHUNK_MIN
    most: int = CHUNK_MAX
    mask_bits: int = 16
    seed: int = 1


SMALL = CdcParams(64, 2048, 8)


def gear_table(seed: int) -> np.ndarray:
    """256 words from a multiplicative sequence."""
    x = (np.arange(1, 257, dtype=U64) + U64(seed * 1009)) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(27))


def boundaries(data: bytes, params: CdcParams) -> list[int]:
    """Chunk ends.  The hash covers the last 64 bytes, so least must be 64 or more."""
    n = len(data)
    if n <= params.least:
        return [n] if n else []
    h = gear_table(params.seed)[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16, 32):
        wide = h.copy()
        wide[step:] += h[:-step] << U64(step)
        h = wide
    spots = (np.flatnonzero((h >> U64(64 - params.mask_bits)) == 0) + 1).tolist()
    out, last, i = [], 0, 0
    while n - last > params.least:
        while i < len(spots) and spots[i] < last + params.least:
            i += 1
        cut = min(spots[i] if i < len(spots) else n, last + params.most)
        if cut >= n:
            break
        out.append(cut)
        last = cut
    return [*out, n]


def cdc_chunks(bodies: DataFrame, key: str, body: str, params: CdcParams = SMALL) -> DataFrame:
    """(key, ord, byte_start, n_bytes, chunk_hash, data) of a binary column; chunk hashes are keyed Blake3 hex."""
    source = bodies.select(F.col(key).alias(key), F.col(body).cast("binary").alias("body"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 64):
                rows, start, data = [], [], []
                piece = part.slice(at, 64)
                for k, raw in enumerate(piece.column(1).to_pylist()):
                    last = 0
                    for end in boundaries(raw or b"", params):
                        rows.append(k)
                        start.append(last)
                        data.append(raw[last:end])
                        last = end
                order, seen = [], {}
                for r in rows:
                    order.append(seen.get(r, 0))
                    seen[r] = order[-1] + 1
                digests = [d.hex() for d in hashing.blake3(data, hashing.DATA_KEY)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows, pa.int64())), pa.array(order, pa.int64()), pa.array(start, pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(digests, pa.string()), pa.array(data, pa.binary())], [key, "ord", "byte_start", "n_bytes", "chunk_hash", "data"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, ord long, byte_start long, n_bytes long, chunk_hash string, data binary")


def frames_roundtrip(bodies: DataFrame, key: str, body: str, params: CdcParams = SMALL) -> DataFrame:
    """Per body and scheme: frames, encoded bytes, and whether decoding gives the body back."""
    source = bodies.select(F.col(key).alias(key), F.col(body).cast("binary").alias("body"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, scheme, count, size, same = [], [], [], [], []
            for k, raw in enumerate(part.column(1).to_pylist()):
                raw = raw or b""
                ends = boundaries(raw, params)
                for s in (frames.RAW, frames.LZ4, frames.GROUPED_LZ4):
                    data = b"".join(frames.encode(raw[a:b], s) for a, b in zip([0, *ends], ends, strict=False))
                    rows.append(k)
                    scheme.append(s)
                    count.append(len(frames.walk(data)[0]))
                    size.append(len(data))
                    same.append(frames.decode(data) == raw)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(scheme, pa.int32()), pa.array(count, pa.int64()), pa.array(size, pa.int64()), pa.array(same)], [key, "scheme", "n_frames", "encoded_bytes", "same"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, scheme int, n_frames long, encoded_bytes long, same boolean")


def fold_roots(parts: Iterator[pa.RecordBatch], names: list[str], room: int) -> Iterator[pa.RecordBatch]:
    """(key, root, file hash) of rows (key, chunk hash, n_bytes) sorted by key and place; files end when the key changes.

    Finished files wait until they have ``room`` children in all and are hashed
    together, since Blake3 over a few nodes costs about as much as over thousands.
    """
    keys, levels, held, key, kind = [], [], 0, None, None
    file = None

    def flush() -> pa.RecordBatch:
        roots = hashing.merkle_roots(levels)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([r.hex() for r in roots], pa.string()), pa.array([h.hex() for h in hashing.file_hashes(roots)], pa.string())], names)

    for part in parts:
        kind = part.column(0).type
        rows = zip(part.column(0).to_pylist(), zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True), strict=True)
        for k, own in itertools.groupby(rows, lambda r: r[0]):
            if file is None or k != key:
                if file is not None:
                    keys.append(key)
                    levels.append(file.top())
                    held += len(levels[-1])
                    if held >= room:
                        yield flush()
                        keys, levels, held = [], [], 0
                file, key = hashing.MerkleFold(room), k
            file.add([leaf for _, leaf in own])
    if file is not None:
        keys.append(key)
        levels.append(file.top())
        yield flush()


def merkle_roots(chunks: DataFrame, key: str, room: int = 1 << 16) -> DataFrame:
    """(key, root, file_hash) from (key, ord, chunk_hash hex, n_bytes): an ordered fold per key, many keys hashed together."""
    value = "file_hash_value" if key == "file_hash" else "file_hash"
    source = chunks.select(key, "ord", F.unhex("chunk_hash").alias("chunk_hash"), "n_bytes").repartition(key).sortWithinPartitions(key, "ord", "chunk_hash", "n_bytes").select(key, "chunk_hash", "n_bytes")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold_roots(parts, [key, "root", value], room)

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, root string, {value} string")


def greedy_pack(chunks: DataFrame, key: str, most_bytes: int, most_chunks: int) -> DataFrame:
    """Archive number of each chunk within its upload: cut before either limit overflows.

    The fold is sequential by nature, so it runs per upload (``key``), never over all.
    """
    schema = f"{key} {chunks.schema[key].dataType.simpleString()}, ord long, n_bytes long, archive long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        out, number, held, count = [], 0, 0, 0
        for n in table.column("n_bytes").to_pylist():
            if count and (held + n > most_bytes or count + 1 > most_chunks):
                number, held, count = number + 1, 0, 0
            held, count = held + n, count + 1
            out.append(number)
        return table.append_column("archive", pa.array(out, pa.int64()))

    return chunks.select(key, "ord", "n_bytes").groupBy(key).applyInArrow(run, schema)


def probe_candidates(placed: DataFrame, modulus_hit: str = "eligible") -> DataFrame:
    """Chunks worth a dedup probe: the first, those after a resolved one, and eligible ones."""
    w = Window.partitionBy("file_hash").orderBy("ord")
    return placed.where(F.col("ord").isNotNull()).withColumn("after", F.lag("resolved", 1, False).over(w)).withColumn("head", F.row_number().over(w) == 1).where(f"NOT resolved AND (head OR after OR {modulus_hit})").drop("after", "head")


def probe_dedup(chunks: DataFrame, index: DataFrame, eligible) -> DataFrame:
    """Sampled dedup to its fixpoint: (file_hash, ord, chunk_hash, resolved).

    Each round probes all candidates not probed yet; a hit resolves every chunk of
    the file that stands in the archives found.  The driver sees one number a round.
    """
    state = chunks.select("file_hash", "ord", "chunk_hash", "n_bytes").withColumn("eligible", eligible).withColumn("resolved", F.lit(False)).withColumn("probed", F.lit(False))
    where = index.select("chunk_hash", "archive_id")
    while True:  # each round probes a chunk that no round has probed, so it ends
        asks = probe_candidates(state).where("NOT probed").select("file_hash", "chunk_hash").distinct()
        state = state.drop("asked").join(asks.withColumn("asked", F.lit(True)), ["file_hash", "chunk_hash"], "left").withColumn("probed", F.coalesce("asked", "probed")).drop("asked")
        hits = asks.join(where, "chunk_hash").select("file_hash", "archive_id").distinct()
        found = hits.join(where, "archive_id").select("file_hash", "chunk_hash").distinct().withColumn("found", F.lit(True))
        state = state.join(found, ["file_hash", "chunk_hash"], "left").withColumn("resolved", F.col("resolved") | F.coalesce("found", F.lit(False))).drop("found").checkpoint()
        if probe_candidates(state).where("NOT probed").isEmpty():
            break
    return state.select("file_hash", "ord", "chunk_hash", "n_bytes", "resolved")


def archive_bodies(store: DataFrame, scheme: int = frames.RAW) -> DataFrame:
    """(archive_id, body): the frames of each archive's chunks (archive_id, chunk_idx, data), in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_idx")
        body = b"".join(frames.encode(x, scheme) for x in table.column("data").to_pylist())
        return pa.table({"archive_id": table.column("archive_id").slice(0, 1), "body": pa.array([body], pa.binary())})

    return store.select("archive_id", "chunk_idx", F.col("data").cast("binary").alias("data")).groupBy("archive_id").applyInArrow(run, "archive_id long, body binary")


def walk_frames(bodies: DataFrame) -> DataFrame:
    """(archive_id, chunk_idx, frame_start, frame_end_excl, n_bytes, chunk_hash) of each leading frame, hash and size recomputed from the decoded chunk."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for archive, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows = []
                for k, (start, _, size) in enumerate(frames.walk(body or b"")[0]):
                    data = frames.decode(body[start - FRAME_HEADER : start + size])
                    rows.append((archive, k, start - FRAME_HEADER, start + size, len(data), hashlib.sha256(data).hexdigest()))
                kinds = [pa.int64()] * 5 + [pa.string()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["archive_id", "chunk_idx", "frame_start", "frame_end_excl", "n_bytes", "chunk_hash"])

    return bodies.select("archive_id", "body").mapInArrow(run, "archive_id long, chunk_idx long, frame_start long, frame_end_excl long, n_bytes long, chunk_hash string")


def decode_frames(bodies: DataFrame) -> DataFrame:
    """(archive_id, data): chunks [chunk_start, chunk_end_excl) of each body; a range past its frames raises."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = [frames.decode(b, s, e) for b, s, e in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["archive_id", "data"])

    return bodies.select("archive_id", "body", "chunk_start", "chunk_end_excl").mapInArrow(run, "archive_id long, data binary")
