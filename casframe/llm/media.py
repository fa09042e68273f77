"""Media columns: content-defined chunks, a deduplicated store, verified read-back.

A text's payload is its UTF-8 bytes, padded with zero bytes to a positive multiple
of 64.  The medium is an 8-bit mono PCM file whose samples are the payload.  The file
is cut where a rolling gear hash of the last 64 bytes has ``CUT_BITS`` zero bits,
within ``MIN_CHUNK`` and ``MAX_CHUNK`` bytes, so an edit moves few cuts.

1. A manifest pass encodes each row's file and lists its SHA-256 (the medium), the
   payload's SHA-256, and the file's ordered chunk digests.  No payload travels.
2. Digests that occur twice or more, found by aggregation, and media of several
   rows make a medium *shared*.  A bitmap of 64 bits or more for each shared
   medium, MOST_BITS in all at most, marks them; what it marks by chance is only
   stored the other way.
3. A storing pass writes each file's chunks, compressed.  What the bitmap does not
   mark has no chunk in common with anything: it is its own container and its bytes
   are never shuffled.  Marked rows (shared ones, and some by chance) are
   deduplicated by joins on medium and digest: each chunk is stored once.  A chunk or
   medium that holds over one in ``common.HEAVY`` of all rows is broadcast.
4. Read-back decodes containers, or joins ordered chunk lists with the chunk store,
   and so has the stored file.  Its size and digests are taken from those bytes; it
   is parsed, its samples' SHA-256 is held against the manifest (a mismatch fails the
   job), and features come from the samples.  Rows get their medium's values by a
   join, so equal texts have equal values.

Null texts are empty; repeated rows and null and repeated keys keep their rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import common, kernel

UNIT = 64
MIN_CHUNK = 1024
MAX_CHUNK = 16384
CUT_BITS = 12
MOST_BITS = 1 << 27
RATE = 8000
U64 = np.uint64


def gear_table(seed: int = 1) -> np.ndarray:
    return kernel.mix(np.arange(256, dtype=U64) + U64(seed << 16))


def cut_points(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> list[list[int]]:
    """Chunk ends within each file of a block (its length not included).

    The hash ``h[i] = sum(table[b[i-k]] << k, k < 64)`` is built by doubling the
    window six times.  Cuts keep MIN_CHUNK >= 64 bytes, so the window of a possible
    cut never reaches into the file before.
    """
    h = table[raw]
    for step in (1, 2, 4, 8, 16, 32):
        if len(h) > step:
            wide = h.copy()
            wide[step:] += h[:-step] << U64(step)
            h = wide
    found = np.flatnonzero((h >> U64(64 - CUT_BITS)) == 0) + 1
    bounds = np.searchsorted(found, at).tolist()
    spots, starts = found.tolist(), at.tolist()
    out = []
    for k in range(len(at) - 1):
        size, last, cuts = starts[k + 1] - starts[k], 0, []
        i = bounds[k]
        while size - last > MIN_CHUNK:
            while i < bounds[k + 1] and spots[i] - starts[k] < last + MIN_CHUNK:
                i += 1
            spot = spots[i] - starts[k] if i < bounds[k + 1] else size
            cut = min(spot, last + MAX_CHUNK)
            if cut >= size:
                break
            cuts.append(cut)
            last = cut
        out.append(cuts)
    return out


def files(part: pa.RecordBatch, text: str, table: np.ndarray) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(unpadded size, payload, the file's chunks) of each row."""
    for _, _, raw, at in kernel.batches(part, text):
        body, starts = raw.tobytes(), at.tolist()
        data = [body[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        full = [x + bytes(-len(x) % UNIT or (0 if x else UNIT)) for x in data]
        media = [encode(x) for x in full]
        cuts = cut_points(np.frombuffer(b"".join(media), np.uint8), np.cumsum([0, *map(len, media)]), table)
        for k, own in enumerate(cuts):
            edges = [0, *own, len(media[k])]
            yield len(data[k]), full[k], [media[k][a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def decode(medium: bytes) -> bytes:
    with wave.open(io.BytesIO(medium), "rb") as file:
        return file.readframes(file.getnframes())


def features(payload: bytes) -> str:
    """Level, zero crossings and the histogram of the samples' upper three bits."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    level = int(np.sqrt((x * x).mean()) * 1000)
    cross = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    bands = np.bincount((x + 128) >> 5, minlength=8).tolist()
    return f"rms={level};crossings={cross};bands={','.join(map(str, bands))}"


def described(medium_id: bytes, payload_id: bytes, medium: bytes) -> tuple:
    """Values read back from a stored file; it and its payload must have the manifest's digests."""
    stored, payload = hashlib.sha256(medium), decode(medium)
    digest = hashlib.sha256(payload)
    if stored.digest() != medium_id or digest.digest() != payload_id:
        raise ValueError(f"stored medium {medium_id.hex()} reads back as {stored.hexdigest()}")
    return len(payload), digest.hexdigest(), zlib.crc32(payload[-UNIT:]), len(medium), stored.hexdigest(), features(payload)


VALUES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def manifest(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key, n_bytes, medium, payload and ordered chunk digests of each row."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        for part in parts:
            size, medium, payload, lists = [], [], [], []
            for n, full, chunks in files(part, "text", table):
                size.append(n)
                medium.append(hashlib.sha256(b"".join(chunks)).digest())
                payload.append(hashlib.sha256(full).digest())
                lists.append([medium[-1]] if len(chunks) == 1 else [hashlib.sha256(c).digest() for c in chunks])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(medium, pa.binary()), pa.array(payload, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["key", "n_bytes", "medium", "payload", "chunks"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_bytes long, medium binary, payload binary, chunks array<binary>")


def _slot(column: str, bits: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring(column, 1, 7)), 16, 10).cast("long"), F.lit(bits))


def stored(documents: DataFrame, text: str, packed: bytes) -> DataFrame:
    """(medium, payload, bodies, marked): every row's compressed chunks in order."""
    source, bits = documents.select(F.col(text).alias("text")), 8 * len(packed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, squeeze = gear_table(), zstandard.ZstdCompressor(level=3)
        for part in parts:
            medium, payload, bodies, flag = [], [], [], []
            for _, full, chunks in files(part, "text", table):
                medium.append(hashlib.sha256(b"".join(chunks)).digest())
                payload.append(hashlib.sha256(full).digest())
                bodies.append([squeeze.compress(c) for c in chunks])
                slot = int.from_bytes(medium[-1][:7], "big") % bits
                flag.append(bool(packed[slot >> 3] >> (slot & 7) & 1))
            yield pa.RecordBatch.from_arrays([pa.array(medium, pa.binary()), pa.array(payload, pa.binary()), pa.array(bodies, pa.list_(pa.binary())), pa.array(flag)], ["medium", "payload", "bodies", "marked"])

    return source.mapInArrow(run, "medium binary, payload binary, bodies array<binary>, marked boolean")


def read_back(containers: DataFrame) -> DataFrame:
    """Values of each (medium, payload, bodies) row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for part in parts:
            rows, bodies = [], part.column(2)
            for k, (medium, payload) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                rows.append(described(medium, payload, b"".join(expand.decompress(b.as_py()) for b in bodies[k].values)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["medium", *(x.split()[0] for x in VALUES.split(", "))])

    return containers.select("medium", "payload", "bodies").mapInArrow(run, f"medium binary, {VALUES}")


def describe(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes and the values read back from the store, for each row."""
    scratch = common.Scratch(spark, "media", documents)
    rows = scratch.save(manifest(documents, key, text), "manifest")
    media = scratch.save(rows.groupBy("medium").agg(F.count(F.lit(1)).alias("n_rows"), F.first("payload").alias("payload"), F.first("chunks").alias("chunks")), "media")
    entries = scratch.save(media.select("medium", "n_rows", F.posexplode("chunks").alias("ord", "digest")), "entries")
    often = scratch.save(entries.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    linked = common.match(entries.select("digest", "medium"), often, "digest", "n", entries.count()).select("medium")
    shared = scratch.save(media.where("n_rows > 1").select("medium").union(linked).distinct(), "shared")
    bits = min(MOST_BITS, 1 << max(16, (64 * shared.count()).bit_length()))
    parted = stored(documents, text, common.bitmap(shared.select(_slot("medium", bits).alias("slot")), bits))
    scratch.drop("often", "shared")
    path = f"{scratch.base}/store"
    parted.coalesce(scratch.parts).write.partitionBy("marked").option("compression", "uncompressed").parquet(path)
    store = spark.read.schema("medium binary, payload binary, bodies array<binary>, marked boolean").parquet(path)
    alone = read_back(store.where("NOT marked"))
    once = store.where("marked").groupBy("medium").agg(F.first("payload").alias("payload"), F.first("bodies").alias("bodies"))
    own = scratch.save(once, "once")
    scratch.drop("store/marked=true")
    lists = scratch.save(entries.join(own.select("medium"), "medium", "left_semi").select("medium", "ord", "digest"), "lists")
    owners = lists.groupBy("digest").agg(F.min(F.struct("medium", "ord")).alias("o"), F.count(F.lit(1)).alias("n")).select("digest", "n", "o.medium", "o.ord")
    pieces = own.select("medium", F.posexplode("bodies").alias("ord", "body"))
    chunks = scratch.save(pieces.join(owners, ["medium", "ord"]).select("digest", "n", "body"), "chunks")
    scratch.drop("once", "entries")
    rebuilt = common.match(lists, chunks, "digest", "n", lists.count()).groupBy("medium").agg(F.sort_array(F.collect_list(F.struct("ord", "body"))).alias("all"))
    rebuilt = rebuilt.join(media.select("medium", "payload"), "medium").select("medium", "payload", F.col("all.body").alias("bodies"))
    values = scratch.save(alone.unionByName(read_back(rebuilt)), "values")
    scratch.drop("store", "chunks", "lists")
    counted = values.join(media.select("medium", "n_rows"), "medium")
    out = common.match(rows.select("key", "n_bytes", "medium"), counted, "medium", "n_rows", rows.count()).drop("medium")
    return out.withColumnRenamed("key", key).coalesce(scratch.parts)
