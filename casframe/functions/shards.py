"""A serialized shard: header, file section, archive section.

Layout, little-endian: MAGIC, version and footer size (32 bits each); then for each
file its hash (32 bytes), number of terms (32 bits) and, for each term, archive hash
(32 bytes), first chunk, chunk end (exclusive) and unpacked bytes (32, 32 and 64
bits); END; then for each archive its hash, number of chunks and, for each chunk, its
hash and size (32 bits); END.  An uploaded shard has footer size 0 and at most
MOST_BYTES.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"casframe-shard1\n"
VERSION = 1
MOST_BYTES = 64 << 20
END = b"\xff" * 32
_HEAD = struct.Struct("<16sII")
_FILE = struct.Struct("<32sI")
_TERM = struct.Struct("<32sIIQ")
_CHUNK = struct.Struct("<32sI")


def encode(files: list[tuple[bytes, list[tuple[bytes, int, int, int]]]], archives: list[tuple[bytes, list[tuple[bytes, int]]]], footer: int = 0) -> bytes:
    out = [_HEAD.pack(MAGIC, VERSION, footer)]
    for name, terms in files:
        out += [_FILE.pack(name, len(terms)), *(_TERM.pack(*t) for t in terms)]
    out.append(END)
    for name, chunks in archives:
        out += [_FILE.pack(name, len(chunks)), *(_CHUNK.pack(*c) for c in chunks)]
    return b"".join([*out, END])


def _section(data: bytes, at: int, item: struct.Struct) -> tuple[list[tuple[bytes, list[tuple]]], int]:
    out = []
    while data[at : at + 32] != END:
        name, n = _FILE.unpack_from(data, at)
        at += _FILE.size
        out.append((name, [item.unpack_from(data, at + k * item.size) for k in range(n)]))
        at += n * item.size
    return out, at + 32


def parse(data: bytes) -> tuple[str | None, list, list]:
    """(error, files, archives); a shard with an error has no entries."""
    if len(data) > MOST_BYTES:
        return "too_large", [], []
    try:
        magic, version, footer = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            return "bad_header", [], []
        if footer:
            return "footer_not_allowed", [], []
        files, at = _section(data, _HEAD.size, _TERM)
        archives, at = _section(data, at, _CHUNK)
    except struct.error:
        return "truncated", [], []
    return (None, files, archives) if at == len(data) else ("trailing_bytes", [], [])


def parse_shards(shards: DataFrame, key: str = "shard_hash", body: str = "body") -> DataFrame:
    """(key, error, kind, owner, ord, hash, first, last_excl, bytes): a row for each term (``kind`` term, owner
    a file) and chunk (``kind`` chunk, owner an archive), or one with the error."""
    source = shards.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body"))
    names = ["key", "error", "kind", "owner", "ord", "hash", "first", "last_excl", "bytes"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                error, files, archives = parse(data or b"")
                rows = [(name, error, None, None, None, None, None, None, None)] if error else []
                rows += [(name, None, "term", f.hex(), k, t[0].hex(), *t[1:]) for f, terms in files for k, t in enumerate(terms)]
                rows += [(name, None, "chunk", a.hex(), k, c[0].hex(), k, k + 1, c[1]) for a, chunks in archives for k, c in enumerate(chunks)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return source.mapInArrow(run, f"key string, error string, kind string, owner string, ord long, hash string, first long, last_excl long, bytes long").withColumnRenamed("key", key)


def bodies(terms: DataFrame, chunks: DataFrame, key: str = "shard_hash") -> DataFrame:
    """(key, body): a serialized shard for each key of terms (key, file_hash, term_idx, archive_hash, chunk_start,
    chunk_end_excl, unpacked_bytes) with the archives it names, of chunks (archive_hash, chunk_idx, chunk_hash, n_bytes)."""
    listed = lambda *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    files = terms.groupBy(key, "file_hash").agg(listed("term_idx", "archive_hash", "chunk_start", "chunk_end_excl", "unpacked_bytes").alias("items")).groupBy(key).agg(listed("file_hash", "items").alias("files"))
    whole = chunks.groupBy("archive_hash").agg(listed("chunk_idx", "chunk_hash", "n_bytes").alias("items"))
    named = terms.select(key, "archive_hash").distinct().join(whole, "archive_hash").groupBy(key).agg(listed("archive_hash", "items").alias("archives"))
    source = files.join(named, key).select(F.col(key).cast("string").alias("key"), "files", "archives")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = bytes.fromhex
        for part in parts:
            out = []
            for row in part.to_pylist():
                terms_of = [(h(f["file_hash"]), [(h(t["archive_hash"]), t["chunk_start"], t["chunk_end_excl"], t["unpacked_bytes"]) for t in f["items"]]) for f in row["files"]]
                out.append(encode(terms_of, [(h(a["archive_hash"]), [(h(c["chunk_hash"]), c["n_bytes"]) for c in a["items"]]) for a in row["archives"]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["key", "body"])

    return source.mapInArrow(run, "key string, body binary").withColumnRenamed("key", key)


def upload_error(body: Column) -> Column:
    """What can be told from a shard's head without parsing it: NULL, or why it is refused."""
    head = F.hex(F.substring(body, 1, 24))
    return F.when(F.octet_length(body) > MOST_BYTES, "too_large").when(~head.startswith(MAGIC.hex().upper()), "bad_header").when(F.substring(head, 41, 8) != "00000000", "footer_not_allowed")
