"""Table schemas, limits and error codes of the storage model.

Files are ordered lists of terms; a term is a range of chunks of one archive; a
manifest (shard) registers files.  ``*_excl`` ends are exclusive, ``*_incl``
inclusive.  Sizes are longs: they exceed 32 bits, and logical sizes stay below 2**63.
"""

from __future__ import annotations

SCHEMA_VERSION = 1

FILES = "file_hash string, owner_id string, seq long, n_bytes long, text string"
CHUNKS = "file_hash string, ord long, chunk_hash string, byte_start long, n_bytes long"
CHUNK_INDEX = "seq long, chunk_hash string, archive_id long, chunk_idx long, n_bytes long"
ARCHIVES = "archive_hash string, num_bytes_on_disk long, last_modified_unix long"
SHARDS = "shard_hash string, size long, last_modified_unix long"
FILE_TERMS = "file_hash string, term_idx long, archive_id long, chunk_start long, chunk_end_excl long, unpacked_bytes long, range_hash string"
FILE_INDEX = "file_hash string, shard_hash string"
FILE_OWNERSHIP = "file_hash string, owner_id string, logical_bytes long, created_at_unix long"
RANGE_REQUESTS = "request_id long, file_hash string, range_header string"
DELETE_REQUESTS = "request_id long, file_hash string, owner_id string, scope string"
FRAMES = "version int, compressed_size int, scheme int, uncompressed_size int, payload binary"

TABLES = {
    "files": FILES, "chunks": CHUNKS, "chunk_index": CHUNK_INDEX, "archives": ARCHIVES, "shards": SHARDS, "file_terms": FILE_TERMS, "file_index": FILE_INDEX,
    "file_ownership": FILE_OWNERSHIP, "range_requests": RANGE_REQUESTS, "delete_requests": DELETE_REQUESTS, "frames": FRAMES,
}


def check(df, name: str) -> None:
    """Raises ValueError unless ``df`` has the columns of TABLES[name] with their types; more columns may follow."""
    have = dict(df.dtypes)
    types = {"long": "bigint"}
    wrong = [column for column, kind in (c.split(" ") for c in TABLES[name].split(", ")) if have.get(column) != types.get(kind, kind)]
    if wrong:
        raise ValueError(f"table {name} (schema {SCHEMA_VERSION}): missing or of another type: {', '.join(wrong)}")


# Fixed limits of the protocol.
CHUNK_TARGET, CHUNK_MIN, CHUNK_MAX = 64 << 10, 8 << 10, 128 << 10
ARCHIVE_BYTES, ARCHIVE_OVERHEAD = 64 << 20, 4 << 20
SHARD_BYTES = 64 << 20
PAGE_DEFAULT, PAGE_MAX = 100, 1000
GC_GRACE_SECONDS, GC_FLOOR_SECONDS = 24 * 3600, 3600
URL_SECONDS = 3600
PROBE_BATCH = 16
FRAME_HEADER = 8

# Status by error code.
ERRORS = {"bad_request": 400, "unauthorized": 401, "forbidden": 403, "not_found": 404, "too_large": 413, "range_not_satisfiable": 416}
