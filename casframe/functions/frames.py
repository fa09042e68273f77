"""Chunk frames: an 8-byte header and a payload, stored as is, LZ4-framed, or byte-grouped and LZ4-framed."""

from __future__ import annotations

import pyarrow as pa

RAW, LZ4, GROUPED_LZ4 = 0, 1, 2


def group4(data: bytes) -> bytes:
    """Bytes by position modulo four."""
    return b"".join(data[k::4] for k in range(4))


def ungroup4(data: bytes) -> bytes:
    out, at = bytearray(len(data)), 0
    for k in range(4):
        n = len(range(k, len(data), 4))
        out[k::4] = data[at : at + n]
        at += n
    return bytes(out)


def encode(chunk: bytes, scheme: int = RAW) -> bytes:
    if scheme == RAW:
        body = chunk
    elif scheme in (LZ4, GROUPED_LZ4):
        body = pa.compress(group4(chunk) if scheme == GROUPED_LZ4 else chunk, codec="lz4", asbytes=True)
    else:
        raise ValueError(f"unknown compression type {scheme}")
    return bytes([0]) + len(body).to_bytes(3, "little") + bytes([scheme]) + len(chunk).to_bytes(3, "little") + body


def walk(data: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """(payload start, scheme, size) of the leading frames, and where an opaque tail begins."""
    out, at = [], 0
    while at + 8 <= len(data) and data[at] == 0 and data[at + 4] <= GROUPED_LZ4:
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        if at + 8 + size > len(data):
            break
        out.append((at + 8, data[at + 4], size))
        at += 8 + size
    return out, at


def decode(data: bytes, start: int = 0, end: int | None = None) -> bytes:
    """Chunks [start, end) joined; malformed frames inside the range raise."""
    out, at, k = [], 0, 0
    while at + 8 <= len(data) and (end is None or k < end):
        if data[at] != 0:
            raise ValueError(f"unsupported chunk version {data[at]}")
        size, scheme, plain = int.from_bytes(data[at + 1 : at + 4], "little"), data[at + 4], int.from_bytes(data[at + 5 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated chunk payload")
        if k >= start:
            if scheme == RAW:
                chunk = body
            elif scheme in (LZ4, GROUPED_LZ4):
                chunk = pa.decompress(body, decompressed_size=plain, codec="lz4", asbytes=True)
                chunk = ungroup4(chunk) if scheme == GROUPED_LZ4 else chunk
            else:
                raise ValueError(f"unknown compression type {scheme}")
            if len(chunk) != plain:
                raise ValueError("chunk length differs from its header")
            out.append(chunk)
        at += 8 + size
        k += 1
    if end is not None and k < end:
        raise ValueError("chunk range out of bounds")
    return b"".join(out)
