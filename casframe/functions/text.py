"""Column expressions over strings: cursors, ranges, formats, redaction, pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PATTERN = "^[0-9a-f]{64}$"
POINTER_VERSION = "https://casframe/spec/v1"
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def is_hash(column: Column) -> Column:
    return F.coalesce(column.rlike(HASH_PATTERN), F.lit(False))


def hash_hex(raw: Column) -> Column:
    """Text form of 32 bytes: hex with each 8-byte word's octets reversed."""
    h = F.lower(F.hex(raw))
    return F.concat(*(F.substring(h, 1 + 16 * w + 2 * (7 - b), 2) for w in range(4) for b in range(8)))


def hash_bytes(text: Column) -> Column:
    """Bytes of the text form; the same octet reversal undoes itself."""
    return F.unhex(F.concat(*(F.substring(text, 1 + 16 * w + 2 * (7 - b), 2) for w in range(4) for b in range(8))))


def encode_cursor(key: Column) -> Column:
    """base64url without padding; the line breaks that base64 puts into long keys go too."""
    return F.rtrim(F.translate(F.base64(key.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """The key of a cursor, or NULL if it is none."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), "=")
    good = cursor.rlike("^[A-Za-z0-9_-]*$") & (F.pmod(F.length(cursor), F.lit(4)) != 1)
    return F.when(good, F.unbase64(padded).cast("string"))


def parse_byte_range(header: Column) -> Column:
    """struct(error, start, end_incl) of a ``bytes=a-b`` header; a missing header is no range."""
    digits = header.rlike(r"^bytes=\+?\d+-\+?\d+$")
    start = F.try_to_number(F.regexp_extract(header, r"^bytes=\+?(\d{1,18})-", 1), F.lit("9" * 18)).cast("long")
    end = F.try_to_number(F.regexp_extract(header, r"-\+?(\d{1,18})$", 1), F.lit("9" * 18)).cast("long")
    error = F.when(header.isNull(), None).when(~digits | start.isNull() | end.isNull(), "bad_request").when(start > end, "range_not_satisfiable")
    return F.struct(error.alias("error"), start.alias("start"), end.alias("end_incl"))


def slice_limits(start: Column, end: Column, size: Column) -> Column:
    """struct(start, end_excl) of Python-style limits on a length."""
    absolute = lambda x, default: F.when(x.isNull(), default).when(x < 0, F.greatest(size + x, F.lit(0))).otherwise(F.least(x, size))
    return F.struct(absolute(start, F.lit(0)).cast("long").alias("start"), absolute(end, size).cast("long").alias("end_excl"))


def format_bytes(n: Column, largest: str = "TB") -> Column:
    """``0 B``, whole bytes, then one decimal (half up) in steps of 1024, in ``largest`` whatever is above it."""
    top = BYTE_UNITS.index(largest)
    unit = sum((F.when(n >= 1024**k, 1).otherwise(0) for k in range(1, top + 1)), F.lit(0))
    value = F.floor(n / F.pow(F.lit(1024.0), unit) * 10 + 0.5) / 10
    name = F.element_at(F.array(*(F.lit(u) for u in BYTE_UNITS)), unit + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.when(unit == 0, n.cast("string")).otherwise(F.format_string("%.1f", value)), F.lit(" "), name))


def truncate_hash(text: Column, chars: int = 8) -> Column:
    return F.when(F.length(text) <= 2 * chars + 3, text).otherwise(F.concat(F.substring(text, 1, chars), F.lit("..."), F.right(text, F.lit(chars))))


def format_unix_time(seconds: Column) -> Column:
    """Local date and time; a dash for 0 or NULL."""
    return F.when(seconds.isNull() | (seconds == 0), "—").otherwise(F.from_unixtime(seconds))


def redact_query(query: Column) -> Column:
    """Hides the values of ``token`` and ``sig``."""
    return F.regexp_replace(query, "(^|&)(token|sig)=[^&]*", "$1$2=REDACTED")


def build_pointer(file_hash: Column, size: Column, version: str = POINTER_VERSION) -> Column:
    return F.format_string(f"{version}\nfile-hash %s\nsize %d\n", file_hash, size)


def parse_pointer(text: Column, version: str = POINTER_VERSION, name: str = "file-hash") -> Column:
    """struct(file_hash, size) of a pointer text, or NULL if it is none."""
    file_hash = F.regexp_extract(text, rf"\n{name} ([^\r\n]*)", 1)
    size = F.regexp_extract(text, r"\nsize (\d{1,18})\s*(\n|$)", 1)
    return F.when(text.startswith(version) & (file_hash != "") & (size != ""), F.struct(F.trim(file_hash).alias("file_hash"), F.try_to_number(size, F.lit("9" * 18)).cast("long").alias("size")))


def keyset_after(key: Column, after: str | None) -> Column:
    return F.lit(True) if after is None else key > F.lit(after)


def clamp_limit(limit: int | None, default: int = 100, most: int = 1000) -> int:
    return max(1, min(most, default if limit is None else limit))


def contains_text(columns: list[Column], needle: str) -> Column:
    """Case-insensitive substring on any of the columns."""
    hits = [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def eligible(chunk_hash: Column, modulus: int = 1024) -> Column:
    """Global-dedup eligibility: the hash's last 8 bytes, read as an unsigned number, are a multiple of ``modulus``.

    The number does not fit a long, so its halves are reduced on their own;
    ``modulus`` is under 2**31.
    """
    high, low = (F.conv(F.substring(chunk_hash, at, 8), 16, 10).cast("long") for at in (49, 57))
    return ((high % modulus) * ((1 << 32) % modulus) + low) % modulus == 0
