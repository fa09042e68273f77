"""Content sniffing and previews of binary columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_BYTES = 512 << 10
SAMPLE_BYTES = 8192
SAMPLE_LINES = 20

# Leading bytes, in the order they are tried.
MAGIC = [("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/gif", "47494638"), ("image/webp", "52494646________57454250"), ("application/pdf", "255044462D")]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looks_like_text(body: Column) -> Column:
    """No NUL and no control byte but tab, line feed and carriage return in the first 8 KiB."""
    return ~F.decode(F.substring(body, 1, SAMPLE_BYTES), "ISO-8859-1").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def detect_tabular(text: Column) -> Column:
    """``tsv``, ``csv`` or NULL: the header's column count holds in 80 % of the first 20 lines."""
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"[\r\t\f\x0B]", " "))) > 0), 1, SAMPLE_LINES)

    def even(counts: Column) -> Column:
        same = F.size(F.filter(counts, lambda c: c == F.get(counts, F.lit(0))))
        return (F.get(counts, F.lit(0)) >= 2) & (same * 5 >= F.size(counts) * 4)

    def holds(some: Column, delimiter: str) -> Column:
        return _bound(F.transform(some, lambda x: F.size(F.split(x, delimiter))), even)

    return _bound(lines, lambda some: F.when(F.size(some) < 2, None).when(holds(some, "\t"), "tsv").when(holds(some, ","), "csv"))


def sniff_content(body: Column) -> Column:
    """Content type by leading bytes, then by text rules; ``application/octet-stream`` at last."""
    head = F.hex(F.substring(body, 1, 16))
    text = F.substring(body, 1, TEXT_BYTES).cast("string")
    start = F.lower(F.ltrim(F.regexp_replace(F.substring(text, 1, 4096), "^[\\s\ufeff]+", "")))
    out = F.when(F.lit(False), "")
    for mime, magic in MAGIC:
        out = out.when(head.like(magic + "%"), mime)
    out = out.when((F.octet_length(body) >= 8) & head.startswith("50415231") & (F.hex(F.substring(body, -4, 4)) == "50415231"), "parquet")
    table = detect_tabular(text)
    plain = F.when(start.startswith("<svg") | (start.startswith("<?xml") & F.lower(text).contains("<svg")), "image/svg+xml").otherwise(F.coalesce(table, F.lit("text/plain")))
    return out.when(looks_like_text(body), plain).otherwise("application/octet-stream")


def image_mime(body: Column) -> Column:
    """MIME type of an image cell; PNG if unknown."""
    head = F.hex(F.substring(body, 1, 9))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8"), "image/jpeg").when(head.startswith("474946"), "image/gif").when(head.like("52494646________57%"), "image/webp").otherwise("image/png")


def data_url(body: Column) -> Column:
    return F.concat(F.lit("data:"), image_mime(body), F.lit(";base64,"), F.translate(F.base64(body), "\r\n", ""))


def short_json(value: Column, most: int = 120) -> Column:
    """A struct as JSON, cut to ``most`` characters with an ellipsis."""
    text = F.to_json(value)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def hex_dump(body: Column, most: int = 256) -> Column:
    """Array of ``offset  hex  |text|`` lines of 16 bytes."""
    def starts(h: Column) -> Column:
        n = F.length(h).cast("int")
        return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(32))).otherwise(F.array().cast("array<int>"))

    def line(h: Column, i: Column) -> Column:
        pairs = F.filter(F.regexp_extract_all(F.substr(h, i + 1, F.lit(32)), F.lit("(..)"), F.lit(1)), lambda p: p != "")
        shown = lambda some: F.transform(some, lambda p: F.when((p >= "20") & (p <= "7e"), F.unhex(p).cast("string")).otherwise("."))
        offset = F.lpad(F.lower(F.hex((i / 2).cast("long"))), 8, "0")
        return _bound(pairs, lambda some: F.concat(offset, F.lit("  "), F.rpad(F.array_join(some, " "), 47, " "), F.lit("  |"), F.array_join(shown(some), ""), F.lit("|")))

    return _bound(F.lower(F.hex(F.substring(body, 1, most))), lambda h: F.transform(starts(h), lambda i: line(h, i)))


def numbered_lines(text: Column) -> Column:
    """Array of struct(line_no, line) of the first 512 KiB."""
    lines = F.split(F.substring(text.cast("binary"), 1, TEXT_BYTES).cast("string"), "\n")
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
