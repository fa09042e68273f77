"""Files, chunks, placement, archives and terms.

The line chunker is the SQL-expressible stand-in for content-defined chunking (see
:mod:`casframe.operators.cdc` for that): a chunk is a line with its line feed, its
identity SHA-256.  Distinct chunks fill archives of ``per_archive`` in order of first
occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions.access import hmac_sha256

PER_ARCHIVE = 64
RANK_GROUP = 1024
HOT = 2000


def files(documents: DataFrame) -> DataFrame:
    """(file_hash, owner_id, seq, n_bytes, text): each row of ``documents`` as one upload."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.sha2(text, 256).alias("file_hash"), F.col("source").alias("owner_id"), F.col("doc_id").alias("seq"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def distinct_files(uploads: DataFrame) -> DataFrame:
    """One row per body with its first upload's seq; equal bodies collapse before the shuffle."""
    return uploads.groupBy("file_hash", "n_bytes", "text").agg(F.min("seq").alias("seq")).select("file_hash", "seq", "n_bytes", "text")


def line_chunks(bodies: DataFrame, with_data: bool = False) -> DataFrame:
    """(file_hash, seq, ord, chunk_hash, n_bytes[, data]); an empty body has no chunk."""
    lines = bodies.select("file_hash", "seq", F.posexplode(F.split("text", "(?<=\n)")).alias("ord", "data"))
    out = lines.select("file_hash", "seq", F.col("ord").cast("long").alias("ord"), "data").where("data <> ''")
    return out.select("file_hash", "seq", "ord", F.sha2("data", 256).alias("chunk_hash"), F.octet_length("data").cast("long").alias("n_bytes"), *(["data"] if with_data else []))


def byte_starts(chunks: DataFrame) -> DataFrame:
    before = Window.partitionBy("file_hash").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("byte_start", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))


def positions(rows: DataFrame, major: str, order: list[Column], name: str = "pos", group: int = RANK_GROUP) -> DataFrame:
    """Adds each row's place in a global order that starts with the non-negative column ``major``.

    No window runs over all rows: rows are ranked inside groups of ``group``
    consecutive values of ``major``, the groups' counts are summed up inside spans of
    ``group`` groups, and the spans' counts before: one row for ``group * group``
    values is all that meets in one task.
    """
    grouped = rows.withColumn("_g", F.floor(F.col(major) / group))
    counts = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.floor(F.col("_g") / group))
    spans = counts.groupBy("_s").agg(F.sum("_n").alias("_m"))
    spans = spans.select("_s", (F.sum("_m").over(Window.orderBy("_s")) - F.col("_m")).alias("_base"))
    inside = F.sum("_n").over(Window.partitionBy("_s").orderBy("_g")) - F.col("_n")
    prefix = counts.withColumn("_in", inside).join(spans, "_s").select("_g", (F.col("_base") + F.col("_in")).alias("_before"))
    ranked = grouped.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return ranked.join(prefix, "_g").withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_g", "_before", "_r")


def chunk_index(chunks: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(chunk_hash, n_bytes, pos, archive_id, chunk_idx): where each distinct chunk is stored."""
    first = chunks.groupBy("chunk_hash").agg(F.min("n_bytes").alias("n_bytes"), F.min(F.struct("seq", "ord")).alias("at")).select("chunk_hash", "n_bytes", F.col("at.seq").alias("seq"), F.col("at.ord").alias("ord"))
    placed = positions(first, "seq", [F.col("seq"), F.col("ord")])
    return placed.select("chunk_hash", "n_bytes", "pos", F.floor(F.col("pos") / per_archive).cast("long").alias("archive_id"), (F.col("pos") % per_archive).cast("long").alias("chunk_idx"))


def archives(index: DataFrame, header: int = 8) -> DataFrame:
    """(archive_id, archive_hash, n_chunks, unpacked_bytes, num_bytes_on_disk)."""
    listed = F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk_hash")))
    return index.groupBy("archive_id").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["chunk_hash"]), ""), 256).alias("archive_hash"), F.count(F.lit(1)).alias("n_chunks"), F.sum("n_bytes").alias("unpacked_bytes"), F.sum(F.col("n_bytes") + header).alias("num_bytes_on_disk"))


def frame_offsets(index: DataFrame, header: int = 8) -> DataFrame:
    """Physical (frame) and unpacked start and end of each chunk in its archive."""
    w = Window.partitionBy("archive_id").orderBy("chunk_idx")
    physical, unpacked = F.sum(F.col("n_bytes") + header).over(w), F.sum("n_bytes").over(w)
    return index.select(
        "archive_id", "chunk_idx", (physical - F.col("n_bytes") - header).alias("frame_start"), physical.alias("frame_end_excl"), (unpacked - F.col("n_bytes")).alias("unpacked_start"), unpacked.alias("unpacked_end_excl")
    )


def sizes_from_ends(offsets: DataFrame) -> DataFrame:
    """Sizes as differences of cumulative ends."""
    w = Window.partitionBy("archive_id").orderBy("chunk_idx")
    return offsets.select("archive_id", "chunk_idx", (F.col("unpacked_end_excl") - F.lag("unpacked_end_excl", 1, 0).over(w)).alias("n_bytes"))


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (one row a key), whatever share of the rows one key holds.

    A key of over one in HOT of the rows is broadcast.  There are fewer than HOT of
    them, and a payload that each of their rows could carry adds up to HOT mean
    payloads of a row at most.  ``rows`` are read three times: give a written table
    where they are costly to make.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("_n") * HOT > F.col("_total")).select(*on)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(keys.join(F.broadcast(hot), on)), on).unionByName(rest)


def file_terms(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Maximal runs of consecutive chunks of one archive: gaps and islands per file."""
    placed = spread_join(chunks.select("file_hash", "ord", "chunk_hash", "n_bytes"), index.select("chunk_hash", "archive_id", "chunk_idx"), ["chunk_hash"])
    w = Window.partitionBy("file_hash").orderBy("ord")
    follows = (F.lag("archive_id").over(w) == F.col("archive_id")) & (F.lag("chunk_idx").over(w) + 1 == F.col("chunk_idx"))
    runs = placed.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("term_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("ord", "chunk_hash"))), lambda x: x["chunk_hash"])
    return runs.groupBy("file_hash", "term_idx", "archive_id").agg(F.min("chunk_idx").alias("chunk_start"), (F.max("chunk_idx") + 1).alias("chunk_end_excl"), F.sum("n_bytes").alias("unpacked_bytes"), F.sha2(F.array_join(hashes, ""), 256).alias("range_hash"))


def shared_chunks(chunks: DataFrame) -> DataFrame:
    """Uses and users of each chunk that more than one place needs."""
    return chunks.groupBy("chunk_hash").agg(F.min("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("uses"), F.countDistinct("file_hash").alias("n_files")).where("uses > 1")


def lookup(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Dedup lookup: the whole archive of every probed chunk that is stored."""
    hit = probes.select("chunk_hash").distinct().join(index.select("chunk_hash", "archive_id"), "chunk_hash").select("archive_id").distinct()
    return index.join(hit, "archive_id", "left_semi")


def keyed(hashes: DataFrame, key: bytes, column: str = "chunk_hash") -> DataFrame:
    """Chunk hashes under a dedup key (HMAC), so that a lookup does not reveal stored hashes."""
    return hashes.withColumn("keyed_hash", hmac_sha256(key, F.col(column)))


def keyed_lookup(probes: DataFrame, index: DataFrame, key: bytes) -> DataFrame:
    """Probed chunks that are stored, found by their keyed hashes alone."""
    return keyed(probes.select("chunk_hash").distinct(), key).join(keyed(index, key).drop("chunk_hash"), "keyed_hash")
