"""Range planning and reassembly of files from their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions.text import parse_byte_range
from casframe.operators.chunks import spread_join


def term_offsets(terms: DataFrame) -> DataFrame:
    """Half-open byte offsets of each term in its file."""
    w = Window.partitionBy("file_hash").orderBy("term_idx")
    end = F.sum("unpacked_bytes").over(w)
    return terms.withColumn("term_end_excl", end).withColumn("term_start", F.col("term_end_excl") - F.col("unpacked_bytes"))


def resolve_requests(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """(request_id, file_hash, error, range_start, range_end_incl, total) of each request.

    Unknown files are not found; the end is clamped to the file; a start at or past
    the end of the file cannot be satisfied; no header means the whole file.
    """
    parsed = requests.withColumn("r", parse_byte_range(F.col("range_header"))).join(sizes.select("file_hash", F.col("n_bytes").alias("total")), "file_hash", "left")
    start = F.coalesce("r.start", F.lit(0))
    error = F.when(F.col("r.error") == "bad_request", "bad_request").when(F.col("r.error").isNotNull(), F.col("r.error")).when(F.col("total").isNull(), "not_found").when(F.col("range_header").isNotNull() & (start >= F.col("total")), "range_not_satisfiable")
    out = parsed.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select("request_id", "file_hash", "error", F.when(ok, start).alias("range_start"), F.when(ok, F.least(F.coalesce("r.end_incl", F.col("total") - 1), F.col("total") - 1)).alias("range_end_incl"), "total")


def plan_terms(resolved: DataFrame, terms: DataFrame) -> DataFrame:
    """Whole terms that a request's range touches."""
    good = resolved.where("error IS NULL")
    return good.join(term_offsets(terms), "file_hash").where("term_start <= range_end_incl AND term_end_excl > range_start")


def first_offset(plan: DataFrame) -> DataFrame:
    """(request_id, n_terms, unpacked_bytes, offset_into_first_range)."""
    return plan.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("unpacked_bytes").alias("unpacked_bytes"), F.min_by(F.greatest(F.col("range_start") - F.col("term_start"), F.lit(0)), F.col("term_idx")).alias("offset_into_first_range"))


def merge_ranges(plan: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Union of chunk ranges per archive; overlapping and adjacent ranges join."""
    w = Window.partitionBy(*keys, "archive_id").orderBy("chunk_start", "chunk_end_excl")
    reach = F.max("chunk_end_excl").over(w.rowsBetween(Window.unboundedPreceding, -1))
    distinct = plan.select(*keys, "archive_id", "chunk_start", "chunk_end_excl").distinct()
    islands = distinct.withColumn("new", F.when(F.col("chunk_start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "archive_id", "island").agg(F.min("chunk_start").alias("chunk_start"), F.max("chunk_end_excl").alias("chunk_end_excl")).drop("island")


def fetch_entries(ranges: DataFrame, offsets: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Byte spans (inclusive ends) of merged ranges; a range past the layout vanishes, an end past it is clamped.

    The join is on single chunk positions, not a range predicate: a range's first
    and last frames are looked up by equality.
    """
    last = offsets.groupBy("archive_id").agg((F.max("chunk_idx") + 1).alias("n_chunks"))
    clamped = ranges.join(last, "archive_id").where("chunk_start < n_chunks").withColumn("end_idx", F.least("chunk_end_excl", "n_chunks") - 1)
    first = offsets.select("archive_id", F.col("chunk_idx").alias("chunk_start"), F.col("frame_start").alias("byte_start"))
    final = offsets.select("archive_id", F.col("chunk_idx").alias("end_idx"), (F.col("frame_end_excl") - 1).alias("byte_end_incl"))
    return clamped.join(first, ["archive_id", "chunk_start"]).join(final, ["archive_id", "end_idx"]).select(*keys, "archive_id", "chunk_start", (F.col("end_idx") + 1).alias("chunk_end_excl"), "byte_start", "byte_end_incl")


def response_v1(entries: DataFrame, key: str = "request_id") -> DataFrame:
    """fetch_info: map of archive to a list of one range each."""
    item = F.struct(F.struct("chunk_start", "chunk_end_excl").alias("range"), F.struct("byte_start", "byte_end_incl").alias("url_range"))
    per = entries.groupBy(key, "archive_id").agg(F.sort_array(F.collect_list(item)).alias("entries"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("archive_id").cast("string"), "entries")))).alias("fetch_info"))


def response_v2(entries: DataFrame, key: str = "request_id") -> DataFrame:
    """archives: map of archive to the list of its ranges (chunks and bytes)."""
    item = F.struct(F.struct("chunk_start", "chunk_end_excl").alias("chunks"), F.struct("byte_start", "byte_end_incl").alias("bytes"))
    per = entries.groupBy(key, "archive_id").agg(F.struct(F.sort_array(F.collect_list(item)).alias("ranges")).alias("entry"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("archive_id").cast("string"), "entry")))).alias("archives"))


def covering(terms: DataFrame, ranges: DataFrame) -> DataFrame:
    """Term to the fetch entry that contains it."""
    r = ranges.select("request_id", "archive_id", F.col("chunk_start").alias("range_start_idx"), F.col("chunk_end_excl").alias("range_end_idx"))
    return terms.join(r, ["request_id", "archive_id"]).where("range_start_idx <= chunk_start AND chunk_end_excl <= range_end_idx")


def assemble(terms: DataFrame, store: DataFrame) -> DataFrame:
    """(file_hash, text): terms expanded to chunks, joined with the chunk store, joined up in order."""
    wanted = terms.select("file_hash", "term_idx", "archive_id", F.explode(F.sequence("chunk_start", F.col("chunk_end_excl") - 1)).alias("chunk_idx"))
    pieces = spread_join(wanted, store.select("archive_id", "chunk_idx", "data"), ["archive_id", "chunk_idx"])
    ordered = F.sort_array(F.collect_list(F.struct("term_idx", "chunk_idx", "data")))
    return pieces.groupBy("file_hash").agg(F.array_join(F.transform(ordered, lambda x: x["data"]), "").alias("text"))


def byte_slice(bodies: DataFrame, start: str, end_excl: str) -> DataFrame:
    """Object-store range read: the end clamps to the size; a start at or past it is an error."""
    size = F.octet_length("body")
    return bodies.select("*", F.when(F.col(start) >= size, "range_not_satisfiable").alias("error"), F.when(F.col(start) < size, F.substring(F.col("body").cast("binary"), F.col(start) + 1, F.least(F.col(end_excl), size) - F.col(start))).alias("slice"))
