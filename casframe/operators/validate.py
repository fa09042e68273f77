"""Constraint queries: rows that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.functions.text import is_hash
from casframe.operators.chunks import spread_join


def bad_hashes(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~is_hash(F.col(column)))


def missing_archives(terms: DataFrame, stored: DataFrame) -> DataFrame:
    return terms.select("archive_id").distinct().join(stored.select("archive_id"), "archive_id", "left_anti")


def term_violations(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(file_hash, term_idx, rule) for empty or overlong ranges, wrong sizes and wrong range hashes.

    Terms are exploded to chunk positions, so the join is an equality join.
    """
    sizes = index.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    known = terms.join(sizes, "archive_id", "left")
    ranges = known.select("file_hash", "term_idx", F.when(F.col("n_chunks").isNull(), "archive_missing").when(F.col("chunk_end_excl") <= F.col("chunk_start"), "range_empty").when(F.col("chunk_end_excl") > F.col("n_chunks"), "range_past_end").alias("rule"))
    good = known.where("n_chunks IS NOT NULL AND chunk_end_excl > chunk_start AND chunk_end_excl <= n_chunks")
    wanted = good.select("file_hash", "term_idx", "archive_id", "unpacked_bytes", "range_hash", F.explode(F.sequence("chunk_start", F.col("chunk_end_excl") - 1)).alias("chunk_idx"))
    parts = spread_join(wanted, index.select("archive_id", "chunk_idx", "chunk_hash", "n_bytes"), ["archive_id", "chunk_idx"])
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk_hash"))), lambda x: x["chunk_hash"]), "")
    sums = parts.groupBy("file_hash", "term_idx", "unpacked_bytes", "range_hash").agg(F.sum("n_bytes").alias("real"), F.sha2(listed, 256).alias("hash"))
    deep = sums.select("file_hash", "term_idx", F.when(F.col("real") != F.col("unpacked_bytes"), "size_mismatch").when(F.col("hash") != F.col("range_hash"), "range_hash_mismatch").alias("rule"))
    return ranges.union(deep).where("rule IS NOT NULL")


def files_without_terms(files: DataFrame, terms: DataFrame) -> DataFrame:
    return files.join(terms.select("file_hash").distinct(), "file_hash", "left_anti")


def wrong_file_hashes(declared: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seq, file_hash, real) of declared files (seq, body, file_hash) whose content has another hash.

    ``chunks`` are (body, ord, data); ``body`` names a content.
    """
    data = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "data"))), lambda x: x["data"]), "")
    real = chunks.groupBy("body").agg(F.sha2(data, 256).alias("real"))
    return declared.join(real, "body").where("file_hash <> real").select("seq", "file_hash", "real")


def wrong_archives(declared: DataFrame, index: DataFrame) -> DataFrame:
    """(archive_id, rule) of declared archives (archive_id, archive_hash) that are empty or whose hash is another."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk_hash"))), lambda x: x["chunk_hash"]), "")
    real = index.groupBy("archive_id").agg(F.sha2(listed, 256).alias("real"))
    rule = F.when(F.col("real").isNull(), "archive_empty").when(F.col("real") != F.col("archive_hash"), "archive_hash_mismatch")
    return declared.join(real, "archive_id", "left").select("archive_id", rule.alias("rule")).where("rule IS NOT NULL")


def index_violations(claimed: DataFrame, index: DataFrame) -> DataFrame:
    """(chunk_hash, archive_id, chunk_idx, rule) of claimed locations whose archive is missing or holds another chunk there."""
    known = index.select("archive_id").distinct().withColumn("known", F.lit(True))
    there = index.select("archive_id", "chunk_idx", F.col("chunk_hash").alias("stored"))
    rule = F.when(F.col("known").isNull(), "archive_missing").when(~F.col("chunk_hash").eqNullSafe(F.col("stored")), "chunk_mismatch")
    found = claimed.join(known, "archive_id", "left").join(there, ["archive_id", "chunk_idx"], "left")
    return found.select("chunk_hash", "archive_id", "chunk_idx", rule.alias("rule")).where("rule IS NOT NULL")
