"""Usage accounting and mark-and-sweep garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_owner(owned: DataFrame) -> DataFrame:
    return owned.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("logical_bytes"), F.lit(0)).alias("logical_bytes"))


def usage_total(owned: DataFrame) -> DataFrame:
    """Each file once, at its largest claim."""
    return owned.groupBy("file_hash").agg(F.max("logical_bytes").alias("b")).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("logical_bytes"))


def accounting(owned: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: counts, bytes and the dedup ratio (0.0 without physical bytes)."""
    physical = stored.agg(F.count(F.lit(1)).alias("n_archives"), F.coalesce(F.sum("num_bytes_on_disk"), F.lit(0)).alias("physical_bytes"))
    both = usage_total(owned).crossJoin(physical)  # one row each
    return both.withColumn("dedup_ratio", F.when(F.col("physical_bytes") > 0, F.col("logical_bytes") / F.col("physical_bytes")).otherwise(0.0))


def reachable(file_index: DataFrame, shard_terms: DataFrame) -> DataFrame:
    """Archives that a file's current shard uses; terms of superseded shards do not count."""
    return shard_terms.join(file_index, ["file_hash", "shard_hash"], "left_semi").select("archive_id").distinct()


def sweep(stored: DataFrame, key: str, keep: DataFrame, now: int, grace: int) -> DataFrame:
    """Unreachable objects with their fate: in_grace or freed."""
    return stored.join(keep, key, "left_anti").withColumn("in_grace", F.lit(now) - F.col("last_modified_unix") < grace)


def gc_report(file_index: DataFrame, shard_terms: DataFrame, stored: DataFrame, shards: DataFrame, now: int, grace: int) -> DataFrame:
    """One row of eight counters.  live_shards counts a shard that files name even if it is missing."""
    live = file_index.select("shard_hash").distinct()
    kept = reachable(file_index, shard_terms)
    a = sweep(stored, "archive_id", kept, now, grace).agg(F.count_if("in_grace").alias("archives_in_grace"), F.count_if(~F.col("in_grace")).alias("archives_deleted"), F.coalesce(F.sum(F.when(~F.col("in_grace"), F.col("num_bytes_on_disk"))), F.lit(0)).alias("archive_bytes_freed"))
    s = sweep(shards, "shard_hash", live, now, grace).agg(F.count_if("in_grace").alias("shards_in_grace"), F.count_if(~F.col("in_grace")).alias("shards_deleted"), F.coalesce(F.sum(F.when(~F.col("in_grace"), F.col("size"))), F.lit(0)).alias("shard_bytes_freed"))
    counts = live.agg(F.count(F.lit(1)).alias("live_shards")).crossJoin(kept.agg(F.count(F.lit(1)).alias("reachable_archives")))
    return counts.crossJoin(a).crossJoin(s)  # one row each


def survivors(stored: DataFrame, key: str, keep: DataFrame, now: int, grace: int) -> DataFrame:
    gone = sweep(stored, key, keep, now, grace).where(~F.col("in_grace"))
    return stored.join(gone.select(key), key, "left_anti")
