"""Ownership, upserts, deletion and keyset-paged listings.

State is a set of immutable tables; a mutation is a function from tables to tables,
to be written as a new version.  ``seq`` orders writes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions.access import satisfies
from casframe.functions.text import clamp_limit, encode_cursor, keyset_after

EPOCH = 1_700_000_000
STEP = 60
WALK_ROWS = 100_000


def claims(uploads: DataFrame) -> DataFrame:
    """(file_hash, owner_id, logical_bytes, created_at_unix): one claim per file and owner.

    A repeated claim refreshes the size and keeps the first time.
    """
    stamped = uploads.select("file_hash", "owner_id", "seq", F.col("n_bytes").alias("logical_bytes"), (F.lit(EPOCH) + F.col("seq") * STEP).alias("created_at_unix"))
    return upsert_claims(stamped)


def upsert_claims(writes: DataFrame) -> DataFrame:
    return writes.groupBy("file_hash", "owner_id").agg(F.max_by("logical_bytes", "seq").alias("logical_bytes"), F.min_by("created_at_unix", "seq").alias("created_at_unix"))


def upsert_latest(writes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last writer wins, by aggregation so that a hot key is combined before the shuffle."""
    rest = [c for c in writes.columns if c not in (key, order)]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def insert_ignore(writes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first of equal keys stays, in insertion order."""
    return writes.groupBy(*keys).agg(F.min(order).alias(order))


def put_if_absent(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``incoming`` (one row per key) with was_inserted."""
    return incoming.join(existing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn("was_inserted", F.col("_there").isNull()).drop("_there")


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent delete: missing keys are no error."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def list_all(file_index: DataFrame, owned: DataFrame) -> DataFrame:
    """(file_hash, logical_bytes): largest claim of every file, 0 if unclaimed."""
    return file_index.select("file_hash").join(owned, "file_hash", "left").groupBy("file_hash").agg(F.coalesce(F.max("logical_bytes"), F.lit(0)).alias("logical_bytes"))


def list_owner(file_index: DataFrame, owned: DataFrame, owner: str) -> DataFrame:
    return owned.where(F.col("owner_id") == owner).join(file_index.select("file_hash"), "file_hash").select("file_hash", "logical_bytes")


def page(rows: DataFrame, key: str, after: str | None = None, limit: int | None = None) -> DataFrame:
    """One page plus a row to tell whether another follows: a top-k over the key."""
    return rows.where(keyset_after(F.col(key), after)).orderBy(key).limit(clamp_limit(limit) + 1)


def split_page(rows: list, limit: int) -> tuple[list, str | None]:
    """The page's rows and the key of the last kept row if there is more."""
    return rows[:limit], rows[limit - 1][0] if len(rows) > limit else None


def walk(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """All pages at once: page number and cursor after each page's last row.

    Keys are hashes in hex; those that share their first digits are ranked together,
    as many digits as leave about WALK_ROWS rows or fewer.
    """
    digits = max(2, math.ceil(math.log(max(1, rows.count() / WALK_ROWS), 16)))
    ranked = rows.withColumn("bucket", F.substring(key, 1, digits))
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    placed = ranked.join(counts, "bucket").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1)
    return placed.select(key, F.floor(F.col("place") / limit).cast("long").alias("page"), F.when(F.col("place") % limit == limit - 1, encode_cursor(F.col(key))).alias("next_cursor"))


def file_detail(owned: DataFrame, terms: DataFrame) -> DataFrame:
    """Per file: owners in order, size of the first owner's claim, sorted distinct archives."""
    claimed = owned.groupBy("file_hash").agg(F.min_by("logical_bytes", "owner_id").alias("size"), F.array_join(F.sort_array(F.collect_list("owner_id")), ",").alias("owners"))
    used = terms.groupBy("file_hash").agg(F.array_join(F.transform(F.sort_array(F.collect_set("archive_id")), lambda x: x.cast("string")), ",").alias("archives"))
    return claimed.join(used, "file_hash", "left")


def visible(file_index: DataFrame, owned: DataFrame, owner: str, admin: bool = False) -> DataFrame:
    """Files a caller may read: all for an admin, else the claimed ones."""
    return file_index if admin else file_index.join(owned.where(F.col("owner_id") == owner), "file_hash", "left_semi")


def delete_outcomes(requests: DataFrame, file_index: DataFrame, owned: DataFrame) -> DataFrame:
    """(request_id, outcome, deleted, remaining_owners): each request against the same state."""
    owners = owned.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    r = requests.join(file_index.select("file_hash", F.lit(True).alias("known")), "file_hash", "left").join(owners, "file_hash", "left")
    r = r.join(owned.select("file_hash", "owner_id", F.lit(True).alias("holds")), ["file_hash", "owner_id"], "left")
    outcome = F.when(F.col("known").isNull(), "not_found").when(F.col("n_owners").isNull(), F.when(satisfies(F.col("scope"), F.lit("admin")), "ok").otherwise("forbidden")).when(F.col("holds").isNull(), "forbidden").otherwise("ok")
    left = F.coalesce(F.col("n_owners") - 1, F.lit(0))
    return r.withColumn("outcome", outcome).select("request_id", "outcome", F.when(F.col("outcome") == "ok", left == 0).alias("deleted"), F.when(F.col("outcome") == "ok", left).alias("remaining_owners"))


def put_shards(incoming: DataFrame, existing: DataFrame, index: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Puts shards (shard_hash, file_hash, owner_id, logical_bytes, created_at_unix, seq): what was inserted, and
    the file index (file_hash, shard_hash, seq) and claims after.  Both are refreshed for known shards too."""
    status = put_if_absent(incoming.groupBy("shard_hash").agg(F.countDistinct("file_hash").alias("n_files")), existing, "shard_hash")
    after = upsert_latest(index.select("file_hash", "shard_hash", "seq").union(incoming.select("file_hash", "shard_hash", "seq")), "file_hash")
    columns = ["file_hash", "owner_id", "seq", "logical_bytes", "created_at_unix"]
    return status, after, upsert_claims(owned.select(*columns).union(incoming.select(*columns)))


def remove_files(index: DataFrame, owned: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File index and claims without the files: claims go with the entry, whoever holds them."""
    return remove(index, gone, ["file_hash"]), remove(owned, gone, ["file_hash"])


def remove_archives(locations: DataFrame, layouts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk locations and layouts without the archives."""
    return remove(locations, gone, ["archive_id"]), remove(layouts, gone, ["archive_id"])


def named(entries: DataFrame) -> DataFrame:
    """A client's catalogue: (client, file_hash, name, place), newest first, each file once with its newest name."""
    latest = entries.groupBy("client", "file_hash").agg(F.max(F.struct("seq", "name")).alias("v")).select("client", "file_hash", F.col("v.name").alias("name"), F.col("v.seq").alias("seq"))
    return latest.select("client", "file_hash", "name", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("seq"))).cast("long").alias("place"))


def layouts(index: DataFrame, header: int = 8) -> DataFrame:
    """(archive_id, layout): the archive's chunks as JSON, in order."""
    chunk = F.struct(F.col("chunk_idx").alias("i"), F.col("chunk_hash").alias("hash"), F.col("n_bytes").alias("size"))
    listed = F.sort_array(F.collect_list(chunk))
    return index.groupBy("archive_id").agg(F.to_json(F.struct(F.sum(F.col("n_bytes") + header).alias("bytes"), listed.alias("chunks"))).alias("layout"))


def decoded_layouts(layouts_: DataFrame) -> DataFrame:
    """(archive_id, chunk_idx, chunk_hash, n_bytes, num_bytes_on_disk) of JSON layouts."""
    read = layouts_.select("archive_id", F.from_json("layout", "bytes long, chunks array<struct<i: long, hash: string, size: long>>").alias("l"))
    return read.select("archive_id", F.col("l.bytes").alias("num_bytes_on_disk"), F.explode("l.chunks").alias("c")).select("archive_id", "num_bytes_on_disk", F.col("c.i").alias("chunk_idx"), F.col("c.hash").alias("chunk_hash"), F.col("c.size").alias("n_bytes"))


def result_frames(status: DataFrame) -> DataFrame:
    """(shard_hash, frame): the line that ends an upload's response, 1 for an inserted shard and 0 for a known one."""
    result = F.struct(F.lit("result").alias("type"), F.col("was_inserted").cast("int").alias("result"))
    return status.select("shard_hash", F.concat(F.to_json(result), F.lit("\n")).alias("frame"))
