"""Scratch tables, sampling and schema helpers for the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PART_BYTES = 16 << 20
HEAVY = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests) a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def part_count(df: DataFrame) -> int:
    """Partitions for what is made of ``df``: one for PART_BYTES of its stored size, two for each core at least.

    A table of a few MB in hundreds of files costs more for its files than for its
    rows; where the input is large this is more than the shuffle's own partitions and
    changes nothing.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        size = PART_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes and rereads a table, in at most ``parts`` files (see part_count;
    ``like`` is the operator's input), ``drop`` deletes one that is not needed any
    more, so that disk use stays near one copy of what is live.
    """

    def __init__(self, spark: SparkSession, name: str, like: DataFrame) -> None:
        self.spark, self.parts = spark, part_count(like)
        self.base = f"{shared_dir(spark)}/casframe/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.coalesce(self.parts).write.mode("overwrite").options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Has the driver collect plans that are done, so that their shuffle files go; long loops need it for their disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo parts."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def spread_sample(df: DataFrame, key: str, rows: int, total: int, seed: str = "s") -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of the key and so the same on each run.

    ``total`` is the number of rows; with fewer than ``rows`` all of them stay.
    """
    if total <= rows:
        return df
    share = int(rows / total * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < share)


def fill_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def heavy_keys(keys: DataFrame, n: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``keys`` split into those of over one in HEAVY of ``total`` rows (column ``n`` counts them) and the rest.

    The first are HEAVY at most, whatever the data, so they may be broadcast; no key
    of the others fills a task.
    """
    heavy = F.col(n) * HEAVY > total
    return keys.where(heavy), keys.where(~heavy)


def match(rows: DataFrame, keys: DataFrame, on: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with distinct ``keys`` by ``on``; rows of heavy keys are not shuffled.

    ``n`` is the column of ``keys`` with the number of a key's rows among ``total``;
    it is not in the result.
    """
    heavy, light = (x.drop(n) for x in heavy_keys(keys, n, total))
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


def bitmap(slots: DataFrame, bits: int) -> bytes:
    """A packed bitmap (little-endian bits) of a column ``slot`` in [0, bits).

    64 bits make one row, gathered by aggregation.
    """
    words = slots.groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    out = np.zeros(bits >> 6, np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.astype("<i8").tobytes()
