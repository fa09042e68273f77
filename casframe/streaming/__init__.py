"""Incremental ingestion of uploads with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casframe.operators import catalog, chunks


class Index:
    """Claims and chunk hashes as a log of batches with regular compactions.

    A batch writes its own claims and chunks, merged, as one entry of the log, so its
    cost follows its size and a retried batch writes the same entry again.  Every
    ``every`` batches all entries so far become one base, and what is older than the
    base before goes.  Reading merges the last base with the entries after it; both
    merges are associative.
    """

    SCHEMAS = {"claims": "file_hash string, owner_id string, logical_bytes long, created_at_unix long, seq long", "chunks": "chunk_hash string, n_bytes long, seq long"}

    def __init__(self, spark: SparkSession, path: str, every: int = 16) -> None:
        self.spark, self.path, self.every = spark, path, every

    def merged(self, name: str, rows: DataFrame) -> DataFrame:
        if name == "claims":
            return rows.groupBy("file_hash", "owner_id").agg(F.max_by("logical_bytes", "seq").alias("logical_bytes"), F.min("created_at_unix").alias("created_at_unix"), F.max("seq").alias("seq"))
        return rows.groupBy("chunk_hash").agg(F.min("n_bytes").alias("n_bytes"), F.min("seq").alias("seq"))

    def read(self, name: str, version: int, own_base: bool = True) -> DataFrame:
        """State after batch ``version``; -1 is before the first."""
        if version < 0:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        base = (version + 1) // self.every * self.every - 1
        base -= self.every * (base == version and not own_base)
        paths = [f"{self.path}/{name}/base={base}"] * (base >= 0) + [f"{self.path}/{name}/batch={k}" for k in range(base + 1, version + 1)]
        rows = self.spark.read.schema(self.SCHEMAS[name]).parquet(*paths)
        return self.merged(name, rows) if len(paths) > 1 else rows

    def merge(self, batch: DataFrame, number: int) -> None:
        uploads = chunks.files(batch)
        claims = uploads.select("file_hash", "owner_id", F.col("n_bytes").alias("logical_bytes"), (F.lit(catalog.EPOCH) + F.col("seq") * catalog.STEP).alias("created_at_unix"), "seq")
        lines = chunks.line_chunks(chunks.distinct_files(uploads)).select("chunk_hash", "n_bytes", "seq")
        for name, rows in (("claims", claims), ("chunks", lines)):
            self.merged(name, rows).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
            if (number + 1) % self.every == 0:
                self.read(name, number, own_base=False).write.mode("overwrite").parquet(f"{self.path}/{name}/base={number}")
                old = number - self.every
                self._expire([f"{name}/batch={k}" for k in range(max(0, old - self.every + 1), old + 1)] + [f"{name}/base={old - self.every}"])

    def _expire(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ingest(source: DataFrame, index: Index, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts merging a stream of uploads (columns of documents) batch by batch."""

    def step(batch: DataFrame, number: int) -> None:
        index.merge(batch, number)
        if after:
            after(number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Event counts and sums by tumbling window and type, with a watermark when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
