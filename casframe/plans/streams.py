"""Streaming queries: ingestion of uploads and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.plans.storage import _with
from casframe.sources import read_table, work_dir
from casframe.streaming import Index, ingest, windowed_counts


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after ingesting documents as a stream of files."""
    work = work_dir(spark, "stream")
    schema = read_table(spark, sf_dir, "documents").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, work, schema))
    index, last = Index(spark, f"{work}/index"), []
    ingest(source, index, f"{work}/checkpoint", last.append).awaitTermination()
    return index.read("claims", last[-1] if last else -1).drop("seq")


def _folder(spark: SparkSession, sf_dir: str, work: str, schema) -> str:
    """The uploads as a folder of two files, to give the stream more than one."""
    path = f"{work}/uploads"
    read_table(spark, sf_dir, "documents").repartition(2).write.parquet(path)
    return path


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(events)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"stream_ingest": stream_ingest, "event_windows": event_windows}
ORACLES = {
    "stream_ingest": _with("k", "SELECT * FROM k"),
    "event_windows": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
