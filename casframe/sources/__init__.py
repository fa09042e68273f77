"""Readers: stored objects, table files as views, pointers, tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.functions.text import parse_pointer

SCHEMES = {"": "local", "file": "filesystem", "s3": "s3", "s3a": "s3", "gs": "gcs", "abfs": "azure", "abfss": "azure", "hdfs": "hdfs", "viewfs": "hdfs"}


def connector(path: str) -> str:
    """The kind of store a path names; unknown ones are an error."""
    scheme = path.split("://", 1)[0] if "://" in path else path.split(":", 1)[0] if path.startswith("file:") else ""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown storage scheme {scheme!r}")
    return SCHEMES[scheme]


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """(hash, size, last_modified_unix) of a folder, sorted; empty and dot names are skipped.  Contents are not read."""
    connector(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("hash"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("last_modified_unix")).where("hash <> '' AND NOT startswith(hash, '.')").orderBy("hash")


def get_object(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(hash, body) of one object; no row if it is missing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    return found.select(F.lit(name).alias("hash"), F.col("content").alias("body"))


def read_view(spark: SparkSession, path: str, kind: str, name: str = "data") -> DataFrame:
    """Registers a Parquet, CSV or TSV file as a view."""
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("inferSchema", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"no table reader for {kind!r}")
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, sql: str = "SELECT * FROM data LIMIT 100") -> DataFrame:
    """User SQL over the registered views, all columns as strings for display."""
    df = spark.sql(sql)
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) if not kind.startswith(("struct", "array", "map")) else F.to_json(f"`{c}`").alias(c) for c, kind in df.dtypes))


def read_pointers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the pointer's file_hash and size, or NULLs for plain content."""
    return texts.withColumn("_p", parse_pointer(F.col(text))).withColumn("file_hash", F.col("_p.file_hash")).withColumn("size", F.col("_p.size")).drop("_p")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder of spark.checkpoint.dir; on one machine without it, in a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table written to ``path`` and read from there: lineage ends, and readers share the work."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_index(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """An index table kept in a relational database, by JDBC."""
    if url.split(":")[1:2] not in (["sqlite"], ["postgresql"]):
        raise ValueError("index databases are sqlite or postgresql")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
