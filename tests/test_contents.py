"""Joins with frequent keys, encoded archives, schemas, tables written once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casframe import schema
from casframe.functions import frames, text
from casframe.operators import cdc, chunks
from casframe.plans import storage

SF = "/root/testdata/sf0.001"


def test_spread_join_is_an_inner_join(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4000)).alias("k"), "id")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS STRING), 9001L"))
    keys = rows.select("k").where("k <> 'k3'").distinct().withColumn("v", F.length("k"))
    got = chunks.spread_join(rows, keys, ["k"])
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, rows.join(keys, "k").select("k", "id", "v").collect()))
    assert chunks.spread_join(rows.limit(0), keys, ["k"]).count() == 0


def test_spread_join_shuffles_no_hot_row(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = chunks.spread_join(rows, spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v")), ["k"])
    assert got.count() == 100_000 and got.where("v <> k + 1").isEmpty()


@pytest.mark.parametrize("text, want", [("", []), ("a", ["a"]), ("a\n", ["a\n"]), ("\n\na\n\nb", ["\n", "\n", "a\n", "\n", "b"]), ("é\r\nb\n", ["é\r\n", "b\n"])])
def test_line_chunks_join_up(spark, text, want):
    bodies = spark.createDataFrame([("f", 1, text)], "file_hash string, seq long, text string")
    got = chunks.line_chunks(bodies, True).orderBy("ord").collect()
    assert [r.data for r in got] == want and [r.ord for r in got] == list(range(len(want)))
    assert [r.n_bytes for r in got] == [len(w.encode()) for w in want]


def test_long_text_splits_in_linear_time(spark):
    bodies = spark.range(1).select(F.lit("f").alias("file_hash"), F.lit(1).cast("long").alias("seq"), F.repeat(F.lit("line of text\n"), 300_000).alias("text"))
    assert chunks.line_chunks(bodies).count() == 300_000


@pytest.mark.parametrize("scheme", [frames.RAW, frames.LZ4, frames.GROUPED_LZ4])
def test_archives_walk_and_decode(spark, scheme):
    data = [b"x" * 50, b"", bytes(range(256)), b"tail"]
    store = spark.createDataFrame([(7, k, d) for k, d in reversed(list(enumerate(data)))], "archive_id long, chunk_idx long, data binary")
    bodies = cdc.archive_bodies(store, scheme)
    got = cdc.walk_frames(bodies).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.n_bytes, r.chunk_hash) for r in got] == [(k, len(d), hashlib.sha256(d).hexdigest()) for k, d in enumerate(data)]
    assert [r.frame_start for r in got] == [0, *(r.frame_end_excl for r in got[:-1])]
    part = cdc.decode_frames(bodies.withColumn("chunk_start", F.lit(1)).withColumn("chunk_end_excl", F.lit(3))).first()
    assert bytes(part.data) == b"".join(data[1:3])
    tail = bodies.withColumn("body", F.concat("body", F.lit(b"\x01opaque tail")))
    assert cdc.walk_frames(tail).count() == len(data)
    assert cdc.walk_frames(spark.createDataFrame([(1, None)], "archive_id long, body binary")).count() == 0


def test_schema_check(spark):
    schema.check(storage._claims(spark, SF), "file_ownership")
    with pytest.raises(ValueError, match="logical_bytes"):
        schema.check(storage._claims(spark, SF).withColumn("logical_bytes", F.lit("x")), "file_ownership")


def test_a_query_writes_its_tables_once(spark, monkeypatch):
    names = []
    real = storage.written
    monkeypatch.setattr(storage, "written", lambda df, path: names.append(path.rsplit("/", 1)[1].split("-")[0]) or real(df, path))
    assert storage.QUERIES["term_cover"](spark, SF).count() > 0
    assert sorted(names) == ["chunks", "index", "terms"]
    storage.QUERIES["file_terms"](spark, SF)
    assert sorted(names) == ["chunks", "chunks", "index", "index", "terms", "terms"]


def test_format_bytes_is_its_sql_on_large_and_odd_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    keys = [(0, 7), (1, 1), (5, 29), (147, 1), (1023, 1024), (20_000, 1000), (1_200_000, 60_000), (3_067_834, 1024), (2**30, 2**20), (None, 3), (3, None), (-40, 9)]
    rows = [(i, p, s, j, q) for i, (p, s) in enumerate(keys) for j, q in enumerate([1.0, 50.0, 0.5, 1.5, 2.5, 2.4999, -1.0, None])]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.sql(storage.ORACLES["format_bytes"]).fetchall())
    assert sorted(map(tuple, storage.QUERIES["format_bytes"](spark, str(tmp_path)).collect())) == want
    assert {(r[2] or "-").split(" ")[-1] for r in want} == {"B", "KB", "MB", "GB", "-"} and any(len(r[2] or "") > 10 for r in want)


def test_format_bytes_in_a_largest_unit(spark):
    got = [spark.range(1).select(text.format_bytes(F.lit(n), unit)).first()[0] for n, unit in [(5 * 1024**4, "GB"), (1024**2, "KB"), (1536, "B"), (1024**5, "TB")]]
    assert got == ["5120.0 GB", "1024.0 KB", "1536 B", "1024.0 TB"]
