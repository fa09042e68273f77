"""Queries over encoded archives, byte ranges, views, and rules on scopes and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from casframe.functions import access, sniff, text
from casframe.operators import catalog, cdc, chunks, reconstruct, validate
from casframe.plans.records import _put
from casframe.plans.storage import _bodies, _chunks, _claims, _file_index, _index, _plan, _terms, _uploads, query
from casframe.sources import read_table, read_view, run_sql, work_dir

_DATA = "x AS (SELECT chunk_hash, any_value(data) AS data FROM c GROUP BY chunk_hash)"


def _encoded(spark, d):
    """Every archive as frames."""
    data = _chunks(spark, d, True).groupBy("chunk_hash").agg(F.first("data").alias("data"))
    return cdc.archive_bodies(_index(spark, d).join(data, "chunk_hash"))


@query("i o", "SELECT i.archive_id, i.chunk_idx, o.frame_start, o.frame_end_excl, i.n_bytes, i.chunk_hash FROM i JOIN o ON i.archive_id = o.archive_id AND i.chunk_idx = o.chunk_idx")
def frame_walk(spark, d):
    """What the frames of encoded archives say is what the index says."""
    return cdc.walk_frames(_encoded(spark, d))


@query("c i a", f"SELECT * FROM (WITH {_DATA} SELECT i.archive_id, sha256(string_agg(x.data, '' ORDER BY i.chunk_idx)) AS half_hash FROM i JOIN x ON i.chunk_hash = x.chunk_hash JOIN a ON i.archive_id = a.archive_id WHERE i.chunk_idx < (a.n_chunks + 1) // 2 GROUP BY i.archive_id)")
def frame_ranges(spark, d):
    """The first half of each archive's chunks, decoded from its frames."""
    half = chunks.archives(_index(spark, d)).select("archive_id", F.lit(0).alias("chunk_start"), F.floor((F.col("n_chunks") + 1) / 2).alias("chunk_end_excl"))
    return cdc.decode_frames(_encoded(spark, d).join(half, "archive_id")).select("archive_id", F.sha2("data", 256).alias("half_hash"))


@query("d", "SELECT file_hash, n_bytes, file_hash AS rebuilt, true AS sized FROM d WHERE n_bytes > 0")
def cdc_rebuilt(spark, d):
    """Content-defined chunks joined up again; all but a file's last keep both limits."""
    cut = cdc.cdc_chunks(_bodies(spark, d), "file_hash", "text")
    listed = F.sort_array(F.collect_list(F.struct("ord", "byte_start", "n_bytes", "data")))
    files = cut.groupBy("file_hash").agg(F.sum("n_bytes").alias("n_bytes"), listed.alias("parts"))
    last = F.size("parts") - 1
    sized = F.forall("parts", lambda p: (p["n_bytes"] <= cdc.SMALL.most) & ((p["n_bytes"] >= cdc.SMALL.least) | (p["ord"] == last)))
    body = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return files.select("file_hash", "n_bytes", F.sha2(body, 256).alias("rebuilt"), sized.alias("sized"))


@query("d", "SELECT file_hash, s AS slice_start, e AS slice_end_excl, CASE WHEN s >= n_bytes THEN 'range_not_satisfiable' END AS error, CASE WHEN s < n_bytes THEN lower(substr(h, 2 * s + 1, 2 * (least(e, n_bytes) - s))) END AS slice FROM (SELECT file_hash, n_bytes, hex(encode(text)) AS h, n_bytes // 3 + n_bytes % 2 * n_bytes AS s, n_bytes // 2 + 40 + n_bytes % 2 * n_bytes AS e FROM d)")
def byte_slices(spark, d):
    """A byte range of every body; those of odd length are asked for one past their end."""
    odd = F.expr("n_bytes % 2 * n_bytes")
    asked = _bodies(spark, d).select("file_hash", F.col("text").alias("body"), (F.expr("n_bytes div 3") + odd).cast("int").alias("s"), (F.expr("n_bytes div 2") + 40 + odd).cast("int").alias("e"))
    out = reconstruct.byte_slice(asked, "s", "e")
    return out.select("file_hash", F.col("s").cast("long").alias("slice_start"), F.col("e").cast("long").alias("slice_end_excl"), "error", F.lower(F.hex("slice")).alias("slice"))


@query("", "SELECT l_orderkey, l_linenumber, CASE WHEN s < 0 THEN greatest(n + s, 0) ELSE least(s, n) END AS first, CASE WHEN e < 0 THEN greatest(n + e, 0) ELSE least(e, n) END AS last_excl FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 40 AS BIGINT) AS n, CAST(l_suppkey % 60 - 30 AS BIGINT) AS s, CAST(l_quantity AS BIGINT) - 25 AS e FROM lineitem)")
def slice_limits(spark, d):
    limits = text.slice_limits(F.col("l_suppkey") % 60 - 30, F.col("l_quantity").cast("long") - 25, F.col("l_partkey") % 40)
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", limits.alias("x")).select("l_orderkey", "l_linenumber", F.col("x.start").alias("first"), F.col("x.end_excl").alias("last_excl"))


_SCOPES = {"F": "read", "O": "write", "P": "admin"}


@query("", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END >= CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END AS allowed FROM orders")
def scope_order(spark, d):
    """Whether a caller's scope (by status) covers the one that is asked for (by priority)."""
    held = F.coalesce(*(F.when(F.col("o_orderstatus") == k, v) for k, v in _SCOPES.items()), F.lit("none"))
    wanted = F.when(F.col("o_orderpriority").startswith("1"), "admin").when(F.col("o_orderpriority").startswith("2"), "write").otherwise("read")
    return read_table(spark, d, "orders").select("o_orderkey", access.satisfies(held, wanted).alias("allowed"))


@query("m o", "SELECT request_id, string_agg(archive_id || ':' || chunk_start || '-' || chunk_end_excl || '@' || byte_start || '-' || byte_end_incl, ',' ORDER BY archive_id, chunk_start) AS v1 FROM (SELECT m.*, x.frame_start AS byte_start, y.frame_end_excl - 1 AS byte_end_incl FROM m JOIN o x ON x.archive_id = m.archive_id AND x.chunk_idx = m.chunk_start JOIN o y ON y.archive_id = m.archive_id AND y.chunk_idx = m.chunk_end_excl - 1) GROUP BY request_id")
def response_v1_shapes(spark, d):
    entries = reconstruct.fetch_entries(reconstruct.merge_ranges(_plan(spark, d)), chunks.frame_offsets(_index(spark, d)))
    flat = F.flatten(F.transform(F.map_entries("fetch_info"), lambda e: F.transform(e["value"], lambda r: F.struct(e["key"].cast("long").alias("k"), r["range"].alias("c"), r["url_range"].alias("b")))))
    shown = lambda r: F.concat(r["k"].cast("string"), F.lit(":"), r["c"]["chunk_start"].cast("string"), F.lit("-"), r["c"]["chunk_end_excl"].cast("string"), F.lit("@"), r["b"]["byte_start"].cast("string"), F.lit("-"), r["b"]["byte_end_incl"].cast("string"))
    return reconstruct.response_v1(entries).select("request_id", F.array_join(F.transform(F.sort_array(flat), shown), ",").alias("v1"))


@query("u", """SELECT CAST(seq // 50 AS VARCHAR) AS shard_hash, '{"type":"result","result":' || CAST(min(seq) > (SELECT max(seq) // 2 FROM u) AS INT) || '}' || chr(10) AS frame FROM u GROUP BY 1""")
def upload_results(spark, d):
    return catalog.result_frames(_put(spark, d)[0])


@query("d t", "SELECT file_hash FROM d WHERE file_hash NOT IN (SELECT file_hash FROM t WHERE archive_id % 2 = 0)")
def unregistered_files(spark, d):
    """Files that have no term in the archives of one half."""
    return validate.files_without_terms(_bodies(spark, d).select("file_hash"), _terms(spark, d).where("archive_id % 2 = 0"))


@query("u fx k", "SELECT r.seq AS request_id, CASE WHEN fx.file_hash IS NULL THEN 'not_found' WHEN n.n IS NULL THEN CASE WHEN r.n_bytes % 2 = 1 THEN 'ok' ELSE 'forbidden' END WHEN h.owner_id IS NULL THEN 'forbidden' ELSE 'ok' END AS outcome FROM u r LEFT JOIN fx ON fx.file_hash = r.file_hash LEFT JOIN k h ON h.file_hash = r.file_hash AND h.owner_id = r.owner_id AND h.owner_id <> 'src3' LEFT JOIN (SELECT file_hash, count(*) AS n FROM k WHERE owner_id <> 'src3' GROUP BY file_hash) n ON n.file_hash = r.file_hash")
def delete_unclaimed(spark, d):
    """Requests after one owner's claims are gone: only an admin may delete a file that nobody claims."""
    scope = F.when(F.col("n_bytes") % 2 == 1, "admin").otherwise("write")
    requests = _uploads(spark, d).select(F.col("seq").alias("request_id"), "file_hash", "owner_id", scope.alias("scope"))
    return catalog.delete_outcomes(requests, _file_index(spark, d), _claims(spark, d).where("owner_id <> 'src3'")).select("request_id", "outcome")


@query("fx", "SELECT file_hash, shard_hash FROM fx")
def visible_admin(spark, d):
    return catalog.visible(_file_index(spark, d), _claims(spark, d), "nobody", admin=True)


@query("", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def parquet_view(spark, d):
    read_view(spark, f"{d}/customer.parquet", "parquet", "preview")
    return run_sql(spark, "SELECT c_custkey, c_name, c_nationkey FROM preview")


@query("", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def tsv_view(spark, d):
    """A table written with tabs and read back by what its text says."""
    path = work_dir(spark, "tsv")
    read_table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).option("sep", "\t").csv(path)
    read_view(spark, path, "tsv", "preview")
    return run_sql(spark, "SELECT p_partkey, p_name, p_size FROM preview")


_PAIR = "substr(h, i + j + 1, 2)"


@query("", f"""SELECT doc_id, array_to_string(list_transform(range(0, CAST(length(h) AS BIGINT), 32), lambda i: lpad(lower(to_hex(i // 2)), 8, '0') || '  ' || rpad(trim(regexp_replace(lower(substr(h, i + 1, 32)), '(..)', '\\1 ', 'g')), 47, ' ') || '  |' ||
array_to_string(list_transform(range(0, least(32, CAST(length(h) AS BIGINT) - i), 2), lambda j: CASE WHEN {_PAIR} BETWEEN '20' AND '7E' THEN chr(CAST('0x' || {_PAIR} AS INT)) ELSE '.' END), '') || '|'), chr(10)) AS dump
FROM (SELECT doc_id, substr(hex(encode(coalesce(text, ''))), 1, 512) AS h FROM documents)""")
def hex_dump_texts(spark, d):
    """The preview of every text as hex lines."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    return read_table(spark, d, "documents").select("doc_id", F.array_join(sniff.hex_dump(body), "\n").alias("dump"))


@query("", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'admin' WHEN lang = 'en' THEN 'write' WHEN source = 'src3' THEN 'read' END AS scope FROM documents")
def scope_from_rows(spark, d):
    """Scopes by token claims written from each row: its source as a scope, its language as a realm role."""
    claims = F.to_json(F.struct(F.concat(F.lit("openid "), "source").alias("scope"), F.struct(F.array("lang").alias("roles")).alias("realm_access")))
    return read_table(spark, d, "documents").select("doc_id", access.scope_of(access.grants(claims), "src1", "en", "src3").alias("scope"))


_HOLDS = "list_transform(a, lambda x: len(string_split(x, {mark})))"
_TABLE = "({c}[1] >= 2 AND len(list_filter({c}, lambda v: v = {c}[1])) * 5 >= len({c}) * 4)"


@query("", f"""SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'application/octet-stream' WHEN lower(t) LIKE '<svg%' THEN 'image/svg+xml' WHEN len(a) >= 2 AND {_TABLE.format(c='tabs')} THEN 'tsv' WHEN len(a) >= 2 AND {_TABLE.format(c='commas')} THEN 'csv' ELSE 'text/plain' END AS kind
FROM (SELECT *, {_HOLDS.format(mark='chr(9)')} AS tabs, {_HOLDS.format(mark="','")} AS commas
FROM (SELECT doc_id, ltrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(regexp_replace(x, '[\\r\\t\\f\\x0B]', ' ', 'g'))) > 0)[1:20] AS a FROM documents))""")
def sniff_texts(spark, d):
    """The type of every text; the oracle leaves out magic numbers, which no text starts with."""
    return read_table(spark, d, "documents").select("doc_id", sniff.sniff_content(F.coalesce("text", F.lit("")).cast("binary")).alias("kind"))
