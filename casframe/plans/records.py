"""Further storage queries: uploads as one operation, deletions, catalogues, layouts, previews, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from casframe.functions import access, shards, sniff, text
from casframe.operators import admin, catalog, cdc, chunks, validate
from casframe.plans.storage import _bodies, _chunk_table, _chunks, _claims, _file_index, _gc_tables, _index, _mac, _shards, _terms, _uploads, query
from casframe.sources import read_table

KEY = b"test-key"


def _incoming(spark, d):
    u = _uploads(spark, d)
    return u.select(F.floor(F.col("seq") / 50).cast("string").alias("shard_hash"), "file_hash", "owner_id", F.col("n_bytes").alias("logical_bytes"), (F.lit(catalog.EPOCH) + F.col("seq") * catalog.STEP).alias("created_at_unix"), "seq")


def _put(spark, d):
    """All shards put over a store that holds the first half of them already."""
    rows = _incoming(spark, d)
    half = rows.agg(F.floor(F.max("seq") / 2).alias("half"))
    before = rows.join(F.broadcast(half), F.col("seq") <= F.col("half")).drop("half")
    return catalog.put_shards(rows, before, before, before)


_HALF = "(SELECT max(seq) // 2 FROM u)"


@query("u", f"SELECT CAST(seq // 50 AS VARCHAR) AS shard_hash, count(DISTINCT file_hash) AS n_files, min(seq) > {_HALF} AS was_inserted FROM u GROUP BY 1")
def put_shards(spark, d):
    return _put(spark, d)[0].select("shard_hash", "n_files", "was_inserted")


@query("u", "SELECT file_hash, CAST(max(seq) // 50 AS VARCHAR) AS shard_hash FROM u GROUP BY file_hash")
def put_shards_index(spark, d):
    return _put(spark, d)[1].select("file_hash", "shard_hash")


@query("k", "SELECT file_hash, owner_id, logical_bytes, created_at_unix FROM k")
def put_shards_claims(spark, d):
    return _put(spark, d)[2].select("file_hash", "owner_id", "logical_bytes", "created_at_unix")


@query("u k fx", "SELECT 'index' AS kind, file_hash, shard_hash AS detail FROM fx WHERE file_hash NOT IN (SELECT file_hash FROM k GROUP BY file_hash HAVING count(*) > 1) UNION ALL SELECT 'claim', file_hash, owner_id FROM k WHERE file_hash NOT IN (SELECT file_hash FROM k GROUP BY file_hash HAVING count(*) > 1)")
def remove_files(spark, d):
    """Index and claims after files of several owners are gone."""
    owned = _claims(spark, d)
    gone = owned.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index, left = catalog.remove_files(_file_index(spark, d), owned, gone)
    return index.select(F.lit("index").alias("kind"), "file_hash", F.col("shard_hash").alias("detail")).union(left.select(F.lit("claim"), "file_hash", "owner_id"))


@query("i a", "SELECT i.archive_id, i.chunk_idx, i.chunk_hash, a.num_bytes_on_disk FROM i JOIN a ON i.archive_id = a.archive_id WHERE a.num_bytes_on_disk >= (SELECT avg(num_bytes_on_disk) FROM a)")
def remove_archives(spark, d):
    """Locations and layouts after the archives of less than the mean size are gone."""
    index, stored = _index(spark, d), chunks.archives(_index(spark, d))
    gone = stored.join(F.broadcast(stored.agg(F.avg("num_bytes_on_disk").alias("mean"))), F.col("num_bytes_on_disk") < F.col("mean")).select("archive_id")
    locations, layouts = catalog.remove_archives(index, stored, gone)
    return locations.join(layouts.select("archive_id", "num_bytes_on_disk"), "archive_id").select("archive_id", "chunk_idx", "chunk_hash", "num_bytes_on_disk")


@query("c i", f"SELECT DISTINCT c.chunk_hash, {_mac('c.chunk_hash')} AS keyed_hash, i.archive_id, i.chunk_idx FROM c JOIN i ON c.chunk_hash = i.chunk_hash")
def keyed_lookup(spark, d):
    return chunks.keyed_lookup(_chunk_table(spark, d), _index(spark, d), KEY).select("chunk_hash", "keyed_hash", "archive_id", "chunk_idx")


_WORD = "CAST('0x' || substr(chunk_hash, {at}, 8) AS BIGINT)"


@query("c", f"SELECT DISTINCT chunk_hash, (({_WORD.format(at=49)} % 1000) * (4294967296 % 1000) + {_WORD.format(at=57)}) % 1000 = 0 AS thousand, {_WORD.format(at=57)} % 16 = 0 AS sixteen FROM c")
def eligible_chunks(spark, d):
    return _chunks(spark, d).select("chunk_hash").distinct().select("chunk_hash", text.eligible(F.col("chunk_hash"), 1000).alias("thousand"), text.eligible(F.col("chunk_hash"), 16).alias("sixteen"))


@query("u", "SELECT client, file_hash, name, row_number() OVER (PARTITION BY client ORDER BY seq DESC) AS place FROM (SELECT owner_id AS client, file_hash, max(seq) AS seq, arg_max(owner_id || '-' || seq, seq) AS name FROM u WHERE owner_id IS NOT NULL GROUP BY 1, 2)")
def catalogue(spark, d):
    """Each client's catalogue after all its uploads."""
    u = _uploads(spark, d).where("owner_id IS NOT NULL")
    return catalog.named(u.select(F.col("owner_id").alias("client"), "file_hash", F.concat_ws("-", "owner_id", F.col("seq").cast("string")).alias("name"), "seq"))


@query("u fx", "SELECT fx.file_hash, n.name FROM fx LEFT JOIN (SELECT file_hash, arg_max(owner_id || '-' || seq, seq) AS name FROM u WHERE owner_id = 'src3' GROUP BY file_hash) n ON fx.file_hash = n.file_hash")
def listed_names(spark, d):
    """The listing with the names that one client's catalogue knows."""
    u = _uploads(spark, d).where("owner_id = 'src3'")
    names = catalog.named(u.select(F.col("owner_id").alias("client"), "file_hash", F.concat_ws("-", "owner_id", F.col("seq").cast("string")).alias("name"), "seq"))
    return _file_index(spark, d).select("file_hash").join(names.select("file_hash", "name"), "file_hash", "left")


@query("i", """SELECT archive_id, '{"bytes":' || sum(n_bytes + 8) || ',"chunks":[' || string_agg('{"i":' || chunk_idx || ',"hash":"' || chunk_hash || '","size":' || n_bytes || '}', ',' ORDER BY chunk_idx) || ']}' AS layout FROM i GROUP BY archive_id""")
def layout_json(spark, d):
    return catalog.layouts(_index(spark, d))


@query("i a", "SELECT i.archive_id, a.num_bytes_on_disk, i.chunk_idx, i.chunk_hash, i.n_bytes FROM i JOIN a ON i.archive_id = a.archive_id")
def layout_decoded(spark, d):
    return catalog.decoded_layouts(catalog.layouts(_index(spark, d)))


@query("", "SELECT doc_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)")
def numbered_preview(spark, d):
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(sniff.numbered_lines(F.col("text"))).alias("l"))
    return rows.select("doc_id", F.col("l.line_no").cast("int").alias("line_no"), F.col("l.line").alias("line"))


@query("", """WITH j AS (SELECT doc_id, to_json({'doc_id': doc_id, 'source': coalesce(source, ''), 'text': coalesce(text, '')})::VARCHAR AS v, coalesce(source, '') AS s FROM documents)
SELECT doc_id, CASE WHEN length(v) > 120 THEN left(v, 119) || '…' ELSE v END AS cell, 'data:image/png;base64,' || base64(encode(s)) AS url FROM j""")
def row_preview(spark, d):
    rows = read_table(spark, d, "documents")
    cell = F.struct("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", sniff.short_json(cell).alias("cell"), sniff.data_url(F.coalesce("source", F.lit("")).cast("binary")).alias("url"))


@query("", "SELECT o_custkey AS who, o_totalprice AS amount, NULL AS name FROM orders UNION ALL BY NAME SELECT c_name AS name, c_custkey AS who, c_acctbal AS amount FROM customer")
def sql_union_by_name(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_totalprice").alias("amount"))
    return orders.unionByName(read_table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("who"), F.col("c_acctbal").alias("amount")), allowMissingColumns=True)


@query("k a sw", "SELECT n_files, logical_bytes, n_archives, physical_bytes, n_shards, shard_bytes FROM (SELECT count(*) AS n_files, CAST(sum(b) AS BIGINT) AS logical_bytes FROM (SELECT max(logical_bytes) AS b FROM k GROUP BY file_hash)), (SELECT count(*) AS n_archives, CAST(sum(num_bytes_on_disk) AS BIGINT) AS physical_bytes FROM a), (SELECT count(*) AS n_shards, CAST(sum(size) AS BIGINT) AS shard_bytes FROM sw)")
def accounting_all(spark, d):
    _, _, _, listed = _gc_tables(spark, d)
    one = admin.accounting(_claims(spark, d), chunks.archives(_index(spark, d))).select("n_files", "logical_bytes", "n_archives", "physical_bytes")
    return one.crossJoin(listed.agg(F.count(F.lit(1)).alias("n_shards"), F.sum("size").cast("long").alias("shard_bytes")))  # one row each


def _shard_bodies(spark, d):
    index = _index(spark, d)
    names = chunks.archives(index).select("archive_id", "archive_hash")
    terms = _shards(spark, d).join(_terms(spark, d), "file_hash").join(names, "archive_id")
    return shards.bodies(terms.select("shard_hash", "file_hash", "term_idx", "archive_hash", "chunk_start", "chunk_end_excl", "unpacked_bytes"), index.join(names, "archive_id").select("archive_hash", "chunk_idx", "chunk_hash", "n_bytes"))


@query("sh t a", "SELECT sh.shard_hash, t.file_hash, t.term_idx, a.archive_hash, t.chunk_start, t.chunk_end_excl, t.unpacked_bytes FROM sh JOIN t ON sh.file_hash = t.file_hash JOIN a ON t.archive_id = a.archive_id")
def shard_terms(spark, d):
    """Terms parsed out of serialized shards."""
    rows = shards.parse_shards(_shard_bodies(spark, d)).where("kind = 'term'")
    return rows.select("shard_hash", F.col("owner").alias("file_hash"), F.col("ord").alias("term_idx"), F.col("hash").alias("archive_hash"), F.col("first").alias("chunk_start"), F.col("last_excl").alias("chunk_end_excl"), F.col("bytes").alias("unpacked_bytes"))


@query("sh t a i", "SELECT DISTINCT sh.shard_hash, a.archive_hash, i.chunk_idx, i.chunk_hash, i.n_bytes FROM sh JOIN t ON sh.file_hash = t.file_hash JOIN a ON t.archive_id = a.archive_id JOIN i ON i.archive_id = a.archive_id")
def shard_chunks(spark, d):
    """Archive chunks parsed out of serialized shards."""
    rows = shards.parse_shards(_shard_bodies(spark, d)).where("kind = 'chunk'")
    return rows.select("shard_hash", F.col("owner").alias("archive_hash"), F.col("ord").alias("chunk_idx"), F.col("hash").alias("chunk_hash"), F.col("bytes").alias("n_bytes"))


@query("u", "SELECT seq, sha256(text || '!') AS file_hash, sha256(text) AS real FROM u WHERE owner_id = 'src3' AND n_bytes > 0")
def validate_file_hashes(spark, d):
    """Uploads, of which one owner declares hashes of something else."""
    u = _uploads(spark, d)
    declared = u.select("seq", F.col("file_hash").alias("body"), F.when(F.col("owner_id") == "src3", F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("file_hash")).alias("file_hash"))
    return validate.wrong_file_hashes(declared, _chunks(spark, d, True).select(F.col("file_hash").alias("body"), "ord", "data"))


@query("a", "SELECT archive_id, 'archive_hash_mismatch' AS rule FROM a WHERE n_chunks < 64 UNION ALL SELECT archive_id + 1000000, 'archive_empty' FROM a")
def validate_archives(spark, d):
    """Archives that are not full declare another hash; one without chunks stands beside each."""
    stored = chunks.archives(_index(spark, d))
    wrong = F.when(F.col("n_chunks") < 64, F.sha2("archive_hash", 256)).otherwise(F.col("archive_hash"))
    declared = stored.select("archive_id", wrong.alias("archive_hash")).union(stored.select(F.col("archive_id") + 1000000, "archive_hash"))
    return validate.wrong_archives(declared, _index(spark, d))


@query("i", "SELECT chunk_hash, archive_id, chunk_idx + 1 AS chunk_idx, 'chunk_mismatch' AS rule FROM i WHERE n_bytes > 200 UNION ALL SELECT chunk_hash, archive_id + 1000000, chunk_idx, 'archive_missing' FROM i WHERE n_bytes < 20")
def validate_index(spark, d):
    """Claimed locations: long chunks one place too far, short ones in archives that are not stored."""
    index = _index(spark, d)
    moved = index.select("chunk_hash", F.when(F.col("n_bytes") < 20, F.col("archive_id") + 1000000).otherwise(F.col("archive_id")).alias("archive_id"), F.when(F.col("n_bytes") > 200, F.col("chunk_idx") + 1).otherwise(F.col("chunk_idx")).alias("chunk_idx"))
    return validate.index_violations(moved, index)


@query("c", "SELECT * FROM (WITH RECURSIVE n AS (SELECT file_hash, ord, n_bytes, row_number() OVER (PARTITION BY file_hash ORDER BY ord) AS k FROM c), g AS (SELECT file_hash, k, ord, n_bytes, 0::BIGINT AS archive, n_bytes AS held, 1 AS cnt FROM n WHERE k = 1 UNION ALL SELECT n.file_hash, n.k, n.ord, n.n_bytes, CASE WHEN g.held + n.n_bytes > 2000 OR g.cnt + 1 > 4 THEN g.archive + 1 ELSE g.archive END, CASE WHEN g.held + n.n_bytes > 2000 OR g.cnt + 1 > 4 THEN n.n_bytes ELSE g.held + n.n_bytes END, CASE WHEN g.held + n.n_bytes > 2000 OR g.cnt + 1 > 4 THEN 1 ELSE g.cnt + 1 END FROM g JOIN n ON n.file_hash = g.file_hash AND n.k = g.k + 1) SELECT file_hash, ord, n_bytes, archive FROM g)")
def greedy_pack(spark, d):
    return cdc.greedy_pack(_chunks(spark, d), "file_hash", 2000, 4)


@query("d", "SELECT file_hash, 0 AS scheme, true AS same FROM d UNION ALL SELECT file_hash, 1, true FROM d UNION ALL SELECT file_hash, 2, true FROM d")
def frames_same(spark, d):
    """Every file's frames decode to its bytes under each scheme."""
    return cdc.frames_roundtrip(_bodies(spark, d), "file_hash", "text").select("file_hash", "scheme", "same")
