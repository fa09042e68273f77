import hashlib
import hmac
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casframe.functions import access, frames, hashing, sniff, text
from casframe.operators import cdc, chunks, reconstruct
from casframe.sources import connector


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(column.alias("r")).first()["r"]


def lcg(n, state=0xDEADBEEFCAFEBABE):
    out = bytearray()
    while len(out) < n:
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out += state.to_bytes(8, "little")
    return bytes(out[:n])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 20000])
def test_blake3_against_jvm(spark, n):
    data = lcg(n)
    jvm = spark.sparkContext._jvm
    digest = lambda b: bytes(x & 255 for x in b)
    blake = jvm.org.apache.commons.codec.digest.Blake3
    assert hashing.blake3([data])[0] == digest(blake.hash(data))
    assert hashing.blake3([data, b"x"], hashing.DATA_KEY)[0] == digest(blake.keyedHash(hashing.DATA_KEY, data))


def test_merkle_is_stable_and_sensitive():
    leaves = [(hashlib.sha256(bytes([i])).digest(), i + 1) for i in range(40)]
    root = hashing.merkle_root(leaves)
    assert root == hashing.merkle_root(list(leaves))
    assert root != hashing.merkle_root(leaves[:-1]) and root != hashing.merkle_root(leaves[::-1])
    assert hashing.merkle_root(leaves[:1]) == leaves[0][0]
    assert len({hashing.file_hash(leaves), root, hashing.range_hash([h for h, _ in leaves])}) == 3


def leaves_of(k, n):
    return [(hashlib.sha256(f"{k}/{i}".encode()).digest(), i % 97 + 1) for i in range(n)]


def plain_root(level):
    """One list at a time."""
    while len(level) > 1:
        groups, own = [], []
        for i, child in enumerate(level):
            own.append(child)
            if len(own) == 9 or len(own) > 1 and child[0][24] % 4 == 0 or i + 1 == len(level):
                groups.append(own)
                own = []
        digests = hashing.blake3(["".join(f"{h.hex()} : {n}\n" for h, n in g).encode() for g in groups], hashing.INTERNAL_NODE_KEY)
        level = [(h, sum(n for _, n in g)) for h, g in zip(digests, groups, strict=True)]
    return level[0][0]


def test_merkle_roots_hash_a_level_of_all_lists_at_once(monkeypatch):
    lists = [leaves_of(k, k % 30 + 1) for k in range(40)]
    want, blake3, calls = [plain_root(x) for x in lists], hashing.blake3, []
    monkeypatch.setattr(hashing, "blake3", lambda *a: calls.append(1) or blake3(*a))
    assert hashing.merkle_roots(lists) == want and len(calls) < 6
    assert hashing.merkle_roots([[], lists[0]]) == [bytes(32), want[0]] and hashing.merkle_roots([]) == []


def test_files_are_hashed_together(monkeypatch):
    rows = [(k, *leaf) for k in range(40) for leaf in leaves_of(k, k % 30 + 1)]
    parts = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100], strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["k", "h", "n"]) for i in range(0, len(rows), 100)]
    want, blake3, calls = [plain_root(leaves_of(k, k % 30 + 1)) for k in range(40)], hashing.blake3, []
    monkeypatch.setattr(hashing, "blake3", lambda *a: calls.append(1) or blake3(*a))
    (got,) = cdc.fold_roots(iter(parts), ["k", "root", "file_hash"], 1 << 16)
    assert len(calls) < 7 and got.column(0).to_pylist() == list(range(40))
    assert got.column(1).to_pylist() == [r.hex() for r in want]
    assert got.column(2).to_pylist() == [h.hex() for h in blake3(want, hashing.FILE_KEY)]
    assert list(cdc.fold_roots(iter(()), ["k", "root", "file_hash"], 8)) == []


@pytest.mark.parametrize("room", [1, 2, 10, 100, 1 << 16])
def test_long_lists_fold_as_they_come(monkeypatch, room):
    monkeypatch.setattr(hashing, "blake3", lambda texts, key: [hashlib.sha256(key + t).digest() for t in texts])
    for n in (1, 2, 3, 9, 10, 40, 1000):
        leaves = leaves_of("x", n)
        for step in (1, 7, n):
            fold = hashing.MerkleFold(room)
            for i in range(0, n, step):
                fold.add(leaves[i : i + step])
                assert all(len(level) <= max(room, 8) for level in fold.levels)
            assert hashing.merkle_roots([fold.top()]) == [plain_root(leaves)]


@pytest.mark.parametrize("room", [5, 1 << 16])
def test_merkle_roots_of_every_key(spark, room):
    want = {k: plain_root(leaves_of(k, n)) for k, n in [(None, 7), *((k, k % 45 + 1) for k in range(60))]}
    rows = [(k, i, h.hex(), n) for k in want for i, (h, n) in enumerate(leaves_of(k, 7 if k is None else k % 45 + 1))]
    chunks = spark.createDataFrame(rows[::-1], "doc long, ord long, chunk_hash string, n_bytes long")
    got = cdc.merkle_roots(chunks, "doc", room).collect()
    assert len(got) == len(want) and {r.doc: (r.root, r.file_hash) for r in got} == {k: (r.hex(), hashing.blake3([r], hashing.FILE_KEY)[0].hex()) for k, r in want.items()}
    assert cdc.merkle_roots(chunks.limit(0), "doc").collect() == []


@pytest.mark.parametrize("n", range(9))
def test_group4(n):
    data = bytes(range(n))
    assert frames.ungroup4(frames.group4(data)) == data


def test_frames():
    parts = [lcg(n) for n in (100, 101, 102)]
    body = b"".join(frames.encode(p, s) for p, s in zip(parts, (0, 1, 2), strict=True))
    assert frames.decode(body) == b"".join(parts)
    assert frames.decode(body, 1, 2) == parts[1]
    assert len(frames.walk(body + b"\xff" * 20)[0]) == 3
    with pytest.raises(ValueError, match="bounds"):
        frames.decode(body, 0, 4)
    with pytest.raises(ValueError, match="version"):
        frames.decode(b"\x01" + body[1:])
    with pytest.raises(ValueError, match="truncated"):
        frames.decode(body[:50])
    with pytest.raises(ValueError, match="type"):
        frames.decode(b"\x00\x01\x00\x00\x09\x01\x00\x00a")


def sequential(data, p):
    table, out, last, h = [int(x) for x in cdc.gear_table(p.seed)], [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + table[b]) % 2**64
        if i + 1 - last >= p.least and (h >> (64 - p.mask_bits) == 0 or i + 1 - last == p.most) and i + 1 < len(data) and len(data) - last > p.least:
            out.append(i + 1)
            last = i + 1
    return [*out, len(data)] if data else []


@pytest.mark.parametrize("data", [b"", b"a", lcg(64), lcg(65), lcg(40_000), bytes(9000), bytes(i * 31 % 251 for i in range(30_000))], ids=len)
def test_boundaries(data):
    ends = cdc.boundaries(data, cdc.SMALL)
    assert ends == sequential(data, cdc.SMALL)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert all(cdc.SMALL.least <= n <= cdc.SMALL.most for n in sizes[:-1])


def test_edit_moves_few_chunks():
    data = lcg(60_000)
    cut = lambda d: {d[a:b] for a, b in zip([0, *cdc.boundaries(d, cdc.SMALL)], cdc.boundaries(d, cdc.SMALL), strict=False)}
    old, new = cut(data), cut(b"prefix" + data)
    assert len(new - old) <= 2


@pytest.mark.parametrize(
    ("header", "want"),
    [("bytes=1000-2000", (None, 1000, 2000)), ("bytes=10-5", ("range_not_satisfiable", 10, 5)), ("bytes=7-", ("bad_request", None, None)), ("items=1-2", ("bad_request", None, None)), ("bytes=-5", ("bad_request", None, None)), (None, (None, None, None))],
)
def test_byte_range(spark, header, want):
    df = spark.createDataFrame([(header,)], "h string").select(text.parse_byte_range(F.col("h")).alias("r")).first()["r"]
    assert df["error"] == want[0]
    if want[0] is None:
        assert (df["start"], df["end_incl"]) == want[1:]


def test_cursors(spark):
    assert one(spark, text.encode_cursor(F.lit("b"))) == "Yg"
    assert one(spark, text.decode_cursor(F.lit("Yg"))) == "b"
    assert one(spark, text.decode_cursor(F.lit("!"))) is None
    assert [text.clamp_limit(x) for x in (None, 0, 5, 9999)] == [100, 1, 5, 1000]


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (5 * 1024**4, "5.0 TB")])
def test_format_bytes(spark, n, want):
    assert one(spark, text.format_bytes(F.col("n")), n=n) == want


def test_text_functions(spark):
    assert one(spark, text.redact_query(F.lit("r=1&exp=2&sig=ab"))) == "r=1&exp=2&sig=REDACTED"
    assert one(spark, text.redact_query(F.lit("token=ab&limit=5"))) == "token=REDACTED&limit=5"
    assert one(spark, text.redact_query(F.lit(""))) == ""
    for h, good in [("a" * 64, True), ("0" * 64, True), ("a" * 63, False), ("a" * 65, False), ("A" * 64, False), ("g" * 64, False), ("", False), ("../" + "a" * 61, False)]:
        assert one(spark, text.is_hash(F.lit(h))) is good
    h = "ab" * 32
    p = one(spark, text.parse_pointer(text.build_pointer(F.lit(h), F.lit(77))))
    assert (p["file_hash"], p["size"]) == (h, 77)
    assert one(spark, text.parse_pointer(F.lit("plain"))) is None
    raw = bytes(range(32))
    assert one(spark, text.hash_hex(F.lit(raw))) == "".join(raw[8 * w : 8 * w + 8][::-1].hex() for w in range(4))


def test_slices(spark):
    for a, b, n in [(4, 10, 16), (-4, None, 16), (None, -2, 16), (3, 99, 16), (None, None, 0)]:
        df = spark.createDataFrame([(a, b, n)], "a int, b int, n int")
        got = df.select(text.slice_limits(F.col("a"), F.col("b"), F.col("n")).alias("r")).first()["r"]
        s, e, _ = slice(a, b).indices(n)
        assert (got["start"], got["end_excl"]) == (s, e)
    rows = spark.createDataFrame([(4, 10), (10, 99), (16, 20)], "s int, e int").withColumn("body", F.lit(bytes(range(16))))
    got = reconstruct.byte_slice(rows, "s", "e").collect()
    assert [bytes(r["slice"]) if r["slice"] else r["error"] for r in got] == [bytes(range(4, 10)), bytes(range(10, 16)), "range_not_satisfiable"]


def test_signed_urls(spark):
    key, h = b"k" * 70, "ab" * 32
    message = f"{access.SIGNED_TAG}|{h}|0|99|500"
    url = one(spark, access.sign_url(key, "http://x", F.lit(h), F.lit(0), F.lit(99), F.lit(500)))
    assert url.endswith(hmac.new(key, message.encode(), hashlib.sha256).hexdigest())
    check = lambda u, now, end: one(spark, access.verify_url(key, F.lit(u), F.lit(now), F.lit(0), F.lit(end)))
    assert check(url, 500, 99) is None
    assert check(url, 501, 99) == "unauthorized"
    assert check(url, 500, 100) == "forbidden"
    assert check(url.replace("r=0-99", "r=0-98"), 500, 50) == "unauthorized"


def test_scopes(spark):
    for have, need, ok in [("admin", "write", True), ("write", "read", True), ("read", "write", False), ("none", "read", False)]:
        assert one(spark, access.satisfies(F.lit(have), F.lit(need))) is ok
    assert one(spark, access.scope_of(F.array(F.lit("")), "", "", "", "read")) == "read"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (b"\x89PNG\r\n\x1a\n...", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"GIF89a", "image/gif"), (b"RIFF\x01\x02\x03\x04WEBPVP8 ", "image/webp"), (b"%PDF-1.4", "application/pdf"),
        (b"PAR1....PAR1", "parquet"), (b"PAR1....", "text/plain"), (b"  <svg/>", "image/svg+xml"), (b"<?xml?><svg/>", "image/svg+xml"), (b"a,b\n1,2\n", "csv"), (b"a\tb\n1\t2\n", "tsv"), (b"plain text", "text/plain"), (b"a\x00b", "application/octet-stream"), (b"", "text/plain"), (b"x" * 20000, "text/plain"),
    ],
)
def test_sniff(spark, body, want):
    assert one(spark, sniff.sniff_content(F.col("b")), b=bytearray(body)) == want


def test_hex_dump(spark):
    got = one(spark, sniff.hex_dump(F.col("b")), b=bytearray(b"0123456789abcdef\x00Z"))
    assert got == ["00000000  30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66  |0123456789abcdef|", "00000010  00 5a" + " " * 42 + "  |.Z|"]


def test_merge_ranges(spark):
    rows = [(1, 7, 0, 2), (1, 7, 2, 3), (1, 7, 5, 8), (1, 7, 6, 7), (1, 8, 1, 2), (2, 7, 0, 1)]
    df = spark.createDataFrame(rows, "request_id long, archive_id long, chunk_start long, chunk_end_excl long")
    assert sorted(map(tuple, reconstruct.merge_ranges(df).collect())) == [(1, 7, 0, 3), (1, 7, 5, 8), (1, 8, 1, 2), (2, 7, 0, 1)]


def test_positions_and_roundtrip(spark):
    r = random.Random(3)
    texts = ["", "a", "\n", "x\ny", "x\ny\n"] + ["\n".join(r.choice("abc") * r.randint(0, 3) for _ in range(r.randint(1, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i * 700, t, "s") for i, t in enumerate(texts)] + [(5, None, "s")], "doc_id long, text string, source string")
    bodies = chunks.distinct_files(chunks.files(docs))
    cs = chunks.line_chunks(bodies, True)
    index = chunks.chunk_index(cs, 4)
    assert sorted(x["pos"] for x in index.collect()) == list(range(index.count()))
    store = index.join(cs.groupBy("chunk_hash").agg(F.first("data").alias("data")), "chunk_hash")
    back = {x["file_hash"]: x["text"] for x in reconstruct.assemble(chunks.file_terms(cs, index), store).collect()}
    assert back == {hashlib.sha256(t.encode()).hexdigest(): t for t in texts if t}


def test_pack_limits(spark):
    rows = [("f", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 1, 1, 1])]
    got = cdc.greedy_pack(spark.createDataFrame(rows, "k string, ord long, n_bytes long"), "k", 10, 3)
    assert [r["archive"] for r in got.orderBy("ord").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_connectors():
    assert connector("s3a://b/x") == "s3" and connector("/tmp/x") == "local"
    with pytest.raises(ValueError, match="unknown"):
        connector("ftp://x")


def test_eligible_reads_all_sixteen_digits(spark):
    import hashlib

    from pyspark.sql import functions as F

    from casframe.functions import text

    hashes = [hashlib.sha256(bytes([k])).hexdigest() for k in range(200)]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    for modulus in (3, 16, 1000, 65_537, 2**31 - 1):
        got = {r["h"]: r["e"] for r in df.select("h", text.eligible(F.col("h"), modulus).alias("e")).collect()}
        assert got == {h: int(h[48:], 16) % modulus == 0 for h in hashes}


def test_keyed_hashes_are_hmac(spark):
    import hashlib
    import hmac

    from casframe.operators import chunks

    df = spark.createDataFrame([("ab" * 32,), ("0" * 64,)], "chunk_hash string")
    for key in (b"k", b"x" * 100):
        got = {r["chunk_hash"]: r["keyed_hash"] for r in chunks.keyed(df, key).collect()}
        assert got == {h: hmac.new(key, h.encode(), hashlib.sha256).hexdigest() for h in got}


def test_shards_parse_back_or_say_why(spark):
    import random

    from casframe.functions import shards

    r = random.Random(3)
    h = lambda: r.randbytes(32)
    files = [(h(), [(h(), k, k + 2, 10**12 + k) for k in range(n)]) for n in (0, 1, 5)]
    archives = [(h(), [(h(), k) for k in range(n)]) for n in (3, 0)]
    data = shards.encode(files, archives)
    assert shards.parse(data) == (None, files, archives)
    assert shards.parse(shards.encode([], [])) == (None, [], [])
    wrong = {"footer_not_allowed": shards.encode(files, archives, 7), "bad_header": b"x" + data[1:], "truncated": data[:-1], "trailing_bytes": data + b"\0"}
    rows = [("good", data), ("none", None), *wrong.items()]
    got = shards.parse_shards(spark.createDataFrame(rows, "shard_hash string, body binary")).where("error IS NOT NULL").collect()
    assert {(x["shard_hash"], x["error"]) for x in got} == {(k, k) for k in wrong} | {("none", "truncated")}
    from pyspark.sql import functions as F

    told = {x["k"]: x["e"] for x in spark.createDataFrame(rows, "k string, body binary").select("k", shards.upload_error(F.col("body")).alias("e")).collect()}
    assert (told["good"], told["footer_not_allowed"], told["bad_header"]) == (None, "footer_not_allowed", "bad_header")


def test_sources_read_what_lies_there(spark, tmp_path):
    from casframe import sources

    path = str(tmp_path)
    spark.range(5).write.parquet(f"{path}/t.parquet")
    spark.range(3).selectExpr("id", "id * 2 AS twice").coalesce(1).write.option("header", True).csv(f"{path}/t.csv")
    spark.range(2).selectExpr("id", "'a,b' AS x").coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{path}/t.tsv")
    assert sources.read_table(spark, path, "t").count() == 5
    assert sources.read_view(spark, f"{path}/t.parquet", "parquet", "v1").count() == 5
    assert sorted(map(tuple, sources.read_view(spark, f"{path}/t.csv", "csv", "v2").collect())) == [(0, 0), (1, 2), (2, 4)]
    assert {r["x"] for r in sources.read_view(spark, f"{path}/t.tsv", "tsv", "v3").collect()} == {"a,b"}
    assert sources.run_sql(spark, "SELECT sum(twice) AS s FROM v2").first()["s"] == "6"
    with pytest.raises(ValueError):
        sources.read_view(spark, path, "xlsx")
    (tmp_path / "store").mkdir()
    for name in ("bb", "aa", ".hidden"):
        (tmp_path / "store" / name).write_bytes(name.encode())
    assert [(r["hash"], r["size"]) for r in sources.list_objects(spark, f"{path}/store").collect()] == [("aa", 2), ("bb", 2)]
    assert [bytes(r["body"]) for r in sources.get_object(spark, f"{path}/store", "bb").collect()] == [b"bb"]
    assert sources.get_object(spark, f"{path}/store", "cc").count() == 0
    with pytest.raises(ValueError):
        sources.read_index(spark, "jdbc:oracle:x", "t")


def test_stream_index_log_and_compaction(spark, tmp_path):
    """State after each batch is the batch merge of all rows so far, over compactions and a retried batch."""
    from casframe.operators import catalog, chunks
    from casframe.streaming import Index

    index, seen = Index(spark, f"file://{tmp_path}/index", every=2), []
    for number in range(7):
        rows = [(number * 10 + k, f"text {k % 3}\nline {number % 2}", "en", f"s{k % 2}", 5) for k in range(4)]
        seen += rows
        batch = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        index.merge(batch, number)
        if number == 3:
            index.merge(batch, number)
        uploads = chunks.files(spark.createDataFrame(seen, batch.schema))
        want = catalog.claims(uploads).select("file_hash", "owner_id", "logical_bytes", "created_at_unix").collect()
        assert sorted(index.read("claims", number).drop("seq").collect()) == sorted(want)
    assert sorted(p.name for p in (tmp_path / "index" / "claims").iterdir()) == ["base=3", "base=5", "batch=4", "batch=5", "batch=6"]
