"""Queries over whole tables leave no row out."""

import __spark_entry__ as entry
from casframe.sources import read_table

SF = "/root/testdata/sf0.001"


def test_asof_of_every_event(spark):
    rows = read_table(spark, SF, "events").select("event_id", "user_id", "ts", "event_type").collect()
    want = {}
    for e in rows:
        seen = [o.ts for o in rows if o.user_id == e.user_id and o.event_type == "purchase" and o.ts < e.ts]
        if seen:
            want[e.event_id] = max(seen)
    got = {r.event_id: r.prev_ts for r in entry.queries()["sql_asof"](spark, SF).collect()}
    assert got == want and any(k % 7 for k in want)


def test_storage_queries_reach_every_chunk_and_upload(spark):
    run = {k: q(spark, SF) for k, q in entry.queries().items() if k in ("chunk_locations", "dedup_lookup_expand", "keyed_dedup_hashes", "validate_hashes")}
    stored = {r.chunk_hash for r in run["chunk_locations"].collect()}
    assert {r.chunk_hash for r in run["dedup_lookup_expand"].collect()} == stored
    assert {r.chunk_hash for r in run["keyed_dedup_hashes"].collect()} == stored
    uploads = {r.doc_id for r in read_table(spark, SF, "documents").select("doc_id").collect()}
    assert {r.seq for r in run["validate_hashes"].collect()} == uploads
