"""The registered corpus queries and the pipeline's stages over whole tables with awkward rows."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casframe.llm import queries, toxicity
from tests.llm.test_operators import brute_base, brute_classes, brute_repeats, corpus, prose

EXTRA = "row string, h long, tid string, key string, id string, uid long, block long, c0 string, cid string, one string, n long, places string"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
CONTRACT = {
    "op1_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_source_mixing": "doc_id source pass position tokens",
    "op4_line_dedup": "doc_id n_removed text",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}
LONG = prose(random.Random(77), 110_000)  # over 512 KiB, the size of a block


def rows():
    """Documents with long, null, empty, repeated and copied texts, null and repeated ids, null sources and languages."""
    r = random.Random(4)
    texts = [*corpus(15, 40), LONG, LONG + " end", "x" * 600_000]
    for k in range(60):
        words = prose(r, 40).split(" ")
        if k % 3 == 0:
            words[7] = words[21] = "grimbo"
        texts.append(" ".join(words))
    out = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 13}", None][i % 17 == 0], len(t or "")) for i, t in enumerate(texts)]
    out += [out[20], out[20], (21, "another text under a known id", "en", "s1", 29), (None, texts[22], "en", "s2", 1), (None, None, None, None, None)]
    return [(*x, "r", 1, "t", "k", "i", 2, 3, "c", "d", "o", 4, "p") for x in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    own = rows()
    spark.createDataFrame(own, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(x[0], int(len(x[1] or "") > 60), int("grimbo" in (x[1] or ""))) for x in own if x[0] is not None and x[0] % 4] + [(None, 1, 1), (3, None, None), (5, 0, 0), (99_999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(k, f"u{k}", f"<title>t</title><nav><a href=x>menu</a></nav><article><h1>Title {k}</h1><p>{prose(random.Random(k), 30)}.</p></article>") for k in range(5)]
    pages += [pages[0], (None, None, None), (7, "v", ""), (8, "w", "<article><p>" + LONG + "</article>")]
    spark.createDataFrame([(*p, "r", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query_on_awkward_rows(spark, folder, name):
    own = rows()
    got = queries.queries()[name](spark, folder)
    assert set(CONTRACT[name].split()) <= set(got.columns)
    got = got.collect()
    ids = collections.Counter(x[0] for x in own)
    if name == "op6_html_extraction":
        assert collections.Counter(x["page_id"] for x in got) == collections.Counter([0, 0, 1, 2, 3, 4, None, 7, 8])
        assert all(x["n_chars"] == len(x["text"]) and x["text"].startswith("Title") == (x["page_id"] is not None and x["page_id"] < 5) for x in got)
        assert max(x["n_chars"] for x in got) == len(LONG)
        return
    if name == "op5_packing":
        tokens, first = collections.Counter(), {x[0] for x in got}
        for x in got:
            tokens[x["doc_id"]] += x["length"]
        whole = collections.defaultdict(int)
        for x in got:
            if x["start"] == 0:
                whole[x["doc_id"]] += x["doc_tokens"]
        assert tokens == whole and set(tokens) == set(ids) == first
        return
    if name == "op3_source_mixing":
        assert {x["doc_id"] for x in got} <= set(ids) and all(x["position"] >= 0 and x["pass"] >= 0 for x in got)
        return
    assert collections.Counter(x["doc_id"] for x in got) == ids
    if name == "op1_suffix_array_dedup":
        by_id = {x["doc_id"]: x for x in got if ids[x["doc_id"]] == 1}
        assert all(by_id[x[0]]["n_bytes"] == len((x[1] or "").encode()) for x in own if x[0] in by_id)
        long = [i for i, x in enumerate(own) if x[1] == LONG][0]
        assert by_id[own[long][0]]["n_removed"] == len(LONG) and by_id[own[long + 1][0]]["n_removed"] == len(LONG) and by_id[own[long + 2][0]]["n_removed"] == 600_000
        assert all(x["n_removed"] == x["n_bytes"] for x in got if x["doc_id"] == 20)
    elif name in ("op2_language_id", "op8_toxicity"):
        parts, held = (5, 0) if name[2] == "2" else (3, 1)
        for x in got:
            assert x["held_out"] == (None if x["doc_id"] is None else zlib.crc32(str(x["doc_id"]).encode()) % parts == held)
            assert 0 <= x["score"] <= 1
            if name[2] == "8":
                assert x["predicted"] == (x["score"] >= toxicity.THRESHOLD)
        if name[2] == "2":
            assert {x["lang_pred"] for x in got} <= {"en", "fr", "und"} and {x["lang_pred"] for x in got if x["doc_id"] in (0, 1, 2)} == {"und"}
    elif name == "op7_minhash_near_dedup":
        single = [x for x in own if x[0] is not None and ids[x[0]] == 1]
        classes = {x["doc_id"]: x["component_id"] for x in got}
        want = brute_classes([x[1] if len(x[1] or "") < 10_000 else None for x in single])
        for a, (_, root) in zip(single, want, strict=True):
            if len(a[1] or "") < 10_000 and single[root][0] not in (20, 21, 22):
                assert classes[a[0]] == classes[single[root][0]]
    elif name == "op9_media_columns":
        texts = collections.defaultdict(set)
        for x in got:
            texts[x["payload_sha256"]].add((x["n_bytes"], x["feature"], x["media_sha256"], x["media_bytes"]))
        assert all(len({v[1:] for v in vs}) == 1 for vs in texts.values()) and all(x["media_bytes"] > x["payload_bytes"] for x in got)
    elif name == "op10_quality_rules":
        by_id = {x["doc_id"]: x for x in got if ids[x["doc_id"]] == 1}
        for x in own:
            if x[0] in by_id and len(x[1] or "") < 10_000:
                y = by_id[x[0]]
                assert (y["n_words"], y["word_chars"], y["n_symbols"], y["n_dup_lines"], y["n_repeat_words"], y["base_failed"]) == brute_base(x[1])


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query_on_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_pipeline_stages(spark, folder):
    """Each stage, and all of them, on awkward rows: columns stay, decisions take effect, clean documents stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = rows()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/stage-{name}")
        docs = spark.read.parquet(f"{folder}/stage-{name}")
        seen[name] = docs.select("doc_id", "text").collect()
    toxic = {x[0] for x in own if "grimbo" in (x[1] or "")}
    left = {x["doc_id"] for x in seen["toxicity"]}
    assert len(toxic & left) <= 0.2 * len(toxic) and len((set(x[0] for x in own) - toxic) - left) <= 2
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in seen["line_dedup"]) == sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in seen["toxicity"])
    before = [x for x in seen["line_dedup"] if x["doc_id"] is not None]
    roots = brute_classes([x["text"] if len(x["text"] or "") < 10_000 else None for x in before])
    kept = collections.Counter(x["doc_id"] for x in seen["near_dedup"])
    for x, (n, root) in zip(before, roots, strict=True):
        if n and x["doc_id"] not in (20, 21, 22) and before[root]["doc_id"] not in (20, 21, 22) and sum(r == root for _, r in roots) > 1:
            assert sum(kept[y["doc_id"]] > 0 for y, (_, r) in zip(before, roots, strict=True) if r == root) <= 1 + sum(y["doc_id"] in (20, 21, 22) for y, (_, r) in zip(before, roots, strict=True) if r == root)
    assert {x["doc_id"] for x in seen["mixing"]} <= set(kept)
    ran = corpus_pipeline.run(spark, folder)
    assert set(CONTRACT["op5_packing"].split()) <= set(ran.columns)
    tokens = collections.Counter()
    for x in ran.collect():
        tokens[x["sequence_id"]] += x["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in tokens.values()) and sum(n < 2048 for n in tokens.values()) <= 11


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_repeated_passages_of_awkward_rows(spark, folder):
    """op1 against brute force on all rows of moderate size."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("coalesce(octet_length(text), 0) < 10000")
    from casframe.llm import suffix_dedup

    own = [x for x in rows() if len((x[1] or "").encode()) < 10_000]
    want = collections.Counter((x[0], *w) for x, w in zip(own, brute_repeats([x[1] for x in own]), strict=True))
    got = collections.Counter(tuple(x) for x in suffix_dedup.remove_repeats(spark, docs.withColumn("z", F.lit(1))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
