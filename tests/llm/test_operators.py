"""The corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casframe.llm import crf, html_extract, kernel, langid, line_dedup, media, minhash, mixing, packing, quality, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, short periods and odd rows."""
    r = random.Random(seed)
    texts = [None, "", " \n\t", "a", "word", "one two three four", "é" * 150, "ab " * 300, "x\ny\n" * 5, "😀   text's <|endoftext|> it's", "z" * 1000]
    passage = prose(r, 60)
    for k in range(n):
        t = prose(r, r.randint(5, 160))
        kind = k % 6
        if kind == 1:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        elif kind == 2 and texts[-1]:
            words = texts[-1].split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = "edit"
            t = " ".join(words)
        elif kind == 3:
            t = texts[-2] or t
        elif kind == 4:
            t = passage[r.randint(0, 60) :] + "\n" + t
        texts.append(t)
    return texts


def frame(spark, texts, extra=""):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 13}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# -- suffix dedup ---------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [8192, 1])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = corpus(2, 80)
    texts.append((texts[20] or "") + "tail" + (texts[20] or ""))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark, frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_suffix_sort_orders_and_finds():
    r = random.Random(5)
    rows = []
    for g in range(6):
        base = bytes(r.choice(b"ab") for _ in range(400))
        for _ in range([1, 2, 3, 9, 30, 2][g]):
            left, right = r.randint(0, 136), r.randint(64, 200)
            c = bytearray(base[200 - left : 200 + right])
            if r.random() < 0.8:
                c[r.randrange(len(c))] ^= 1
            rows.append((g, left, bytes(c)))
    items = suffix_dedup.Contexts(np.array([x[1] for x in rows]), pa.array([x[2] for x in rows], pa.binary()))
    start = np.searchsorted([x[0] for x in rows], np.arange(7))
    order = suffix_dedup.merge_sort(items, start, True)
    for a, b in zip(start, start[1:], strict=False):
        keys = [rows[k][2][rows[k][1] :] for k in order[a:b]]
        assert keys == sorted(keys)
    got = suffix_dedup.shared_windows(items, start)
    for k, (g, left, c) in enumerate(rows):
        want = set()
        for k2, (g2, left2, c2) in enumerate(rows):
            if g2 == g and k2 != k:
                for j in range(0, 138):
                    if left - j >= 0 and left2 - j >= 0:
                        w, w2 = c[left - j : left - j + 200], c2[left2 - j : left2 - j + 200]
                        if len(w) == 200 and w == w2:
                            want.add(j)
        assert {j for lo, hi in got.get(k, []) for j in range(lo, hi + 1)} == want


def test_suffix_empty(spark):
    assert suffix_dedup.remove_repeats(spark, frame(spark, ["a"]).limit(0)).count() == 0


# -- near duplicates ------------------------------------------------------------------------------


def brute_classes(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(seed, n, edits):
    """Copies of one text with random edits: many are near the threshold."""
    r = random.Random(seed)
    base = prose(r, 120).split(" ")
    out = []
    for k in range(n):
        words = list(base) if k % 5 else list(out[r.randrange(len(out))].split(" ")) if out else list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("texts", [corpus(3, 90), family(1, 120, 9), family(2, 60, 4) + corpus(4, 30)], ids=["corpus", "family", "both"])
def test_minhash(spark, texts):
    got = {r["doc_id"]: r for r in minhash.classes(spark, frame(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_minhash_one_bucket(spark, monkeypatch):
    """With all texts in one bucket the levels alone must find a link that two hubs in a row do not meet."""
    words, own = prose(random.Random(5), 80).split(" "), [prose(random.Random(k), 60) for k in range(6, 9)]
    tail = [" ".join(words + o.split(" ")[:5]) for o in own[1:]]
    texts = [" ".join(words[:24]) + " " + own[0], " ".join(words[20:]) + " " + own[0], *tail]
    sign = minhash.sign
    monkeypatch.setattr(minhash, "sign", lambda *a: sign(*a).withColumn("bands", F.array(F.lit(0).cast("long"))))
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark, frame(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == [c for _, c in brute_classes(texts)] == [0, 1, 2, 2]


def brute_links(texts):
    """Components by all pairs, with sets as rows of a matrix."""
    import numpy as np

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    number = {s: k for k, s in enumerate(sorted({s for x in sets for s in x}))}
    rows = np.zeros((len(sets), len(number)), np.float32)
    for k, x in enumerate(sets):
        rows[k, [number[s] for s in x]] = 1
    both, n = rows @ rows.T, rows.sum(1)
    a, b = np.nonzero(100 * both >= 75 * (n[:, None] + n[None, :] - both))
    comp = np.arange(len(sets))
    while True:
        low = comp.copy()
        np.minimum.at(low, a, comp[b])
        if (low == comp).all():
            return comp.tolist()
        comp = low


@pytest.mark.parametrize("copies", [2, 0])
def test_minhash_large_family(spark, monkeypatch, copies):
    """3,400 near copies around the threshold, compared in blocks at once or after stars of their own: no link is lost."""
    monkeypatch.setattr(minhash, "COPIES", copies if copies else 0.2)
    n = 3400 if copies else 700
    texts = family(21, n, 10)
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark, frame(spark, texts)).collect()}
    assert [got[i] for i in range(n)] == brute_links(texts)


def test_components_of_chains(spark):
    """Paths, in awkward orders too, settle in few rounds."""
    for path in ([1, *range(300, 1, -1)], list(range(1, 301)), [x for k in range(1, 151) for x in (k, 301 - k)]):
        links = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
        scratch = minhash.common.Scratch(spark, "chain", links)
        saves, save = [], scratch.save
        scratch.save = lambda df, name, save=save, saves=saves: (saves.append(name), save(df, name))[1]
        assert {(r["sid"], r["comp"]) for r in minhash.components(scratch, links, "c").collect()} == {(k, 1) for k in range(1, 301)}
        assert len(saves) <= 40


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.classes(spark, df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=repr)
    kept = minhash.keep_one(spark, df)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, None]
    assert minhash.keep_one(spark, df.limit(0)).count() == 0


def test_densified_signatures_estimate():
    raw, at = kernel.utf8(pa.array([" ".join(map(str, range(300))), " ".join(map(str, range(30, 330))), "a b c d e f"]))
    win, bound = minhash.shingle_sets(raw, at)
    sig = minhash.signatures(win, bound)
    assert (sig != minhash._EMPTY).all()
    both = len(np.intersect1d(win[bound[0] : bound[1]], win[bound[1] : bound[2]]))
    true = both / (bound[2] - both)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15


# -- line dedup and mixing ------------------------------------------------------------------------


@pytest.mark.parametrize("share", [None, 0.5])
def test_line_dedup(spark, share):
    r = random.Random(7)
    texts = []
    for k in range(60):
        lines = [prose(r, 12) for _ in range(r.randint(1, 4))]
        if k % 2:
            lines.insert(0, "common notice")
        if k % 7 == 0:
            lines.append("  rare\t")
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "common notice", "common notice\nx"]
    df = frame(spark, texts).withColumn("row", F.lit(1)).withColumn("h", F.lit("x"))
    got = {x["doc_id"]: x for x in line_dedup.dedup(spark, df, most_share=share).collect()}
    sites = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            sites[line.strip(" \t\r")].add(f"s{i % 13}")
    for i, t in enumerate(texts):
        want = t
        if t:
            lines = t.split("\n")
            bad = [line for line in lines if line.strip(" \t\r") and len(sites[line.strip(" \t\r")]) >= line_dedup.MIN_SITES]
            size = lambda ls: sum(len(x.strip(" \t\r")) for x in ls)
            if bad and (share is None or size(bad) <= share * size(lines)):
                want = "\n".join(x for x in lines if x not in bad)
        assert got[i]["text"] == want
        if want is not None:
            assert got[i]["n_chars"] == len(want)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "row", "h"}


def test_mixing_weights():
    tokens = {"a": 8000, "b": 1000, "c": 1000, "d": 0}
    alpha, w = mixing.solve(tokens, 10_000, 1.25)
    assert math.isclose(sum(w.values()), 1) and w["d"] == 0
    assert mixing.repetition(tokens, w, 10_000) <= 1.25 + 1e-9 and mixing.repetition(tokens, mixing.weights(tokens, alpha - 1e-6), 10_000) > 1.25
    alpha, w = mixing.solve(tokens, 10_000, None, 0.9)
    assert math.isclose(mixing.entropy(w), 0.9 * math.log(3), abs_tol=1e-9)
    assert mixing.solve({}, 0)[1] == {} and mixing.solve({"a": 0}, 0)[1] == {"a": 0.0}


def test_mixing_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    r = random.Random(9)
    rows = [(i, prose(r, r.randint(0, 30)) if i % 9 else None, "en", None if i % 50 == 0 else "big" if i % 3 else f"s{i % 4}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tokens, per = collections.Counter(), {}
    for i, t, _, s, _ in rows:
        per[i] = len(WORD.findall(t or ""))
        tokens[s] += per[i]
    budget = sum(tokens.values())
    _, w = mixing.solve(dict(tokens), budget)
    out = mixing.draw(spark, df)
    assert out.columns == df.columns
    drawn, copies = collections.Counter(), collections.Counter()
    for x in out.collect():
        drawn[x["source"]] += per[x["doc_id"]]
        copies[x["doc_id"]] += 1
    for s in tokens:
        quota = math.floor(w[s] * budget + 1e-9)
        assert quota <= drawn[s] < quota + 40
    for s in tokens:
        own = [copies[i] for i, _, _, src, _ in rows if src == s and per[i]]
        assert max(own) - min(own) <= 1
    # The permutation by its definition: blocks in the order of their hashes, documents inside by theirs.
    seed, parts = mixing.SEED, collections.Counter(s for _, _, _, s, _ in rows)
    hashed = {x["doc_id"]: x for x in df.select("doc_id", *(F.xxhash64(F.col("doc_id").cast("string"), *more).alias(n) for n, more in (("b", [F.lit(seed)]), ("p0", [F.lit(0).cast("long"), F.lit(seed + 2)]), ("p1", [F.lit(1).cast("long"), F.lit(seed + 2)])))).collect()}
    turns = {(x["b"], x["p"]): x["t"] for x in spark.range(40).select(F.col("id").alias("b"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("p")).select("b", "p", F.xxhash64("b", "p", F.lit(seed + 1)).alias("t")).collect()}
    want = set()
    for s in tokens:
        full, rest = divmod(math.floor(w[s] * budget + 1e-9), tokens[s])
        own = [i for i, _, _, src, _ in rows if src == s]
        blocks = -(-parts[s] // 8)
        for p in range(full + (rest > 0)):
            at = 0
            for i in sorted(own, key=lambda i: (turns[hashed[i]["b"] % blocks, p], hashed[i]["b"] % blocks, hashed[i][f"p{p}"], str(i))):
                if p < full or at < rest:
                    want.add((i, s, p, at, per[i]))
                at += per[i]
    places = [tuple(x) for x in mixing.draw(spark, df, report=True).collect()]
    assert len(places) == len(want) and set(places) == want
    assert collections.Counter(x[0] for x in places) == copies
    assert sorted(map(tuple, mixing.draw(spark, df).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert mixing.draw(spark, df.limit(0)).count() == 0


# -- packing --------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    paths = packing.vocabulary_paths()
    tokenizer = Tokenizer.from_file(paths[0])
    texts = corpus(6, 40) + ["a  b", " lead", "trail ", "x\r\ny", "'s it's l'eau 'x", "1 2 3\n4 ½²", "日本語 テキスト", "a\n b"]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces = collections.defaultdict(list)
    spots = collections.defaultdict(list)
    for r in packing.pack(spark, frame(spark, texts), length=256, range_rows=9).collect():
        pieces[r["doc_id"]].append(r)
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for s in spots.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and sum(n < 256 for n in sizes) <= 8
    assert packing.pack(spark, frame(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_curve(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    order = packing.hilbert(cells, bits)
    assert sorted(order) == list(range(len(cells)))
    walk = cells[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# -- media ----------------------------------------------------------------------------------------


def test_media(spark):
    texts = corpus(8, 30) + ["n" * 40_000, prose(random.Random(1), 9000), prose(random.Random(1), 9000) + " more"]
    got = {r["doc_id"]: r for r in media.describe(spark, frame(spark, texts)).collect()}
    by_text = collections.defaultdict(set)
    for i, t in enumerate(texts):
        body = (t or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.encode(payload)), hashlib.sha256(media.encode(payload)).hexdigest())
        by_text[t or ""].add(r["feature"])
    assert all(len(x) == 1 for x in by_text.values())
    assert media.describe(spark, frame(spark, ["a"]).limit(0)).count() == 0


def test_media_cuts_resist_edits():
    r = random.Random(2)
    data = prose(r, 20_000).encode()
    table = media.gear_table()
    digest = lambda b: {c for _, _, cs in media.files(pa.record_batch([pa.array([b.decode()])], ["text"]), "text", table) for c in cs}
    assert len(digest(b"new words " + data) - digest(data)) <= 3
    with pytest.raises(ValueError, match="reads back"):
        media.described(b"\0" * 32, hashlib.sha256(b"x" * 64).digest(), media.encode(b"x" * 64))
    _, payload, chunks = next(media.files(pa.record_batch([pa.array([data.decode()])], ["text"]), "text", table))
    assert len(chunks) > 10 and b"".join(chunks) == media.encode(payload)  # the stored form is the file


# -- models ---------------------------------------------------------------------------------------


def brute_segments(scores):
    """Maximal segments by the definition: split at the best segment, on both sides."""
    out = []

    def go(lo, hi):
        best = (0, 0, 0)
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > best[0]:
                    best = (total, a, b + 1)
        if best[0] > 0:
            go(lo, best[1])
            out.append((best[1], best[2], best[0]))
            go(best[2], hi)

    go(0, len(scores))
    return out


def test_segments():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() * 1e-3 for _ in range(r.randint(0, 25))]
        got = toxicity.segments(np.array(scores, float))
        assert [g[:2] for g in got] == [w[:2] for w in brute_segments(scores)]


def test_toxicity(spark):
    r = random.Random(5)
    bad = ["grimbo", "grimbly", "grimax", "grimzen", "snarkle"]
    rows, labels = [], []
    for i in range(600):
        words = prose(r, r.randint(5, 60)).split(" ")
        toxic = i % 4 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad) if i < 400 else "grim" + prose(r, 1)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "...")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id < 400"))
    got = {x["doc_id"]: x for x in toxicity.apply(docs, model, passages=True).collect()}
    right = [got[i]["predicted"] == y for i, y in labels if i >= 400]
    assert sum(right) / len(right) > 0.95
    assert got[0]["passages"] and got[9000]["predicted"] == got[9001]["predicted"] == 0 and 0 <= got[9002]["score"] <= 1
    left = {x["doc_id"] for x in toxicity.drop_toxic(docs, model).collect()}
    assert left == {i for i, x in got.items() if not x["predicted"]}
    empty = toxicity.fit(docs, marks.limit(0))
    assert {x["score"] for x in toxicity.apply(docs, empty).collect()} == {0.0}


def all_cuts(word, prob):
    """Sum over every segmentation, by recursion."""
    if not word:
        return 1.0
    return sum(prob.get(word[:k], 0.0) * all_cuts(word[k:], prob) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab"]
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.3], [0.1, 0.1], [0.2, 0.1], [0.1, 0.1], [0.2, 0.1]])
    words = ["ab", "aba", "b", "abababab"]
    got = langid.score_words(langid.Lattice(pieces), prob, words)
    for k, w in enumerate(words):
        for lang in range(2):
            want = all_cuts(b" " + w.encode(), {p: prob[i, lang] for i, p in enumerate(pieces)})
            assert math.isclose(got[k, lang], math.log(want), rel_tol=1e-9)
    long = langid.score_words(langid.Lattice(pieces), prob, ["ab" * 2000, "a"])
    assert np.isfinite(long).all()
    edges, logp = langid.Lattice(pieces).edges(words), np.log(prob)
    shift = np.array([len(p) for p in pieces])[:, None]
    for lang in range(2):  # the gradient of a word's log-probability by a piece's is that piece's expected count
        want = np.zeros(len(pieces))
        for i in range(len(pieces)):
            up, down = logp.copy(), logp.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            want[i] = (edges.logs(up) - edges.logs(down))[:, lang].sum() / 2e-5
        got = edges.expected(logp, np.ones((4, 2)), len(pieces))[:, lang]
        assert np.allclose(got, want, atol=1e-6) and math.isclose((got * shift[:, 0]).sum(), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_language_pieces_and_words_have_no_bound():
    pieces = langid.read_pieces(langid.vocabulary_path())
    assert b" everything" in pieces and max(map(len, pieces)) > 16
    word = "ab" * 40
    model = langid.learn({"xx": {word: 50}, "yy": {"cd" * 40: 50}}, pieces)
    assert langid.score_words(langid.Lattice(model.pieces), model.prob, [word]).argmax() == 0


def test_language_id(spark):
    r = random.Random(6)
    make = {"xx": lambda: " ".join(r.choice(["ka", "lo", "mi"]) + r.choice(["tan", "pol"]) for _ in range(30)), "yy": lambda: " ".join(r.choice(["ße", "uch", "er"]) + r.choice(["ng", "ist"]) for _ in range(30))}
    rows = [(i, make[x](), x) for i in range(80) for x in [["xx", "yy"][i % 2]]] + [(900, None, "xx"), (901, "123 ...", None), (902, "", "yy"), (903, "katan", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 40"), langid.vocabulary_path())
    got = {x["doc_id"]: x for x in langid.apply(docs, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows if 40 <= i < 900)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    nothing = langid.fit(docs.limit(0), langid.vocabulary_path())
    assert {x["lang_pred"] for x in langid.apply(docs, nothing).collect()} == {"und"}


def test_viterbi_is_the_best_labelling():
    r = random.Random(8)
    for _ in range(100):
        n = r.randint(1, 8)
        m, move = [r.gauss(0, 2) for _ in range(n)], [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y: sum(m[i] for i in range(n) if y[i]) + sum(move[a][b] for a, b in zip(y, y[1:], strict=False))
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert math.isclose(value(crf.viterbi(m, move)), value(best))
    assert crf.viterbi([], [[0, 0], [0, 0]]) == []


def brute_base(t):
    words = WORD.findall(t or "")
    win = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_quality(spark):
    r = random.Random(10)
    texts = corpus(11, 30) + ["a b\na b\n a b\n\na b", "x " * 40, "# $ % | <a> * & é😀"]
    junk = [" | ".join(prose(r, 30).upper().split(" ")) for _ in range(40)]
    good = [". ".join(prose(r, 9).capitalize() for _ in range(5)) + "." for _ in range(40)]
    docs = frame(spark, texts + junk + good)
    n = len(texts)
    labels = spark.createDataFrame([(n + k, int(k >= 40), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {x["doc_id"]: x for x in quality.apply(docs, model).collect()}
    for i, t in enumerate(texts + junk + good):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute_base(t)
        assert not (x["base_failed"] and x["kept"])
    assert not any(got[n + k]["kept"] for k in range(40)) and all(got[n + k]["kept"] for k in range(40, 80))
    assert quality.apply(docs.limit(0), model).count() == 0
    assert all(x["kept"] != x["base_failed"] for x in quality.apply(docs, quality.fit(docs, labels.limit(0))).collect() if x["n_words"])


def test_quality_labels_lines(spark):
    """A text of good and bad lines decodes as mixed, and its share says how much is content."""
    r = random.Random(12)
    junk = lambda: " | ".join(prose(r, 12).upper().split(" "))
    good = lambda: prose(r, 12).capitalize() + "."
    texts = ["\n".join((good if k % 2 else junk)() for _ in range(r.choice([3, 9, 90]))) for k in range(120)]
    model = quality.fit(frame(spark, texts), spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int"))
    mixed = ["\n".join([good() for _ in range(a)] + [junk() for _ in range(b)] + [good() for _ in range(c)]) for a, b, c in [(6, 8, 6), (1, 3, 12), (10, 30, 2), (0, 5, 5)]]
    got = {x["doc_id"]: x for x in quality.apply(frame(spark, mixed), model).collect()}
    for k, (a, b, c) in enumerate([(6, 8, 6), (1, 3, 12), (10, 30, 2), (0, 5, 5)]):
        assert abs(got[k]["content_lines"] - (a + c)) <= 1 and 0 < got[k]["content_share"] < 1
        assert got[k]["kept"] == (got[k]["content_share"] >= quality.CONTENT_SHARE)
    sequences = quality.spliced(np.arange(300.0)[:, None], np.array([0, 100, 300]), np.array([0, 1]))
    assert sorted(np.concatenate([f[:, 0] for f, _ in sequences])) == list(range(300))
    assert all(y == (f >= 100) for fs, ys in sequences for f, y in zip(fs[:, 0], ys, strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><div>Site name</div></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div><main><article><h1>The &quot;title&quot;</h1><p>First  paragraph
with <b>bold</b> &amp; <a href="x">link</a> text that goes on.</p><div class="ad">Buy now!</div><p>Second<br>paragraph of the article, with some words.<ul><li>An item of a list.</li></ul>
<script>var t = "</p><p>no";</script></article></main><section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot.</p></div></section>
<aside class="sidebar"><p>Read also these stories.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_html():
    model = html_extract.fit()
    want = 'The "title"\n\nFirst paragraph with bold & link text that goes on.\n\nSecond paragraph of the article, with some words.\n\nAn item of a list.'
    assert html_extract.extract(PAGE, model) == want
    for cut in range(0, len(PAGE), 7):
        assert isinstance(html_extract.extract(PAGE[:cut], model), str)
    right = total = 0
    for blocks, labels in html_extract.labelled_pages(60, seed=77):
        got = crf.viterbi(model.margins(html_extract.features(blocks)).tolist(), model.move.tolist())
        right, total = right + int((np.array(got) == labels).sum()), total + len(labels)
    assert right / total > 0.97


def test_html_omitted_tags():
    model = html_extract.fit()
    rest = "<article><h1>A title of words</h1><p>The first paragraph, which has several words.</p><p>Another one that goes on for a while.</p></article>"
    want = "A title of words\n\nThe first paragraph, which has several words.\n\nAnother one that goes on for a while."
    for page in (
        f"<html><head><title>x</title></head><body>{rest}</body></html>",
        f"<html><head><title>x</title><body>{rest}</body></html>",
        f"<html><head><title>x</title>{rest}",
        f"<title>x</title>{rest}",
        f"<head><meta charset=utf-8><title>x</title>{rest.replace('</p>', '')}",
        rest.replace("article>", "main>"),
    ):
        assert html_extract.extract(page, model) == want
    bare = "<p>The first paragraph, which has several words in it.</p><p>Another one that goes on for a while.</p>"
    assert html_extract.extract(bare, model) == "The first paragraph, which has several words in it.\n\nAnother one that goes on for a while."
    cells = html_extract.leaf_blocks("<article><table><tr><td>one<td>two<tr><td>three<ul><li>a<li>b</ul></table><dl><dt>t<dd>d<dt>u</dl>")
    assert [b[0] for b in cells] == ["one", "two", "three", "a", "b", "t", "d", "u"]
    assert len({b[1] for b in cells[:3]}) == 1  # none stands in another's cell or row
    digits = html_extract.features(html_extract.leaf_blocks("<p>" + "x" * 300 + "1" * 300))
    assert np.isclose(digits, 0.5).any()


def test_html_rows(spark):
    model = html_extract.fit(60)
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<<<>>> & text < 3 </"), (5, "x", "<p" * 50)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.apply(df, model).collect()}
    assert got[2]["text"] == got[3]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert "First paragraph" in html.unescape(got[1]["text"])
