"""Exact removal of repeated passages by a hash-compared sparse suffix sort.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else,
in the same text or another one; matches never cross texts.

Anchors.  Each window of LENGTH bytes chooses the k-gram inside it with the least
hash.  Equal windows choose at the same offset, so any repeated window meets its
twin at a common anchor, and a few per cent of the positions stand for all of them.
The windows that chose an anchor start in one run, and the bytes they span are the
anchor's *context*.

Candidates.  Anchors are counted by hash with map-side aggregation; only those of
at least two places go on, and only texts that hold such anchors move, once.  A
context is named by 128 bits of the SHA-256 of its bytes and its anchor's offset.
Contexts that occur whole more than once are repeated in all their windows.

Suffix sort.  The distinct contexts of one anchor are suffixes of one sparse
suffix array.  Prefix polynomial hashes give the common extension of two contexts,
to the right and to the left of the anchor, by binary search, so a comparison takes
a logarithmic number of steps; a bottom-up mergesort orders all groups of a block
at once with such comparisons, and the extensions of neighbours are verified on
the bytes.  Joining neighbours from the longest right extension down, smaller group
into larger, finds for each context the left extensions it shares at every right
one: all its windows that occur elsewhere, though never all pairs are compared.

Bounds.  No group of any size is sorted in one task: the contexts of an anchor with
more than ``GROUP`` distinct ones are compared by their windows, each named by 128
bits of a cryptographic digest of its bytes, again with map-side aggregation, which
finds the same windows.  Anchors and contexts that hold over one in
``common.HEAVY`` of all rows are broadcast, as names without bytes, instead of
gathered in a task.  Polynomial hashes, which texts can be made to collide in, only
choose candidates; digests and bytes decide.

Equal texts (by SHA-256) are worked on once, and removed whole from LENGTH bytes on.
Null texts are empty, null and repeated keys and repeated rows keep their rows.
Texts shorter than LENGTH bytes lose nothing.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import common, kernel

LENGTH = 200
GRAM = 64
GROUP = 8192
BLOCK_ROWS = 4096
OUT_ROWS = 8192
U64 = np.uint64


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first window, last window) of each chosen k-gram of a block."""
    n, none = len(raw), np.zeros(0, np.int64)
    sizes = np.diff(at)
    if n < length or not (sizes >= length).any():
        return np.zeros(0, U64), none, none, none, none
    p = kernel.prefix_hash(raw)
    start = np.arange(n - gram + 1)
    h = kernel.mix(kernel.span_hash(p, start, start + gram))
    bits = U64(int(n).bit_length())
    key = np.full(n, np.iinfo(U64).max, U64)
    key[: len(h)] = ((h >> bits) << bits) | start.astype(U64)
    span, step, least = length - gram + 1, 1, key
    while 2 * step <= span:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    least = np.minimum(least[: n - length + 1], least[span - step : span - step + n - length + 1])
    text = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    good = at[text + 1] - np.arange(n - length + 1) >= length
    window = np.flatnonzero(good)
    chosen = (least[window] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    owner = text[window]
    head = np.ones(len(window), bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(window)) - 1
    return h[chosen[first]], owner[first], chosen[first], window[first], window[last]


def list_anchors(texts: DataFrame) -> DataFrame:
    """(h, tid, pos) of every anchor of (tid, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, _, raw, at in kernel.batches(part):
                h, text, place, _, _ = anchors(raw, at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(i + text)), pa.array((place - at[text]).astype(np.int32))], ["h", "tid", "pos"])

    return texts.mapInArrow(run, "h long, tid binary, pos int")


def name(left: int, context: bytes) -> bytes:
    """128 bits of a digest of a context and its anchor's offset."""
    return hashlib.sha256(left.to_bytes(4, "little") + context).digest()[:16]


def list_contexts(found: DataFrame) -> DataFrame:
    """(tid, pos, h, cid, left, ctx) of the wanted anchors of (tid, text, places)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wanted = part.column(2)
            for i, j, raw, at in kernel.batches(part):
                h, text, place, first, last = anchors(raw, at)
                own = wanted.slice(i, j - i)
                flat, sizes = own.flatten().to_numpy(), np.array([len(x) for x in own], np.int64)
                marks = np.zeros(len(raw) + 1, bool)
                marks[flat + np.repeat(at[:-1], sizes)] = True
                keep = np.flatnonzero(marks[place]) if len(place) else np.zeros(0, np.int64)
                h, text, place, first, last = (x[keep] for x in (h, text, place, first, last))
                left = place - first
                body = raw.tobytes()
                for k in range(0, len(place), OUT_ROWS):  # a text of short period has an anchor every few bytes
                    w = slice(k, k + OUT_ROWS)
                    ctx = [body[a : b + LENGTH] for a, b in zip(first[w].tolist(), last[w].tolist(), strict=True)]
                    cid = [name(n, c) for n, c in zip(left[w].tolist(), ctx, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(i + text[w])), pa.array((place[w] - at[text[w]]).astype(np.int32)), pa.array(h[w].view(np.int64)), pa.array(cid, pa.binary()), pa.array(left[w].astype(np.int32)), pa.array(ctx, pa.binary())],
                        ["tid", "pos", "h", "cid", "left", "ctx"],
                    )

    return found.mapInArrow(run, "tid binary, pos int, h long, cid binary, left int, ctx binary")


class Contexts:
    """Contexts in a common frame, with the anchor at one column, and their prefix hashes."""

    def __init__(self, left: np.ndarray, ctx: pa.Array, length: int = LENGTH, gram: int = GRAM) -> None:
        self.at = length - gram + 1
        width = self.at + length
        raw, bound = kernel.utf8(ctx)
        size = np.diff(bound)
        self.byte = np.zeros((len(size), width + 1), np.uint16)
        flat = np.arange(len(raw)) - np.repeat(bound[:-1], size) + np.repeat(np.arange(len(size)) * (width + 1) + self.at - left, size)
        self.byte.ravel()[flat] = raw.astype(np.uint16) + 1
        self.left, self.right = left, size - left
        self.p = np.zeros((len(size), width + 1), U64)
        np.cumsum(self.byte[:, :-1].astype(U64) * kernel._powers("up", width), axis=1, out=self.p[:, 1:])

    def extension(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """Common extension of pairs from the anchor, by binary search on prefix hashes."""
        size = self.right if forward else self.left
        lo, hi, at = np.zeros(len(x), np.int64), np.minimum(size[x], size[y]), self.at
        px, py = self.p[x, at], self.p[y, at]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            col = at + mid if forward else at - mid
            same = (self.p[x, col] - px) == (self.p[y, col] - py)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def less(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        e = self.extension(x, y, forward)
        col = self.at + e if forward else self.at - 1 - e
        inside = col >= 0
        col = np.maximum(col, 0)
        return inside & (self.byte[x, col] < self.byte[y, col])

    def verified(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """Extensions measured on the bytes."""
        a, b = (self.byte[x, self.at : -1], self.byte[y, self.at : -1]) if forward else (self.byte[x, : self.at][:, ::-1], self.byte[y, : self.at][:, ::-1])
        differ = (a != b) | (a == 0)
        return np.where(differ.any(1), differ.argmax(1), differ.shape[1])


def merge_sort(items: Contexts, start: np.ndarray, forward: bool) -> np.ndarray:
    """Orders each group of rows (``start`` has the groups' bounds) by its suffixes.

    Runs of 1, 2, 4, ... are merged in all groups at once: an item's place in the
    merged run is its place in its own plus the number of smaller items in the
    sibling run, found by binary search with hash comparisons.
    """
    n = int(start[-1])
    order = np.arange(n)
    size = np.diff(start)
    base, stop = np.repeat(start[:-1], size), np.repeat(start[1:], size)
    run, most = 1, int(size.max()) if len(size) else 0
    while run < most:
        live = np.flatnonzero(np.repeat(size > run, size))
        spot, low, high = live, base[live], stop[live]
        own = (spot - low) // run
        sib = low + (own ^ 1) * run
        sib_end = np.minimum(sib + run, high)
        sib = np.minimum(sib, high)
        lo, hi, first = sib.copy(), sib_end.copy(), own % 2 == 0
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            me, other = order[spot[open_]], order[mid]
            # Items of the left run count strictly smaller ones, so equal items keep their order.
            left = first[open_]
            before = items.less(np.where(left, other, me), np.where(left, me, other), forward)
            up = np.where(left, before, ~before)
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
        own_start = low + own * run
        target = np.minimum(own_start, sib) + (spot - own_start) + (lo - sib)
        fresh = order.copy()
        fresh[target] = order[spot]
        order = fresh
        run *= 2
    return order


def shared_windows(items: Contexts, start: np.ndarray, length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """For each row the ranges of offsets before the anchor whose windows another row of its group has."""
    out: dict[int, list[tuple[int, int]]] = {}
    by_right, by_left = merge_sort(items, start, True), merge_sort(items, start, False)
    n = int(start[-1])
    inner = np.ones(max(n - 1, 0), bool)
    inner[start[1:-1] - 1] = False
    right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = np.flatnonzero(inner)
    right[pairs] = items.verified(by_right[pairs], by_right[pairs + 1], True)
    left[pairs] = items.verified(by_left[pairs], by_left[pairs + 1], False)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)

    def note(x: int, y: int, r: int, e: int) -> None:
        if e >= length - r:
            out.setdefault(x, []).append((length - r, e))
            out.setdefault(y, []).append((length - r, e))

    for g in range(len(start) - 1):
        a, b = int(start[g]), int(start[g + 1])
        if b - a == 2:
            note(int(by_right[a]), int(by_right[a + 1]), int(right[a]), int(left[a]))
            continue
        if b - a < 2:
            continue
        sets = {k: [int(rank[by_right[k]])] for k in range(a, b)}
        root = list(range(b - a))
        near = left[a:b].tolist()

        def find(k: int, root=root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in sorted(range(a, b - 1), key=lambda k: -int(right[k])):
            r = int(right[k])
            if length - r > items.at:
                break
            x, y = find(k - a), find(k + 1 - a)
            big, small = (x, y) if len(sets[x + a]) >= len(sets[y + a]) else (y, x)
            into = sets[big + a]
            for spot in sets.pop(small + a):
                i = bisect.bisect_left(into, spot)
                if i:
                    note(int(by_left[into[i - 1]]), int(by_left[spot]), r, min(near[into[i - 1] - a : spot - a]))
                if i < len(into):
                    note(int(by_left[into[i]]), int(by_left[spot]), r, min(near[spot - a : into[i] - a]))
                into.insert(i, spot)
            root[small] = big
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges; neighbours join."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


RANGES = "cid binary, n long, low int, high int"


def resolve(contexts: DataFrame) -> DataFrame:
    """(cid, n, low, high): offsets whose windows occur in another context of the anchor; rows come sorted by h."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        h = rows.column(0).to_numpy()
        start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        items = Contexts(rows.column(3).to_numpy().astype(np.int64), rows.column(4).combine_chunks())
        own, low, high = [], [], []
        for row, ranges in shared_windows(items, start).items():
            for a, b in merged(ranges):
                own.append(row)
                low.append(a)
                high.append(b)
        chosen = rows.take(pa.array(own, pa.int64()))
        return pa.RecordBatch.from_arrays([chosen.column(1).combine_chunks(), chosen.column(2).combine_chunks(), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["cid", "n", "low", "high"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for part in parts:
            for i in range(0, part.num_rows, BLOCK_ROWS):
                held.append(part.slice(i, BLOCK_ROWS))
                count += held[-1].num_rows
                if count < BLOCK_ROWS:
                    continue
                rows = pa.Table.from_batches(held)
                h = rows.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if cut:
                    yield solve(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                count = count - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    return contexts.select("h", "cid", "n", "left", "ctx").mapInArrow(run, RANGES)


def counted(contexts: DataFrame) -> DataFrame:
    """(cid, n, low, high) of contexts whose anchors have too many of them for one task: windows by digest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):
                rows = part.slice(k, 256)
                w, own, low = [], [], []
                for r, (left, ctx) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                    for first in range(min(left, len(ctx) - LENGTH) + 1):
                        w.append(name(left - first, ctx[first : first + LENGTH]))
                        own.append(r)
                        low.append(left - first)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), rows.column(0).take(pa.array(own, pa.int64())), rows.column(1).take(pa.array(own, pa.int64())), pa.array(low, pa.int32())], ["w", "cid", "n", "low"])

    windows = contexts.select("cid", "n", "left", "ctx").mapInArrow(run, "w binary, cid binary, n long, low int")
    often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w")  # contexts are distinct, so each counts once
    return windows.join(often, "w").select("cid", "n", "low", F.col("low").alias("high"))


def cut(texts: DataFrame) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256) of (tid, text, spans of window starts)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, at = kernel.utf8(part.column(1))
            gone, spans, sha = [], [], []
            for k, own in enumerate(part.column(2).to_pylist()):
                body, done, digest, n = raw[at[k] : at[k + 1]].tobytes(), 0, hashlib.sha256(), 0
                # Windows that start within LENGTH of the last one overlap or touch it.
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in own):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b + LENGTH)
                    else:
                        runs.append([a, b + LENGTH])
                for a, b in runs:
                    digest.update(body[done:a])
                    n += b - a
                    done = b
                digest.update(body[done:])
                gone.append(n)
                spans.append(len(runs))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["tid", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "tid binary, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    scratch = common.Scratch(spark, "suffix", documents)
    docs = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("key", F.unhex(F.sha2("text", 256)).alias("tid"), "text")
    rows = scratch.save(docs.select("key", "tid", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    known = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("one")
    texts = scratch.save(rows.where(F.col("n_bytes") >= LENGTH).groupBy("tid").agg(F.count(F.lit(1)).alias("n_rows"), F.min(known).alias("one")), "texts")
    found = scratch.save(list_anchors(docs.where(F.octet_length("text") >= LENGTH).select("tid", "text")), "anchors")
    # Two places at least, told apart by 128 bits: rows of equal texts share their places.
    one, two = F.xxhash64("tid", "pos"), F.xxhash64("pos", "tid", F.lit(1))
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *(f(x).alias(f"{f.__name__}{k}") for k, x in enumerate((one, two)) for f in (F.min, F.max)))
    often = scratch.save(often.where("min0 <> max0 OR min1 <> max1").select("h", "n"), "often")
    wanted = common.match(found, often, "h", "n", found.count()).groupBy("tid").agg(F.collect_set("pos").alias("places"))
    wanted = scratch.save(wanted.join(texts, "tid").select("tid", "one", "places"), "wanted")
    scratch.drop("anchors", "often")
    likely = docs.where(F.octet_length("text") >= LENGTH).select(known, "tid", "text")
    bodies = scratch.save(likely.join(wanted, ["tid", "one"]).dropDuplicates(["tid", "one"]).select("tid", "text", "places"), "bodies")
    ctx = scratch.save(list_contexts(bodies), "contexts")
    # Names come first, without bytes: each context once with its number of places and one of them.
    groups = ctx.groupBy("h", "cid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "pos")).alias("at"))
    groups = scratch.save(groups.select("h", "cid", "n", "at.tid", "at.pos"), "groups")
    several = scratch.save(groups.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    chosen = common.match(groups, several.withColumn("rows", F.col("m")), "h", "rows", groups.count()).select("tid", "pos", "n", "m")
    distinct = scratch.save(ctx.join(chosen, ["tid", "pos"]).select("h", "cid", "n", "m", "left", "ctx"), "distinct")
    small = distinct.where(F.col("m") <= GROUP).repartition("h").sortWithinPartitions("h", "cid")
    whole = groups.where("n > 1").select("cid", "n", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    ranges = scratch.save(resolve(small).union(counted(distinct.where(F.col("m") > GROUP))), "ranges")
    marks = ranges.union(whole).groupBy("cid", "n").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    marks = scratch.save(marks, "marks")
    places = ctx.select("tid", "pos", "cid", "left", (LENGTH - (F.octet_length("ctx") - F.col("left"))).alias("least"))
    hit = common.match(places, marks, "cid", "n", ctx.count()).select("tid", "pos", "left", "least", F.explode("marks").alias("mark"))
    spans = hit.select("tid", F.struct((F.col("pos") - F.coalesce("mark.high", "left")).alias("a"), (F.col("pos") - F.coalesce("mark.low", "least")).alias("b")).alias("span"))
    spans = spans.groupBy("tid").agg(F.collect_list("span").alias("spans"))
    done = scratch.save(cut(bodies.select("tid", "text").join(spans, "tid").select("tid", "text", "spans")), "done")
    scratch.drop("bodies", "contexts", "distinct", "groups", "several", "ranges", "marks", "wanted")
    twins = texts.where("n_rows > 1").select("tid", F.lit(True).alias("twin"))
    verdicts = scratch.save(done.join(twins, "tid", "full"), "verdicts")
    # Only rows of equal texts share a key, and all those of LENGTH bytes have a verdict.
    long = common.match(rows.where(F.col("n_bytes") >= LENGTH), texts.select("tid", "n_rows").join(verdicts, "tid", "left"), "tid", "n_rows", rows.count())
    out = long.unionByName(rows.where(F.col("n_bytes") < LENGTH), allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(F.col("twin"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("twin"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("twin"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("tid")))).alias("kept_sha256"),
    ).coalesce(scratch.parts)
