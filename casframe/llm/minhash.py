"""Near-duplicate classes: one-permutation MinHash, banded buckets, star edges.

A text's set holds its distinct shingles of five consecutive words (ASCII
lower-cased); a text of fewer words is one shingle, a text without words is the
empty set and links with nothing.  Two texts link if their sets' Jaccard
similarity is ``PERCENT`` per cent or more; classes are the components of links.

1. One pass hashes the shingles into ``BINS`` bins, keeps each bin's minimum and
   fills empty bins by optimal densification (an empty bin probes bins in its own
   hashed order until one has a value).  ``BANDS`` bands of bins give the buckets.
   A pair at exactly 75 % shares no band with a probability of 5e-6.
2. Rows with equal sets fall into one class without buckets, so groups of copies
   cost one row each; only one row of each set goes on.
3. Each bucket proposes a star: its hub, which is the member that meets most others
   over all buckets, with every other member.  Pairs are linear in the members, and
   each is confirmed on the full sets.
4. A star can miss a link between two points.  Where a hub's members are not yet in
   one component, those outside the largest are compared with all of its members in
   blocks of ``BLOCK`` texts: each text moves once for a pair of blocks, and its set
   meets the others in one matrix product.  No pair is a row.
5. That is done for every hub as long as it moves at most ``COPIES`` times as many
   texts as there are; hubs for which it would move more go a further step first.  A
   link that is missing there lies either on a shingle that the hub lacks, or inside
   the hub, and then its size, ``min(|x & hub|, |y & hub|)``, must suffice.  Members
   that share a shingle outside the hub (by prefix filtering, which loses none) meet
   in new buckets: up to ``SMALL`` members have all their pairs of different
   components confirmed, larger ones get a star of their own, without the hub, and
   pairs that the sizes inside the hub allow are confirmed directly.

So every link between members of a bucket is found or joins two texts that are in
one component already.
No bucket, partner or pair is capped or dropped for its size.  Null and
empty texts are classes of their own; rows with a null id keep a null class and
are kept; rows that repeat an id count as one node with all their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casframe.llm import common, kernel

WIDTH = 5
PERCENT = 75
BINS = 128
BANDS = 32
SMALL = 32
BLOCK = 128
COPIES = 2
U64 = np.uint64
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes by text, end to end, and the texts' bounds."""
    raw = kernel.lower_ascii(raw)
    start, end, first = kernel.words(raw, at)
    h = kernel.mix(kernel.span_hash(kernel.prefix_hash(raw), start, end))
    win, bound = kernel.windows(h, first, width)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    text = np.repeat(np.arange(len(n)), np.diff(bound))
    if len(short):
        whole = np.array([_fold(h[first[k] : first[k + 1]]) for k in short], U64)
        win, text = np.concatenate([win, whole]), np.concatenate([text, short])
    order = np.lexsort((win, text))
    win, text = win[order], text[order]
    fresh = np.ones(len(win), bool)
    fresh[1:] = (win[1:] != win[:-1]) | (text[1:] != text[:-1])
    win, text = win[fresh], text[fresh]
    return win, np.searchsorted(text, np.arange(len(n) + 1))


def _fold(h: np.ndarray) -> np.uint64:
    out = np.array([0x5851F42D4C957F2D + len(h)], U64)
    for k in range(len(h)):
        out = kernel.mix(out * U64(kernel.BASE) + h[k : k + 1])
    return out[0]


def signatures(win: np.ndarray, bound: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signatures, a row for each text (all ones for empty sets)."""
    texts, shift = len(bound) - 1, U64(64 - int(bins).bit_length() + 1)
    out = np.full((texts, bins), _EMPTY, U64)
    if not len(win):
        return out
    text = np.repeat(np.arange(texts), np.diff(bound))
    cell = (win >> shift).astype(np.int64)
    slot = text * bins + cell
    first = np.ones(len(win), bool)
    first[1:] = slot[1:] != slot[:-1]
    out.ravel()[slot[first]] = win[first]
    single = np.flatnonzero(np.diff(bound) == 1)
    out[single] = win[bound[single]][:, None]
    some = np.diff(bound) > 0
    origin = out.copy()
    row, col = np.nonzero((out == _EMPTY) & some[:, None])
    probe = 0
    while len(row):
        probe += 1
        where = (kernel.mix(col.astype(U64) * U64(0x9E3779B1) + U64(probe)) >> shift).astype(np.int64)
        got = origin[row, where]
        hit = got != _EMPTY
        out[row[hit], col[hit]] = got[hit]
        row, col = row[~hit], col[~hit]
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    out = np.zeros((len(sig), bands), U64)
    for r in range(rows):
        out = kernel.mix(out * U64(kernel.BASE) + sig[:, r * bands : (r + 1) * bands] + U64(r + 1))
    return out


def sign(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_shingles, a 128-bit set hash (two longs) and the bands of each row."""
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                win, bound = shingle_sets(raw, at)
                n = np.diff(bound)
                one, two = np.zeros(len(win) + 1, U64), np.zeros(len(win) + 1, U64)
                np.cumsum(kernel.mix(win ^ U64(0xA5A5A5A5A5A5A5A5)), out=one[1:])
                np.cumsum(kernel.mix(win + U64(0x1234567)), out=two[1:])
                bands = band_hashes(signatures(win, bound)).view(np.int64)
                full = n > 0
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(i, j - i), pa.array(n), pa.array((one[bound[1:]] - one[bound[:-1]]).view(np.int64)), pa.array((two[bound[1:]] - two[bound[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return source.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each pair (a, b) with the sizes of both full sets and what they share, whether
    they link, and ``outside``: the shingles of b that a lacks.
    """
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (left, left_at), (right, right_at) = kernel.utf8(part.column(2)), kernel.utf8(part.column(3))
            for i, j in kernel.blocks(left_at + right_at):
                x, x_at = shingle_sets(left[left_at[i] : left_at[j]], left_at[i : j + 1] - left_at[i])
                y, y_at = shingle_sets(right[right_at[i] : right_at[j]], right_at[i : j + 1] - right_at[i])
                nx, ny = np.diff(x_at), np.diff(y_at)
                h, pair = np.concatenate([x, y]), np.concatenate([np.repeat(np.arange(j - i), nx), np.repeat(np.arange(j - i), ny)])
                side = np.concatenate([np.zeros(len(x), bool), np.ones(len(y), bool)])
                order = np.lexsort((side, h, pair))
                h, pair, side = h[order], pair[order], side[order]
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[same], minlength=j - i)
                good = (100 * shared >= percent * (nx + ny - shared)) & (shared > 0)
                only = side & ~same
                bound = np.concatenate([[0], np.cumsum(np.bincount(pair[only], minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).slice(i, j - i) for k in (0, 1)), pa.array(nx), pa.array(ny), pa.array(shared.astype(np.int64)), pa.array(good), pa.ListArray.from_arrays(pa.array(bound), pa.array(h[only].view(np.int64)))],
                    ["a", "b", "na", "nb", "both", "linked", "outside"],
                )

    return both.mapInArrow(run, "a long, b long, na long, nb long, both long, linked boolean, outside array<long>")


def components(scratch: common.Scratch, links: DataFrame, name: str) -> DataFrame:
    """(sid, comp) of all linked nodes: comp is the smallest node that can be reached.

    Each round hooks every component's root to the least neighbouring root, lets
    roots jump to their root's root until all have arrived, and goes on with the
    links between roots that differ.  A root that has a smaller neighbour is one no
    more, so every round ends all local maxima; jumps are logarithmic in a round.
    Later rounds see only what is left of the links.
    """
    edges = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    labels, k = None, 0
    while labels is None or not edges.isEmpty():
        k += 1
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        up, j = scratch.save(up, f"{name}-up{k}-0"), 0
        while True:
            above = up.select(F.col("root").alias("up"), F.col("up").alias("next"))
            j += 1
            jumped = scratch.save(up.select("root", "up").join(above, "up").select("root", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")), f"{name}-up{k}-{j}")
            scratch.drop(f"{name}-up{k}-{j - 1}")
            up = jumped.select("root", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.toDF("sid", "comp")
        else:
            labels = scratch.save(labels.join(up.toDF("comp", "up"), "comp", "left").select("sid", F.coalesce("up", "comp").alias("comp")), f"{name}-{k}")
        one, two = edges.join(up.toDF("a", "x"), "a").select("x", "b"), up.toDF("b", "y")
        edges = one.join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.save(edges, f"{name}-edges{k}")
        scratch.drop(f"{name}-edges{k - 1}")
    return labels


def together(rows: DataFrame) -> DataFrame:
    """(line, bucket, sid, size) of the buckets with two members or more."""
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(shared, "bucket").select("line", "bucket", "sid", "size")


def stars(members: DataFrame) -> DataFrame:
    """Distinct (line, a, b): hub a with every other member b of its buckets.

    ``line`` stands for the hubs met on the way here.  Members under a line never
    include one of its hubs, so lines end.
    """
    known = members.groupBy("sid").agg(F.sum("size").alias("meets"))
    hubs = members.join(known, "sid").groupBy("bucket").agg(F.max(F.struct("meets", -F.col("sid"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("a"))
    return members.join(hubs, "bucket").where("sid <> a").select(F.xxhash64("line", "a").alias("line"), "a", F.col("sid").alias("b")).distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """(bucket, size) of the buckets with members of two components or more."""
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "size")


def outside_hub(seen: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(line, bucket, sid): a prefix of what each member has outside its hub, a bucket for each shingle.

    Only shingles that members of another component have too can be in a link that is
    still missing.  A member with less than ``need`` of them has no such link here; of
    the others the rarest go on, all but ``need - 1``: two members that share ``need``
    of them meet in one.  ``need`` is what a link asks for with the smallest partner that
    the line and the threshold allow, less what the member shares with the hub.
    """
    least = seen.groupBy("line").agg(F.min("nb").alias("least"))
    partner = f"greatest(({percent} * nb + 99) div 100, least)"
    need = f"greatest(1, ({percent} * (nb + {partner}) + {99 + percent}) div {100 + percent} - both)"
    spread = seen.join(least, "line").select("line", F.col("b").alias("sid"), "comp", F.expr(need).alias("need"), F.explode("outside").alias("h")).withColumn("bucket", F.xxhash64("line", "h")).drop("h")
    each = Window.partitionBy("line", "sid")
    ranked = spread.join(mixed(spread), "bucket").withColumn("n", F.count(F.lit(1)).over(each)).where("n >= need").withColumn("rank", F.row_number().over(each.orderBy("size", "bucket")))
    prefix = ranked.where("rank <= n - need + 1").select("line", "bucket", "sid", "comp")
    return prefix.join(mixed(prefix), "bucket").select("line", "bucket", "sid", "comp", "size")


def families(seen: DataFrame) -> DataFrame:
    """(line, largest, lefts, rights, copies): a line's largest component, how many blocks hold the members
    outside of it and all members, and how many texts their comparison moves."""
    sizes = seen.groupBy("line", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("line").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK)
    sizes = sizes.select("line", F.col("top.comp").alias("largest"), "m", (F.col("m") - F.col("top.n")).alias("rest")).where("rest > 0")
    sizes = sizes.withColumn("lefts", blocks(F.col("rest"))).withColumn("rights", blocks(F.col("m")))
    return sizes.select("line", "largest", "lefts", "rights", (F.col("rest") * F.col("rights") + F.col("m") * F.col("lefts")).alias("copies"))


def across(seen: DataFrame, lines: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the links of each line's members outside its largest component with any of its members."""
    rows = seen.select("line", F.col("b").alias("sid"), "comp").join(lines, "line")
    slot = lambda seed, n: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("comp <> largest").select("line", "sid", F.lit(True).alias("own"), slot(1, "lefts").alias("i"), every("rights").alias("j"))
    right = rows.select("line", "sid", F.lit(False).alias("own"), every("lefts").alias("i"), slot(2, "rights").alias("j"))
    placed = left.union(right).join(texts, "sid").select("line", "i", "j", "own", "sid", "text")

    def link(group: pa.Table) -> pa.Table:
        own, sid = group.column("own").to_numpy(), group.column("sid").to_numpy()
        win, bound = shingle_sets(*kernel.utf8(group.column("text")))
        n, text = np.diff(bound), np.repeat(np.arange(len(sid)), np.diff(bound))
        _, win = np.unique(win, return_inverse=True)
        x, y = np.flatnonzero(own), np.flatnonzero(~own)
        place = np.empty(len(sid), np.int64)
        place[x], place[y] = np.arange(len(x)), np.arange(len(y))
        both = np.zeros((len(x), len(y)), np.float32)
        order = np.argsort(win, kind="stable")
        win, text = win[order], text[order]
        for k in range(0, int(win[-1]) + 1 if len(win) else 0, 1 << 14):
            part = slice(*np.searchsorted(win, [k, k + (1 << 14)]))
            one, two = np.zeros((len(x), 1 << 14), np.float32), np.zeros((len(y), 1 << 14), np.float32)
            mine = own[text[part]]
            one[place[text[part][mine]], win[part][mine] - k] = 1
            two[place[text[part][~mine]], win[part][~mine] - k] = 1
            both += one @ two.T
        good = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (both > 0) & (sid[x][:, None] != sid[y][None, :])
        a, b = np.nonzero(good)
        a, b = sid[x[a]], sid[y[b]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return placed.groupBy("line", "i", "j").applyInArrow(link, "a long, b long")


def inside_hub(seen: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): members of a line in different components that could link by what they share inside the hub.

    What x shares with the hub must then suffice for x and y together, so it lies
    between what y shares and ``percent`` of that; classes of sizes by that factor
    are joined with their own and the next.
    """
    room = seen.where(f"100 * both >= {percent} * nb").select("line", "b", "nb", "both", "comp").withColumn("class", F.floor(F.log("both") / math.log(100 / percent)).cast("long"))
    several = room.groupBy("line").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("line")
    room = room.join(several, "line")
    x, y = (room.select("line", "class", *(F.col(c).alias(f"{c}_{side}") for c in ("b", "nb", "both", "comp"))) for side in "xy")
    y = y.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    fits = f"comp_x <> comp_y AND (both_x < both_y OR (both_x = both_y AND b_x < b_y)) AND 100 * both_x >= {percent} * (nb_x + nb_y - both_x)"
    return x.join(y, ["line", "class"]).where(fits).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def classes(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``documents``."""
    scratch = common.Scratch(spark, "minhash", documents)
    signed = scratch.save(sign(documents, key, text), "signed")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("sid"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    sets = scratch.save(sets, "sets")
    every = sets.select("sid", F.posexplode("bands").alias("band", "value")).select(F.lit(0).cast("long").alias("line"), F.xxhash64("band", "value").alias("bucket"), "sid")
    members = scratch.save(together(every), "members-0")
    wanted = members.select("sid").distinct().join(sets.select("sid", "set_a", "set_b"), "sid")
    texts = scratch.save(_texts(documents, wanted, key, text), "texts")
    links, tested, step = None, None, 0
    while True:
        rays = scratch.save(stars(members), f"rays-{step}")
        pairs = rays.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = scratch.save(pairs.distinct() if tested is None else tested.union(pairs).distinct(), f"tested-{step}")
        compared = scratch.save(compare(rays.select("a", "b").distinct(), texts, percent), f"compared-{step}")
        new = compared.where("linked").select("a", "b")
        links = scratch.save(new if links is None else links.union(new), f"linked-{step}")
        comp = components(scratch, links, f"comp-{step}")
        step += 1
        seen = rays.join(comp.select(F.col("sid").alias("b"), "comp"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
        apart = seen.groupBy("line").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("line")
        seen = seen.join(apart, "line").join(compared, ["a", "b"]).select("line", "b", "nb", "both", "comp", "outside")
        seen = scratch.save(seen, f"seen-{step}")
        scratch.drop(*(f"{t}-{step - 1}" for t in ("compared", "rays", "members", "seen", "tried", "near")))
        if seen.isEmpty():
            break
        lines = scratch.save(families(seen), f"lines-{step}")
        most = COPIES * sets.count()
        last = (lines.agg(F.sum("copies")).first()[0] or 0) <= most
        now = lines if last else lines.where(F.col("rights") <= 2)
        links = scratch.save(links.union(across(seen, now, texts, percent)), f"links-{step}")
        scratch.drop(f"linked-{step - 1}")
        if last:
            comp = components(scratch, links, "comp-last")
            break
        seen = seen.join(lines.where(F.col("rights") > 2).select("line"), "line")
        outside = scratch.save(outside_hub(seen, percent), f"outside-{step}")
        few = outside.where(F.col("size") <= SMALL)
        x, y = (few.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in ("sid", "comp"))) for side in "xy")
        close = x.join(y, "bucket").where("sid_x < sid_y AND comp_x <> comp_y").select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b"))
        close = scratch.save(close.union(inside_hub(seen, percent)).distinct().join(tested, ["a", "b"], "left_anti"), f"close-{step}")
        links = scratch.save(links.union(compare(close, texts, percent).where("linked").select("a", "b")), f"near-{step}")
        members = scratch.save(outside.where(F.col("size") > SMALL).select("line", "bucket", "sid", "size"), f"members-{step}")
        tested = scratch.save(tested.union(close), f"tried-{step}")
        scratch.drop(f"outside-{step}", f"close-{step}", f"tested-{step - 1}", f"links-{step}", f"lines-{step}")
        if members.isEmpty():
            comp = components(scratch, links, "comp-last")
            break
        common.free(spark)
    found = sets.select("set_a", "set_b", "sid").join(comp, "sid", "left").select("set_a", "set_b", F.coalesce("comp", "sid").alias("component_id"))
    empty = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(found, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).coalesce(scratch.parts)


def _texts(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(sid, text) of one row for each wanted set."""
    source = documents.select(F.col(key).cast("long").alias("sid"), F.col(text).alias("text"))
    found = source.join(wanted, "sid").select("sid", "text", "set_a", "set_b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share an id only those whose set is the wanted one."""
        for part in parts:
            a = part.column(2).to_numpy()
            for i, j, raw, at in kernel.batches(part):
                win, bound = shingle_sets(raw, at)
                one = np.zeros(len(win) + 1, U64)
                np.cumsum(kernel.mix(win ^ U64(0xA5A5A5A5A5A5A5A5)), out=one[1:])
                same = (one[bound[1:]] - one[bound[:-1]]).view(np.int64) == a[i:j]
                yield part.select(["sid", "text"]).slice(i, j - i).filter(pa.array(same))

    return found.mapInArrow(run, "sid long, text string")


def keep_one(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each class; rows with a null id stay."""
    scratch = common.Scratch(spark, "kept", documents)
    found = scratch.save(classes(spark, documents, key, text, percent), "classes")
    chosen = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    names = [f"c{k}" for k in range(len(documents.columns))]
    inner, own = documents.toDF(*names), names[documents.columns.index(key)]
    once = inner.join(chosen.where("n = 1").select(F.col("doc_id").alias("_id")), F.col(own).cast("long") == F.col("_id"), "left_semi")
    out = once.union(inner.where(F.col(own).isNull()))
    if not chosen.where("n > 1").isEmpty():
        again = inner.join(chosen.where("n > 1").select(F.col("doc_id").alias("_id")), F.col(own).cast("long") == F.col("_id"), "left_semi")
        out = out.union(again.dropDuplicates([own]))
    return out.toDF(*documents.columns).coalesce(scratch.parts)
