"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are maximal runs of letters, lower-cased.  A token's toxic rate is
estimated with Dirichlet priors chained along its prefixes: the prior of the
token is centred on the rate of its longest known prefix, that prefix's on the
next shorter one, and the shortest on the base rate.  So stems that toxic words
share speak for words never seen.  A token's score is its log-odds against the
base rate less ``DRIFT``, which makes the expected score negative.

One linear scan finds all maximal-scoring segments of a text (every passage that
no neighbour improves).  With lambda the root of ``sum p exp(lambda s) = 1`` over
clean text, a segment of score S among n tokens has
``P(max >= S) = 1 - exp(-n exp(-lambda S))``; its significance is the logarithm
of the mean number of such segments, ``lambda S - log n``.  Two fitted weights
turn the best significance and the sum over significant segments into the
probability of label 1.

Labels are learned from at most about ``TRAIN_ROWS`` labelled rows, whole whatever
their size, chosen by a hash of the key; half of them give rates while the other
half is scored to fit the calibration, and the final rates use all.  Null and empty
texts have no token, no segment and the probability of a text without toxic
passages.  Without labels of both kinds every score is 0.  Null and repeated keys
keep their rows; a key with several labels is toxic if one says so, and null labels
and labels of null keys teach nothing.  A score equal to the threshold is toxic.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm import common, kernel

TRAIN_ROWS = 4000
PREFIXES = (3, 4, 5, 6, 8)
PRIOR = 4.0
DRIFT = 0.7
LEAST_ROWS = 2
THRESHOLD = 0.7
_LIMIT = 12.0


@dataclass
class Model:
    rates: dict[str, float] = field(default_factory=dict)  # unit to score; prefixes end in *
    decay: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: bool = False


def units(word: str) -> list[str]:
    """A token's prefixes, marked as such, then the token itself."""
    return [word[:k] + "*" for k in PREFIXES if k < len(word)] + [word]


def word_score(table: dict[str, float], word: str) -> float:
    got = table.get(word)
    if got is None:
        for k in reversed(PREFIXES):
            if k < len(word) and (got := table.get(word[:k] + "*")) is not None:
                return got
        return -DRIFT
    return got


class Units:
    """The units of a list of words as a forest: each unit's parent is the next shorter prefix.

    ``levels`` holds the units' numbers from the shortest on, ``leaf`` each word's own
    unit, and word k has the units ``own[first[k] : first[k + 1]]``.
    """

    def __init__(self, words: list[str]) -> None:
        number: dict[str, int] = {}
        parent, depth, own, first, leaf = array("i"), array("i"), array("i"), array("i", [0]), array("i")
        for word in words:
            above = -1
            for d, unit in enumerate(units(word)):
                at = number.setdefault(unit, len(number))
                if at == len(parent):
                    parent.append(above)
                    depth.append(d)
                own.append(at)
                above = at
            first.append(len(own))
            leaf.append(above)
        self.names = list(number)
        self.parent, self.leaf, self.own, self.first = (np.array(x, np.int64) for x in (parent, leaf, own, first))
        depth = np.array(depth, np.int64)
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1 if len(depth) else 0)]

    def documents(self, words: np.ndarray) -> np.ndarray:
        """The distinct units of a text's words."""
        words = np.unique(words)
        n = self.first[words + 1] - self.first[words]
        return np.unique(self.own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[words], n)])

    def scores(self, bad: np.ndarray, good: np.ndarray, toxic: float, clean: float) -> np.ndarray:
        """Each unit's score from its numbers of toxic and clean documents.

        A unit of fewer than LEAST_ROWS documents has its parent's rate.
        """
        base = toxic / (toxic + clean)
        rate = np.full(len(self.names) + 1, base)  # the last stands for the parent of roots
        for level in self.levels:
            above, n = rate[self.parent[level]], bad[level] + good[level]
            rate[level] = np.where(n >= LEAST_ROWS, (bad[level] + PRIOR * above) / (n + PRIOR), above)
        rate = rate[:-1]
        return np.clip(np.log(rate / (1 - rate)) - np.log(base / (1 - base)), -_LIMIT, _LIMIT) - DRIFT

    def table(self, scores: np.ndarray, within: float = 0.1) -> dict[str, float]:
        """Scores by unit without those that the next shorter kept unit gives to ``within``."""
        kept, chosen = np.append(scores, -DRIFT), np.zeros(len(scores), bool)
        for level in self.levels:
            above = kept[self.parent[level]]
            chosen[level] = np.abs(scores[level] - above) > within
            kept[level] = np.where(chosen[level], scores[level], above)
        return {self.names[k]: float(scores[k]) for k in np.flatnonzero(chosen).tolist()}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Only positive items open or close a segment, so the scan steps from one to
    the next over cumulative sums.  Of the open candidates each remembers the sum
    before it (left) and after it (right); a new item merges with the nearest
    candidate whose left is smaller, if that one's right is smaller than the new
    right, and then looks on from there.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    nearest: list[int] = []
    for i in at.tolist():
        s, e, lo, hi = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(start) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = nearest[j]
            if j < 0 or right[j] >= hi:
                break
            s, lo = start[j], left[j]
            del start[j:], end[j:], left[j:], right[j:]
            nxt = nearest[j]
            del nearest[j:]
            j = nxt
        nearest.append(j)
        start.append(s)
        end.append(e)
        left.append(lo)
        right.append(hi)
    return [(s, e, hi - lo) for s, e, lo, hi in zip(start, end, left, right, strict=True)]


def decay_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where there is none below 5."""
    if not len(scores) or scores.max() <= 0 or (scores * weights).sum() >= 0:
        return 1.0
    p, lo, hi = weights / weights.sum(), 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 50))).sum() < 1 else (lo, mid)
    return lo


def evidence(scores: np.ndarray, decay: float) -> tuple[float, float]:
    """Best significance of a text's segments and the sum of the positive ones, damped."""
    found = segments(scores)
    if not found:
        return 0.0, 0.0
    values = decay * np.array([f[2] for f in found]) - np.log(len(scores))
    return float(np.clip(values.max() + 10, 0, 40)) / 10, float(np.log1p(np.maximum(values, 0).sum()))


def chance(model: Model, x: np.ndarray) -> np.ndarray:
    a, b, c = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; slopes are kept positive."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge @ w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(3), grad)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    if w[1] < 0 or w[2] < 0:  # collinear: one evidence is enough
        keep = 0 if w[1] >= w[2] else 1
        reduced = calibrate_one(x[:, keep], y)
        return (reduced[0], reduced[1], 0.0) if keep == 0 else (reduced[0], 0.0, reduced[1])
    return float(w[0]), float(w[1]), float(w[2])


def calibrate_one(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - np.array([1e-6, 1e-2]) * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-2]), grad)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(max(w[1], 0.0))


def learn(words: list[str], word: np.ndarray, bound: np.ndarray, labels: list[int]) -> Model:
    """The model from labelled texts: text k holds ``word[bound[k] : bound[k + 1]]``, numbers in ``words``."""
    y = np.array(labels, float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model()
    fold = np.random.default_rng(len(y)).permutation(len(y)) % 2  # order of ids must not split the labels
    forest = Units(words)
    counts = np.zeros((2, 2, len(forest.names)), np.int32)  # documents by fold, label and unit
    often = np.zeros(len(words))  # tokens of all clean texts
    for i in range(len(y)):
        own = word[bound[i] : bound[i + 1]]
        counts[fold[i], int(y[i]), forest.documents(own)] += 1
        if not y[i]:
            np.add.at(often, own, 1)

    def fitted(folds: list[int]) -> np.ndarray:
        good, bad = counts[folds].sum(0)
        some = np.isin(fold, folds)
        return forest.scores(bad, good, y[some].sum() + 0.5, (1 - y[some]).sum() + 0.5)

    x = np.zeros((len(y), 2))
    for k in (0, 1):
        scores = fitted([1 - k])[forest.leaf]
        rate = decay_of(scores, often)
        for i in np.flatnonzero(fold == k):
            x[i] = evidence(scores[word[bound[i] : bound[i + 1]]], rate)
    scores = fitted([0, 1])
    return Model(forest.table(scores), decay_of(scores[forest.leaf], often), calibrate(x, y), True)


def numbered(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a text column, each text's tokens by number end to end, and the texts' bounds."""
    names: list[str] = []
    number: dict[int, int] = {}
    parts, sizes = [], [0]
    raw, at = kernel.utf8(column)
    for i, j in kernel.blocks(at):
        low, start, end, first, h = kernel.letter_words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        known = []
        for key, k in zip(unique.tolist(), where.tolist(), strict=True):
            if key not in number:
                number[key] = len(names)
                names.append(low[start[k] : end[k]].tobytes().decode("utf-32-le"))
            known.append(number[key])
        parts.append(np.array(known, np.int64)[back].astype(np.int32))
        sizes.extend(np.diff(first).tolist())
    return names, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(sizes)


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id") -> Model:
    """The model from labelled documents; ``labels`` holds the key and toxic.

    Learns from at most about ``rows`` labelled rows.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("label"))
    picked = common.spread_sample(known, key, rows, known.count(), "toxic").limit(2 * rows)
    texts = documents.where(F.octet_length("text") >= 1).select(key, "text")
    got = texts.join(F.broadcast(picked), key).select(key, "text", "label").toArrow().sort_by([(key, "ascending"), ("text", "ascending")])
    return learn(*numbered(got.column("text")), [int(y == 1) for y in got.column("label").to_pylist()])


def apply(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, passages: bool = False) -> DataFrame:
    """Key, score, predicted, n_segments and, on request, the passages of each row.

    ``passages`` are structs (start token, end token, score) of all maximal segments
    that are significant, which is lambda S > log n.
    """
    source = documents.select(F.col(key).alias(key), F.col(text).alias("text"))
    schema = f"{key} {source.schema[key].dataType.simpleString()}, score double, predicted int, n_segments long" + ", passages array<struct<start:long,end:long,score:double>>" * passages

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.rates
        seen = kernel.Interned(lambda words: np.array([[word_score(table, w)] for w in words]), 1)
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                low, start, end, first, h = kernel.letter_words(raw, at)
                rows = seen.look(h, low, start, end) if len(h) else np.zeros(0, np.int64)
                scores = seen.values[rows, 0].astype(float)
                x, n, spans = np.zeros((j - i, 2)), np.zeros(j - i, np.int64), []
                bound = first.tolist()
                for k in range(j - i):
                    own = scores[bound[k] : bound[k + 1]]
                    if len(own):
                        x[k] = evidence(own, model.decay)
                        good = [f for f in segments(own) if model.decay * f[2] > np.log(len(own))]
                        n[k] = len(good)
                    if passages:
                        spans.append([{"start": s, "end": e, "score": v} for s, e, v in good] if len(own) else [])
                score = chance(model, x) if model.known else np.zeros(j - i)
                columns = [part.column(0).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(spans, struct)] if passages else [])], [key, "score", "predicted", "n_segments", *(["passages"] if passages else [])])

    return source.mapInArrow(run, schema)


def drop_toxic(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows whose score reaches the threshold; one pass, no join."""
    spot = documents.columns.index(text)
    names = [f"c{k}" for k in range(len(documents.columns))]
    inner = documents.toDF(*names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.rates
        seen = kernel.Interned(lambda words: np.array([[word_score(table, w)] for w in words]), 1)
        for part in parts:
            for i, j, raw, at in kernel.batches(part, names[spot]):
                x = block_evidence(raw, at, seen, model.decay)
                clean = chance(model, x) < threshold if model.known else np.ones(j - i, bool)
                yield part.slice(i, j - i).filter(pa.array(clean))

    return inner.mapInArrow(run, inner.schema).toDF(*documents.columns)


def block_evidence(raw: np.ndarray, at: np.ndarray, seen: kernel.Interned, decay: float) -> np.ndarray:
    """Evidence of each text of a block."""
    low, start, end, first, h = kernel.letter_words(raw, at)
    rows = seen.look(h, low, start, end) if len(h) else np.zeros(0, np.int64)
    scores, bound = seen.values[rows, 0].astype(float), first.tolist()
    return np.array([evidence(scores[a:b], decay) if b > a else (0.0, 0.0) for a, b in zip(bound, bound[1:], strict=False)]).reshape(-1, 2)
