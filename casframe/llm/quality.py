"""Quality rules: base counts, and a conditional random field over a text's lines.

The base counts are exact.  A linear-chain CRF labels the lines of a text as
content or boilerplate (Viterbi decoding); a document is kept if content lines
hold at least ``content_share`` of its word characters.

The field learns from at most about ``TRAIN_ROWS`` labelled documents, whole
whatever their size, chosen by a hash of doc_id.  Their lines are cut into runs of
one to ``2 * RUN - 1`` lines, a run's label is its document's quality, and shuffled
runs of all documents are laid end to end to training sequences.  So the sequences
hold content next to boilerplate, with every switch labelled where it happens, and
the field learns both what lines look like and how labels persist; each line is
learned from once.  With no labels the field keeps everything the base rules keep.

Null or empty texts have no words and fail the base rules.  Repeated rows give
repeated results; null and repeated keys keep their rows.  A key with several labels
is good if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm import common, crf, kernel

TRAIN_ROWS = 1500
RUN = 6
SEQUENCE = 48
CONTENT_SHARE = 0.5
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_lines long, content_share double, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"'")] = True
_KIND = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 or b >= 0xC0 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "mark": np.array([b in b"#*$%&<>@^~=+_\\/{}[]" for b in range(256)]),
    "pipe": np.array([b == 0x7C for b in range(256)]),
    "bang": np.array([b in b"!?" for b in range(256)]),
}


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of a block, and each text's first line."""
    cuts = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([at[:-1], cuts + 1]))
    n = np.diff(np.searchsorted(cuts, at)) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    # An empty text's line and a text that starts after a final \n share a start; the order by position holds.
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = at[1:]
    return start, end, first


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Features by line, and what the base counts need."""
    start, end, first = _lines(raw, at)
    w_start, w_end, w_first = kernel.words(raw, at)
    p = kernel.prefix_hash(raw)
    h = kernel.mix(kernel.span_hash(p, w_start, w_end))
    size = np.maximum(end - start, 0)
    share = {}
    for name, kind in _KIND.items():
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kind[raw], out=total[1:])
        share[name] = (total[end] - total[start]).astype(float)
    letters = np.maximum(share["upper"] + share["lower"], 1)
    some = np.maximum(size, 1)
    lo, hi = np.searchsorted(w_start, start), np.searchsorted(w_start, end)
    n = hi - lo
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    repeat = np.where(n > 1, same[hi] - same[np.minimum(lo + 1, len(h))], 0) / np.maximum(n - 1, 1)
    line_of = np.repeat(np.arange(len(start)), n)
    order = np.lexsort((h, line_of))
    fresh = np.ones(len(h), bool)
    if len(h) > 1:
        fresh[1:] = (line_of[order][1:] != line_of[order][:-1]) | (h[order][1:] != h[order][:-1])
    distinct = np.bincount(line_of[order][fresh], minlength=len(start)) / np.maximum(n, 1)
    word_bytes = np.zeros(len(h) + 1, np.int64)
    np.cumsum(w_end - w_start, out=word_bytes[1:])
    mean = (word_bytes[hi] - word_bytes[lo]) / np.maximum(n, 1)
    last = np.where(n > 0, w_end[np.maximum(hi - 1, 0)] - 1, 0) if len(h) else np.zeros(len(start), int)
    ends = np.where(n > 0, _END[raw[last]] if len(raw) else False, False)
    up, marks, pipes = share["upper"] / letters, share["mark"] / some, share["pipe"] / some
    bangs, digits = share["bang"] / some, share["digit"] / some
    position = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
    features = np.stack(
        [
            np.ones(len(start)), np.log1p(size) / 6, np.log1p(n) / 5, up, up > 0.5, digits, digits > 0.3, marks * 5, marks > 0.04, pipes * 5, pipes > 0.03,
            bangs * 5, bangs > 0.06, ends, np.minimum(mean, 30) / 10, distinct, (n >= 10) & (distinct < 0.4), repeat, repeat > 0.3, n == 0, n < 4, position == 0,
        ],
        1,
    ).astype(float)
    return features, {"start": start, "end": end, "first": first, "n": n, "hash": h, "w_first": w_first, "w_start": w_start, "w_end": w_end, "p": p}


def _repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text in 5-word windows that the text holds twice or more."""
    win, bound = kernel.windows(h, first, 5)
    out = np.zeros(len(first) - 1, np.int64)
    if not len(win):
        return out
    text = np.repeat(np.arange(len(out)), np.diff(bound))
    order = np.lexsort((win, text))
    a, b = win[order], text[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    often = np.zeros(len(win), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often)
    mark = np.zeros(len(h) + 1, np.int64)
    word = at - bound[text[at]] + first[text[at]]
    np.add.at(mark, word, 1)
    np.add.at(mark, word + 5, -1)
    return kernel.per_text((np.cumsum(mark)[:-1] > 0).astype(np.int64), first)


def score_block(raw: np.ndarray, at: np.ndarray, model: crf.Crf, content_share: float) -> dict[str, np.ndarray]:
    features, x = line_features(raw, at)
    margins = (model.margins(features) if len(model.emit) == features.shape[1] else np.zeros(len(features))).tolist()
    first, n, texts = x["first"], x["n"], len(at) - 1
    in_word = ~kernel._SPACE[raw]
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(in_word & ((raw & 0xC0) != 0x80), out=chars[1:])
    line_chars = chars[x["end"]] - chars[x["start"]]
    move = model.move.tolist()
    labels = np.zeros(len(n), bool)
    bound = first.tolist()
    for k in range(texts):
        labels[bound[k] : bound[k + 1]] = crf.viterbi(margins[bound[k] : bound[k + 1]], move)
    total = kernel.per_text(line_chars, first)
    content = kernel.per_text(line_chars * labels, first)
    share = np.where(total > 0, content / np.maximum(total, 1), 0.0)
    # An earlier equal line: hashes of whole lines, in order of position.
    used = np.flatnonzero(n > 0)
    key = kernel.mix(kernel.span_hash(x["p"], x["start"][used], x["end"][used]))
    text = np.searchsorted(first, used, side="right") - 1
    order = np.lexsort((key, text))
    again = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    dup = np.bincount(text[order][1:][again], minlength=texts)
    words = np.diff(x["w_first"])
    repeat = _repeat_words(x["hash"], x["w_first"])
    failed = (words < 10) | (100 * repeat > 20 * words)
    return {
        "n_words": words, "word_chars": total, "n_symbols": kernel.per_text(_SYMBOL[raw], at), "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_lines": np.diff(first), "content_lines": kernel.per_text(labels & (n > 0), first), "content_share": share, "base_failed": failed, "kept": ~failed & (share >= content_share),
    }


def spliced(features: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences of about SEQUENCE lines, of shuffled runs of all texts' lines."""
    r = np.random.default_rng(seed)
    runs = []
    for k in range(len(first) - 1):
        at, end = int(first[k]), int(first[k + 1])
        while at < end:
            to = min(end, at + int(r.integers(1, 2 * RUN)))
            runs.append((at, to, k))
            at = to
    out, lines, marks = [], [], []
    for spot, i in enumerate(r.permutation(len(runs)).tolist(), 1):
        at, to, k = runs[i]
        lines.append(np.arange(at, to))
        marks.append(np.full(to - at, int(labels[k])))
        if sum(map(len, lines)) >= SEQUENCE or spot == len(runs):
            out.append((features[np.concatenate(lines)], np.concatenate(marks)))
            lines, marks = [], []
    return out


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id") -> crf.Crf:
    """The line field, from at most about ``rows`` labelled documents; only their lines' features reach the driver."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.max("quality").alias("label"))
    picked = common.spread_sample(known, key, rows, known.count()).limit(2 * rows)
    texts = documents.where(F.octet_length("text") >= 1).select(key, "text")
    chosen = texts.join(F.broadcast(picked), key).select(F.xxhash64(F.col(key), "text").alias("place"), "text", (F.col("label") == 1).cast("int").alias("label"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                features, x = line_features(raw, at)
                bodies = [features[a:b].astype("<f4").tobytes() for a, b in zip(x["first"][:-1].tolist(), x["first"][1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), part.column(2).slice(i, j - i), pa.array(bodies, pa.binary())], ["place", "label", "lines"])

    got = chosen.mapInArrow(run, "place long, label int, lines binary").toArrow().sort_by("place")
    if not got.num_rows:
        return crf.train([])
    width = len(line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0][0])
    flat = [np.frombuffer(x, "<f4").reshape(-1, width) for x in got.column("lines").to_pylist()]
    return crf.train(spliced(np.concatenate(flat).astype(float), np.cumsum([0, *map(len, flat)]), got.column("label").to_numpy()))


def apply(documents: DataFrame, model: crf.Crf, key: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row for each row of ``documents``: its key, the base counts and the verdict."""
    source = documents.select(F.col(key).alias(key), F.col(text).alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                got = score_block(raw, at, model, content_share)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), *(pa.array(got[c].astype(float) if c == "content_share" else got[c] if got[c].dtype == bool else got[c].astype(np.int64)) for c in names)], [key, *names])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {SCHEMA}")
