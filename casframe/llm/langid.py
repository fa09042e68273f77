"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability is the sum, over all ways to cut it into pieces, of the
product of its pieces' probabilities; a forward pass over the word's bytes
computes that sum exactly.  A text's score is the sum over its words, and the
posterior over languages starts from equal priors.

Pieces are all those of the vocabulary file that are lower-case letters, after at
most one space, of any length, and all single bytes, so every word has a
segmentation.  Probabilities come from expectation-maximisation over the word counts
of a sample: all words of at most about ``TRAIN_ROWS`` texts for each language,
chosen by a hash of the key; each language is smoothed with the mixture of all.

Words are maximal runs of letters, lower-cased.  A null text or one without a
letter is ``und`` with score 0; so is every text if nothing can be learned.  A
tie goes to the alphabetically first language.  Null and repeated keys and repeated
rows keep their rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm import common, kernel

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TRAIN_ROWS = 1200
ROUNDS = 4
SMOOTH = 200.0
UNKNOWN = "und"
_FILTER_BITS = 21


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[bytes]:
    """The pieces that can occur in `` word``, and every single byte."""
    out = {bytes([b]) for b in range(256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            try:
                word = piece.decode().removeprefix(" ")
            except UnicodeDecodeError:
                continue
            if word == "" or (word.isalpha() and word == word.lower()):
                out.add(piece)
    return sorted(out)


class Lattice:
    """Finds all pieces in a list of words."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.n, self.lengths = len(pieces), sorted(set(map(len, pieces)))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        h = kernel.mix(kernel.span_hash(kernel.prefix_hash(raw), end - np.array([len(p) for p in pieces]), end))
        order = np.argsort(h)
        self.keys, self.ids = h[order], order
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[h & kernel.U64((1 << _FILTER_BITS) - 1)] = True

    def edges(self, words: list[str]) -> Edges:
        """Every place of every piece in the words, each after a space."""
        spelled = [b" " + w.encode() for w in words]
        size = np.array([len(w) for w in spelled], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(b"".join(spelled), np.uint8)
        p = kernel.prefix_hash(raw)
        room = np.repeat(at[1:], size) - np.arange(len(raw))
        starts, lengths, pieces = [], [], []
        for k in self.lengths:
            s = np.flatnonzero(room >= k)
            if not len(s):
                break
            h = kernel.mix(kernel.span_hash(p, s, s + k))
            hit = self.filter[h & kernel.U64((1 << _FILTER_BITS) - 1)]
            s, h = s[hit], h[hit]
            spot = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
            good = self.keys[spot] == h
            starts.append(s[good])
            lengths.append(np.full(int(good.sum()), k))
            pieces.append(self.ids[spot[good]])
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        word = np.repeat(np.arange(len(words)), size)[start]
        return Edges(size, word, start - at[word], length, piece)


class Edges:
    """The segmentation lattices of a block of words: (word, start, length, piece) of every piece found.

    Sums run in logarithms, so words of any length keep their precision.
    """

    def __init__(self, size: np.ndarray, word: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> None:
        self.size, self.word, self.start, self.end, self.piece = size, word, start, start + length, piece

    def _sums(self, order: np.ndarray, to: np.ndarray, come: np.ndarray, logp: np.ndarray, out: np.ndarray) -> None:
        """Adds up paths in ``order``, sorted by (to, word): out[to, word] from out[come, word]."""
        to, come, word, piece = (x[order] for x in (to, come, self.word, self.piece))
        head = np.ones(len(to), bool)
        head[1:] = (to[1:] != to[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(head)
        levels = np.flatnonzero(np.diff(to[first], prepend=-1, append=-1))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            lo, hi = first[a], first[b] if b < len(first) else len(to)
            value = out[come[lo:hi], word[lo:hi]] + logp[piece[lo:hi]]
            group = first[a:b] - lo
            top = np.maximum.reduceat(value, group, axis=0)
            n = np.diff(np.append(group, hi - lo))
            out[to[lo], word[first[a:b]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n, axis=0)), group, axis=0))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log forward sums by (position, word, language)."""
        out = np.full((int(self.size.max()) + 1, len(self.size), logp.shape[1]), -np.inf)
        out[0] = 0.0
        self._sums(np.lexsort((self.word, self.end)), self.end, self.start, logp, out)
        return out

    def logs(self, logp: np.ndarray) -> np.ndarray:
        """Log-probability of each word by language."""
        return self.forward(logp)[self.size, np.arange(len(self.size))]

    def expected(self, logp: np.ndarray, counts: np.ndarray, pieces: int) -> np.ndarray:
        """Expected piece counts by language, given each word's count by language."""
        alpha = self.forward(logp)
        left = self.size[self.word]
        beta = np.full_like(alpha, -np.inf)  # by bytes that remain
        beta[0] = 0.0
        self._sums(np.lexsort((self.word, left - self.start)), left - self.start, left - self.end, logp, beta)
        total = alpha[left, self.word]
        share = np.exp(alpha[self.start, self.word] + logp[self.piece] + beta[left - self.end, self.word] - total) * counts[self.word]
        return np.stack([np.bincount(self.piece, share[:, k], pieces) for k in range(logp.shape[1])], 1)


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    prob: np.ndarray  # (pieces, languages)


def blocks(words: list[str]) -> Iterator[list[int]]:
    """Words by number in blocks of similar length, which bounds a block's lattice."""
    order = sorted(range(len(words)), key=lambda k: (len(words[k]), words[k]))
    i = 0
    while i < len(order):
        longest = max(16, 2 * len(words[order[i]]))
        most = max(1, (1 << 17) // longest)
        j = i
        while j < len(order) and j - i < most and len(words[order[j]]) <= longest:
            j += 1
        yield order[i:j]
        i = j


def learn(counts: dict[str, dict[str, int]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation from word counts by language."""
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    if not langs or not words:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    lattice = Lattice(pieces)
    prob = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    weights = np.array([[counts[x].get(w, 0) for x in langs] for w in words], float)
    parts = [(lattice.edges([words[k] for k in part]), weights[part]) for part in blocks(words)]
    for _ in range(rounds):
        logp = np.log(np.maximum(prob, 1e-300))
        total = sum(edges.expected(logp, w, len(pieces)) for edges, w in parts)
        pooled = total.sum(1) + 0.01
        pooled /= pooled.sum()
        prob = (total + SMOOTH * pooled[:, None]) / (total.sum(0) + SMOOTH)
    single = np.array([len(p) == 1 for p in pieces])
    keep = np.flatnonzero((prob.max(1) > 1e-9) | single)
    return Model(langs, [pieces[i] for i in keep], prob[keep])


def fit(documents: DataFrame, path: str, rows: int = TRAIN_ROWS, key: str = "doc_id") -> Model:
    """The model from ``documents`` (key, text, lang), every row of which may be learned from."""
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL").select(key, "text", "lang")
    totals = dict(map(tuple, known.groupBy("lang").count().collect()))
    if not totals:
        return Model([], [], np.zeros((0, 0)))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, rows / n))) for x, n in sorted(totals.items())))
    sample = known.where(F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 31)) < share * (1 << 31))
    spelled = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in spelled.toArrow().columns), strict=True):
        counts.setdefault(lang, {})[word] = n
    return learn(counts, read_pieces(path))


def score_words(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word by language."""
    out, logp = np.zeros((len(words), prob.shape[1])), np.log(np.maximum(prob, 1e-300))
    for part in blocks(words):
        out[part] = lattice.edges([words[k] for k in part]).logs(logp)
    return out


def apply(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of each row."""
    source = documents.select(F.col(key).alias(key), F.col(text).alias("text"))
    kind = source.schema[key].dataType.simpleString()
    if not model.langs:
        return source.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.pieces)
        seen = kernel.Interned(lambda words: score_words(lattice, model.prob, words), len(model.langs))
        names = np.array([*model.langs, UNKNOWN], object)
        for part in parts:
            for i, j, raw, at in kernel.batches(part):
                low, start, end, first, h = kernel.letter_words(raw, at)
                n = np.diff(first)
                total = np.zeros((len(h) + 1, len(model.langs)))
                if len(h):
                    rows = seen.look(h, low, start, end)
                    np.cumsum(seen.values[rows], axis=0, dtype=float, out=total[1:])
                logs = total[first[1:]] - total[first[:-1]]
                best = logs.argmax(1)
                odds = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700))
                score = np.where(n > 0, 1.0 / odds.sum(1), 0.0)
                best = np.where(n > 0, best, len(model.langs))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return source.mapInArrow(run, f"{key} {kind}, lang_pred string, score double")
