"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word stems is learned from labelled documents (terms that are over-represented
in those labelled toxic), beside fixed lists for second persons. Trees are grown by histograms in
numpy on a bounded sample; every text is then scored whole where it lies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import filter_rows

#: The model is fitted on at most so many labelled documents of either class (least id hashes first).
SAMPLE_TOXIC = 1_500
SAMPLE_OTHER = 3_000
TREES, DEPTH, RATE, BINS, MIN_LEAF = 60, 3, 0.2, 32, 8
LEAST_DOCS = 3
#: A term enters the lexicon if the lower bound of its log odds is at least this.
LEAST_ODDS = 1.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Second-person words of the languages at hand, and usual stand-ins for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti tú tus tuyo usted ustedes vous votre vos toi ton ta tes du dich dir dein deine ihr euch euer sie ihnen".split())
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
FEATURES = (
    "word_density", "word_any", "word_odds", "stem_density", "stem_any", "stem_odds", "kinds", "obfuscated_hits",
    "second_person", "second_person_near", "capitals", "shouted", "exclamation", "punctuation", "obfuscation", "repeats", "log_words",
)

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_][^\W_]*")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
#: Of bytes: 0 white space and other signs, 1 small or non-ASCII letters, 2 capitals, 3 digits, 4 signs that stand in for letters.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "@$!*"]] = 4
_PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)], np.float32)
NEAR = 6


def terms(text: str) -> dict[str, int]:
    """A text's distinct words (1 each), and its stems, marked by a closing ``*``, with the number of
    distinct words that have them."""
    words = set(_WORD.findall(text.lower()))
    out = Counter(f"{w[:n]}*" for w in words for n in STEMS if len(w) > n)
    out.update(words)
    return out


def signature(text: str) -> tuple[int, int]:
    """Near copies mostly agree in this (least hashes of their longer words); others rarely do."""
    words = set(_WORD.findall(text.lower()))
    raw = [w.encode() for w in words if len(w) >= 8] or [w.encode() for w in words] or [b""]
    return min(map(zlib.crc32, raw)), min(zlib.adler32(w) * 2654435761 % 2**32 for w in raw)


def count_terms(docs: Iterable[tuple[str, int]]) -> tuple:
    """(words by term in toxic texts, the same in others, toxic texts by term, all words in either)."""
    yes, no, docs_of = Counter(), Counter(), Counter()
    total = [0, 0]
    for text, label in docs:
        found = terms(text)  # of one text at a time: they take many times its size
        (yes if label else no).update(found)
        total[label] += sum(1 for t in found if t[-1] != "*")
        if label:
            docs_of.update(found.keys())
    return yes, no, docs_of, total


class Lexicon(dict):
    """Term -> weight, and the first four letters of all terms."""

    def __init__(self, weights: dict[str, float] = {}):  # noqa: B006  never changed
        super().__init__(weights)
        self.heads = frozenset(t.rstrip("*")[:4] for t in weights)


def learn_lexicon(counts: list[tuple]) -> Lexicon:
    """Term -> lower bound of the log odds of its words in toxic documents, for terms well above what
    luck would make of so many. ``counts``: of the parts to learn from."""
    docs_of = Counter()
    for c in counts:
        docs_of.update(c[2])
    n0, n1 = (sum(c[3][k] for c in counts) for k in (0, 1))
    if not n1 or not n0:
        return Lexicon()
    least = math.log(len(docs_of) + 1) + 2
    out: dict[str, float] = {}
    for t, k in docs_of.items():
        if k < LEAST_DOCS:
            continue
        a, b = (sum(c[i][t] for c in counts) for i in (0, 1))
        low = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) - 1.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        surprise = a * math.log(a / ((a + b) * n1 / (n0 + n1)))
        if low >= LEAST_ODDS and surprise >= least:
            out[t] = round(low, 6)
    return Lexicon(out)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of :data:`FEATURES`; null is like empty, all zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    heads = lexicon.heads
    at, best_word, best_stem, n_word, n_stem, kinds = [], 0.0, 0.0, 0, 0, set()
    for i, w in enumerate(words):
        if w[:4] not in heads:
            continue
        hit = False
        if w in lexicon:
            n_word, best_word, hit = n_word + 1, max(best_word, lexicon[w]), True
        stem = max((lexicon.get(f"{w[:k]}*", 0.0) for k in STEMS if len(w) > k), default=0.0)
        if stem:
            n_stem, best_stem, hit = n_stem + 1, max(best_stem, stem), True
        if hit:
            at.append(i)
            kinds.add(w[:4])
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    second = len(persons)
    near = 0
    if at and persons:
        p, hits = np.array(persons), np.array(at)
        after = np.searchsorted(p, hits)  # both rise, so the nearest person is the one before or the one after
        gap = np.minimum(np.abs(hits - p[np.maximum(after - 1, 0)]), np.abs(p[np.minimum(after, len(p) - 1)] - hits))
        near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = _CLASS[raw]
    count = np.bincount(kind, minlength=5)
    # the costlier patterns only where neighbouring bytes allow for them
    mixed = _MIXED.findall(low) if ((kind[1:] >= 3) & ((kind[:-1] == 1) | (kind[:-1] == 2))).any() else []
    hidden = sum(m.translate(STAND_INS) in lexicon for m in mixed)
    shouted = len(_SHOUT.findall(text)) if ((kind[2:] == 2) & (kind[1:-1] == 2) & (kind[:-2] == 2)).any() else 0
    repeats = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (kind[2:] > 0)).sum())
    size = len(raw)
    return [
        1000 * n_word / n, float(n_word > 0), best_word, 1000 * n_stem / n, float(n_stem > 0), best_stem, float(len(kinds)), float(hidden),
        1000 * second / n, float(near), count[2] / size, 1000 * shouted / n, 1000 * text.count("!") / size, float(_PUNCTUATION[raw].mean()), 1000 * len(mixed) / n, 1000 * repeats / size, math.log1p(len(words)),
    ]


class Trees:
    """Gradient boosting of the logistic loss with histogram trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(rate / (1 - rate))
        self.trees: list[tuple[list, list, list]] = []
        f = np.full(n, self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = [], []
            for level in range(DEPTH):
                split_f, split_c = np.full(1 << level, -1), np.zeros(1 << level, np.int64)
                best = np.full(1 << level, 1e-6)
                for j in range(d):
                    key = node * BINS + code[:, j]
                    g, h, c = (np.bincount(key, w, BINS << level).reshape(-1, BINS).cumsum(axis=1) for w in (grad, hess, None))
                    G, Hs, C = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + 1) + (G - g) ** 2 / (Hs - h + 1) - G**2 / (Hs + 1)
                    gain[(c < MIN_LEAF) | (C - c < MIN_LEAF)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(len(k)), k]
                    better = top > best + 1e-9
                    best[better], split_f[better], split_c[better] = top[better], j, k[better]
                feature.append(split_f)
                cut.append(split_c)
                own = split_f[node]
                right = (own >= 0) & (code[np.arange(n), np.maximum(own, 0)] > split_c[node])
                node = 2 * node + right
            leaf = RATE * np.bincount(node, grad, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + 1)
            f += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        row = np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for split_f, split_c in zip(feature, cut, strict=True):
                own = split_f[node]
                node = 2 * node + ((own >= 0) & (code[row, np.maximum(own, 0)] > split_c[node]))
            f += leaf[node]
        return f


def _pool(blocks: Iterable[list[float]]) -> list[list[float]]:
    """Merge neighbouring [sum of y, weight, sum of scores, rows] until sum / weight rises strictly."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            last = out.pop()
            out[-1] = [x + y for x, y in zip(out[-1], last, strict=True)]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising scores and their rising calibrated values, for interpolation.

    A pinch of the mean (one row's weight a block) keeps pure blocks off 0 and 1; as it moves small blocks
    more than large ones, what it brings out of order is pooled once more."""
    at, of, n = np.unique(score, return_inverse=True, return_counts=True)  # equal scores share a value
    blocks = _pool([v, w, s * w, w] for s, v, w in zip(at.tolist(), np.bincount(of, y).tolist(), n.astype(float).tolist(), strict=True))
    mean = float(np.mean(y))
    blocks = _pool([v + mean, w + 1, s, n] for v, w, s, n in blocks)
    return np.array([b[2] / b[3] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Lexicon, trees and calibration; without labels of both classes every text scores 0."""

    def __init__(self, rows: list[tuple[str, int]]):
        once: dict[tuple, tuple] = {}  # copies of a document would make its chance words look sure
        for t, label in rows:
            once.setdefault((int(label), *signature(t)), (t, int(label)))
        rows = list(once.values())
        y = np.array([label for _, label in rows], float)
        fold = np.arange(len(rows)) % 3
        counts = [count_terms(r for r, own in zip(rows, fold, strict=True) if own == k) for k in range(3)]
        self.lexicon = learn_lexicon(counts)
        self.trees = None
        if not len(y) or y.min() == y.max():
            return
        # features of a document use a lexicon learned without it, else rare words would look sure
        x = np.zeros((len(rows), len(FEATURES)))
        for k in range(3):
            lexicon = learn_lexicon([c for own, c in enumerate(counts) if own != k])
            for i in np.flatnonzero(fold == k):
                x[i] = features(rows[i][0], lexicon)
        raw = np.zeros(len(rows))
        for k in range(3):
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
        self.at, self.value = isotonic(raw, y)
        self.trees = Trees().fit(x, y)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(np.interp(self.trees.score(x), self.at, self.value), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> Model:
    """Fit on at most ``toxic`` and ``other`` labelled rows where ``learnable`` (over the labels' id
    column) holds, taken by least hash. Ids without a document, and null labels, teach nothing; an
    id with several labels counts as toxic if one of them says so."""
    marked = labels.where(learnable).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("y")).where("y is not null and id is not null")
    marked = marked.select("id", "y", F.xxhash64(F.col("id").cast("long")).alias("k"))
    have = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [(r.id, r.y) for v, n in ((1, toxic), (0, other)) for r in common.lowest(marked.where(F.col("y") == v), "k", n, have.get(v, 0))]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"id {dict(marked.dtypes)['id']}, y int"))  # bounded by the two parameters
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null").join(chosen, "id").select("id", "text", "y").collect()
    rows.sort(key=lambda r: (r.id * 0x9E3779B97F4A7C15 % 2**64, r.id, r.text))
    return Model([(r.text, r.y) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row; null ids and repeated rows stay as they are."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in common.byte_slices(big, "text", 4 << 20):
                s = model.scores(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return filter_rows(docs, lambda texts: model.scores(texts) < threshold, text_col)
