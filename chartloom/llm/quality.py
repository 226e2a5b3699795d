"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown here on binned statistics, with gradients and hessians summed into histograms, and are
kept as flat arrays of complete binary trees: node ``k`` has children ``2k + 1`` and ``2k + 2``, so a block
of documents walks all trees with one numpy gather per level.

Learning uses at most ``SAMPLE`` labelled documents, the first by a hash of the id; that bound is the only
one. The sample's statistics, ``SAMPLE`` short rows, come to the driver; the labels, language, source and
id are no inputs of a score. Everything else reads each whole text once, where it lies, with no shuffle.

Edge cases: a null or empty text has all statistics zero and gets the score the trees give it. Labels that
are null, of null ids or of unknown documents are not learnt from; of an id's several labels the largest
counts. With no labels, or one class only, every score is the share of ones (0.5 without labels). Repeated
rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_of, record, slices, texts

#: Most labelled documents to learn from, and the parts of ids that are held out of learning.
SAMPLE, FOLDS = 20_000, 5
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, RIDGE = 80, 4, 0.15, 64, 0.5, 1.0

_CLASSES = {"space": b" \t\r\x0b\x0c", "newline": b"\n", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "stop": b".,;:!?", "symbol": b"#*$%&|<>", "other": b"\"'()[]{}=+-_/\\@^~`"}
_TABLE = np.full(256, len(_CLASSES), dtype=np.uint8)  # the rest: control bytes and all beyond ASCII
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[list(_c)] = _i

FEATURES = (
    *(f"share_{c}" for c in _CLASSES), "share_beyond_ascii", "log_bytes", "log_words", "mean_word", "std_word", "long_words", "words_a_line", "distinct_words", "distinct_pairs",
    "top_word", "distinct_lines", "repeated_bytes", "stopped_lines", "symbol_words", "shouted_words", "one_byte_words",
)
_SYMBOLS = frozenset(_CLASSES["symbol"])


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; zeros for a text without a word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)
    shares = np.bincount(_TABLE[np.frombuffer(text, dtype=np.uint8)], minlength=len(_CLASSES) + 1) / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = set(lines)
    shouted = sum(k for w, k in times.items() if len(w) > 1 and w.isupper())
    marked = sum(k for w, k in times.items() if w[0] in _SYMBOLS or w[-1] in _SYMBOLS)
    return [
        *shares.tolist(), np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), (lengths > 14).mean(), n / len(lines), len(times) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        max(times.values()) / n, len(kinds) / len(lines), 1 - sum(map(len, kinds)) / sum(map(len, lines)), sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines), marked / n, shouted / n, (lengths == 1).mean(),
    ]


@dataclass(frozen=True)
class Trees:
    """All trees, flattened: row t of each array is tree t, level by level."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # goes right if the feature is greater
    value: np.ndarray  # (trees, 2**depth), at the leaves
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        trees = np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), dtype=np.int64)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return _logistic(self.start + self.value[trees, node - self.feature.shape[1]].sum(0))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Fit by logistic loss. Equal rows in any order give equal trees up to rounding of sums."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not len(y) or share in (0.0, 1.0):
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), 0.0 if not len(y) else 500.0 * (2 * share - 1), depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # bin b: cut b-1 < value <= cut b
    wide = bins * np.arange(x.shape[1])
    flat = (binned + wide).ravel()
    raw = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = _logistic(raw)
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            spot = np.repeat((at - first) * (bins * x.shape[1]), x.shape[1]) + flat
            hist = [np.bincount(spot, np.repeat(w, x.shape[1]), width * bins * x.shape[1]).reshape(width, x.shape[1], bins) for w in (g, h)]
            left = [a.cumsum(2) for a in hist]
            whole = [a[:, :, -1:] for a in left]
            gain = sum((part[0] ** 2) / (part[1] + RIDGE) for part in (left, [w - a for w, a in zip(whole, left, strict=True)])) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[1] < LEAST_HESSIAN) | (whole[1] - left[1] < LEAST_HESSIAN)] = -1
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], cut[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), start, depth)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted to at most ``sample`` labelled documents that are not held out."""
    key = labels[id_col].cast("long")
    known = labels.where(key.isNotNull() & labels[label_col].isNotNull() & (held_out(key) == F.lit(False))).groupBy(key.alias("id")).agg(F.max(labels[label_col].cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield record(("id", "y", "x"), b.column(0), b.column(2), rows)

    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "text", "y").mapInArrow(work, "id long, y int, x array<double>")
    got = sorted(map(tuple, rows.dropDuplicates(["id"]).collect()), key=lambda r: r[0])  # at most ``sample`` rows
    return grow(np.array([r[2] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], dtype=np.float64))


def held_out(key):
    """Whether crc32 of the id, as text, is divisible by ``FOLDS``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def scores(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                x = np.array([statistics(t.as_py()) for t in b.column(1)])
                yield record(("id", "score"), b.column(0), pa.array(trees.score(x)))

    return texts(docs, id_col, text_col).mapInArrow(work, "id long, score double").withColumn("id", id_of())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    trees = learn(docs, labels, id_col, text_col)

    @F.pandas_udf(T.DoubleType())
    def score(text):
        import pandas as pd

        out = [trees.score(np.array([statistics(t) for t in text.iloc[i : i + 1024]])) for i in range(0, len(text), 1024)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.where(score(F.coalesce(docs[text_col].cast("binary"), F.lit(b""))) >= threshold)
