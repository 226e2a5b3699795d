"""Quality rules on repetition: what share of a text's characters lies in n-grams and lines said before.

Words become numbers, and a polynomial hash rolls over them for each n-gram length: the hash of n words is
that of n - 1 times a constant plus the next word, for the whole text at once in numpy. Windows equal to an
earlier one cover their words; the covered characters over all words' characters are held against one limit
a length, and lines equal to an earlier one against limits of their number and characters. Base figures are
exact: three-word windows are compared by number, not by hash.

Each text is judged alone where it lies, so nothing is shuffled.

Edge cases: a null or empty text, or one without a word, has all figures 0; it fails the base rule and is
not kept. Null ids stay null, repeated rows are judged alike, an empty table gives an empty result. Lines
without a word are not counted. Texts of any length are judged whole, in memory that grows with their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_of, record, slices, texts

#: The most that a kept text may have in repeated n-grams, by words in them: a share that is usual for long texts, and
#: ``ONE_LINE`` words more, since short clean texts that say one line twice reach a quarter of their characters, up to
#: a share that no text may exceed. Then the most in repeated lines: share of lines, share of characters.
USUAL = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
NGRAMS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
ONE_LINE = 20
LINES, LINE_CHARS = 0.50, 0.30
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def said_before(keys: np.ndarray) -> np.ndarray:
    """Whether each key equals one before it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` that ``starts`` marks."""
    edge = np.zeros(total + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def windows3(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each three-word window, equal for equal windows only."""
    if distinct < 1 << 21:
        return (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    _, pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
    return pairs * distinct + ids[2:]


def measure(text: bytes) -> dict:
    """All figures of one text."""
    words = text.split()  # on bytes: the six white-space bytes of ASCII
    decoded = text.decode("utf-8", "replace")
    n = len(words)
    out = {"n_words": n, "word_chars": len(decoded) - sum(map(decoded.count, " \t\n\x0b\x0c\r")), "n_symbols": sum(map(decoded.count, SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0, "dup_line_chars": 0}
    out |= {f"dup_{k}": 0 for k in NGRAMS} | {"n_lines": 0}
    if not n:
        return out
    lines: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in lines:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += lines[line]
            else:
                lines[line] = sum(len(w.decode("utf-8", "replace")) for w in line.split())
            out["n_lines"] += 1
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if n >= 3:
        keys = windows3(ids, len(seen))
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        out["n_repeat_words"] = int(covered(times[back] > 1, 3, n).sum())
    sizes = np.array([len(w.decode("utf-8", "replace")) for w in seen], dtype=np.int64)[ids]
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h, k = x, 1
    for length in NGRAMS:
        while k < length and len(h) > 1:
            h = h[:-1] * _BASE + x[k:]
            k += 1
        if k < length:
            break
        again = said_before(h)
        if not again.any():
            break  # then no longer window comes again either
        out[f"dup_{length}"] = int(sizes[covered(again, length, n)].sum())
    return out


def limit(k: int, n_words: int) -> float:
    """The share of characters that repeated windows of ``k`` words may hold in a text of ``n_words``."""
    return min(NGRAMS[k], USUAL[k] + ONE_LINE / max(n_words, 1))


def verdict(m: dict) -> tuple[bool, bool]:
    """``(base_failed, kept)``."""
    base = m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]
    said = m["n_dup_lines"] > LINES * m["n_lines"] or m["dup_line_chars"] > LINE_CHARS * m["word_chars"]
    return base, not (base or said or any(m[f"dup_{k}"] > limit(k, m["n_words"]) * m["word_chars"] for k in NGRAMS))


INTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_{k}" for k in NGRAMS))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the figures ``INTS``, ``base_failed`` and ``kept`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                got = [measure(t.as_py()) for t in b.column(1)]
                verdicts = [verdict(m) for m in got]
                yield record(("id", *INTS, "base_failed", "kept"), b.column(0), *(pa.array([m[c] for m in got], pa.int64()) for c in INTS), *(pa.array([v[k] for v in verdicts], pa.bool_()) for k in (0, 1)))

    schema = "id long, " + ", ".join(f"{c} long" for c in INTS) + ", base_failed boolean, kept boolean"
    return texts(docs, id_col, text_col).mapInArrow(work, schema).withColumn("id", id_of())
