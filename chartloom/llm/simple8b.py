"""Simple-8b: ids packed into 64-bit words, many to a word.

The top four bits of a word select how many ids it holds and how wide they are; the other 60 bits hold them,
the first id lowest. Selector 15 is the escape: the word after it is one id of any 64 bits. A block starts
with its number of words and the number of ids before the end of each of its documents, so that all words
of a kind are decoded at once and documents are cut out by offsets.
"""

from __future__ import annotations

import struct

import numpy as np

#: (ids in a word, bits of each), by selector.
KINDS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIII")  # magic, documents, words, ids
_BITS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each unsigned id needs, one at least."""
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS[ids]
    out = np.ones(len(ids), dtype=np.uint8)
    rest = ids.astype(np.uint64) >> np.uint64(1)
    while rest.any():
        out += rest > 0
        rest >>= np.uint64(1)
    return out


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of unsigned ``ids``: from each place on, as many ids as fit."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    most = widths(ids)  # of the windows of ``held`` ids that begin here
    own = most
    count, kind = np.ones(n, dtype=np.uint8), np.full(n, 13, dtype=np.uint8)
    kind[own > 60] = ESCAPE
    held = 1
    for s in range(len(KINDS) - 2, -1, -1):
        c, width = KINDS[s]
        while held < c and len(most) > 1:  # windows that fit at c ids fit at fewer, so this may stop early
            step = min(held, c - held)
            most = np.maximum(most[: len(most) - step], most[step:])
            held += step
        if held < c:
            break
        fits = most <= width
        if not fits.any():
            break
        np.copyto(count[: len(fits)], np.uint8(c), where=fits)
        np.copyto(kind[: len(fits)], np.uint8(s), where=fits)
    jumps, i, starts = count.tobytes(), 0, []
    while i < n:
        starts.append(i)
        i += jumps[i]
    at = np.array(starts, dtype=np.int64)
    kinds = kind[at]
    place = np.arange(len(at)) + np.cumsum(kinds == ESCAPE) - (kinds == ESCAPE)
    words = np.zeros(len(at) + int((kinds == ESCAPE).sum()), dtype=np.uint64)
    for s, (c, width) in enumerate(KINDS):
        chosen = np.flatnonzero(kinds == s)
        if len(chosen):
            w = np.full(len(chosen), s << 60, dtype=np.uint64)
            for k in range(c):
                w |= ids[at[chosen] + k] << np.uint64(k * width)
            words[place[chosen]] = w
    escaped = np.flatnonzero(kinds == ESCAPE)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = ids[at[escaped]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``words``."""
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    if (kinds == ESCAPE).any():  # a word after an escape is an id whatever its top bits say
        i, escapes = 0, np.flatnonzero(kinds == ESCAPE).tolist()
        for e in escapes:
            if e >= i:
                raw[e + 1], i = True, e + 2
    counts = np.array([c for c, _ in KINDS] + [0, 0], dtype=np.int64)[kinds]
    counts[raw] = 1
    start = np.cumsum(counts) - counts
    out = np.empty(n, dtype=np.uint64)
    out[start[raw]] = words[raw]
    for s, (c, width) in enumerate(KINDS):
        chosen = np.flatnonzero((kinds == s) & ~raw)
        mask = np.uint64((1 << width) - 1)
        for k in range(c) if len(chosen) else ():
            out[start[chosen] + k] = (words[chosen] >> np.uint64(k * width)) & mask
    return out


def block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A block of the ids of some documents; ``ends``: how many ids there are up to the end of each."""
    words = pack(ids)
    return _HEAD.pack(MAGIC, len(ends), len(words), len(ids)) + ends.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, ends)`` of a block."""
    magic, docs, n_words, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    ends = np.frombuffer(data, "<u4", docs, _HEAD.size).astype(np.int64)
    return unpack(np.frombuffer(data, "<u8", n_words, _HEAD.size + 4 * docs), n), ends
