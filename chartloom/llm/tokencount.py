"""Token counts at every prefix, by prefix dynamic programming over a sentence-piece BPE vocabulary.

For each prefix of a word the program keeps the last token of that prefix's own encoding and its number of
tokens. A prefix of length j ends in the one vocabulary piece w[i:j] that is compatible with the last token
of prefix i: the pair must encode to itself. So one pass over the characters gives the exact count of each
prefix, which need not grow with its length, and a budget or truncation question is a lookup. No text is
encoded again.

No piece spans a boundary from another character to a space, holds a newline, or has one of ``MARKS`` behind
a letter, so texts are cut there into words whose counts add up (a vocabulary with such pieces is refused). A
worker remembers the counts at all prefixes of each distinct word, within a bound in bytes. The program runs
over all new words of a batch at once, place by place, in numpy; words longer than ``WIDE`` go by themselves.
A text within the budget fits as a whole; where one is beyond it, the counts at all its prefixes are laid out.

Runs of spaces are counted by the vocabulary's longest runs; the space before a word belongs to the word
unless the word's first token leaves it alone.

Edge cases: null or empty texts have no token. Strings that look like special tokens are plain text, as in
the library; characters without a piece count one token per UTF-8 byte. Malformed UTF-8 is replaced by
U+FFFD. Texts of any length are handled whole, in time and memory that grow with their length. Null ids stay
null, repeated rows are counted alike, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_of, record, slices, texts
from .parts import MARKS, MOST, Memory, Runs, Table, blocks, cut, gather, spelling, starts

LIMIT = 4096
MARK = "▁"  # stands for a space
#: Characters of the longest word that is counted together with others, pairs of tokens that are remembered.
WIDE, PAIRS = 40, 1 << 20


class Prefixes:
    """Prefix counts under one sentence-piece model of kind BPE with byte fallback and a dummy space."""

    def __init__(self, path: str, most: int = MOST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p or any(a.isalpha() and b in MARKS for a, b in zip(p, p[1:], strict=False)) for p in self.rank):
            raise ValueError("a piece spans a place where texts are cut")
        self.longest = max(map(len, self.rank))
        self.spelt = ["", *self.rank]  # tokens by number; 0: none, or bytes
        self.number = {p: i for i, p in enumerate(self.spelt)}
        # ends of pieces, read backwards, are paths from node 0
        nodes, self.piece, keys = {"": 0}, [0], []
        for p in self.rank:
            for i in range(len(p) - 1, -1, -1):
                if (end := p[i:]) not in nodes:
                    keys.append(nodes[p[i + 1 :]] << 21 | ord(p[i]))
                    nodes[end] = len(nodes)
                    self.piece.append(0)
            self.piece[nodes[p]] = self.number[p]
        self.nodes, self.step = nodes, Table()
        self.step.put(np.array(keys, dtype=np.uint64), np.arange(1, len(nodes)))
        self.piece = np.array(self.piece, dtype=np.int64)
        self.pairs = Table()
        self.memory = Memory(self.resolve, np.uint16, most)
        self.runs = [0]
        while len(self.runs) <= 2 * self.longest:
            self.runs.append(len(self.merge(MARK * len(self.runs))))

    def merge(self, s: str) -> list[str]:
        """The tokens of a short string by plain merging: best rank first, leftmost on ties."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each ``token`` may follow its ``last`` (may begin, if that is 0); remembered in ``pairs``."""
        key = last.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)
        known = self.pairs.get(key)
        if (known < 0).any():
            new = np.unique(key[known < 0])
            if self.pairs.held + len(new) > PAIRS:
                self.pairs, known = Table(), np.full(len(key), -1)
                new = np.unique(key)
            ok = []
            for a, b in zip((new >> np.uint64(32)).tolist(), (new & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
                a, b = self.spelt[a], self.spelt[b]
                ok.append(self.merge(a + b) == ([a, b] if a else [b]))
            self.pairs.put(new, np.array(ok, dtype=np.int32))
            known = self.pairs.get(key)
        return known > 0

    def spaces(self, k: int) -> int:
        """Tokens of k spaces in a row."""
        turn = self.longest
        return self.runs[k] if k <= turn else k // turn + self.runs[k % turn]

    def _states(self, s: str) -> tuple[list[int], list[int]]:
        """For each prefix of ``s``: its tokens, and the number of the last of them."""
        count, last = [0], [0]
        code = [ord(c) for c in s]
        one = lambda x: np.array([x], dtype=np.uint64)
        known: dict[tuple[int, int], bool] = {}
        ends, piece = self.nodes.get, self.piece
        for j in range(1, len(s) + 1):
            i, token = j - 1, 0
            while i >= 0 and j - i <= self.longest:
                if (node := ends(s[i:j])) is None:  # no longer piece ends here either
                    break
                if (p := int(piece[node])) and (ok := known.get((last[i], p))) is not False:
                    if ok is None:
                        ok = known[last[i], p] = bool(self.fits(one(last[i]), one(p))[0])
                    if ok:
                        token = p
                        break
                i -= 1
            count.append(count[i] + 1 if token else count[-1] + len(chr(code[j - 1]).encode()))
            last.append(token)
        return count, last

    def _together(self, strings: list[str]) -> np.ndarray:
        """Counts at all prefixes of strings of one length each, in order of length; a row a place, a column a string."""
        size = np.array([len(s) for s in strings])
        wide = int(size[-1]) if len(size) else 0
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4")
        char = np.zeros((wide, len(strings)), dtype=np.uint64)
        column = np.repeat(np.arange(len(strings)), size)
        char[np.arange(len(codes)) - np.repeat(starts(size), size), column] = codes
        utf8 = (1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)).astype(np.int64)
        count, last = np.zeros((wide + 1, len(strings)), dtype=np.int64), np.zeros((wide + 1, len(strings)), dtype=np.int64)
        for j in range(1, wide + 1):
            first = int(np.searchsorted(size, j))  # shorter strings have ended
            open_, node = np.arange(first, len(strings)), np.zeros(len(strings) - first, dtype=np.int64)
            count[j, first:] = count[j - 1, first:] + utf8[j - 1, first:]
            for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
                node = self.step.get(node.astype(np.uint64) << np.uint64(21) | char[i, open_]).astype(np.int64)
                alive = node >= 0
                open_, node = open_[alive], node[alive]
                if not len(open_):
                    break
                token = self.piece[node]
                tried = np.flatnonzero(token)
                took = tried[self.fits(last[i, open_[tried]], token[tried])]
                count[j, open_[took]] = count[i, open_[took]] + 1
                last[j, open_[took]] = token[took]
                stay = np.ones(len(open_), dtype=bool)
                stay[took] = False
                open_, node = open_[stay], node[stay]
        return count

    def resolve(self, parts: list[str]) -> Runs:
        """For each part the counts at its prefixes of one, two, ... characters."""
        spelt = [spelling(p).replace(" ", MARK) for p in parts]
        size = np.array([len(s) for s in spelt], dtype=np.int64)
        begin, out = starts(size), np.zeros(int(size.sum()), dtype=np.int64)
        short = np.argsort(size, kind="stable")
        short = short[size[short] <= WIDE]
        for some in blocks(short.tolist(), lambda k: int(size[k]) + 1, 1 << 19):
            at = np.array(some)
            count = self._together([spelt[k] for k in some])
            for j in range(1, len(count)):
                which = np.flatnonzero(size[at] >= j)
                out[begin[at[which]] + j - 1] = count[j, which]
        for k in np.flatnonzero(size > WIDE).tolist():
            out[begin[k] : begin[k] + size[k]] = self._states(spelt[k])[0][1:]
        if len(out) and out.max() >= 1 << 16:  # remembered words are short: this is a very long one
            return size, out
        return size, out.astype(np.uint16)

    def _spaced(self, text: str) -> np.ndarray:
        """Counts at all prefixes of a text in which spaces may meet."""
        out, base, run = [], 0, 0  # base: tokens before the run of spaces that is open
        for w in text.split(" "):
            run += 1
            count, last = self._states(MARK + w)
            alone = [False]  # whether the space in front stays alone
            for j in range(1, len(count)):
                i = j - (len(self.spelt[last[j]]) or 1)
                alone.append(alone[i] if i else j == 1)
            out.append(np.where(alone[1:], self.spaces(run) - 1, self.spaces(run - 1)) + base + np.array(count[1:]))
            if w:
                base, run = int(out[-1][-1]), 0
        flat = np.concatenate(out)
        flat[0] = 0
        return flat

    def counted(self, texts: list[str], limit: int, store: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Tokens of each text, characters of its longest prefix within ``limit``; with ``store`` all prefix counts."""
        texts = [t.replace(MARK, " ") for t in texts]
        spaced = np.array([t[:1] == " " or "  " in t for t in texts], dtype=bool)
        strings, order, ends = cut([t for t, s in zip(texts, spaced, strict=True) if not s], lead="")
        size, flat = self.memory.look(strings)
        begin = starts(size)
        each = np.zeros(len(size), dtype=np.int64)
        each[size > 0] = flat[(begin + size - 1)[size > 0]]
        tokens, chars = np.concatenate([[0], np.cumsum(each[order])]), np.concatenate([[0], np.cumsum(size[order])])
        bound = np.concatenate([[0], ends])
        total, fit_chars, prefixes = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), []
        total[~spaced], fit_chars[~spaced] = np.diff(tokens[bound]), np.diff(chars[bound]) - 1  # the space in front is not the text's
        parts = iter(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True))
        for k, t in enumerate(texts):
            counts = None
            if spaced[k]:
                counts = self._spaced(t)
                total[k] = counts[-1]
            else:
                a, b = next(parts)
                if not t:
                    total[k] = fit_chars[k] = 0
                    counts = np.zeros(1, dtype=np.int64)
                elif store or total[k] > limit:
                    which = order[a:b]
                    counts = gather(begin[which], size[which], flat).astype(np.int64) + np.repeat(tokens[a:b] - tokens[a], size[which])
                    counts[0] = 0  # the empty prefix gets no space in front
            if counts is not None:
                fit_chars[k] = fit(counts, limit)
            if store:
                prefixes.append(counts)
        return total, fit_chars, prefixes

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... all characters."""
        return self.counted([text], 0, True)[2][0]


def fit(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


_MODELS: dict[str, Prefixes] = {}


def model(path: str) -> Prefixes:
    if path not in _MODELS:
        _MODELS[path] = Prefixes(path)
    return _MODELS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """``(id, n_bytes, n_tokens, fit_chars)`` of every row; with ``store`` also ``prefix_tokens``, the counts
    of all prefixes. ``fit_chars`` is the length of the longest prefix within ``limit`` tokens. ``path`` must
    name the model on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for b in slices(whole, 1):
                raw = b.column(1).to_pylist()
                total, fits, counts = m.counted([t.decode("utf-8", "replace") for t in raw], limit, store)
                cols = [b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(total), pa.array(fits)]
                yield record(names, *cols, *([pa.array(counts, pa.list_(pa.int64()))] if store else []))

    names = ["id", "n_bytes", "n_tokens", "fit_chars"] + ["prefix_tokens"] * store
    schema = "id long, n_bytes long, n_tokens long, fit_chars long" + ", prefix_tokens array<long>" * store
    return texts(docs, id_col, text_col).mapInArrow(work, schema).withColumn("id", id_of())
