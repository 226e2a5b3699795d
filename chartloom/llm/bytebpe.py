"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one connection per worker.

A text is cut by the vocabulary's pattern, and each match into stretches: a merge makes a token, so none crosses
a place that no token within the match spans. Each new stretch becomes token-position rows, first one row a
byte; every round joins a stretch's adjacent rows to the merge table, contracts its leftmost pair of least
rank, and passes it on as done once no pair joins. The ids of whole texts then go back to DuckDB with their
positions: a join to the vocabulary and an ordered aggregation give the bytes of all tokens in order, which are
put together where each text begins and ends.

Rounds are as many as the merges of a batch's longest stretch, and each touches all its rows. So stretches of
over ``LONG`` bytes contract all places of their least rank at once, leftmost first where they overlap.

Workers remember the words and stretches they met, within a bound in bytes, so DuckDB sees each of them about
once. Texts are worked on in blocks of bounded bytes where they lie: nothing is shuffled.

Edge cases: a null or empty text has no id (the digests are those of empty strings). Special tokens are
plain text. Malformed UTF-8 is replaced by U+FFFD before encoding. Null ids stay null, repeated rows are
encoded alike, an empty table gives an empty result. Ties of rank go to the leftmost pair. A text of any length is
encoded whole; its ids are decoded a bounded number at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_of, record, slices, texts
from .parts import MOST, Memory, Runs, Table, Words, blocks, gather, joined, layout, spelt, starts

#: Bytes of words given to DuckDB at once, longest word to contract pair by pair, ids decoded at once, bytes of texts worked on at once.
BLOCK, LONG, AT_ONCE, SLICE = 1 << 17, 256, 1 << 18, 4 << 20

#: Positions of a word stay 0, 1, ... A row knows the next row's token; ``pair`` has what the two would make
#: above its position, so that the least one is the leftmost of least rank.
ROUND = """
WITH RECURSIVE state(w, pos, tok, nxt, pair, live) AS (
  SELECT s.w, s.pos, s.tok, s.nxt, (m.tok::BIGINT << 32) + s.pos, true FROM start s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
  UNION ALL (
    WITH best AS (
      SELECT w, min(pair) AS pair, (min(pair) & 4294967295)::INT AS pos, (min(pair) >> 32)::INT AS made FROM state WHERE live GROUP BY w
    ), known AS (
      SELECT s.w, s.pos, s.tok, s.nxt, s.pair, b.pos AS spot, b.made FROM state s JOIN best b ON s.w = b.w WHERE s.live
    ), contracted AS (
      SELECT k.w, CASE WHEN k.pos > k.spot THEN k.pos - 1 ELSE k.pos END AS pos,
             CASE WHEN k.pos = k.spot THEN k.made ELSE k.tok END AS tok,
             CASE WHEN k.pos = k.spot THEN d.nxt WHEN k.pos = k.spot - 1 THEN k.made ELSE k.nxt END AS nxt,
             CASE WHEN k.pos > k.spot THEN k.pair - 1 ELSE k.pair END AS pair,
             k.pos = k.spot OR k.pos = k.spot - 1 AS changed, k.made IS NOT NULL AS live
      FROM known k LEFT JOIN (SELECT w, spot, nxt FROM known WHERE pos = spot + 1) d ON d.w = k.w AND d.spot = k.pos
      WHERE k.spot IS NULL OR k.pos <> k.spot + 1
    )
    SELECT c.w, c.pos, c.tok, c.nxt, CASE WHEN c.changed THEN (m.tok::BIGINT << 32) + c.pos ELSE c.pair END, c.live
    FROM contracted c LEFT JOIN merges m ON m.a = CASE WHEN c.changed THEN c.tok END AND m.b = c.nxt
  )
)
SELECT w, pos, tok FROM state WHERE NOT live
"""

#: As above, but all places of a word's least rank go in one round; in a run of overlapping places every other one.
ROUND_ALL = """
WITH RECURSIVE state(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM start
  UNION ALL (
    WITH adjacent AS (
      SELECT w, pos, tok, lead(tok) OVER along AS nxt, row_number() OVER along AS n
      FROM state WHERE live WINDOW along AS (PARTITION BY w ORDER BY pos)
    ), ranked AS (
      SELECT a.w, a.pos, a.tok, a.n, m.tok AS merged FROM adjacent a LEFT JOIN merges m ON m.a = a.tok AND m.b = a.nxt
    ), best AS (
      SELECT w, min(merged) AS merged FROM ranked GROUP BY w
    ), places AS (
      SELECT r.w, r.n, r.n - row_number() OVER (PARTITION BY r.w ORDER BY r.n) AS run
      FROM ranked r JOIN best b ON r.w = b.w AND r.merged = b.merged
    ), chosen AS (
      SELECT w, n FROM (SELECT w, n, row_number() OVER (PARTITION BY w, run ORDER BY n) AS k FROM places) WHERE k % 2 = 1
    )
    SELECT r.w, r.pos, CASE WHEN c.n = r.n THEN b.merged ELSE r.tok END, b.merged IS NOT NULL
    FROM ranked r JOIN best b ON r.w = b.w LEFT JOIN chosen c ON c.w = r.w AND c.n = r.n LEFT JOIN chosen d ON d.w = r.w AND d.n = r.n - 1
    WHERE d.n IS NULL
  )
)
SELECT w, pos, tok FROM state WHERE NOT live
"""

#: Ids are put in order again, and each one's bytes come from the vocabulary.
DECODED = "SELECT list(v.bytes ORDER BY g.pos) AS bytes FROM given g JOIN vocabulary v ON v.tok = g.tok"


class Vocabulary:
    """Ranks, the merge table and the words met so far, in one DuckDB connection."""

    def __init__(self, path: str, pattern: str, most: int = MOST):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        merges, nodes, keys, ends = [], {b"": 0}, [], [False]
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    merges.append((a, b, r))
            for i in range(1, len(t) + 1):
                if t[:i] not in nodes:
                    keys.append(nodes[t[: i - 1]] << 8 | t[i - 1])
                    nodes[t[:i]] = len(nodes)
                    ends.append(False)
            ends[nodes[t]] = True
        self.ends, self.step = np.array(ends), Table()  # beginnings of tokens are paths from node 0
        self.step.put(np.array(keys, dtype=np.uint64), np.arange(1, len(nodes)))
        self.decimals = pa.array(map(str, range(max(ranks.values()) + 1)), pa.large_string())
        self.find = spelt(pattern).findall
        self.words = Words(self.resolve, np.int32, most, find=self.find)
        self.stretches = Memory(self.contract, np.int32, most, pa.large_binary())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        a, b, tok = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True))
        given = pa.table({"a": a, "b": b, "tok": tok})  # noqa: F841  DuckDB finds it by its name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        given = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    def _encode(self, words: list[bytes], query: str) -> Runs:
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(lengths) - lengths
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(raw)) - np.repeat(first, lengths)).astype(np.int32)
        tok, last = self.byte[raw], np.zeros(len(raw), dtype=bool)
        last[first + lengths - 1] = True
        start = pa.table({"w": w, "pos": pos, "tok": tok, "nxt": pa.array(np.roll(tok, -1), mask=last)})  # noqa: F841
        w, pos, tok = (c.to_numpy() for c in self.db.sql(query).to_arrow_table().columns)
        return np.bincount(w, minlength=len(words)), tok[np.argsort(w.astype(np.int64) << 32 | pos)]

    def _begins(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which bytes of the words begin a stretch: those that no token within the word joins to the byte before."""
        stop, at, node = np.repeat(start + size, size), np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64)
        edge, n = np.zeros(len(raw) + 1, dtype=np.int64), 0
        while len(at):
            on = at + n < stop[at]
            at, node = at[on], node[on]
            node = self.step.get(node.astype(np.uint64) << np.uint64(8) | raw[at + n].astype(np.uint64)).astype(np.int64)
            on = node >= 0
            at, node, n = at[on], node[on], n + 1
            if n > 1:  # a token of n bytes joins all its bytes
                token = at[self.ends[node]]
                edge += np.bincount(token + 1, minlength=len(edge)) - np.bincount(token + n, minlength=len(edge))
        begins = np.cumsum(edge[:-1]) == 0
        begins[start] = True
        return begins

    def contract(self, stretches: list[bytes]) -> Runs:
        """The ids of distinct stretches, by DuckDB."""
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        whole = [stretches[i] for i in order]
        short = sum(len(s) <= LONG for s in whole)
        got = [self._encode(some, query) for group, query in ((whole[:short], ROUND), (whole[short:], ROUND_ALL)) for some in blocks(group, len, BLOCK)]
        size, ids = (np.concatenate(x) for x in zip(*got, strict=True))
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        return size[at], gather(starts(size)[at], size[at], ids)

    def encode(self, pieces: pa.Array) -> Runs:
        """The ids of distinct pieces, put together from those of their stretches."""
        start, size, raw = layout(pieces)
        at = np.flatnonzero(self._begins(raw, start, size)) if len(raw) else np.empty(0, dtype=np.int64)
        offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        length, ids = self.stretches.look(coded.dictionary)
        return joined(length, ids, coded.indices, np.searchsorted(at, start + size))

    def resolve(self, asked: list[str]) -> Runs:
        """Ids of each string, its matches encoded separately."""
        split = [self.find(w) for w in asked]
        coded = pa.array([p for ps in split for p in ps], pa.large_string()).dictionary_encode()
        size, ids = self.encode(coded.dictionary)
        return joined(size, ids, coded.indices, np.cumsum([len(ps) for ps in split]))

    def decode(self, size: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes of each run of ``ids``; DuckDB gets a bounded number of ids at once, however long runs are."""
        tokens = [pa.array([], pa.large_binary())]
        for at in range(0, len(ids), AT_ONCE):
            some = ids[at : at + AT_ONCE]
            given = pa.table({"pos": np.arange(len(some), dtype=np.int32), "tok": some})  # noqa: F841
            tokens.append(self.db.sql(DECODED).to_arrow_table().column(0).combine_chunks().flatten().cast(pa.large_binary()))
        runs = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.concat_arrays(tokens))
        return pc.binary_join(runs, pa.scalar(b"", pa.large_binary()))

    def texts(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """How many ids each text has, all ids, each text's ids as decimals joined by spaces, and the bytes that they decode to."""
        size, ids = self.words.texts(raw)
        decimals = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), self.decimals.take(pa.array(ids)))
        return size, ids, pc.binary_join(decimals, pa.scalar(" ", pa.large_string())), self.decode(size, ids)


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str, most: int = MOST) -> Vocabulary:
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern, most)
    found = _VOCABULARIES[path, pattern]
    found.words.memory.most = found.stretches.most = most
    return found


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, most: int = MOST) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every row; with ``keep`` also ``ids`` and ``decoded``.

    ``path`` names a file of base64 tokens and ranks, the same on every executor; ``most`` bounds the bytes of the
    words that a worker remembers, and those of their stretches.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern, most)
        digest = lambda values: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                size, ids, decimals, decoded = v.texts([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
                cols = [pa.array(size), digest(decimals), digest(decoded)]
                if keep:
                    cols += [pa.array(np.split(ids, np.cumsum(size)[:-1]), pa.list_(pa.int32())), decoded.cast(pa.binary())]
                yield record(names, b.column(0), *cols)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep
    return texts(docs, id_col, text_col).mapInArrow(work, schema).withColumn("id", id_of())
