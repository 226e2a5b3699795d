"""Operators that judge each text alone, against the libraries and plain loops."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import bytebpe, parts, quality, repetition, simple8b, tokencount, tokenfile

from .conftest import table_of

PIECES, RANKS, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


LETTERS = st.text(alphabet=st.sampled_from(list("aethio .,\n\t'sSX9é中🙂▁<>|\xa0\x85\x1c  ")), max_size=40)


# --- token counts


@settings(max_examples=150, deadline=None)
@given(LETTERS)
def test_each_prefix_counts_as_the_library_says(pieces, text):
    counts = tokencount.model(PIECES).counts(text)
    assert counts.tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]


def test_runs_of_spaces(pieces):
    m = tokencount.model(PIECES)
    assert [m.spaces(k) for k in range(2, 120)] == [len(pieces.encode(" " * (k - 1))) for k in range(2, 120)]


def test_token_counts(docs, rows, pieces):
    got = table_of(tokencount.token_counts(docs, PIECES, limit=50), "id", "n_bytes", "n_tokens", "fit_chars")
    fits = lambda t: max(i for i in range(len(t) + 1) if i in near(t) and len(pieces.encode(t[:i])) <= 50)
    near = lambda t: range(len(t) + 1) if len(t) < 400 else range(0)
    expected = sorted(((d, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t in rows), key=repr)
    assert sorted((g[:3] for g in got), key=repr) == expected
    by_id = {g[0]: g[3] for g in got if g[0] is not None}
    for d, t in rows[:20]:
        if t and len(t) < 400 and sum(x == d for x, _ in rows) == 1 and d is not None:
            assert by_id[d] == fits(t)


def test_stored_prefixes(docs, spark):
    one = docs.where("doc_id = 39")
    row = tokencount.token_counts(one, PIECES, store=True).first()
    assert row.prefix_tokens[-1] == row.n_tokens and len(row.prefix_tokens) == len(one.first().text) + 1


# --- byte-level BPE


def agrees(v, tik, texts):
    size, ids, decimals, decoded = v.texts(texts)
    expected = [tik.encode_ordinary(t) for t in texts]
    assert size.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert decimals.to_pylist() == [" ".join(map(str, e)) for e in expected]
    assert decoded.to_pylist() == [t.encode() for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=4))
def test_ids_as_the_library_says(tik, texts):
    agrees(bytebpe.vocabulary(RANKS, P.PATTERN), tik, texts)


def test_white_space_before_newlines(tik):
    texts = ["a \nb", " \n x", "x \n\n  y\t\n z", "\n ", " ", "a  ", "\n\n\n", "a\n\n", "a \n \n b"]
    agrees(bytebpe.vocabulary(RANKS, P.PATTERN), tik, texts)


def test_long_words(tik):
    texts = ["a" * 5000, "the" * 700, "中文" * 600, "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(3000)), "0123456789" * 100]
    agrees(bytebpe.vocabulary(RANKS, P.PATTERN), tik, texts)


def test_decoded_bytes_follow_the_ids():
    v = bytebpe.vocabulary(RANKS, P.PATTERN)
    size, ids, _, decoded = v.texts(["the first text", "", "another one"])
    other = ids.copy()
    other[1] = ids[0]
    changed = v.decode(size, other).to_pylist()
    assert changed[0] != decoded.to_pylist()[0] and changed[1:] == decoded.to_pylist()[1:]


def test_decoding_in_several_turns(tik, monkeypatch):
    monkeypatch.setattr(bytebpe, "AT_ONCE", 7)
    agrees(bytebpe.vocabulary(RANKS, P.PATTERN), tik, ["a text of more ids than are decoded at once", "", "b", " and one more of them here"])


def test_memory_of_words_is_bounded(tik):
    v = bytebpe.Vocabulary(RANKS, P.PATTERN, most=200_000)
    for k in range(6):
        agrees(v, tik, [" ".join(f"w{k}x{i}," for i in range(1500)) + " the and of.\nSo"])
    assert v.words.memory.bytes() <= 200_000 and v.stretches.bytes() <= 200_000


def test_long_words_are_not_remembered(pieces):
    """Texts without a space: what a worker holds does not grow with them."""
    texts = ["".join(chr(0x4E00 + (i * k) % 2000) for i in range(5000)) for k in range(3, 11)]
    m = tokencount.Prefixes(PIECES)
    assert m.counted(texts, 100, False)[0].tolist() == [len(pieces.encode(t)) for t in texts]
    e = tokenfile.Encoder(BPE)
    e.encode(texts)
    empty = parts.Memory(None, "u2").bytes()
    assert m.memory.bytes() < empty + 2000 and e.words.memory.bytes() < empty + 2000


def test_remembered_numbers(monkeypatch):
    """Those of strings that share a key, that are asked for again, and that were forgotten."""
    calls = []

    def resolve(new):
        calls.extend(new)
        return np.array([len(s) for s in new]), np.array([ord(c) for s in new for c in s], dtype=np.int32)

    m = parts.Memory(resolve, np.int32)
    ask = lambda *s: tuple(x.tolist() for x in m.look(pa.array(s, pa.large_string())))
    assert ask("ab", "", "c") == ([2, 0, 1], [97, 98, 99]) and ask("c", "d", "ab") == ([1, 1, 2], [99, 100, 97, 98])
    assert calls == ["ab", "", "c", "d"]
    monkeypatch.setattr(parts, "hashes", lambda strings: np.zeros(len(strings), dtype=np.uint64))
    m = parts.Memory(resolve, np.int32)
    for _ in range(2):
        assert ask("ab", "x", "c") == ([2, 1, 1], [97, 98, 120, 99])


def test_encode_decode(docs, rows, tik):
    def one(t):
        ids = tik.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = table_of(bytebpe.encode_decode(docs, RANKS, P.PATTERN), "id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((d, *one(t)) for d, t in rows), key=repr)


def test_kept_ids(docs, tik):
    row = bytebpe.encode_decode(docs.where("doc_id = 48"), RANKS, P.PATTERN, keep=True).first()
    assert tik.decode_bytes(row.ids) == bytes(row.decoded)


def test_plain_texts():
    distinct, order, ends = parts.cut(["a b.\nc\n\nd", " x a"])
    assert [distinct[i].as_py() for i in order] == ["\na", "b", "\n.", "\n\n", "\nc", "\n\n", "\n", "\n\n", "\nd", "\n", "x", "a"] and ends.tolist() == [9, 12]
    assert not any(map(parts.plain, ["a  b", "a\n b", "a \nb", "a\tb", "a\xa0b", "a\n\n\nb", "a\n\n"])) and parts.plain(" a\n") and parts.plain("a\n\nb")


# --- Simple-8b


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, dtype=np.uint64)
    assert (simple8b.unpack(simple8b.pack(a), len(a)) == a).all()


def test_words_are_full():
    assert len(simple8b.pack(np.zeros(600, dtype=np.uint64))) == 10
    assert len(simple8b.pack(np.full(30, 2**15 - 1, dtype=np.uint64))) == 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(LETTERS, st.just("a<|endoftext|>b c")), min_size=1, max_size=4))
def test_encoder_equals_the_library(library, texts):
    for t, ids in zip(texts, tokenfile.encoder(BPE).encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_file(spark, docs, rows, library, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenfile.write(docs, BPE, path)
    got = tokenfile.read(spark, path, with_ids=True).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for g, (d, t) in zip(got, ordered, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (g.id, g.start, g.n_tokens, list(g.ids)) == (d, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


# --- repetition


def loop_base(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    inside = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def loop_kept(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, _, dup, rep = loop_base(text)
    base = n < 50 or 100 * rep > 50 * n
    fine = not base
    for k, most in repetition.NGRAMS.items():
        seen, cover = set(), set()
        for i in range(n - k + 1):
            g = tuple(ws[i : i + k])
            if g in seen:
                cover.update(range(i, i + k))
            seen.add(g)
        fine &= sum(len(ws[i]) for i in cover) <= min(most, repetition.USUAL[k] + 20 / max(n, 1)) * chars
    lines, seen, said = [x for x in text.split("\n") if x.split()], set(), 0
    for x in lines:
        said += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x))) if x in seen else 0
        seen.add(x)
    return base, bool(fine and dup <= repetition.LINES * len(lines) and said <= repetition.LINE_CHARS * chars)


def test_a_passage_said_five_times():
    """A quarter of a long text goes too far; a line said twice in a short one does not."""
    words = [f"w{i}" for i in range(2000)]
    passage = words[:60]
    text = " ".join(passage + [w for k in range(4) for w in [*words[100 + 190 * k : 290 + 190 * k], *passage]])
    assert len(text.split()) == 1060 and repetition.verdict(repetition.measure(text.encode())) == (False, False)
    short = " ".join(words[:48]) + "\n" + " ".join(words[36:48])
    assert repetition.verdict(repetition.measure(short.encode())) == (False, True)


def test_rules(docs, rows):
    got = table_of(repetition.rules(docs), "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted(((d, *loop_base(t or ""), *loop_kept(t or "")) for d, t in rows), key=repr)
    assert {g[-1] for g in got} == {True, False}


def test_many_distinct_words():
    ids = np.arange(5) % 2
    assert (np.unique(repetition.windows3(ids, 1 << 21), return_inverse=True)[1] == np.unique(repetition.windows3(ids, 2), return_inverse=True)[1]).all()


# --- quality


def test_trees_walk_as_a_loop_does():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.grow(x, y, trees=30, depth=3)
    score = trees.score(x)

    def loop(row):
        total = trees.start
        for f, c, v in zip(trees.feature, trees.cut, trees.value, strict=True):
            k = 0
            for _ in range(trees.depth):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += v[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score, [loop(r) for r in x])
    assert ((score > 0.5) == y).mean() > 0.93


def test_one_class_or_none():
    x = np.zeros((3, 2))
    assert quality.grow(x, np.ones(3)).score(x).min() > 0.99 and quality.grow(x, np.zeros(3)).score(x).max() < 0.01
    assert (quality.grow(x[:0], np.zeros(0)).score(x) == 0.5).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trees = quality.learn(docs, labels)
    got = {r.id: r.score for r in quality.scores(docs, trees).collect()}
    held = [(got[r.doc_id] >= quality.THRESHOLD, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == docs.count() and sum(bool(q) == p for p, q in held) / len(held) > 0.9


def test_quality_of_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1), (39, 1), (42, 1), (45, 0), (51, 0), (None, 0), (3, None), (39, 0), (10**9, 1)], "doc_id long, quality int")
    trees = quality.learn(docs, labels)
    got = table_of(quality.scores(docs, trees), "id", "score")
    assert sorted((g[0] for g in got), key=repr) == sorted((d for d, _ in rows), key=repr) and all(0 <= g[1] <= 1 for g in got)
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)


# --- nothing in, nothing out


def test_empty_tables(spark, empty, tmp_path):
    assert tokencount.token_counts(empty, PIECES).count() == 0
    assert bytebpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0
    assert repetition.rules(empty).count() == 0
    trees = quality.learn(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scores(empty, trees).count() == 0
    tokenfile.write(empty, BPE, f"file://{tmp_path}/ids")
    assert tokenfile.read(spark, f"file://{tmp_path}/ids").count() == 0
