"""The registered queries over their whole tables, against the libraries and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P

from chartloom.llm import bytebpe, contamination, linededup, quality, queries, repetition, simhash, substrings, surrogates, tokencount, tokenfile

from .test_corpus_operators import loop_components, loop_fingerprint
from .test_text_operators import library, pieces, tik  # noqa: F401  fixtures

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: {r.doc_id: r for r in queries.QUERIES[name](spark, DIR).collect()}


def test_op1(documents, result, spark):
    spark.conf.set(surrogates.KEY_SETTING, "a key")
    try:
        got = result("op1_surrogates")
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)
    import regex

    find, made, back = regex.compile(surrogates.PATTERN), {}, {}
    assert got.keys() == documents.keys()
    for d, t in documents.items():
        mentions = [m.group(0) for m in find.finditer(t)]
        assert (got[d].text == t) == (not mentions)
        if mentions and not any(re.match(surrogates.TITLE, m) for m in mentions):
            row = re.fullmatch("(.+)".join(map(re.escape, find.split(t))), got[d].text, re.DOTALL).groups()
            assert got[d].n_entities == len(mentions)
            for old, new in zip(mentions, row, strict=True):
                assert made.setdefault(old, new) == new and back.setdefault(new, old) == old
    assert made and not made.keys() & back.keys()


def test_op2(documents, result, spark):
    got = result("op2_quality")
    assert got.keys() == documents.keys()
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.learn(docs, labels)
    for d, t in documents.items():
        score = trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            x, node = quality.statistics(t.encode()), 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + (x[feature[node]] > cut[node])
            score += value[node - len(feature)]
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and abs(r.score - 1 / (1 + np.exp(-score))) < 1e-9
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality) for r in labels.collect()]
    a, b = quality.learn(docs, labels), quality.learn(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "cut", "value")) and a.start == b.start


def test_statistics_by_loops():
    for t in ["One two two.\nONE x\n\nthree three #four!", "a", "Été 12 ... <b>  y"]:
        s = dict(zip(quality.FEATURES, quality.statistics(t.encode()), strict=True))
        raw, words = t.encode(), t.encode().split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        assert s["share_upper"] == pytest.approx(sum(65 <= c <= 90 for c in raw) / len(raw)) and s["share_digit"] == pytest.approx(sum(48 <= c <= 57 for c in raw) / len(raw))
        assert s["share_beyond_ascii"] == pytest.approx(sum(c > 127 or c < 32 and c not in b"\t\n\r\x0b\x0c" for c in raw) / len(raw))
        assert s["mean_word"] == pytest.approx(sum(map(len, words)) / len(words)) and s["words_a_line"] == pytest.approx(len(words) / len(lines))
        assert s["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and s["top_word"] == pytest.approx(max(map(words.count, words)) / len(words))
        assert s["distinct_pairs"] == pytest.approx(len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / max(1, len(words) - 1))
        assert s["repeated_bytes"] == pytest.approx(1 - sum(map(len, set(lines))) / sum(map(len, lines))) and s["one_byte_words"] == pytest.approx(sum(len(w) == 1 for w in words) / len(words))
        assert s["stopped_lines"] == pytest.approx(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)) and s["log_bytes"] == pytest.approx(np.log(1 + len(raw)))


def test_the_best_cut_by_a_loop():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 12, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 6] = 1
    trees = quality.grow(x, y, trees=1, depth=1)
    p = y.mean()

    def gain(f, c):
        g, h = y - p, np.full(len(y), p * (1 - p))
        parts = [(g[m].sum(), h[m].sum()) for m in (x[:, f] <= c, x[:, f] > c, np.ones(len(y), bool))]
        (a, b), (c, d), (e, k) = parts
        return a * a / (b + quality.RIDGE) + c * c / (d + quality.RIDGE) - e * e / (k + quality.RIDGE)

    best = max(((gain(f, c), f, c) for f in range(3) for c in range(11)), key=lambda v: v[0])
    assert (trees.feature[0, 0], trees.cut[0, 0]) == best[1:]


def test_op3(documents, result, pieces):  # noqa: F811
    got = result("op3_token_counts")
    assert {d: (r.n_bytes, r.n_tokens, r.over_limit) for d, r in got.items()} == {d: (len(t.encode()), n := len(pieces.encode(t)), n > 4096) for d, t in documents.items()}


def test_op4(documents, result):
    got = result("op4_simhash")
    ids = sorted(documents)
    fps = [loop_fingerprint(documents[d]) for d in ids]
    least = loop_components(fps, ids)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, least, strict=True)}


def test_op6(documents, result, library):  # noqa: F811
    got, start = result("op6_token_file"), 0
    for d in sorted(documents):
        ids = [*library.encode(documents[d], add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert got.keys() == documents.keys()


def test_op8(documents, result, tik):  # noqa: F811
    got = result("op8_byte_bpe")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {d: (ids := tik.encode_ordinary(t)) and (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) or (0, sha(b""), sha(b"")) for d, t in documents.items()}
    assert {d: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for d, r in got.items()} == expected


def test_vocabularies_are_named():
    assert queries.vocabulary("piece_bpe_32k.model") == P.path("piece_bpe_32k.model")


LONG = ["a" * (1 << 20), "中" * 350_000, "The quick brown fox, and so on.\n" * 40_000, "x1 " * 300_000, None, ""]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(3)


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_megabyte_texts_keep_their_tokens(long_docs, spark, tmp_path, library, pieces):  # noqa: F811
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in LONG]
    tokenfile.write(long_docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids")
    read = by_id(tokenfile.read(spark, f"file://{tmp_path}/ids", with_ids=True))
    assert [read[d].ids for d in range(len(LONG))] == [[*i, 0] for i in ids]
    coded = by_id(bytebpe.encode_decode(long_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=True))
    assert [coded[d].ids for d in range(len(LONG))] == ids and [bytes(coded[d].decoded).decode() for d in range(len(LONG))] == [t or "" for t in LONG]
    counted = by_id(tokencount.token_counts(long_docs, P.path("piece_bpe_32k.model")))
    assert [counted[d].n_tokens for d in range(len(LONG))] == [len(pieces.encode(t or "")) for t in LONG]


def test_megabyte_texts_elsewhere(long_docs, spark):
    items = spark.createDataFrame([(7, "fox, and so on. The quick brown fox,"), (8, "中" * 350_000)], "item_id long, text string")
    assert {(r.id, r.item_id) for r in contamination.matches(long_docs, items).collect()} == {(1, 8), (2, 7)}
    words = {d: r.n_words for d, r in by_id(repetition.rules(long_docs)).items()}
    assert words == {0: 1, 1: 1, 2: 280_000, 3: 300_000, 4: 0, 5: 0}
    assert {d: r.n_removed for d, r in by_id(substrings.remove_repeated(long_docs)).items()} == {d: len((t or "").encode()) for d, t in enumerate(LONG)}
    assert {d: r.n_dropped for d, r in by_id(linededup.keep_bitmaps(long_docs)).items()} == dict.fromkeys(range(len(LONG)), 0)
    assert {d: r.component_id for d, r in by_id(simhash.near_duplicates(long_docs)).items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert all(0 <= r.score <= 1 for r in quality.scores(long_docs, quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect())
