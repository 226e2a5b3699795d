"""The pipeline's stages against brute force over each stage's own input."""

import base64
import hashlib

import pytest
import public_tokenizers as P

import corpus_pipeline
from chartloom.llm import quality

from .test_corpus_operators import loop_keep_one, loop_lines, loop_pairs

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, written and read as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], DIR).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1]) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    trees = quality.learn(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {d for d, t in pairs(stages[0]) if trees.score(__import__("numpy").array([quality.statistics(t.encode())]))[0] >= quality.THRESHOLD}
    kept = {d for d, _ in pairs(stages[1])}
    assert kept == good
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and len(kept) < stages[0].count()


def test_line_stage(stages):
    assert pairs(stages[2]) == sorted((x[0], x[4]) for x in loop_lines(pairs(stages[1])))


def test_near_duplicate_stage(stages):
    rows = pairs(stages[2])
    assert pairs(stages[3]) == sorted(loop_keep_one(rows))


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {p[0] for p in loop_pairs(pairs(stages[3]), items)}
    assert pairs(stages[4]) == [(d, t) for d, t in pairs(stages[3]) if d not in dirty]


def test_token_stage_and_run(spark, stages):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d, t in pairs(stages[4]):
        ids = tik.encode_ordinary(t)
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, stages[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).select(stages[5].columns).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_documents(spark, docs):
    """Null ids, texts and columns, repeated rows and clashing names pass through every stage."""
    out = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, out, DIR)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, out, DIR).count() == out.count()


def test_no_documents(spark, empty):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, DIR).count() == 0
