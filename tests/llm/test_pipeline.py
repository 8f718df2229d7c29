"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarrylens.llm import mixing, quality
from tests.llm import brute
from tests.llm.test_operators import expected_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    """Each stage's input and output on the small documents, as lists of rows."""
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_small).cache()
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_names_and_columns(stages):
    assert list(stages) == ["quality", "near_copies", "benchmark_leaks", "mixing", "token_output"]
    assert all(c == COLUMNS for name, (_, _, c) in stages.items() if name != "token_output")


def test_quality_stage(spark, sf_small, stages):
    before, after, _ = stages["quality"]
    docs, labels = (spark.read.parquet(f"{sf_small}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    want = []
    for r in before:
        rows, weight = quality.line_features(r.text or "")
        if len(weight) and model.score(rows, weight, np.array([len(weight)]))[0] >= 0.5:
            want.append(r.doc_id)
    assert ids(after) == sorted(want)
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(ids(after))
    good = [i for i, q in label.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) < len(before)


def test_near_copy_stage(stages):
    before, after, _ = stages["near_copies"]
    groups = brute.components([(r.doc_id, r.text) for r in before], 5, 80)
    assert ids(after) == sorted(i for i, (_, c) in groups.items() if c == i) and len(after) < len(before)


def test_leak_stage(spark, sf_small, stages):
    before, after, _ = stages["benchmark_leaks"]
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    kept = set(ids(after))
    plain = lambda t: brute.shingles(re.sub(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t), 3)
    for r in before:
        if any(x in r.text for x in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert any(len(plain(x) & plain(r.text)) >= 0.6 * len(plain(x)) for x in items)


def test_mixing_stage(spark, stages):
    before, after, _ = stages["mixing"]
    docs = spark.createDataFrame(before)
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in after) == want and max(want.values()) <= 2
    text = {r.doc_id: r.text for r in before}
    assert all(r.text == text[r.doc_id] for r in after)


def test_token_stage(stages):
    before, after, _ = stages["token_output"]
    want = expected_tokens(sorted((r.doc_id, r.text) for r in before))
    at, rows = 0, []
    for i, tokens in want:
        rows.append((i, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    assert sorted(tuple(r) for r in after) == sorted(rows)


def test_run_equals_stages(spark, sf_small, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_small).collect())) == sorted(map(tuple, stages["token_output"][1]))


def test_stages_on_odd_tables(spark, sf_small, repeated_docs, no_docs):
    for docs in (repeated_docs, no_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_small)
            m = out.count()
            assert (m <= n or name in ("mixing", "token_output")) and (n or not m)
            if name not in ("token_output", "mixing"):
                assert out.columns == docs.columns
    kept = corpus_pipeline.near_copy_stage(spark, repeated_docs, sf_small).collect()
    assert sum(r.doc_id is None for r in kept) == 3 and all(k == 1 for i, k in Counter(r.doc_id for r in kept).items() if i is not None)
