"""Columns of any name beside those that an operator reads; every operator and every stage."""

import pytest

import corpus_pipeline
from quarrylens.llm import decontaminate, fingerprint, jaccard, mixing, quality, repeats, secrets, sharding, tokenstore, urlfilter
from quarrylens.llm.queries import tokenizer_path

NAMES = ["score", "_scored", "_text", "_hits", "hits", "_mix_base", "_first", "_row", "row", "place", "a.b", "h", "copies", "limit", "vslot", "_in", "c0", "c1", "base", "found", "kept", "TEXT", "Doc_id", "bucket", "id", "component", "a`b"]
TEXTS = ["one good sentence that stands here for a while and has its end.", "another text of many words, all of them plain and of no harm at all.", None, "", "tok kJ8s+Qz3Lw0PvX7bTn2YdRf5HcGmA1eU end"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, TEXTS[i % 5], "en", "ab"[i % 2], 7) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(spark, plain):
    """The same rows, with the odd columns before and after."""
    rows = [(*(f"{n}{r.doc_id}" for n in NAMES[:13]), *r, *(f"{n}{r.doc_id}" for n in NAMES[13:])) for r in plain.collect()]
    names = [*NAMES[:13], *plain.columns, *NAMES[13:]]
    return spark.createDataFrame(rows, ", ".join(f"c{i} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for i, n in enumerate(names))).toDF(*names)


def same(a, b):
    key = lambda r: tuple(map(str, r))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, quality int, score string")
    bench = spark.createDataFrame([(1, TEXTS[1], "x")], "item_id long, text string, hits string")
    return labels, bench


def test_operators(plain, clashing, tables, spark):
    labels, bench = tables
    runs = [
        sharding.shard_documents, jaccard.similar_groups, secrets.scan_secrets, lambda d: tokenstore.token_output(d, tokenizer_path()), mixing.mix,
        lambda d: decontaminate.contamination(d, bench), repeats.remove_repeats, lambda d: quality.quality(d, labels), fingerprint.grouped_fingerprints,
    ]
    for run in runs:
        assert same(run(plain), run(clashing))
    pages = lambda d: d.toDF(*("url" if c == "text" else "page_id" if c == "doc_id" else c for c in d.columns))
    assert same(urlfilter.filter_urls(pages(plain)), urlfilter.filter_urls(pages(clashing)))


def test_stages(spark, plain, clashing, sf_small, tables, monkeypatch):
    from quarrylens.llm import pipeline

    monkeypatch.setattr(pipeline, "table", lambda spark, sf_dir, name: dict(zip(("labels", "benchmark"), tables, strict=True))[name])
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, sf_small), stage(spark, clashing, sf_small)
        if name == "token_output":
            assert same(a, b)
            continue
        assert b.columns == clashing.columns
        ours = b.toDF(*(f"c{i}" for i in range(len(b.columns))))
        assert same(a, ours.select(*(f"c{clashing.columns.index(c)}" for c in plain.columns)))
        at = clashing.columns.index("doc_id")
        assert all(r[i] == f"{n}{r[at]}" for r in ours.collect() for i, n in enumerate(clashing.columns) if n in NAMES)
        assert 0 < a.count()
