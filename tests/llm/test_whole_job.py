"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarrylens.llm import fingerprint, jaccard, queries, sql, tokenstore


def test_jaccard_sets_that_agree_in_24_bits_stay_apart(monkeypatch):
    real = jaccard._set_key
    monkeypatch.setattr(jaccard, "_set_key", lambda s: (real(s)[0] >> 24 << 24 | 7, real(s)[1]))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(4)] + [(9, " ".join([*words[:-1], "end0"]))]
    join = jaccard.Join(4, 80, 1)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    signed = (b.select(["doc_id", "k1", "keys"]) for b in join.signatures(iter([batch])))
    met = next(join.crowded(join.places(signed)))
    assert set(met.column("doc_id").to_pylist()) == {0, 1, 2, 3}  # 9 is a copy of 0


def test_near_copies_keep_rows_that_share_an_id(spark, sf_small):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (7, near), (7, "a text of its own that nothing else holds"), (7, "one more text that stands alone here"), (7, None), (7, "one more text that stands alone here"), (8, near), (None, near)]
    kept = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_small).collect()
    want = [rows[0], rows[2], rows[3], rows[4], rows[7]]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_token_output_is_the_librarys(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(1, "some words"), (2, "a <|endoftext|> b"), (3, "<|endoftext|>"), (4, "x " * 600_000 + "<|endoftext|>"), (5, "<|endoftext|>ü日本")]
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, tokenstore.END_ID] for i, t in rows}
    assert 50256 in want[2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.ids for r in tokenstore.encoded(docs, queries.tokenizer_path()).collect()} == want
    assert {r.doc_id: r.n_tokens for r in tokenstore.token_output(docs, queries.tokenizer_path()).collect()} == {i: len(t) for i, t in want.items()}


def test_band_members_beyond_the_head_are_linked(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "_BLOCK", 3)
    rng = random.Random(4)
    e, n = 10, len(fingerprint.sampled_steps(10))
    base = np.array([rng.randrange(1, 256) for _ in range(n)], np.uint8)

    def changed(of, places):
        out = of.copy()
        out[places] = out[places] % 255 + 1
        return out

    tail = np.arange(int(n * 0.31) + 2, n)  # beyond what bands sample
    middle = changed(base, tail[: n // 4])  # unlike the head 0, alike among themselves
    prints = [base] + [changed(middle, tail[n // 4 + 3 * k : n // 4 + 3 * k + 3]) for k in range(8)]
    rows = [(i, f"{e:02x}{p.tobytes().hex()}") for i, p in enumerate(prints)]
    assert all(fingerprint.likeness(rows[0][1], p) < 0.8 for _, p in rows[1:])
    links = fingerprint._links(spark.createDataFrame(rows, "id long, fingerprint string"), 0.8).collect()
    assert all(abs(r.likeness - fingerprint.likeness(rows[r.a][1], rows[r.b][1])) < 1e-12 and r.likeness >= 0.8 for r in links)
    assert {(r.node, r.component) for r in fingerprint.components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()} == {(i, 1) for i in range(1, 9)}


def test_op10_groups_edited_copies(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghij ", k=600)) for _ in range(10)]
    rows = list(enumerate(texts)) + [(100 + i, t[:-40] + "zz" + t[-38:]) for i, t in enumerate(texts)] + [(200, texts[3]), (300, ""), (301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.near_group for r in queries.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {i: i % 100 if i < 200 else 3 if i == 200 else i for i, _ in rows}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck(sql.oracle_sql()[name], sf)
    text = lambda df: sorted(tuple("-" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and text(got) == text(want)
