"""Work that must not grow with the square of a group."""

import random

import numpy as np
import pyarrow as pa

from quarrylens.llm import jaccard, tokenstore
from tests.llm import brute


def test_forest_does_not_compare_a_group_in_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = (rng.poisson(12, (1, 32)) + rng.integers(0, 2, (2000, 32))).astype(np.int32)
    seen, real = [], jaccard.CountTree._fits
    monkeypatch.setattr(jaccard.CountTree, "_fits", lambda self, v, n, top, lo, hi: seen.append(len(top)) or real(self, v, n, top, lo, hi))
    links = jaccard.forest(vectors, vectors.sum(1), 85)
    assert len({i for x in links for i in x}) == 2000
    assert sum(seen) < 100_000


def test_forest_links_what_pairs_link():
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        base = rng.sample(range(1, 1 << 62), rng.randint(4, 60))
        sets += [np.array(sorted({*base[rng.randint(0, 3) :], *rng.sample(range(1, 1 << 62), rng.randint(0, 5))}), np.uint64) for _ in range(5)]
    sizes = np.array([len(s) for s in sets])
    vectors = np.stack([jaccard.count_vector(s) for s in sets])
    exact = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - both)}

    def parts(links, group):
        label = list(group)
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    for group in (np.arange(len(sets)), np.arange(len(sets)) // 2):
        found = jaccard.forest(vectors, sizes, 80, sets, group)
        assert {(max(x), min(x)) for x in found} <= exact
        assert parts(found, group) == parts(exact, group)


def test_a_shared_passage_is_no_meeting_place_and_costs_no_link(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(10, 40))) for _ in range(150)]
    texts += [t + " and more" for t in texts[:40]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common = jaccard.common_shingles(docs, 4, 85)
    assert len(common)
    met = []
    for join in (jaccard.Join(4, 85, 1), jaccard.Join(4, 85, 1, common)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts[:150])], names=["doc_id", "text"])
        signed = (b.select(["doc_id", "k1", "keys"]) for b in join.signatures(iter([batch])))
        met.append(next(join.crowded(join.places(signed))).num_rows)
    assert met[1] < met[0] / 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()} == brute.components(rows, 4, 85)


def test_odd_characters_are_found_as_by_search():
    for text in ("", "plain text\nin lines\n", *(f"a{chr(c)}b" for c in range(0x300))):
        assert tokenstore._odd(text) == bool(tokenstore._ODD.search(text))
