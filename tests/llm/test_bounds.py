"""Very long texts, repeated ids, many shards, hot groups: the whole result, in bounded work."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import decontaminate, fingerprint, jaccard, mixing, pipeline, quality, repeats, secrets, sharding
from quarrylens.session import Scratch
from tests.llm import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- 1 sharding: stored versions and bytes of slots


def test_query_uses_the_stored_maps(spark, odd_docs, tmp_path):
    path = str(tmp_path / "map")
    got = sharding.shard_documents(odd_docs, path=path).collect()
    maps = [{r.vslot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in range(3)]
    assert all((r.shard, r.grown_shard, r.balanced_shard) == tuple(m[r.virtual_slot] for m in maps) for r in got)
    load = lambda column: Counter({s: sum(r["size"] for r in got if r[column] == s) for s in range(8)})
    largest = max(sum(r["size"] for r in got if r.virtual_slot == s) for s in {r.virtual_slot for r in got})
    assert max(load("balanced_shard").values()) <= sum(r["size"] for r in got) / 8 + largest


# --- 3 Jaccard: chunks of a cluster, ids with several texts


def test_chunks_with_few_hub_documents(spark, monkeypatch):
    rng, rows = random.Random(19), []
    base = [f"w{i}" for i in range(80)]
    for i in range(120):  # a chain of edits: members at its ends are unlike
        t = list(base)
        for j in range(i // 6):
            t[(7 * j) % 80] = f"y{j}"
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(jaccard, "CHUNK", 900)
    monkeypatch.setattr(jaccard, "HUB", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, rows), 4, 80).collect()}
    assert got == brute.components(rows, 4, 80)


def test_many_near_copies_lose_no_link(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(100)]
    rows = []
    for i in range(3000):
        t = list(words)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    assert {r.component_id for r in jaccard.similar_groups(frame(spark, rows)).collect()} == {0}


def test_an_id_with_several_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    got = jaccard.similar_groups(frame(spark, [(1, a), (5, a), (5, b), (9, b), (7, "alone here now then")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (7, 7)}


# --- 4 secrets: planted in real documents; one text with very many spans


def test_planted_tokens_in_documents_are_added(spark, small_docs):
    rng, planted = random.Random(12), {}
    rows = []
    for r in small_docs.select("doc_id", "text").collect():
        text = r.text or ""
        if r.doc_id % 9 == 0:
            token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=rng.choice((40, 56, 88))))
            planted[r.doc_id] = len(text) + 6
            text += " see: " + token + " end"
        rows.append((r.doc_id, text))
    found = {r.doc_id: [int(x.split(":")[1]) for x in r.spans.split(",") if x.startswith("random")] for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    hit = sum(at in found[i] for i, at in planted.items())
    assert hit >= 0.95 * len(planted) and sum(map(len, found.values())) <= hit + 2


def test_work_grows_with_a_texts_spans_not_their_square(spark):
    took = []
    for n in (4000, 32_000):
        text = " ".join(f"{i:024x} tok{'xy' * 12}{i}" for i in range(n))
        start = time.perf_counter()
        (row,) = secrets.scan_secrets(frame(spark, [(1, text)])).select("n_hex", "spans").collect()
        took.append(time.perf_counter() - start)
        assert row.n_hex == n and row.spans.count("hex") == n
    assert took[1] < 8 * took[0] + 6


# --- 6 mixing: null and repeated ids


@pytest.mark.parametrize("rows", [[(None, f"text {i} of some words") for i in range(400)], [(5, f"text {i} of some words") for i in range(400)], [(5, "the same text always")] * 400])
def test_ids_that_do_not_tell_rows_apart(spark, rows):
    docs = frame(spark, rows).withColumn("source", F.lit("a")).unionByName(frame(spark, [(i, "w " * 30) for i in range(1000, 1100)]).withColumn("source", F.lit("b")))
    for source in "ab":
        got = [r for r in mixing.mix(docs).collect() if r.source == source]
        assert abs(sum(r.taken for r in got) - got[0].target) <= max(r["size"] for r in got)
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(docs).count() == want


# --- 7 decontamination: every score by plain BM25, and any number of shards


def plain_leaks(items, docs):
    unit_list, kept = [], []
    for item, text in sorted(items):
        t = decontaminate.tokens(text).tolist()
        if t:
            unit_list += [(item, t[i : i + decontaminate.UNIT]) for i in range(0, len(t), decontaminate.UNIT)]
            kept.append((item, text))
    df = Counter(x for _, u in unit_list for x in set(u))
    n, mean = len(unit_list), sum(len(u) for _, u in unit_list) / max(len(unit_list), 1)
    weights = []
    for item, u in unit_list:
        w = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(u) / mean)) for x, c in Counter(u).items()}
        weights.append((item, {x: v / sum(w.values()) for x, v in w.items()}))
    out = {}
    for doc, text in docs:
        t = decontaminate.tokens(text)
        have = set(decontaminate.tk.shingle_set(t, 5).tolist())
        best = {}
        step = decontaminate.PASSAGE // 2
        for lo in range(0, max(len(t), 1), step):
            terms = set(t[lo : lo + decontaminate.PASSAGE].tolist())
            for item, w in weights:
                score = sum(v for x, v in w.items() if x in terms)
                if score >= decontaminate.THRESHOLD:
                    best[item] = max(best.get(item, 0.0), score)
        for item, text_ in kept:
            if item in best:
                shares = []
                for part in decontaminate.question_and_answer(text_):
                    p = decontaminate.tokens(part)
                    s = decontaminate.tk.shingle_set(p, 5).tolist()
                    small = {int(x) for k in range(1, 5) for x in decontaminate.tk.window_hashes(t, k)} if len(p) < 5 else set()
                    shares.append(sum(x in have or x in small for x in s) / len(s) if s else 1.0)
                if shares[0] >= 0.8 and shares[1] >= 0.5:
                    out[doc, item] = best[item]
    return out


def test_leaks_equal_plain_bm25(spark, sf_small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_small}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_leaks([(r.item_id, r.text) for r in bench.collect()], [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for size in (decontaminate.SHARD_BYTES, 3000):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(docs, bench).collect()}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


# --- 8 substring dedup: maximal repeats


def test_spans_are_the_maximal_repeats(odd_docs):
    for r in repeats.remove_repeats(odd_docs).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and all(s.end - s.start >= 20 for s in r.spans)


def test_a_passage_of_all_documents_in_many_batches(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {passage} c{i} " + " ".join(f"d{i}x{j}" for j in range(i % 25))) for i in range(300)] + [(i, passage) for i in range(300, 340)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows).repartition(5)).collect()}
    spark.conf.set(size, "2000")
    assert got == brute.removed(rows)


# --- 9 quality: bounds of what is learned from


def test_training_rows_are_bounded(spark, monkeypatch):
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *a, **k: seen.append(rows.shape) or real(rows, *a, **k))
    rows = [(i, "a line of words.\n" * 20) for i in range(60)] + [(0, "a line of words.")] * 500 + [(70, "word\n" * 300_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 70]], "doc_id long, quality int")
    model = quality.train(frame(spark, rows), labels, max_lines=600)
    assert len(seen) == 1 and 0 < seen[0][0] <= 600 and model.weights.any()
    assert quality.score_documents(frame(spark, rows), model).count() == len(rows)


def test_scores_equal_plain_marginals(spark, sf_small):
    """Every score of short documents from the model's weights, by enumerating all states of their lines."""
    docs, labels = (spark.read.parquet(f"{sf_small}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    got, seen = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}, 0
    for r in docs.select("doc_id", "text").collect():
        rows, weight = quality.line_features(r.text or "")
        if not len(weight) or len(weight) > 9:
            continue
        x = np.clip((rows - model.mean) / model.spread, -6, 6) @ model.weights[:-1] + model.weights[-1]
        total, good = 0.0, np.zeros(len(x))
        for code in range(1 << len(x)):
            y = np.array([(code >> i) & 1 for i in range(len(x))])
            w = np.exp(x @ y + sum(model.move[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * y
        d = ((good / total) * weight).sum() / weight.sum()
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.curve[0] * (d - 0.5) + model.curve[1])))) < 1e-6
        seen += 1
    assert seen > 50


# --- 10 fingerprints: one very long text; recall over documents


def test_a_very_long_text_is_walked_in_seconds():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ijkl", k=1_000_000))
    start = time.perf_counter()
    one, two = fingerprint.fingerprints([text, text[:500_000] + "x" + text[500_000:]])
    assert time.perf_counter() - start < 12 and fingerprint.likeness(one, two) > 0.9


def test_recall_of_links_over_documents(spark, small_docs):
    rows = [(r.doc_id, r.text or "") for r in small_docs.select("doc_id", "text").collect()]
    rows += [(1000 + i, t[: len(t) // 2] + "#" + t[len(t) // 2 + 2 :]) for i, t in rows if len(t) > 200]
    prints = dict(zip([i for i, _ in rows], fingerprint.fingerprints([t for _, t in rows]), strict=True))
    real = [(a, b) for a in prints for b in prints if a < b and prints[a] != "00" and fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    links = fingerprint.near_links(frame(spark, rows))
    group = {r.node: r.component for r in fingerprint.components(links).collect()}
    assert real and sum(group.get(a, a) == group.get(b, b) for a, b in real) >= 0.9 * len(real)


# --- pipeline: which of several rows stays


def test_of_rows_that_repeat_the_first_by_their_other_columns_stays(spark, sf_small):
    rows = [(1, "some text that is here", s) for s in ("c", "a", "b")] + [(2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 3):
        assert sorted(r.source for r in pipeline.near_copy_stage(spark, docs.repartition(parts), sf_small).collect()) == ["a", "z"]


def test_near_copies_send_no_table_to_the_driver(spark, sf_small, odd_docs, repeated_docs, monkeypatch):
    """Whatever Spark's size check would allow, no plan of the stage broadcasts: all its tables grow with the corpus."""
    plans, real = [], Scratch.table

    def table(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    monkeypatch.setattr(jaccard, "CHUNK", 2000)
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "1g")
    try:
        for docs in (odd_docs, repeated_docs):
            plans.append(pipeline.near_copy_stage(spark, docs, sf_small)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set(size, before)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
