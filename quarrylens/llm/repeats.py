"""Substring dedup by seed and extend over words.

A window is WINDOW consecutive words of one document; every word covered by a window whose word sequence also
starts earlier (smaller doc_id, or the same document at an earlier start) is removed.

* Seeds: of every window the smallest hash of its SEED-word runs is its anchor (winnowing), so equal windows have
  equal anchors and about 2 / (WINDOW - SEED + 2) of all positions are anchors.
* Join: anchors meet by hash; one shuffle, sorted, finds anchors that two different texts share or that one text
  has twice.  Exact copies are one text here, stood for by their smallest id, and need no seeds of their own.
* Extend: a shared anchor is extended to the left and right to all windows that chose it.  They meet by 128 bits of
  their word sequence, and each group keeps its earliest start.  Extending pair by pair would need all pairs of the
  documents that share a passage, or lose windows that a document shares with another than the first.
* Maximal repeats: neighbouring removed windows join up into the longest runs of words that repeat (`spans`), and
  their words go.

No step makes pairs: a passage that k documents share costs k rows for each of its windows, and streams through
its task in sorted order without being held.  Of rows that meet in one batch all but the earliest are known to
repeat at once; they are dealt evenly, and only one row a batch goes to the task of a common anchor or window.

Defined results: a null or empty text has no words; a text with fewer words than a window keeps them all; null
ids come after all others; rows with equal ids count as one document if their texts are equal, else they are
ordered by text hash; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm import textkit as tk
from quarrylens.llm.rows import pick
from quarrylens.session import Scratch, ship_package

WINDOW, SEED = 20, 8
_LAST = (1 << 63) - 1  # stands for a null id in orders
_PROFILE = "doc_id long, h1 long, h2 long, n_words long, all_sha256 string, anchors array<long>, repeated array<boolean>, common array<long>"
_KEPT = "place long, h1 long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
_SLICE, _HELD = 1 << 16, 1 << 20
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)  # the second half of a window's 128 bits


def text_key(text: str) -> tuple[int, int]:
    """128 bits of the text's content."""
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _window_least(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    have, out = 1, h
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Seeds:
    def __init__(self, window: int, seed: int, texts: bool = True):
        self.window, self.seed, self.texts = window, seed, texts

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of every window, and the hashes of all seed runs."""
        if len(words) < self.window:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        runs = tk.window_hashes(words, self.seed)
        return _window_least(runs, self.window - self.seed + 1), runs

    def profile(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = tk.encode(text)
                starts, ends = tk.word_spans(raw)
                least, runs = self.of(tk.span_hashes(raw, starts, ends))
                anchors = np.unique(least)
                ordered = np.sort(runs)
                twice = np.searchsorted(ordered, anchors, "right") - np.searchsorted(ordered, anchors, "left") > 1
                whole = hashlib.sha256(b" ".join(raw.split())).hexdigest()
                rows.append((key, *text_key(text or ""), len(starts), whole, anchors.view(np.int64), twice))
                held += len(anchors)
                if held > 1 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of a batch.  An anchor that two texts of the batch share stays with the first of them, as repeated;
        with the others it is common."""
        cols = list(zip(*rows, strict=True)) or [()] * 7
        sizes = np.array([len(a) for a in cols[5]], np.int64)
        anchors = np.concatenate([*cols[5], np.zeros(0, np.int64)])
        twice, owner = np.concatenate([*cols[6], np.zeros(0, bool)]), np.repeat(np.arange(len(rows)), sizes)
        place = np.array([_LAST if k is None else k for k in cols[0]], np.int64)[owner]
        h1 = np.array(cols[1], np.int64)[owner]
        by = np.lexsort((h1, place, anchors))
        new = np.append(True, anchors[by][1:] != anchors[by][:-1])[: len(by)]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        several = (np.minimum.reduceat(h1[by], starts) != np.maximum.reduceat(h1[by], starts))[group] if len(by) else np.zeros(0, bool)
        common = np.zeros(len(anchors), bool)
        common[by] = several & ~new
        twice = twice.copy()
        twice[by] |= several & new

        def lists(mask: np.ndarray, values: np.ndarray) -> pa.ListArray:
            n = np.bincount(owner[mask], minlength=len(rows))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values[mask]))

        arrays = [pa.array(c, k) for c, k in zip(cols[:5], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        arrays += [lists(~common, anchors), lists(~common, twice), lists(common, anchors)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PROFILE.split(", ")])

    def extend(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """128-bit hashes of all windows whose anchor is among the shared anchors of their document.

        A window that came earlier in the batch goes for sure; such rows are marked and dealt evenly, so that a
        word repeated ten thousand times, or a passage of many documents, does not meet in one task."""
        for batch in batches:
            found, held = [], 0
            for order, h1, text, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text_key(text or "")[0] != h1:
                    continue  # another text under the same id
                words = tk.word_hashes(text)
                least, _ = self.of(words)
                known = np.sort(np.array(shared, np.int64).view(np.uint64))
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
                other = tk.window_hashes(tk.mix(words + _OTHER), self.window, int(_OTHER))
                found.append((tk.window_hashes(words, self.window)[at], other[at], np.full(len(at), order), np.full(len(at), h1), at.astype(np.int32)))
                held += len(at)
                if held > _HELD:
                    yield from self._windows(found)
                    found, held = [], 0
            if found:
                yield from self._windows(found)

    @staticmethod
    def _windows(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        one, two, place, h1, start = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((start, h1, place, two, one))
        one, two, place, h1, start = (x[by] for x in (one, two, place, h1, start))
        again = np.append(False, (one[1:] == one[:-1]) & (two[1:] == two[:-1]))[: len(one)]
        row = again.copy()  # a row that is there twice: one document in two rows
        row[1:] &= (place[1:] == place[:-1]) & (h1[1:] == h1[:-1]) & (start[1:] == start[:-1])
        one, two, place, h1, start, again = (x[~row] for x in (one, two, place, h1, start, again))
        one[again] = tk.mix(start[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[again].view(np.uint64))
        for lo in range(0, len(one), _SLICE):
            part = slice(lo, lo + _SLICE)
            columns = (one[part].view(np.int64), two[part].view(np.int64), place[part], h1[part], start[part], again[part])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["window", "other", "place", "h1", "start", "again"])

    def keep(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each document once the words of the windows at the given starts are gone."""
        for batch in batches:
            out: list[tuple] = []
            for order, h1, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text_key(text or "")[0] != h1:
                    continue
                raw = tk.encode(text)
                lo, hi = tk.word_spans(raw)
                edge = np.zeros(len(lo) + 1, np.int64)
                s = np.array(starts, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + self.window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(raw[a:b] for a, b in zip(lo[~gone].tolist(), hi[~gone].tolist(), strict=True))
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                spans = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                out.append((order, h1, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "surrogatepass") if self.texts else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _KEPT.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, h1, place: the first place of each text, for anchors that two texts have or one has
    twice.  Holds one row between batches."""
    last: tuple | None = None  # the last first-row: anchor, h1, place, repeated, already sent
    for batch in batches:
        anchor, h1, place, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(anchor):
            continue
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (h1[1:] == h1[:-1])
        same[0] = last is not None and (anchor[0], h1[0]) == last[:2]
        anchor, h1, place, twice = (x[~same] for x in (anchor, h1, place, twice))
        sent = np.zeros(len(anchor), bool)
        if last is not None:
            anchor, h1, place, twice = (np.concatenate((np.array([v], x.dtype), x)) for v, x in zip(last[:4], (anchor, h1, place, twice), strict=True))
            sent = np.concatenate(([last[4]], sent))
        near = anchor[1:] == anchor[:-1]
        good = twice.copy()
        good[1:] |= near
        good[:-1] |= near
        now = good & ~sent
        last = (anchor[-1], h1[-1], place[-1], twice[-1], bool(good[-1] | sent[-1]))
        if now.any():
            yield pa.RecordBatch.from_arrays([pa.array(place[now]), pa.array(h1[now]), pa.array(anchor[now])], names=["place", "h1", "anchor"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window, other, place, h1, start: all but the first of each window, and those marked."""
    last: tuple | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(5)]
        if not len(cols[0]):
            continue
        before = [np.append(x[:1] if last is None else np.array([v], x.dtype), x[:-1]) for x, v in zip(cols, last or cols, strict=True)]
        again = (cols[0] == before[0]) & (cols[1] == before[1])
        if last is None:
            again[0] = False
        last = tuple(x[-1] for x in cols)
        again &= ~np.logical_and.reduce([x == y for x, y in zip(cols, before, strict=True)])  # one document in two rows
        again |= batch.column(5).to_numpy(zero_copy_only=False)
        if again.any():
            mask = pa.array(again)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (2, 3, 4)], names=["place", "h1", "start"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (the maximal repeats, in words) and, with texts, kept (null: all
    words stay, or none) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch, seeds = Scratch(spark, "repeats"), Seeds(window, seed, texts)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = scratch.table(rows.mapInArrow(seeds.profile, _PROFILE), "profile")
    place = F.coalesce("doc_id", F.lit(_LAST)).alias("place")
    firsts = profile.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    anchors = profile.select(place, "h1", F.explode(F.arrays_zip("anchors", "repeated")).alias("a")).select(F.col("a.anchors").alias("anchor"), "h1", "place", F.col("a.repeated").alias("repeated"))
    shared = anchors.repartition("anchor").sortWithinPartitions("anchor", "h1", "place").mapInArrow(_shared, "place long, h1 long, anchor long")
    shared = shared.unionByName(profile.select(place, "h1", F.explode("common").alias("anchor")))
    chosen = shared.groupBy("place", "h1").agg(F.collect_list("anchor").alias("shared"))  # at most a document's own anchors
    chosen = chosen.join(firsts.select("h1", F.col("first").alias("place")), ["place", "h1"], "left_semi")  # of copies one
    involved = scratch.table(rows.select(place, "text").join(chosen, "place").select("place", "h1", "text", "shared"), "involved")
    windows = involved.mapInArrow(seeds.extend, "window long, other long, place long, h1 long, start int, again boolean")
    later = windows.repartition("window").sortWithinPartitions("window", "other", "place", "h1", "start").mapInArrow(_later, "place long, h1 long, start int")
    starts = later.groupBy("place", "h1").agg(F.collect_set("start").alias("starts"))
    left = involved.select("place", "h1", "text").join(starts, ["place", "h1"]).mapInArrow(seeds.keep, _KEPT)
    left = left.dropDuplicates(["place", "h1"])
    # every later copy of a text loses all its words, or none if it has no window
    base = profile.select("doc_id", place, "h1", "h2", "n_words", "all_sha256")
    copy = (F.col("place") != F.col("first")) & (F.col("n_words") >= window)
    none, all_words = F.sha2(F.lit(""), 256), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    out = base.join(firsts, ["h1", "h2"]).join(left, ["place", "h1"], "left")
    kept = [F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, none).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(copy, all_words).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        *kept,
    )
