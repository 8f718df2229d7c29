"""Benchmark decontamination: BM25 with block-max WAND over test items, then question and answer overlap.

Test items are cut into units of at most UNIT tokens and indexed once; each posting list is sorted by unit and
cut into blocks that know their largest impact.  Impacts are BM25 term weights divided by the unit's own total,
so a unit's copy scores 1 and one threshold serves short and long items alike.

Every training passage (PASSAGE tokens, half overlapping, so each unit lies whole in some passage) is a query
that retrieves all units above the threshold, not a top k.  The pivot rule of WAND with a fixed threshold says
that a unit can only reach it if its essential terms (the heaviest, with ESSENTIAL of its total) bring in what the
other terms together leave open.  That bound is taken for all passages of a document at once, on arrays; passages
that pass it for some unit go through block-max WAND.
Retrieved items are then verified on the whole document: five-word shingles of the item's question and of its
answer (what follows the last question mark, or else the last quarter) must be found again.

The benchmark is cut into shards of about SHARD_BYTES.  Document frequencies and mean lengths are those of the whole
benchmark, so results do not depend on the cut.  Executors build one index a shard, and each index, whose size the
shard bounds, is broadcast; a worker holds one of them at a time and takes blocks of documents through all shards.
Documents are read once and never shuffled.

Defined results: tokens are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; an item
with fewer words than a shingle is one shingle; null or empty texts and items without tokens match nothing; rows
that repeat are judged alike; null item ids are ignored; empty tables give no matches; other columns are kept,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarrylens.llm import textkit as tk
from quarrylens.llm.rows import pack, pick, unpack
from quarrylens.session import Scratch, ship_package

UNIT, PASSAGE, THRESHOLD, ESSENTIAL = 64, 128, 0.6, 0.85
SHINGLE, QUESTION_SHARE, ANSWER_SHARE = 5, 0.8, 0.5
K1, B, BLOCK = 1.2, 0.75, 64
SHARD_BYTES, HELD_BYTES = 16 << 20, 64 << 20
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the tokens of text."""
    raw = tk.encode(text, lower=True)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _GAP[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return tk.span_hashes(raw, edges[0::2], edges[1::2])


def question_and_answer(text: str) -> tuple[str, str]:
    """Split after the last question mark that something follows; else the last quarter of the words answers."""
    head, mark, tail = text.rpartition("?")
    if mark and tail.strip():
        return head + mark, tail
    words = text.split()
    cut = len(words) - len(words) // 4
    return " ".join(words[:cut]), " ".join(words[cut:])


class Statistics:
    """What BM25 weights need of the whole benchmark: units, their mean length, units that have each term."""

    def __init__(self, n_units: int, mean: float, terms: np.ndarray, df: np.ndarray):
        by = np.argsort(terms)
        self.n_units, self.mean, self.terms, self.df = n_units, mean, terms[by], df[by]

    @classmethod
    def of(cls, units: list[np.ndarray]) -> Statistics:
        seen = np.concatenate([np.unique(u) for u in units]) if units else np.zeros(0, np.uint64)
        terms, df = np.unique(seen, return_counts=True)
        return cls(len(units), sum(map(len, units)) / max(len(units), 1), terms, df)


def _units(t: np.ndarray) -> list[np.ndarray]:
    return [t[lo : lo + UNIT] for lo in range(0, len(t), UNIT)]


class _Runs:
    """Many short arrays as one flat array."""

    def __init__(self, parts: list[np.ndarray]):
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]


class ItemIndex:
    """Block-max inverted index of test items, in flat arrays."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, statistics: Statistics | None = None):
        self.threshold = threshold
        questions, answers, units, ids, unit_item = [], [], [], [], []
        for item, text in sorted(items):
            t = tokens(text)
            if not len(t):
                continue
            question, answer = (tk.shingle_set(tokens(x), SHINGLE) for x in question_and_answer(text))
            questions.append(question), answers.append(answer)
            own = _units(t)
            units += own
            unit_item += [len(ids)] * len(own)
            ids.append(item)
        self.item_ids, self.unit_item = np.array(ids, np.int64), np.array(unit_item, np.int64)
        self.questions, self.answers = _Runs(questions), _Runs(answers)
        s = statistics or Statistics.of(units)
        lengths = np.array([len(u) for u in units], np.int64)
        token, unit = np.concatenate([*units, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(units)), lengths)
        by = np.lexsort((unit, token))
        token, unit = token[by], unit[by]
        new = np.append(True, (token[1:] != token[:-1]) | (unit[1:] != unit[:-1]))[: len(token)]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(token)))
        term, unit = token[first], unit[first]
        df = s.df[np.searchsorted(s.terms, term)]
        weight = np.log(1 + (s.n_units - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[unit] / max(s.mean, 1e-9)))
        impact = weight / np.bincount(unit, weight, len(units))[unit]
        # postings by term, then unit; their blocks start anew with each term
        self.terms, start = np.unique(term, return_index=True)
        self.post_at = np.append(start, len(term))
        self.post_unit, self.post_impact = unit, impact
        sizes = np.diff(self.post_at)
        self.top = np.maximum.reduceat(impact, start) if len(start) else np.zeros(0)
        blocks = -(-sizes // BLOCK)
        self.block_at = np.concatenate(([0], np.cumsum(blocks))).astype(np.int64)
        heads = np.repeat(start, blocks) + (np.arange(int(blocks.sum())) - np.repeat(self.block_at[:-1], blocks)) * BLOCK
        self.block_last = unit[np.append(heads[1:], len(term))[: len(heads)] - 1]
        self.block_top = np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0)
        # essential terms: the heaviest of each unit
        by = np.lexsort((term, -weight, unit))
        run = np.cumsum(impact[by]) - impact[by]
        starts = np.flatnonzero(np.append(True, unit[by][1:] != unit[by][:-1])[: len(by)])
        run -= np.repeat(run[starts], np.diff(np.append(starts, len(by))))
        heavy = by[run < max(ESSENTIAL, 1.05 - threshold)]
        mass = np.bincount(unit[heavy], impact[heavy], len(units))
        self.need = threshold - (1 - mass) - 1e-9
        heavy = heavy[np.lexsort((unit[heavy], term[heavy]))]
        self.essential, at = np.unique(term[heavy], return_index=True)
        self.first = np.append(at, len(heavy))
        self.essential_unit, self.essential_impact = unit[heavy], impact[heavy]

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray] | None:
        """Units, impacts, largest impact, last unit and largest impact of each block of a term; None if no item has it."""
        i = int(np.searchsorted(self.terms, np.uint64(t)))
        if i == len(self.terms) or int(self.terms[i]) != t:
            return None
        p, b = slice(self.post_at[i], self.post_at[i + 1]), slice(self.block_at[i], self.block_at[i + 1])
        return self.post_unit[p], self.post_impact[p], float(self.top[i]), self.block_last[b], self.block_top[b]

    def retrieve(self, terms: list[int]) -> dict[int, float]:
        """Units whose summed impacts over distinct terms reach the threshold, by block-max WAND."""
        lists = [[p, 0] for t in sorted(set(terms)) if (p := self.postings(t)) is not None]
        out: dict[int, float] = {}
        limit = self.threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: x[0][0][x[1]])
            bound, pivot = 0.0, -1
            for i, (p, _) in enumerate(lists):
                bound += p[2]
                if bound >= limit:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = int(lists[pivot][0][0][lists[pivot][1]])
            while pivot + 1 < len(lists) and int(lists[pivot + 1][0][0][lists[pivot + 1][1]]) == unit:
                pivot += 1
            blocks, until = 0.0, None
            for p, _ in lists[: pivot + 1]:
                b = int(np.searchsorted(p[3], unit))
                if b < len(p[3]):
                    blocks += p[4][b]
                    until = int(p[3][b]) if until is None else min(until, int(p[3][b]))
            if blocks >= limit:
                if int(lists[0][0][0][lists[0][1]]) == unit:
                    score = sum(float(p[1][at]) for p, at in lists[: pivot + 1] if int(p[0][at]) == unit)
                    if score >= limit:
                        out[unit] = score
                    to = unit + 1
                else:
                    to = unit
            else:  # no unit up to the nearest block end can reach the threshold from these lists
                to = max(unit, until or unit) + 1
                if pivot + 1 < len(lists):
                    to = min(to, int(lists[pivot + 1][0][0][lists[pivot + 1][1]]))
                to = max(to, unit + 1)
            for x in lists[: pivot + 1]:
                x[1] += int(np.searchsorted(x[0][0][x[1] :], to))
            lists = [x for x in lists if x[1] < len(x[0][0])]
        return out

    def passages(self, t: np.ndarray, step: int) -> list[int]:
        """Passages (of two steps each) in which the essential terms of some unit reach what it needs."""
        at = np.minimum(np.searchsorted(self.essential, t), len(self.essential) - 1)
        hot = np.flatnonzero(self.essential[at] == t)
        if not len(hot):
            return []
        lo, n = self.first[at[hot]], self.first[at[hot] + 1] - self.first[at[hot]]
        posting = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        place = np.repeat(hot // step, n)
        once = np.unique(place * len(self.essential_unit) + posting)  # a term counts once in each step
        place, posting = once // len(self.essential_unit), once % len(self.essential_unit)
        n_units = len(self.need)
        keys, back = np.unique(place * n_units + self.essential_unit[posting], return_inverse=True)
        score = np.bincount(back, self.essential_impact[posting])
        after = np.minimum(np.searchsorted(keys, keys + n_units), len(keys) - 1)
        both = score + np.where(keys[after] == keys + n_units, score[after], 0.0)
        return np.unique(keys[both >= self.need[keys % n_units]] // n_units).tolist()

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """Ids of the items whose question and answer the document holds, each with its best passage's score."""
        t = tokens(text)
        if not len(t) or not len(self.essential):
            return []
        step = PASSAGE // 2
        best: dict[int, float] = {}
        for w in self.passages(t, step):
            for unit, score in self.retrieve(t[w * step : w * step + PASSAGE].tolist()).items():
                item = int(self.unit_item[unit])
                best[item] = max(best.get(item, 0.0), score)
        if not best:
            return []
        have = tk.shingle_set(t, SHINGLE)
        found = []
        for item in sorted(best):
            if self._held(self.questions[item], have, t) >= QUESTION_SHARE and self._held(self.answers[item], have, t) >= ANSWER_SHARE:
                found.append((int(self.item_ids[item]), best[item]))
        return found

    @staticmethod
    def _held(part: np.ndarray, have: np.ndarray, t: np.ndarray) -> float:
        """Share of part's shingles that the document has; a short part is one shingle of fewer words."""
        if not len(part):
            return 1.0
        both = len(np.intersect1d(part, have, assume_unique=True)) / len(part)
        if both or len(part) > 1:
            return both
        return max(float(np.isin(part, tk.window_hashes(t, k))[0]) for k in range(1, SHINGLE + 1))


HIT = StructField("hits", ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType())])))
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))


class _Match:
    """Batches with a column text, and one more, hits: items that the text holds, with scores, by shard, then item."""

    def __init__(self, shards: list[Broadcast]):
        self.shards = shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = pickle.loads(self.shards[0].value) if len(self.shards) == 1 else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if alone is not None or size > HELD_BYTES:
                yield from self._block(held, alone)
                held, size = [], 0
        if held:
            yield from self._block(held, alone)

    def _block(self, held: list[pa.RecordBatch], alone: ItemIndex | None) -> Iterator[pa.RecordBatch]:
        hits: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in held]
        for shard in self.shards:
            index = alone or pickle.loads(shard.value)
            if alone is None:
                shard.__dict__.pop("_value", None)  # the worker keeps one index, not all
            for batch, found in zip(held, hits, strict=True):
                for text, own in zip(batch.column("text"), found, strict=True):
                    own += [{"item_id": i, "score": round(x, 6)} for i, x in index.leaks(text.as_py())]
        for batch, found in zip(held, hits, strict=True):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _HITS)], names=[*batch.schema.names, "hits"])


def _unit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, term and units that have it, within a batch; term null: units and tokens of the batch."""
    for batch in batches:
        shard, term, n, size = [], [], [], []
        for k, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
            t = tokens(text)
            units = _units(t)
            seen, counts = np.unique(np.concatenate([np.unique(u) for u in units] + [np.zeros(0, np.uint64)]), return_counts=True)
            shard += [k] * (len(seen) + 1)
            term += [*seen.view(np.int64).tolist(), None]
            n += [*counts.tolist(), len(units)]
            size += [*([0] * len(seen)), len(t)]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(term, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["shard", "term", "n", "size"])


class _Build:
    """Rows sorted by shard and kind (term and frequency, then item and text): one index a shard."""

    def __init__(self, threshold: float, n_units: int, mean: float):
        self.threshold, self.n_units, self.mean = threshold, n_units, mean

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms, df, items = None, [], [], []
        for batch in batches:
            for shard, kind, key, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and now is not None:
                    yield self._index(now, terms, df, items)
                    terms, df, items = [], [], []
                now = shard
                if kind:
                    items.append((key, text))
                else:
                    terms.append(key), df.append(n)
        if now is not None:
            yield self._index(now, terms, df, items)

    def _index(self, shard: int, terms: list[int], df: list[int], items: list[tuple[int, str]]) -> pa.RecordBatch:
        s = Statistics(self.n_units, self.mean, np.array(terms, np.int64).view(np.uint64), np.array(df, np.int64))
        blob = pickle.dumps(ItemIndex(items, self.threshold, s), pickle.HIGHEST_PROTOCOL)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])


def shipped_index(benchmark: DataFrame, threshold: float = THRESHOLD) -> list[Broadcast]:
    """The benchmark's index, a broadcast for each shard (one at least)."""
    spark = benchmark.sparkSession
    scratch, items = Scratch(spark, "benchmark"), pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_shards = max(1, -(-n_bytes // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)).cast("int").alias("shard")
    items = items.select(shard, F.col("item_id").cast("long").alias("item_id"), "text")
    counts = scratch.table(items.mapInArrow(_unit_terms, "shard int, term long, n long, size long"), "terms")
    n_units, n_tokens = counts.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    terms = counts.where("term is not null").select("shard", "term").distinct().join(df, "term")
    none, rows = F.lit(None).cast("string").alias("text"), items.select("shard", F.lit(1).alias("kind"), F.col("item_id").alias("key"), F.lit(0).cast("long").alias("n"), "text")
    rows = rows.unionByName(terms.select("shard", F.lit(0).alias("kind"), F.col("term").alias("key"), "n", none))
    built = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "key").mapInArrow(_Build(threshold, n_units, n_tokens / max(n_units, 1)), "shard int, blob binary")
    built = scratch.table(built, "index")
    out = []
    for k in range(n_shards):
        row = built.where(F.col("shard") == k).first()  # the driver holds one shard's index at a time
        if row is not None:
            out.append(spark.sparkContext.broadcast(bytes(row.blob)))
    return out or [spark.sparkContext.broadcast(pickle.dumps(ItemIndex([], threshold)))]


def _matched(packed: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """packed, which has a column text, with the column hits."""
    ship_package(packed.sparkSession)
    return packed.mapInArrow(_Match(shipped_index(benchmark, threshold)), StructType([*packed.schema.fields, HIT]))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id and score of every document and test item that it holds; clean documents have no row."""
    hits = _matched(pick(docs, "doc_id", "text"), benchmark, threshold).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", F.col("h.item_id").alias("item_id"), F.col("h.score").alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, all columns kept."""
    found = _matched(pack(docs, "text"), benchmark, threshold)
    return unpack(found.where(F.size("hits") == 0), docs, "text")
