"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own bytes and words and those of its neighbours, and one of two states, good or
bad.  Forward-backward gives each line's probability of being good; a document's figure is their mean weighted
by line length, turned into a probability by a logistic curve fitted on the same training rows.

The model is fitted on at most MAX_TRAIN labelled ids, those with the smallest hashes among ids that may be
learned from, one text each (of several texts of an id the smallest), and on at most MAX_LINES of their lines:
texts are taken in hash order while their lines fit, and one of more than a tenth of MAX_LINES is not learned
from.  A training document gives its label to its lines.  Features of training rows are computed on the
executors; only they, N_FEATURES figures a line, reach the driver.  Scoring is one pass over the texts with no
shuffle, in blocks of at most BLOCK_LINES lines and the lines of one text.

Defined results: a null text or one without a word scores 0 (nothing of quality in it); repeated rows score
alike; an empty documents table gives an empty table; without any usable label every text with words scores
0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarrylens.llm import textkit as tk
from quarrylens.llm.rows import pack, pick, unpack
from quarrylens.session import Scratch, ship_package

MAX_TRAIN, MAX_LINES, ROUNDS, PENALTY = 4000, 200_000, 150, 1e-3
BLOCK_LINES = 20_000
_MARKS = b"!#$%&*|<>{}[]=_~^@/\\+"
_KINDS = ("lower", "upper", "digit", "space", "other_letter", "sentence", "mark")
_KIND = np.full(256, 6, np.int64)
for _i, _bytes in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b".,;:?'\"()-")):
    _KIND[list(_bytes)] = _i
OWN = (
    "lower", "upper", "digit", "space", "other_letter", "sentence", "mark", "bang", "bar", "doubled_mark", "marked_words", "log_words",
    "word_length", "distinct_words", "repeated_line", "short_line", "ends_sentence", "starts_upper", "long_words", "short_words", "stutter",
)
N_FEATURES = 3 * len(OWN) + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and byte lengths of the lines of text that hold a word."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(raw)]))
    ws, we = tk.word_spans(raw)
    if not len(ws):
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    line_of = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(line_of, minlength=len(starts))
    keep = np.flatnonzero(words)
    again = np.full(len(starts), -1)
    again[keep] = np.arange(len(keep))
    starts, ends, words = starts[keep], ends[keep], words[keep].astype(float)
    line_of = again[line_of]
    n, length = len(keep), np.maximum(ends - starts, 1).astype(float)

    of_kind = _KIND[data]
    out = np.zeros((n, len(OWN)))
    index = np.repeat(np.arange(n), ends - starts)
    inside = _ranges(starts, ends)
    out[:, :7] = np.bincount(index * 7 + of_kind[inside], minlength=7 * n).reshape(n, 7) / length[:, None]
    per = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), np.stack((starts, ends), 1).ravel())[::2] * (ends > starts)
    out[:, 7] = per(data == 33) / words
    out[:, 8] = per(data == 124) / words
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & (of_kind[1:] == 6)
    out[:, 9] = per(doubled) / words
    last = data[we - 1]
    out[:, 10] = np.bincount(line_of, of_kind[we - 1] == 6, n) / words
    out[:, 11] = np.log1p(words)
    lengths = we - ws
    out[:, 12] = np.bincount(line_of, lengths, n) / words
    hashes = tk.span_hashes(raw, ws, we)
    seen = np.unique(tk.mix(hashes + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out[:, 13] = np.bincount(line_of[seen], minlength=n) / words
    first = np.unique(tk.span_hashes(raw, starts, ends), return_index=True)[1]
    out[:, 14] = 1.0
    out[first, 14] = 0.0
    out[:, 15] = words < 4
    final = np.flatnonzero(np.append(line_of[1:] != line_of[:-1], True))
    out[:, 16] = np.isin(last[final], list(b".?!:\""))
    out[:, 17] = np.bincount(line_of, of_kind[ws] == 1, n) / words
    out[:, 18] = np.bincount(line_of, lengths > 12, n) / words
    out[:, 19] = np.bincount(line_of, lengths < 4, n) / words
    echo = np.append(False, (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1]))
    out[:, 20] = np.bincount(line_of, echo, n) / words

    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:], after[:-1] = out[:-1], out[1:]
    ends_of = np.zeros((n, 3))
    ends_of[0, 0] = ends_of[-1, 1] = 1.0
    ends_of[:, 2] = n == 1
    return np.concatenate((out, before, after, ends_of), 1), length


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, end)."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def _by_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chains by falling length, first row of each, and chains still active at each step."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    return order, first, active


def forward_backward(score: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of state 1 at each row, expected transitions (2 x 2), log partition, over chains of rows.

    score is the log potential of state 1 (state 0 has 0); move the log potentials of transitions.  All chains
    step together; messages are normalised at each step.
    """
    order, first, active = _by_step(lengths)
    n = len(score)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    emit = np.exp(np.stack((np.minimum(-score, 0), np.minimum(score, 0)), 1))  # scaled by exp(max(score, 0))
    trans = np.exp(move)
    for t, k in enumerate(active):
        at = first[:k] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ trans) * emit[at]
        z = a.sum(1)
        alpha[at], scale[at] = a / z[:, None], z
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        b = emit[at] * beta[at]
        down = (b @ trans.T) / scale[at][:, None]
        pairs += (alpha[at - 1][:, :, None] * trans * (b / scale[at][:, None])[:, None, :]).sum(0)
        beta[at - 1] = down
    good = alpha * beta
    return good[:, 1] / good.sum(1), pairs, float(np.log(scale).sum() + np.maximum(score, 0).sum())


@dataclass
class LineModel:
    """Weights of the chain and of the logistic curve from mean marginals to a document's probability."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (0.0, 0.0)

    def marginals(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.spread, -6, 6)
        return forward_backward(x @ self.weights[:-1] + self.weights[-1], lengths, self.move)[0]

    def documents(self, rows: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each chain; chains have at least one row."""
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return np.add.reduceat(self.marginals(rows, lengths) * weight, at) / np.add.reduceat(weight, at)

    def score(self, rows: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * (self.documents(rows, weight, lengths) - 0.5) + b)))


def fit(rows: np.ndarray, weight: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> LineModel:
    """Maximum likelihood of the labelled chains with a ridge penalty, by Adam over all chains at once."""
    model = LineModel(rows.mean(0), rows.std(0) + 1e-6)
    x = np.concatenate((np.clip((rows - model.mean) / model.spread, -6, 6), np.ones((len(rows), 1))), 1)
    y = np.repeat(labels, lengths).astype(float)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = ((lengths - 1) * (labels == 0)).sum(), ((lengths - 1) * (labels == 1)).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ theta[:-4], lengths, theta[-4:].reshape(2, 2))
        g = np.concatenate((x.T @ (y - p), (seen - pairs).ravel())) / len(x) - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    model.weights, model.move = theta[:-4], theta[-4:].reshape(2, 2)
    d = model.documents(rows, weight, lengths) - 0.5
    a, b = 4.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, with a small ridge
        p = 1 / (1 + np.exp(-(a * d + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(d * (labels - p)).sum() - 1e-2 * a, (labels - p).sum() - 1e-2 * b])
        h = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, grad)
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
    model.curve = (float(a), float(b))
    return model


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, weight = line_features(text or "")
            if len(weight):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [key], "quality": [label], "n": [len(weight)], "rows": [rows.astype(np.float32).tobytes()], "weight": [weight.astype(np.float32).tobytes()]},
                    schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("weight", pa.binary())]),
                )


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> LineModel:
    """Fit on the max_train labelled ids with the smallest hashes outside the held-out fold, within max_lines lines."""
    spark = docs.sparkSession
    ship_package(spark)
    labels = pick(labels, "doc_id", "quality")
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train ids
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "quality").agg(F.min("text").alias("text"))
    rows = Scratch(spark, "quality").table(rows.withColumn("lines", F.size(F.split("text", "\n"))), "labelled")
    some = rows.where(F.col("lines") <= max_lines // 10).withColumn("order", F.xxhash64("doc_id"))
    upto = F.sum("lines").over(Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = some.select("doc_id", "order", "lines").withColumn("upto", upto).where(F.col("upto") <= max_lines).select("doc_id")  # at most max_train rows
    rows = rows.join(F.broadcast(fits), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(_training_rows, "doc_id long, quality int, n int, rows binary, weight binary").collect()  # at most max_train ids and max_lines lines
    got.sort(key=lambda r: (r.doc_id, r.n, bytes(r.weight)))
    if len({r.quality for r in got}) < 2:
        return LineModel()
    return fit(
        np.concatenate([np.frombuffer(r.rows, np.float32).reshape(r.n, -1) for r in got]).astype(float),
        np.concatenate([np.frombuffer(r.weight, np.float32) for r in got]).astype(float),
        np.array([r.n for r in got]),
        np.array([r.quality for r in got]),
    )


class _Score:
    def __init__(self, model: LineModel):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = batch.column("text"), np.zeros(batch.num_rows)
            rows, weights, lengths, at, held = [], [], [], [], 0

            def flush() -> None:
                if at:
                    scores[at] = self.model.score(np.concatenate(rows), np.concatenate(weights), np.array(lengths))  # noqa: B023
                for x in (rows, weights, lengths, at):  # noqa: B023
                    x.clear()

            for i in range(batch.num_rows):
                x, w = line_features(texts[i].as_py() or "")
                if len(w):
                    rows.append(x), weights.append(w), lengths.append(len(w)), at.append(i)
                    held += len(w)
                    if held > BLOCK_LINES:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])


def _scored(packed: DataFrame, model: LineModel) -> DataFrame:
    """packed, which has a column text, with the column score."""
    ship_package(packed.sparkSession)
    return packed.mapInArrow(_Score(model), StructType([*packed.schema.fields, StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id and score of every row."""
    return _scored(pick(docs, "doc_id", "text"), model).select("doc_id", "score")


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_documents(docs, train(docs, labels, max_train))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score at least threshold, all columns kept whatever their names."""
    scored = _scored(pack(docs, "text"), train(docs, labels, max_train))
    return unpack(scored.where(F.col("score") >= threshold), docs, "text")
