"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids.

Writing ranges documents by id, sorts inside each range and encodes there, so a file holds a contiguous run of
ids and its stripes carry min/max and Bloom metadata that prune lookups.  Reading goes stripe by stripe in
parallel.  Text is moved once, token ids never.

Encoding is the tokenizers library's.  A byte-level vocabulary encodes every pre-token on its own, so pre-tokens
that were seen before come from a table in the worker and only new ones go through the library; texts with
control characters or letters beyond U+024F, where regex engines may differ in class tables, go to it whole, and so do
texts that hold an added token such as <|endoftext|>, which becomes that token's id, as in the library.

Defined results: a null text is stored as its end id alone; rows with equal ids (null ids too, which come
first) stand in the order of their texts' hashes, so that a hot id is dealt to many files; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrylens.llm.rows import pick
from quarrylens.session import Scratch, ship_package

END_ID = 2
STORE_SCHEMA = "part int, pos long, doc_id long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
_ENCODERS: dict[str, Encoder] = {}
_CACHE_LIMIT = 650_000


#: letters, digits and white space below U+0250, where the classes of all regex engines agree
_LETTER, _DIGIT, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\x0b\\x0c\\r\\xa0"
#: the byte-level split; contractions come after words and numbers, which cannot start with their quote
_PIECE = re.compile(f" ?[{_LETTER}]+| ?[{_DIGIT}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_WHITE}{_LETTER}{_DIGIT}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fɐ-\U0010ffff]")
_LETTERS = frozenset(re.findall(f"[{_LETTER}]", "".join(map(chr, range(0x250)))))
_BLOCK = 1 << 20  # characters that are encoded together


def _odd(text: str) -> bool:
    """Whether the text has a character that the pieces are not defined for; most ASCII texts need no search."""
    return not (text.isascii() and text.replace("\n", "").isprintable()) and bool(_ODD.search(text))


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for; new ones are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Ids of texts by one tokenizer file; kept by the worker between tasks.

    known maps a pre-token to its row in ids/first, a table of id runs.  An added token in a text is that token, as
    the library has it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        kind = str(self.lib.pre_tokenizer)
        self.by_piece = self.lib.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self.by_piece &= not any(re.fullmatch(f"[{_LETTER} \n]*", t) for t in added)  # words sent together could make one
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.ids, self.first = np.zeros(0, np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.int32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def _age(self) -> None:
        """Make room if need be: pieces that came only once since they were learned go, and counts of the rest are halved."""
        if len(self.known) <= _CACHE_LIMIT:
            return
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > _CACHE_LIMIT // 2:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: _CACHE_LIMIT // 2])
        names, kept = list(self.known), _Numbered()
        kept.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        self.ids, n = self._runs(keep)
        self.known, self.first, self.used = kept, np.concatenate(([0], np.cumsum(n))), self.used[keep] // 2

    def _runs(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in these rows, one after another, and how many each has."""
        lo = self.first[row]
        n = self.first[row + 1] - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return self.ids[at], n

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __call__(self, text: str) -> list[int]:
        return self.block([text])[0].tolist()

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        plain = [self.by_piece and not _odd(t) and not (self.added and self.added.search(t)) for t in texts]
        rows, parts, counts, pieces = [], {}, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, (t, ok) in enumerate(zip(texts, plain, strict=True)):
            if ok and len(t) <= _BLOCK:
                rows.append(self._numbers(_PIECE.findall(t)))  # at once, while the pieces are in the processor's cache
                pieces[i] = len(rows[-1])
            elif ok:
                parts[i] = self._long(t)
            else:
                parts[i] = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.int32)
        flat, sizes = self._gather(np.concatenate([*rows, np.zeros(0, np.int64)]))
        self._age()
        ends = np.concatenate(([0], np.cumsum(pieces)))
        at = np.concatenate(([0], np.cumsum(sizes)))
        counts[:] = at[ends[1:]] - at[ends[:-1]]
        if not parts:
            return flat, counts
        out = []
        for i in range(len(texts)):
            run = parts.get(i, flat[at[ends[i]] : at[ends[i + 1]]])
            counts[i] = len(run)
            out.append(run)
        return np.concatenate(out), counts

    def _long(self, text: str) -> np.ndarray:
        """A very long text by bounded lists of pieces."""
        out, part = [], []
        for m in _PIECE.finditer(text):
            part.append(m.group())
            if len(part) == 1 << 18:
                out.append(self._gather(self._numbers(part))[0])
                part = []
        return np.concatenate([*out, self._gather(self._numbers(part))[0]])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Rows of pieces; those of new ones are learned before they are read."""
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in these rows and how many each has."""
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        self.used += np.bincount(row, minlength=len(self.used))
        return self._runs(row)

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces, in order, from the library.  Words after a space, and words alone with a line
        end between them, can be sent as one text: each stays a piece of its own there, and the library tells which piece an id belongs to."""
        spaced, bare, rest = [], [], []
        for i, p in enumerate(new):  # a piece with a letter at its end is a word, or a contraction
            (spaced if p[0] == " " and p[-1] in _LETTERS else bare if p[0] in _LETTERS else rest).append(i)
        ids, sizes, order = [], [], []
        groups = [(g[i : i + 500], between) for g, between in ((spaced, ""), (bare, "\n")) for i in range(0, len(g), 500)]
        texts = [between.join(["", *(new[i] for i in g)]) for g, between in groups]
        for (group, between), got in zip(groups, self.lib.encode_batch(texts, add_special_tokens=False), strict=True):
            word, run = np.array(got.word_ids, np.int64), np.array(got.ids, np.int32)
            if between:  # every second piece is a line end
                run, word = run[word % 2 == 1], word[word % 2 == 1] // 2
            n = np.bincount(word, minlength=len(group))
            if len(n) != len(group) or not n.all():
                rest += group
                continue
            ids.append(run), sizes.append(n), order.append(np.array(group))
        runs = [e.ids for e in self.lib.encode_batch([new[i] for i in rest], add_special_tokens=False)]
        ids.append(np.fromiter(itertools.chain.from_iterable(runs), np.int32)), sizes.append(np.fromiter(map(len, runs), np.int64, len(runs))), order.append(np.array(rest, np.int64))
        flat, size, by = np.concatenate(ids), np.concatenate(sizes), np.argsort(np.concatenate(order))
        lo, n = (np.cumsum(size) - size)[by], size[by]
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        self.ids = np.concatenate((self.ids, flat[at].astype(self.ids.dtype)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n)))
        self.used = np.concatenate((self.used, np.zeros(len(n), np.int64)))


def _trim() -> None:
    """Give memory that earlier tasks of this worker freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class _Write:
    def __init__(self, path: str, end_id: int | None):
        self.path, self.end = path, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = Encoder.of(self.path), TaskContext.get().partitionId(), 0
        _trim()
        gc.disable()  # millions of short-lived pieces and no cycles
        try:
            for batch in batches:
                texts, at, held = [], 0, 0
                for lo in range(0, batch.num_rows, 256):  # few texts are Python strings at a time
                    for i, text in enumerate(batch.column(1).slice(lo, 256).to_pylist(), lo):
                        texts.append(text or "")
                        held += len(texts[-1])
                        if held > _BLOCK or i == batch.num_rows - 1:
                            yield self._rows(encoder, part, pos, batch.column(0).slice(at, len(texts)), texts)
                            pos, at, texts, held = pos + len(texts), i + 1, [], 0
        finally:
            gc.enable()  # the worker lives on

    def _rows(self, encoder: Encoder, part: int, pos: int, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        flat, counts = encoder.block(texts)
        if self.end is not None:
            flat = np.insert(flat, np.cumsum(counts), self.end)
            counts = counts + 1
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), keys, pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))],
            names=["part", "pos", "doc_id", "n_tokens", "ids"],
        )


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a store, in ascending id order from partition to partition."""
    ship_package(docs.sparkSession)
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(_Write(tokenizer, end_id), STORE_SCHEMA)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, **columns: str) -> None:
    encoded(docs, tokenizer, end_id, **columns).write.options(**ORC_OPTIONS).orc(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of given documents; the filter reaches the stripes' statistics and Bloom filters."""
    return read_store(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"]
        )


def store_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the stored ids.

    Starts are sums inside a file plus the ids of the files before it: one row a file, at most as many as files.
    """
    ship_package(spark)
    store = read_store(spark, path)
    rows = store.select("part", "pos", "doc_id", "ids").mapInArrow(_checksums, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("pos")), F.lit(0))
    return rows.withColumn("_in", inside).join(files, "part").select("doc_id", (F.col("offset") + F.col("_in")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, path: str | None = None) -> DataFrame:
    """Write a store (to path, else to the shared folder), read it back and describe each document in it."""
    spark = docs.sparkSession
    path = path or Scratch(spark, "tokens").path("store.orc")
    write_store(docs, path, tokenizer, end_id)
    return store_index(spark, path)
