"""Document fingerprints by a randomised edit embedding, with banding and verification.

A text is walked by one pointer.  At step j the symbol under the pointer is put out, and a shared random bit of
(j, symbol) says whether the pointer moves on; walks over two texts fall into step again soon after an edit, so
edit distance becomes Hamming distance of the walks.  A fingerprint keeps the walk's symbols at sampled steps:
step j is sampled at octave e (the walk is shorter than 2**e) if its shared random number is below SAMPLES / 2**e,
so a longer walk's steps are a subset of a shorter one's and any two fingerprints can be compared.

Symbols are 8-bit hashes of code points; a fingerprint is the octave in two hex digits, then two hex digits for
each sampled step that the walk reached.  Likeness is the share of equal symbols among the steps of the coarser
octave that either walk reached.  Equal texts have equal fingerprints.

Walks run side by side for all texts of a batch, longest first, so each step is a few array operations; once few
are left, such as one very long text, they run one after another through blocks of steps.

Defined results: a null text is the empty text, whose fingerprint is `00` and which is like itself (1) and like
nothing else (0); rows with equal ids stand in text order, null ids last; a single row's next document is
itself; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.llm import textkit as tk
from quarrylens.llm.rows import pick
from quarrylens.operators.components import components
from quarrylens.session import Scratch, ship_package

SAMPLES, SEED = 256, 77
N_BANDS, BAND_SYMBOLS = 24, 6
_CUTS, _MOST_BUCKETS = 200, 20_000
_BATCH_CHARS = 1 << 24
_STEP_BLOCK = 4096
_FEW = 40  # walks that are faster one by one than side by side
_BITS: dict[int, np.ndarray] = {}
_STEPS: dict[int, np.ndarray] = {}
_PICKS: dict[int, list[np.ndarray]] = {}
_BLOCK = 1000  # members of a band that a task holds of each side


def _symbols(text: str) -> np.ndarray:
    """8-bit hash of each code point, never 0; 0 stands for the end of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (tk.mix(points + np.uint64(SEED)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _bits(block: int) -> np.ndarray:
    """Shared random bits for a block of steps, by symbol; symbol 0 never moves the pointer."""
    if block not in _BITS:
        if len(_BITS) > 256:
            _BITS.clear()
        bits = np.random.Generator(np.random.PCG64([SEED, block])).integers(0, 2, (_STEP_BLOCK, 256), dtype=np.uint8)
        bits[:, 0] = 0
        _BITS[block] = bits
    return _BITS[block]


def _fraction(lo: int, hi: int) -> np.ndarray:
    """The shared random number in [0, 1) of each step."""
    return (tk.mix(np.arange(lo, hi, dtype=np.uint64) + np.uint64(SEED << 32)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sampled_steps(octave: int, samples: int = SAMPLES) -> np.ndarray:
    """Steps below 2**octave that fingerprints of this octave keep, ascending."""
    if octave not in _STEPS:
        keep, size = [], 1 << octave
        for lo in range(0, size, 1 << 20):
            hi = min(size, lo + (1 << 20))
            keep.append(lo + np.flatnonzero(_fraction(lo, hi) < samples / size))
        _STEPS[octave] = np.concatenate(keep)
    return _STEPS[octave]


def octave_of(length: int) -> int:
    """Smallest octave whose 2**octave steps are at least three times the text's length."""
    return (3 * length - 1).bit_length() if length else 0


def walk(symbols: list[np.ndarray]) -> list[bytes]:
    """The symbols that each walk puts out at the sampled steps of its octave."""
    n = len(symbols)
    lengths = np.array([len(x) for x in symbols], np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    firsts = np.concatenate(([0], np.cumsum(size + 1)))  # one 0 after each text
    data = np.zeros(int(firsts[-1]) + 1, np.uint8)
    for rank, i in enumerate(order):
        data[firsts[rank] : firsts[rank] + size[rank]] = symbols[i]
    octaves = np.array([octave_of(int(x)) for x in size], np.int64)
    groups = []  # ranks lo to hi share an octave; column[step] is the place of a sampled step in their table
    for e in sorted({int(x) for x in octaves if x}, reverse=True):
        ranks = np.flatnonzero(octaves == e)
        steps = sampled_steps(e).tolist()
        groups.append((int(ranks[0]), int(ranks[-1]) + 1, dict(zip(steps, range(len(steps)), strict=True)), np.zeros((len(ranks), len(steps)), np.uint8)))
    wanted = set().union(*(g[2] for g in groups))
    pointer = firsts[:n].copy()
    active, step, last = int((size > 0).sum()), 0, 1 << int(octaves.max(initial=0))
    sampled = np.array(sorted(wanted), np.int64)
    group_of = [g for g in groups for _ in range(g[0], g[1])]
    while active and step < last:
        if active <= _FEW:
            stops = (sampled[np.searchsorted(sampled, step) : np.searchsorted(sampled, min(step + _STEP_BLOCK, last))] - step).tolist()
            for rank in range(active):
                lo, _, column, table = group_of[rank]
                pointer[rank] = _alone(data, int(pointer[rank]), step, min(_STEP_BLOCK, last - step), stops, column, table[rank - lo])
            step += _STEP_BLOCK
            alive = np.flatnonzero(data[pointer[:active]])
            active = int(alive[-1]) + 1 if len(alive) else 0
            continue
        bits = _bits(step // _STEP_BLOCK)
        at = pointer[:active]
        for j in range(min(_STEP_BLOCK, last - step)):
            symbol = data[at]
            if step + j in wanted:
                for lo, hi, column, table in groups:
                    if lo < active and step + j in column:
                        table[: min(hi, active) - lo, column[step + j]] = symbol[lo:hi]
            at += bits[j][symbol]
        step += _STEP_BLOCK
        alive = np.flatnonzero(data[at])
        active = int(alive[-1]) + 1 if len(alive) else 0
    out = [b""] * n
    for lo, hi, _, table in groups:
        for rank in range(lo, hi):
            row = table[rank - lo]
            out[order[rank]] = row[row != 0].tobytes()  # zeros stand only after the end of a walk
    return out


def _alone(data: np.ndarray, at: int, step: int, n: int, stops: list[int], column: dict[int, int], row: np.ndarray) -> int:
    """Takes one walk from the given place through n steps; writes its symbols at those stops that its octave samples."""
    moves = _bits(step // _STEP_BLOCK).tobytes()
    near = data[at : at + n + 1].tobytes()  # a walk moves by one at most
    p, j = 0, 0
    for stop in (*(s for s in stops if step + s in column), n):
        for base in range(j << 8, stop << 8, 256):
            p += moves[base + near[p]]
        j = stop
        if stop < n:
            row[column[step + stop]] = near[p]
    return at + p


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    symbols = [_symbols(t) for t in texts]
    return [f"{octave_of(len(x)):02x}{w.hex()}" for x, w in zip(symbols, walk(symbols), strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal symbols among the steps of the coarser octave that either walk reached."""
    if a == b:
        return 1.0
    ea, eb = int(a[:2], 16), int(b[:2], 16)
    if not ea or not eb:
        return 0.0
    e = max(ea, eb)
    steps = sampled_steps(e)
    sides = []
    for text, own in ((a, ea), (b, eb)):
        s = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
        if own < e:
            mine = sampled_steps(own)[: len(s)]
            s = s[np.isin(mine, steps)]
        sides.append(s)
    x, y = sides
    k, longest = min(len(x), len(y)), max(len(x), len(y))
    return float((x[:k] == y[:k]).sum() / longest) if longest else 0.0


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many first code points of the following text (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batch: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    """batch: id, text and next text; consecutive rows follow each other."""
    texts: dict[str, int] = {}
    plan = []
    for _, text, following in batch:
        changed = edited(text, following)
        plan.append(tuple(texts.setdefault(t, len(texts)) for t in (text, changed, following)) + (changed,))
    prints = fingerprints(list(texts))
    cols: list[list] = [[] for _ in range(7)]
    for (key, text, _), (a, b, c, changed) in zip(batch, plan, strict=True):
        row = (key, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), prints[a], prints[b], likeness(prints[a], prints[b]), likeness(prints[a], prints[c]))
        for col, value in zip(cols, row, strict=True):
            col.append(value)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, then descending id; a bucket's last row is only there to be the next document."""
    held: list[tuple[int | None, str, str]] = []
    chars, last = 0, None
    for batch in batches:
        for bucket, border, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if last is not None and last[0] == bucket:
                held.append((last[1], last[2], text))
                chars += len(last[2]) + len(text)
                if chars > _BATCH_CHARS:
                    yield from _rows(held)
                    held, chars = [], 0
            last = None if border else (bucket, key, text)
    if held:
        yield from _rows(held)


def _buckets(rows: DataFrame, rows_a_bucket: int) -> Column | None:
    """A column that maps ids to order-preserving buckets of similar size; None for an empty table.

    At most _CUTS quantiles cut the ids, and each range between two cuts is cut evenly again; null ids get -1.
    """
    n, least, most = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return None
    if least is None:
        return F.lit(-1).cast("long")
    n_buckets = max(1, -(-n // max(rows_a_bucket, n // _MOST_BUCKETS + 1)))
    n_cuts = min(_CUTS, n_buckets)
    found = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / n_cuts) for i in range(n_cuts))), F.lit(10 * n_cuts))).first()[0]
    lows = sorted({least, *found})
    parts = -(-n_buckets // n_cuts)
    which = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in lows)), lambda x: x <= F.col("doc_id")))
    low = F.element_at(F.array(*(F.lit(float(x)) for x in lows)), which)
    width = F.element_at(F.array(*(F.lit(float(b - a) / parts) for a, b in zip(lows, [*lows[1:], most + 1], strict=True))), which)
    part = F.least(F.floor((F.col("doc_id").cast("double") - low) / width), F.lit(parts - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(which * parts + part).cast("long")


def fingerprint_documents(docs: DataFrame, rows_a_bucket: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Each bucket of ids is sorted in its task, so texts move once.  The next document of a bucket's last row is
    the head of the next bucket below, so rows with a head's id also go one bucket up, and the first bucket's to
    the last; there is one head for each of at most _MOST_BUCKETS buckets.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket = _buckets(rows, rows_a_bucket)
    if bucket is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    heads = heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(Window.orderBy(F.desc("bucket"))), F.min("bucket").over(Window.partitionBy(F.lit(1)))).alias("above"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    own, up = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("border")), F.struct(F.col("above").alias("b"), F.lit(True).alias("border"))
    sent = rows.join(F.broadcast(heads), "bucket").select("doc_id", "text", F.explode(F.when(is_head, F.array(own, up)).otherwise(F.array(own))).alias("x"))
    sent = sent.select(F.col("x.b").alias("bucket"), F.col("x.border").alias("border"), "doc_id", "text")
    order = ["bucket", "border", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit(""))]
    return sent.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_chained, RESULT)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and band key: bit-sampled bands at a fingerprint's own octave and at the next coarser one."""
    for batch in batches:
        ids, bands = [], []
        for key, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            e = int(own[:2], 16)
            mine = np.frombuffer(bytes.fromhex(own[2:]), np.uint8)
            steps = sampled_steps(e)[: len(mine)]
            for octave in (e, e + 1):
                at = np.flatnonzero(np.isin(steps, sampled_steps(octave)[:SAMPLES])) if octave > e else np.arange(len(mine))
                limit = int(len(sampled_steps(octave)) * 0.3) + 1  # steps that a walk of this octave surely reaches
                at = at[: max(limit, 1)]
                for band, pick in enumerate(_picks(octave, limit)):
                    if pick.max() < len(at):
                        digest = hashlib.blake2b(bytes([octave, band]) + mine[at[pick]].tobytes(), digest_size=8).digest()
                        ids.append(key), bands.append(int.from_bytes(digest, "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int64())], names=["id", "band"])


def _picks(octave: int, limit: int) -> list[np.ndarray]:
    if octave not in _PICKS:
        _PICKS[octave] = [np.random.Generator(np.random.PCG64([SEED, octave, band])).integers(0, limit, BAND_SYMBOLS) for band in range(N_BANDS)]
    return _PICKS[octave]


def _like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, x, b, y = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([likeness(p, q) for p, q in zip(x, y, strict=True)], pa.float64())], names=["a", "b", "likeness"])


class _Rest:
    """Rows sorted by task: links among members of a band that are not yet in one group, each pair compared."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for *key, i, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != task and rows:
                    yield self._links(rows)
                    rows = []
                task = key
                rows.append((i, group, text))
        if rows:
            yield self._links(rows)

    def _links(self, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        ids, group = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        own = np.array([int(r[2][:2], 16) for r in rows])
        at = {e: self._table([r[2] for r in rows], own, e) for e in sorted(set(own.tolist()))}
        a, b, found = [], [], []
        for i in range(len(rows)):
            others = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
            for e in sorted(set(own[others].tolist())):
                js = others[own[others] == e]
                table, size = at[max(e, int(own[i]))]
                same = ((table[js] == table[i]) & (table[i] != 0)).sum(1) / np.maximum(np.maximum(size[js], size[i]), 1)
                for j, like in zip(js[same >= self.least].tolist(), same[same >= self.least].tolist(), strict=True):
                    if group[j] != group[i]:
                        a.append(ids[i]), b.append(ids[j]), found.append(like)
                        group[group == group[j]] = group[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())], names=["a", "b", "likeness"])

    @staticmethod
    def _table(prints: list[str], own: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the steps of octave e of those not coarser, a row each (0 after a walk's end), and how many."""
        steps = sampled_steps(e)
        table, size = np.zeros((len(prints), len(steps)), np.uint8), np.zeros(len(prints), np.int64)
        for i, text in enumerate(prints):
            if own[i] <= e:
                s = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
                if own[i] < e:
                    s = s[np.isin(sampled_steps(int(own[i]))[: len(s)], steps)]
                table[i, : len(s)], size[i] = s, len(s)
        return table, size


def _links(nodes: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b, likeness) among nodes (id, fingerprint), a stored table of unique ids.

    First every member of a band meets the band's smallest id.  In bands whose members are then not all in one group,
    every pair of different groups is compared too, in blocks of members.  So each two nodes that share a band are in one group or verified as unlike."""
    scratch = Scratch(nodes.sparkSession, "bands")
    keys = nodes.where(F.col("fingerprint") != "00").mapInArrow(_band_keys, "id long, band long").distinct()
    crowd = keys.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = scratch.table(keys.join(crowd, "band"), "keys")
    side = lambda i, f: nodes.select(F.col("id").alias(i), F.col("fingerprint").alias(f))
    pairs = keys.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    schema = "a long, b long, likeness double"
    first = scratch.table(pairs.select("a", "x", "b", "y").mapInArrow(_like, schema).where(F.col("likeness") >= least), "first")
    group = components(first).select(F.col("node").alias("id"), F.col("component").alias("group"))
    member = keys.where("n > 2").join(group, "id", "left").select("band", "id", "n", F.coalesce("group", "id").alias("group"))
    member = scratch.table(member, "members")
    open_bands = member.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("band")
    member = member.join(open_bands, "band").withColumn("chunks", F.ceil(F.col("n") / F.lit(_BLOCK)).cast("int"))
    i = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"))))
    member = member.select("band", "id", "group", task.alias("t")).join(nodes, "id").select("band", "t.lo", "t.hi", "id", "group", "fingerprint")
    rest = member.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "id").mapInArrow(_Rest(least), schema)
    return scratch.table(first.unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").dropDuplicates(["a", "b"]), "links")


def near_links(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Verified links (a, b, likeness) of texts that share a band, enough of them to join each group.  Ids must be unique."""
    ship_package(docs.sparkSession)
    rows = pick(docs, id="doc_id", text="text").select(F.col("id").cast("long").alias("id"), "text").where("id is not null")
    return _links(Scratch(docs.sparkSession, "prints").table(rows.mapInArrow(_prints, "id long, fingerprint string"), "prints"), least)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints([t or "" for t in batch.column(1).to_pylist()]), pa.string())], names=["id", "fingerprint"])


def grouped_fingerprints(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """fingerprint_documents with near_group: the smallest id that equal fingerprints and verified links of bands reach.

    A text without a fingerprint (`00`) is in a group of its own; a group of null ids alone has near_group null."""
    scratch = Scratch(docs.sparkSession, "groups")
    rows = scratch.table(fingerprint_documents(docs), "rows")
    nodes = rows.where(F.col("fingerprint") != "00").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    nodes = scratch.table(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    found = components(_links(nodes.select("id", "fingerprint"), least)).withColumnRenamed("node", "id")
    named = scratch.table(nodes.join(found, "id", "left").select("fingerprint", "least", F.coalesce("component", "id").alias("component")), "named")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("near_group")), "component").select("fingerprint", "near_group")
    out = rows.join(named, "fingerprint", "left")
    return out.select(*rows.columns, F.when(F.col("fingerprint") == "00", F.col("doc_id")).otherwise(F.col("near_group")).alias("near_group"))
