"""N-gram Jaccard join: exact links between documents whose shingle sets are similar, and their components.

* Classes: documents with equal sets (128 bits of them) are one point, stood for by their smallest id; only that
  document goes on.
* Routing: shingles have a common order (their hashes, but those that a sample finds in many texts come last, so that a
  passage which many texts share is no meeting place of them all; no link depends on the order).  If A and B have Jaccard >= t, then in the order, up to
  the 2 (1 - t) n + 2 first shingles of whichever ends first, more shingles are shared than not, so somewhere two
  shared shingles follow each other directly in both.  Each point therefore is sent to the meeting places of its
  neighbouring shingle pairs in that stretch, and no link can be missed.  Two shingles at once hardly ever meet
  by chance, and a passage that documents have in common is broken up by the rest of their text.  Keys travel
  packed, a blob for each batch and bucket.
* Count vectors: shingles are hashed to GROUPS groups, and a point is its count in each.  Two sets cannot share
  more than the summed minima of their coordinates.  Points that meet are kept in a packed R-tree over these
  vectors; a search drops every node whose upper corner bounds the overlap below what the threshold needs.
  The points of one meeting place that survive are joined into a forest, not pairs: what a search reaches leaves the
  tree, so that a group of near copies costs a few searches, not one comparison for each pair.
* Verification: the components of those forests are candidate clusters.  A cluster is solved in one task, or, if
  its sets are many, in chunks that each also hold some HUB documents of the whole cluster, which joins what is
  truly one group.  What then is not in the cluster's largest group meets every chunk once more.  In a task the
  R-tree again drops pairs, and the rest are compared set by set, but only while their documents are not yet in
  one component.  Verified forests give the final components.

Defined results: words are lower-cased in A-Z; fewer words than a shingle make one shingle; a null or empty text
has the empty set and links to nothing; rows with equal ids are one node, linked to whatever any of their texts links to; a null id belongs
to its class but never names a component (a class of null ids alone has component null); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm import textkit as tk
from quarrylens.llm.rows import pick
from quarrylens.operators.components import components
from quarrylens.session import MERGE, Scratch, ship_package

GROUPS = 32
DOCS_A_BUCKET = 1000  # a bucket gets about as many keys as this many documents have
CHUNK = 1_500_000  # shingles of a cluster's chunk
_LEAF = 16
SAMPLE, SAMPLE_SHINGLES = 8000, 4_000_000  # texts and shingles that tell which shingles are frequent, about
COMMON, COMMON_LEAST = 50_000, 4  # the most shingles that count as frequent, and in how many sampled texts they are
HUB = 64  # documents of a large cluster that go to all its chunks, about
_SIG = "doc_id long, n_shingles long, k1 long, k2 long, counts binary, keys binary"


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.int32)


class CountTree:
    """Packed R-tree over count vectors of similar-sized sets, in tiles of size order."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        spread = int(np.argmax(vectors.var(0))) if len(vectors) else 0
        tile = np.argsort(np.argsort(sizes, kind="stable")) // (_LEAF * _LEAF)
        self.order = np.lexsort((vectors[:, spread], tile))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.n, self.levels, self.left = len(sizes), [], [np.ones(len(sizes), np.int64)]
        top, lo, hi = self.vectors, self.sizes, self.sizes
        while len(top) > _LEAF:
            at = np.arange(0, len(top), _LEAF)
            top, lo, hi = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((top, lo, hi))
            self.left.append(np.add.reduceat(self.left[-1], at))

    def _fits(self, v: np.ndarray, n: int, top: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        least = np.maximum(lo, -(-self.percent * n // 100))
        room = (hi * 100 >= self.percent * n) & (lo * self.percent <= 100 * n)
        return room & (np.minimum(top, v).sum(1) >= needed(n, least, self.percent))

    def search(self, place: int) -> np.ndarray:
        """Places (in tree order) still in the tree whose summed minima with the point at place reach the needed overlap."""
        v, n = self.vectors[place], int(self.sizes[place])
        at: np.ndarray | None = None
        for (top, lo, hi), left in zip(reversed(self.levels), reversed(self.left[1:]), strict=True):
            at = np.arange(len(top)) if at is None else self._below(at, len(top))
            at = at[left[at] > 0]
            at = at[self._fits(v, n, top[at], lo[at], hi[at])]
        at = np.arange(len(self.vectors)) if at is None else self._below(at, len(self.vectors))
        at = at[self.left[0][at] > 0]
        return at[self._fits(v, n, self.vectors[at], self.sizes[at], self.sizes[at])]

    def remove(self, places: np.ndarray) -> None:
        """Take points that are in the tree out of it; searches pass over nodes that are empty."""
        self.n -= len(places)
        for left in self.left:
            np.subtract.at(left, places, 1)
            places = places // _LEAF

    @staticmethod
    def _below(at: np.ndarray, n: int) -> np.ndarray:
        out = (at[:, None] * _LEAF + np.arange(_LEAF)).ravel()
        return out[out < n]


class _Overlaps:
    """Sizes of intersections of one set with many, through an inverted index over the cluster's shingles."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        self.owner, ordered = owner[by], flat[by]
        self.keys, self.first = np.unique(ordered, return_index=True)
        self.first = np.append(self.first, len(ordered))
        self.sets, self.n = sets, len(sets)

    def of(self, i: int) -> np.ndarray:
        k = np.searchsorted(self.keys, self.sets[i])
        lo, hi = self.first[k], self.first[k + 1]
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.bincount(self.owner[at], minlength=self.n)


def forest(vectors: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the survivors' graph, or, given the sets, the exact links; points of one group are taken as
    joined already.  What a search reaches leaves the tree, so the points of one large group are not compared in pairs."""
    if len(sizes) < 2:
        return []
    tree = CountTree(vectors, sizes, percent)
    own = [sets[i] for i in tree.order] if sets is not None else None
    label = starts = by = None
    if group is not None:
        _, label, n = np.unique(group[tree.order], return_inverse=True, return_counts=True)
        by, starts = np.argsort(label, kind="stable"), np.concatenate(([0], np.cumsum(n)))
    overlaps, out, order = None, [], tree.order

    def reached(places: np.ndarray) -> list[int]:
        if label is not None:
            places = np.concatenate([by[starts[g] : starts[g + 1]] for g in np.unique(label[places])])
        tree.remove(places)
        return places.tolist()

    for start in range(len(sizes)):
        if not tree.left[0][start]:
            continue
        wait = reached(np.array([start]))
        while wait and tree.n:
            i = wait.pop()
            near = tree.search(i)
            if own is not None and len(near):
                if len(near) > 24:
                    overlaps = overlaps or _Overlaps(own)
                    both = overlaps.of(i)[near]
                else:
                    both = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in near])
                near = near[100 * both >= percent * (tree.sizes[i] + tree.sizes[near] - both)]
            if len(near):
                one = near if label is None else near[np.unique(label[near], return_index=True)[1]]
                out.extend((int(order[i]), int(order[j])) for j in one)
                wait += reached(near)
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _six(keys: np.ndarray) -> bytes:
    """Keys of 48 bits, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Join:
    """The steps that run in Python workers."""

    def __init__(self, words: int, percent: int, n_buckets: int = 64, common: np.ndarray | None = None):
        self.words, self.percent, self.n_buckets = words, percent, n_buckets
        self.common = np.zeros(0, np.uint64) if common is None else common  # sorted

    def shingles(self, text: str | None) -> np.ndarray:
        return tk.shingle_set(tk.word_hashes(text, lower=True), self.words)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Meeting places of a set: its neighbouring pairs in the stretch that a link must share, 48 bits each."""
        if len(self.common) and len(s):
            at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            last = self.common[at] == s
            s = np.concatenate((s[~last], s[last]))
        first = s[: 2 * (100 - self.percent) * len(s) // 100 + 2]
        return tk.mix(first[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:]) >> np.uint64(16)

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles (of the first SAMPLE_SHINGLES or so) that several of the texts have, most frequent first."""
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist() if n < SAMPLE_SHINGLES else ():
                held.append(self.shingles(text)[:SAMPLE_SHINGLES])
                n += len(held[-1])
                if n >= SAMPLE_SHINGLES:
                    break
        if n:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found = found[np.lexsort((found, -times))][: min(COMMON, int((times >= COMMON_LEAST).sum()))]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["shingle"])

    def signatures(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SIG.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = self.shingles(text)
                rows.append((key, len(s), *_set_key(s), count_vector(s).tobytes(), _six(self.keys(s))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names=names)

    def places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket and packed keys, set ids and documents, by batch; set ids (64 bits) tell copies of one set."""
        for batch in batches:
            keys, sets, docs, held = [], [], [], 0
            for doc, own, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = _from_six(blob)
                keys.append(k), sets.append(np.full(len(k), own, np.int64)), docs.append(np.full(len(k), doc, np.int64))
                held += len(k)
                if held > 1 << 21:
                    yield self._pack(keys, sets, docs)
                    keys, sets, docs, held = [], [], [], 0
            if held:
                yield self._pack(keys, sets, docs)

    def _pack(self, keys: list, sets: list, docs: list) -> pa.RecordBatch:
        key, own, doc = np.concatenate(keys), np.concatenate(sets), np.concatenate(docs)
        bucket = (key % np.uint64(self.n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        key, own, doc, bucket = key[by], own[by], doc[by], bucket[by]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = []
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
            blobs.append(_six(key[lo:hi]) + own[lo:hi].astype("<i8").tobytes() + doc[lo:hi].astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    @staticmethod
    def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for blob in blobs:
            n = len(blob) // 22
            parts.append((_from_six(blob[: 6 * n]), np.frombuffer(blob, "<i8", n, 6 * n), np.frombuffer(blob, "<i8", n, 14 * n)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def crowded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: place and smallest document of each set, where two different sets meet."""
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield self._crowded(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield self._crowded(blobs)

    def _crowded(self, blobs: list[bytes]) -> pa.RecordBatch:
        key, own, doc = self._unpack(blobs)
        by = np.argsort(key, kind="stable")
        near = np.zeros(len(key), bool)
        same = key[by][1:] == key[by][:-1]
        near[1:] |= same
        near[:-1] |= same
        by = by[near]
        key, own, doc = key[by], own[by], doc[by]
        by = np.lexsort((doc, own, key))
        key, own, doc = key[by], own[by], doc[by]
        if len(key):
            new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            key, doc = key[new], doc[new]
            same = key[1:] == key[:-1]
            keep = np.append(same, False) | np.append(False, same)
            key, doc = key[keep], doc[keep]
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(doc)], names=["place", "doc_id"])

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by place (and size): forests of the count-vector survivors of every meeting place."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            token = batch.column(0).to_numpy()
            cut = int(np.searchsorted(token, token[-1], "left")) if len(token) and token[0] != token[-1] else 0
            if len(token) and held and held[-1].column(0)[-1].as_py() != token[0]:
                yield self._meet(held)
                held = []
            if cut:
                yield self._meet([*held, batch.slice(0, cut)])
                held = []
            if len(token):
                held.append(batch.slice(cut))
        if held:
            yield self._meet(held)

    def _meet(self, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        token, doc, n = (t.column(i).to_numpy() for i in range(3))
        vectors = np.frombuffer(b"".join(t.column(3).to_pylist()), np.int32).reshape(len(token), -1)
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(first, len(token)))
        two = first[size == 2]  # most places: one pair
        ok = np.minimum(vectors[two], vectors[two + 1]).sum(1) >= needed(n[two], n[two + 1], self.percent)
        ok &= 100 * np.minimum(n[two], n[two + 1]) >= self.percent * np.maximum(n[two], n[two + 1])
        pairs = [np.stack((doc[two[ok]], doc[two[ok] + 1]), 1)]
        for lo, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            links = forest(vectors[lo : lo + k], n[lo : lo + k], self.percent)
            if links:
                pairs.append(doc[lo + np.array(links)])
        out = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def solve(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by task (component, lo, hi), with group, doc_id and text: exact forests of each task's documents."""
        task, ids, groups, sets = None, [], [], []
        for batch in batches:
            for *key, group, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != task and ids:
                    yield self._solve(ids, groups, sets)
                    ids, groups, sets = [], [], []
                task = key
                ids.append(doc), groups.append(group), sets.append(self.shingles(text))
        if ids:
            yield self._solve(ids, groups, sets)

    def _solve(self, ids: list[int], groups: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        links = forest(np.stack([count_vector(s) for s in sets]), sizes, self.percent, sets, np.array(groups, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], names=["a", "b"])


def _solved(join: Join, tasks: DataFrame, named: DataFrame) -> DataFrame:
    """Links found in tasks (component, lo, hi, group, doc_id)."""
    by = ["component", "lo", "hi"]
    rows = tasks.hint(MERGE).join(named, "doc_id").select(*by, "group", "doc_id", "text")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(join.solve, "a long, b long")


def _verified(join: Join, clusters: DataFrame, sizes: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the documents of each cluster (node, component) as their exact links do."""
    sized = clusters.hint(MERGE).join(sizes.withColumnRenamed("doc_id", "node"), "node")
    counts = sized.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("chunks"), F.count(F.lit(1)).alias("docs"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("docs")) < HUB)
    placed = scratch.table(sized.join(counts.hint(MERGE), "component").withColumn("i", chunk).withColumn("hub", hub), "clusters")
    tasks = placed.select("component", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("i"))).alias("lo"), F.lit(0).alias("hi"), F.col("node").alias("group"), F.col("node").alias("doc_id"))
    links = scratch.table(_solved(join, tasks, named), "links")
    large = placed.where("chunks > 1")
    if not large.head(1):
        return links
    joined = components(links).select("node", F.col("component").alias("group"))
    large = scratch.table(large.join(joined.hint(MERGE), "node", "left").withColumn("group", F.coalesce("group", "node")), "large")
    groups = large.groupBy("component", "group").agg(F.sum("n").alias("n"))
    rest = groups.groupBy("component").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"))
    rest = rest.select("component", F.col("most.group").alias("largest"), F.ceil((F.col("all") - F.col("most.n")) / F.lit(CHUNK)).cast("int").alias("parts")).where("parts > 0")
    open_ = large.join(rest.hint(MERGE), "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    at = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: at(F.col("i"), k))
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: at(j, F.col("part")))
    tasks = open_.select("component", "group", "node", F.explode(F.when(F.col("group") == F.col("largest"), own).otherwise(F.array_union(own, every))).alias("t"))
    tasks = tasks.select("component", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), "group", F.col("node").alias("doc_id"))
    return links.unionByName(scratch.table(_solved(join, tasks, named), "links"))


def common_shingles(rows: DataFrame, words: int, percent: int) -> np.ndarray:
    """Shingles that a sample of about SAMPLE texts finds to be frequent; they only order the search, and any set would
    give the same links."""
    total = rows.count()
    some = rows.where(F.rand(1) * total < SAMPLE).select("text")
    found = some.coalesce(1) if total <= SAMPLE else some.repartition(1)
    return np.sort(np.array([r.shingle for r in found.mapInArrow(Join(words, percent).counted, "shingle long").collect()], np.int64).astype(np.uint64))  # COMMON at most


def similar_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links reach) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id is not null")
    common = common_shingles(rows, words, percent)
    sig = scratch.table(rows.mapInArrow(Join(words, percent, common=common).signatures, _SIG), "signatures")
    join = Join(words, percent, max(64, sig.count() // DOCS_A_BUCKET))
    full = sig.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    chosen = full.join(classes.hint(MERGE), ["k1", "k2", "doc_id"], "left_semi")  # ids that are null stand for no class
    points = scratch.table(chosen.select("doc_id", F.col("n_shingles").alias("n"), "k1", "counts", "keys"), "points")
    places = points.select("doc_id", "k1", "keys").mapInArrow(join.places, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    crowded = places.mapInArrow(join.crowded, "place long, doc_id long")
    met = crowded.join(points.select("doc_id", "n", "counts").hint(MERGE), "doc_id").select("place", "doc_id", "n", "counts")
    survivors = met.repartition("place").sortWithinPartitions("place", "n").mapInArrow(join.meet, "a long, b long").distinct()
    links = _verified(join, components(survivors), points.select("doc_id", "n").distinct(), named, scratch)
    # ids with several sets join the classes of all of them
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("doc_id")
    if several.head(1):
        own = full.select("doc_id", "k1", "k2").join(several.hint(MERGE), "doc_id").join(classes.withColumnRenamed("doc_id", "b").hint(MERGE), ["k1", "k2"])
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), "b"))
    final = components(links).select(F.col("node").alias("doc_id"), "component")
    named_classes = classes.join(final.hint(MERGE), "doc_id", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(scratch.table(named_classes, "classes").hint(MERGE), ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
