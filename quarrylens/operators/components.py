"""Connected components of a table of links.

Links that fit one task (at most SMALL rows, counted first) are solved there by hooking and pointer jumping.  More go
through alternating star operations: large-star hangs every larger neighbour of a node on the node's smallest
neighbour, small-star does so for the smaller ones; both only shuffle links, and links fall to a forest of depth one in
a few rounds.  Each round is written to the shared folder, which cuts lineage, and read back; nothing of the links
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from quarrylens.session import MERGE, Scratch, ship_package

SMALL = 1_000_000  # links that one task may solve


def labels(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and for each the smallest node that it reaches."""
    nodes, code = np.unique(np.concatenate((v, u)), return_inverse=True)
    a, b = code[: len(v)], code[len(v) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        differs = root[a] != root[b]
        a, b = a[differs], b[differs]
    return nodes, nodes[root]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    kind = table.schema.field(0).type
    v, u = (table.column(i).to_numpy() for i in range(2))
    nodes, least = labels(v, u)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(least, kind)], names=["node", "component"])


def _star(links: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """links: (v, u) with v > u.  Minimum over neighbours first (combined before the shuffle), then a join of two
    stored tables, in which Spark splits hot nodes."""
    both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u"))) if large else links
    least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
    hung = both.join(least.hint(MERGE), both["v"] == least["c"]).select(F.col("u").alias("w"), "m", "v")
    if large:
        out = hung.where(F.col("w") > F.col("v")).select(F.col("w").alias("v"), F.col("m").alias("u"))
    else:
        out = hung.select(F.explode(F.array(F.struct(F.col("w").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
    return scratch.table(out.where(F.col("v") != F.col("u")).distinct(), "star")


def _flat(links: DataFrame) -> bool:
    """Whether the links are stars already: each node hangs on one other, which hangs on none."""
    if links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        return False
    return not links.join(links.select(F.col("u").alias("v")).distinct().hint(MERGE), "v", "left_semi").head(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that it reaches."""
    spark = links.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "components")
    pairs = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col("v") != F.col("u")).distinct()
    now = scratch.table(pairs, "links")
    if now.count() <= SMALL:
        kind = now.schema["v"].dataType
        return scratch.table(now.coalesce(1).mapInArrow(_solve, StructType([StructField("node", kind), StructField("component", kind)])), "solved")
    while not _flat(now):
        wide = _star(now, scratch, True)
        scratch.drop(now)
        now = _star(wide, scratch, False)
        scratch.drop(wide)
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
