"""Graph queries as loops of joins: callers, callees, impact, hierarchy, cycles.

Each level is one join of the frontier with the edges and one anti-join against what was visited; it is written to the
shared folder, so lineage stays short and lost executors cost one level.  Levels are merged into one table when there
are MERGE of them, so plans do not grow with the depth of a search.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylens.functions import rules
from quarrylens.operators.components import components
from quarrylens.session import Scratch, ship_package

MERGE = 8
IMPACT_KINDS = ("calls", "extends", "implements", "uses_type")
HIERARCHY_KINDS = ("extends", "implements")


def breadth_first(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] | None, forward: bool, most: int, floor: float | None = None, key: str | None = None) -> DataFrame:
    """(id, depth[, confidence][, key]) of what the seeds reach in at most `most` steps, without the seeds.

    Levels are synchronous: a node has the depth at which it is first met and, with floor, the best product of
    confidences among paths through the level before; weaker products than floor are dropped.  With key, each
    value of it is a search of its own."""
    spark, by = edges.sparkSession, ["id"] + ([key] if key else [])
    scratch = Scratch(spark, "bfs")
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    weight = F.col("confidence") if floor is not None else F.lit(1.0)
    links = scratch.table(links.groupBy(F.col(a).alias("id"), F.col(b).alias("to")).agg(F.max(weight).alias("w")), "links")
    seen = scratch.table(seeds.select(*by).distinct().withColumns({"depth": F.lit(0), "confidence": F.lit(1.0)}), "seeds")
    frontier, parts = seen, [seen]
    for depth in range(1, most + 1):
        step = frontier.join(links, "id").select(F.col("to").alias("id"), *by[1:], (F.col("confidence") * F.col("w")).alias("confidence"))
        if floor is not None:
            step = step.where(F.col("confidence") >= floor)
        step = step.groupBy(*by).agg(F.max("confidence").alias("confidence"))
        fresh = step.join(seen.select(*by), by, "left_anti").select(*by, F.lit(depth).alias("depth"), "confidence")
        frontier = scratch.table(fresh, "level")
        if not frontier.head(1):
            break
        parts.append(frontier)
        seen = reduce(DataFrame.unionByName, parts)
        if len(parts) > MERGE:
            seen = scratch.table(seen, "seen")
            parts = [seen]
    out = seen.where("depth > 0")
    return out if floor is not None else out.drop("confidence")


def callers(graph, name: str, most: int = 3) -> DataFrame:
    return breadth_first(graph.edges, graph.find(name), ("calls",), False, most)


def callees(graph, name: str, most: int = 3) -> DataFrame:
    return breadth_first(graph.edges, graph.find(name), ("calls",), True, most)


def impact(graph, name: str, most: int = 5) -> DataFrame:
    """What a change of a symbol reaches against the edges, with the confidence of the path."""
    return breadth_first(graph.edges, graph.find(name), IMPACT_KINDS, False, most, rules.IMPACT_FLOOR)


def affected_files(graph, reached: DataFrame) -> DataFrame:
    return reached.join(graph.nodes.select("id", "file"), "id").where(F.col("file").isNotNull()).select("file").distinct().orderBy("file")


def affected_modules(graph, reached: DataFrame) -> DataFrame:
    """Modules among the reached nodes; impact follows no edge that leads to one, so there are none in practice."""
    return reached.join(graph.nodes.where(F.col("type") == "module").select("id", "name"), "id").select("name").distinct()


def type_hierarchy(graph, name: str, direction: str = "both") -> DataFrame:
    """Supertypes (`up`), subtypes (`down`) or both, with a column that tells which."""
    out = []
    for side, forward in (("up", True), ("down", False)):
        if direction in (side, "both"):
            out.append(breadth_first(graph.edges, graph.find(name), HIERARCHY_KINDS, forward, rules.HIERARCHY_DEPTH).withColumn("direction", F.lit(side)))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def strong_components(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Component number of nodes 0 to n-1: depth-first orders forwards, then backwards, without recursion."""

    def lists(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(a, kind="stable")
        return np.searchsorted(a[by], np.arange(n + 1)), b[by]

    at, to = lists(src, dst)
    seen, order, nxt = np.zeros(n, bool), [], at[:-1].copy()
    for s in range(n):
        if seen[s]:
            continue
        seen[s], stack = True, [s]
        while stack:
            v = stack[-1]
            if nxt[v] < at[v + 1]:
                w = to[nxt[v]]
                nxt[v] += 1
                if not seen[w]:
                    seen[w] = True
                    stack.append(w)
            else:
                order.append(stack.pop())
    at, to = lists(dst, src)
    label = np.full(n, -1)
    for s in reversed(order):
        if label[s] >= 0:
            continue
        label[s], stack = s, [s]
        while stack:
            v = stack.pop()
            for w in to[at[v] : at[v + 1]]:
                if label[w] < 0:
                    label[w] = s
                    stack.append(w)
    return label


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, codes = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
    codes = codes.reshape(-1, 2)
    label = strong_components(codes[:, 0], codes[:, 1], len(ids))
    out = pd.DataFrame({"id": ids, "label": label})
    size, least = out.groupby("label")["id"].transform("size"), out.groupby("label")["id"].transform("min")
    return pd.DataFrame({"id": ids, "component": least})[size.to_numpy() > 1]


def _frontier_sets(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Strong components of edges too many for one task: each node takes the smallest id that reaches it, and
    those of a colour that reach its root are one component; the rest goes round again."""
    found, rest = None, edges
    while rest.head(1):
        both = rest.select(F.col("src").alias("id")).union(rest.select(F.col("dst").alias("id"))).distinct()
        colour = scratch.table(both.withColumn("c", F.col("id")), "colour")
        while True:
            better = rest.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            moved = scratch.table(colour.join(better, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("m")), "colour")
            colour = moved.select("id", "c")
            if not moved.where("m").head(1):
                break
        inside = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        roots = colour.where("id = c").select("id", F.col("c").alias("root"))
        own = inside.select("src", "dst", F.col("cs").alias("root"))
        back = own.select(F.concat_ws("\x1e", "dst", "root").alias("src"), F.concat_ws("\x1e", "src", "root").alias("dst"), F.lit(1.0).alias("confidence"))
        seeds = roots.select(F.concat_ws("\x1e", "id", "root").alias("id"))
        reach = breadth_first(back, seeds, None, True, 1 << 30).select("id").union(seeds).select(F.split("id", "\x1e").alias("p"))
        done = scratch.table(reach.select(F.col("p")[0].alias("id"), F.col("p")[1].alias("component")), "done")
        found = done if found is None else found.unionByName(done)
        gone = done.select("id")
        rest = scratch.table(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "rest")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes.select("component"), "component").select("id", "component")


def cycles(edges: DataFrame, kinds: tuple[str, ...] | None = None, most_edges: int = 2_000_000, trims: int = 3) -> DataFrame:
    """(id, component) of nodes in strong components of more than one node; component is the smallest id.

    Nodes that nothing enters or leaves are trimmed a few times; every weak component of what is left is solved
    in one task if it has at most most_edges edges, else by colouring."""
    spark = edges.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "cycles")
    left = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    left = left.where(F.col("src") != F.col("dst")).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    for _ in range(trims):
        left = scratch.table(left, "edges")
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    left = scratch.table(left, "edges")
    weak = components(left.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    dealt = scratch.table(left.join(weak.withColumnRenamed("node", "src"), "src"), "dealt")
    sizes = dealt.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = dealt.join(sizes.where(F.col("n") <= most_edges).select("component"), "component")
    out = small.groupBy("component").applyInPandas(_solve, "id string, component string")
    large = scratch.table(dealt.join(sizes.where(F.col("n") > most_edges).select("component"), "component").select("src", "dst"), "large")
    return out.unionByName(_frontier_sets(large, scratch)) if large.head(1) else out


def module_cycles(graph) -> DataFrame:
    return cycles(graph.edges, ("depends_on",)).join(graph.nodes.select("id", "name"), "id").select("component", "name")


