"""The knowledge graph of a code model: typed nodes, weighted edges, and figures over them.

Node ids are stable text keys (`kind:part:part`), so tables built in different jobs join.  Edges are a multigraph:
each fact row adds its own edge.  Of several rows that make the same node the first by (step, ordinal) wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators.components import components
from quarrylens.operators.resolve import exposed_symbols

NODE_COLUMNS = ("id", "type", "name", "file", "line", "kind", "method", "path")
EDGE_COLUMNS = ("src", "dst", "kind", "confidence")


def key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _node(df: DataFrame, step: int, of: str, id_: Column, **columns: Column) -> DataFrame:
    none = F.lit(None)
    types = {"line": "long"}
    order = columns.pop("ordinal", F.lit(0))
    return df.select(
        id_.alias("id"), F.lit(of).alias("type"), *((columns.get(c, none)).cast(types.get(c, "string")).alias(c) for c in NODE_COLUMNS[2:]), F.lit(step).alias("_step"), order.cast("long").alias("_ordinal")
    )


def _edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, confidence: Column | float = 1.0) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    c = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    return df.select(src.alias("src"), dst.alias("dst"), k.alias("kind"), c.cast("double").alias("confidence"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_facts(cls, facts: dict[str, DataFrame]) -> KnowledgeGraph:
        """facts: files, symbols, interfaces, data_models, references, modules.

        A call's target keeps its qualified text as its name, so it meets the definition only if the texts agree;
        symbols known from references alone are functions."""
        files, symbols, routes, models, refs, modules = (facts[k] for k in ("files", "symbols", "interfaces", "data_models", "references", "modules"))
        c = F.col
        nodes = [
            _node(modules, 1, "module", key("module", c("name")), name=c("name")),
            _node(files, 2, "file", key("file", c("path")), name=c("path"), file=c("path"), path=c("path")),
            _node(symbols, 3, "symbol", key("symbol", c("name"), c("file")), name=c("name"), file=c("file"), line=c("line"), kind=c("kind"), ordinal=c("line")),
            _node(routes, 4, "interface", key("interface", c("method"), c("path"), c("file")), name=F.concat_ws(" ", "method", "path"), file=c("file"), line=c("line"), method=c("method"), path=c("path"), ordinal=c("line")),
            _node(models, 5, "data_model", key("data_model", c("name"), c("file")), name=c("name"), file=c("file"), line=c("line"), kind=c("model_kind"), ordinal=c("line")),
        ]
        edges = [
            _edge(symbols, key("file", c("file")), key("symbol", c("name"), c("file")), "defines"),
            _edge(routes, key("file", c("file")), key("interface", c("method"), c("path"), c("file")), "defines"),
            _edge(models, key("file", c("file")), key("data_model", c("name"), c("file")), "defines"),
        ]
        linked = refs.where(c("reference_kind") != "import")
        target = F.when(c("target_file").isNotNull(), key("symbol", c("target_symbol"), c("target_file"))).otherwise(key("external", c("target_symbol")))
        kind = F.create_map(*(F.lit(x) for x in ("call", "calls", "extends", "extends", "implements", "implements", "type_usage", "uses_type")))[c("reference_kind")]
        edges.append(_edge(linked, key("symbol", c("source_symbol"), c("source_file")), target, kind, c("confidence")))
        nodes.append(_node(linked, 6, "symbol", key("symbol", c("source_symbol"), c("source_file")), name=c("source_symbol"), file=c("source_file"), line=c("source_line"), kind=F.lit("function"), ordinal=c("source_line")))
        inside, outside = refs.where(c("target_file").isNotNull()), refs.where(c("target_file").isNull())
        nodes.append(_node(inside.where(c("reference_kind") != "import"), 6, "symbol", key("symbol", c("target_symbol"), c("target_file")), name=c("target_symbol"), file=c("target_file"), line=c("target_line"), kind=F.lit("function"), ordinal=c("target_line")))
        nodes.append(_node(outside, 6, "external", key("external", c("target_symbol")), name=c("target_symbol")))
        imports = refs.where(c("reference_kind") == "import")
        nodes.append(_node(imports, 6, "file", key("file", c("source_file")), name=c("source_file"), file=c("source_file"), path=c("source_file")))
        nodes.append(_node(imports.where(c("target_file").isNotNull()), 6, "file", key("file", c("target_file")), name=c("target_file"), file=c("target_file"), path=c("target_file")))
        edges.append(_edge(imports, key("file", c("source_file")), F.when(c("target_file").isNotNull(), key("file", c("target_file"))).otherwise(key("external", c("target_symbol"))), "imports", c("confidence")))
        member = modules.select("name", F.explode("files").alias("file"))
        edges.append(_edge(member, key("module", c("name")), key("file", c("file")), "contains"))
        edges.append(_edge(exposed_symbols(modules, symbols), key("module", c("module")), key("symbol", c("symbol"), c("file")), "exposes"))
        needs = modules.select("name", F.explode("depends_on").alias("to"))
        edges.append(_edge(needs, key("module", c("name")), key("module", c("to")), "depends_on"))
        nodes.append(_node(needs, 7, "module", key("module", c("to")), name=c("to")))
        return cls(first_nodes(_union(nodes)), _union(edges))

    def find(self, name: str) -> DataFrame:
        """Ids of all symbols with a name, in any file."""
        return self.nodes.where((F.col("type") == "symbol") & (F.col("name") == name)).select("id")

    def neighbours(self, ids: DataFrame, kinds: tuple[str, ...], forward: bool = True) -> DataFrame:
        """Edges of some kinds that leave (or reach) the given ids."""
        side = "src" if forward else "dst"
        return self.edges.where(F.col("kind").isin(*kinds)).join(ids.select(F.col("id").alias(side)), side, "left_semi")

    def stats(self) -> DataFrame:
        """One row: nodes and edges by type, weakly connected components, cycles."""
        from quarrylens.operators.traverse import cycles

        n = self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("nodes_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_nodes"))
        e = self.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("edges_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges"))
        w = weak_components(self.nodes, self.edges).agg(F.count_distinct("component").alias("connected_components"))
        s = cycles(self.edges).agg(F.count_distinct("component").alias("cycle_count"))
        return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(w)).crossJoin(F.broadcast(s))  # one row each

    def to_json(self) -> DataFrame:
        """Lines of JSON: every node as {id, label, data}, every edge as {source, target, type, confidence}."""
        data = F.struct(*(F.col(c) for c in NODE_COLUMNS[1:]))
        n = self.nodes.select(F.to_json(F.struct("id", F.col("name").alias("label"), data.alias("data"))).alias("value"), F.lit("node").alias("part"))
        e = self.edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "confidence")).alias("value"), F.lit("edge").alias("part"))
        return n.unionByName(e)


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the first by (step, ordinal, columns); combined before the shuffle."""
    order = F.struct("_step", "_ordinal", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in NODE_COLUMNS[1:]))
    return nodes.groupBy("id").agg(F.min_by(F.struct(*NODE_COLUMNS[1:]), order).alias("n")).select("id", "n.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node over all edge kinds; parallel edges count each."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return nodes.join(n, "id", "left").select(*nodes.columns, F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a node without edges is its own component."""
    linked = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
