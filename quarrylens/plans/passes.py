"""Analysis passes over a knowledge graph, run one after another; later passes read what earlier ones found."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from quarrylens.functions import rules
from quarrylens.operators.diff import drop_prefixes
from quarrylens.operators.flows import flows
from quarrylens.operators.graph import KnowledgeGraph, degrees
from quarrylens.operators.traverse import cycles

log = logging.getLogger(__name__)


@dataclass
class AnalysisContext:
    """Outputs of the passes so far, by name."""

    found: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


class GraphPass(Protocol):
    name: str

    def analyze(self, graph: KnowledgeGraph, context: AnalysisContext) -> None: ...


class DegreePass:
    name = "degree_centrality"

    def analyze(self, graph: KnowledgeGraph, context: AnalysisContext) -> None:
        context.found["degree_centrality"] = degrees(graph.nodes, graph.edges)


def entry_points(degree: DataFrame, least: int = rules.FAN_OUT_LEAST, ratio: float = rules.FAN_OUT_RATIO) -> DataFrame:
    """Nodes that start flows, each with its first reason: endpoints; high fan-out with low fan-in; names."""
    words = "|".join(rules.ENTRY_WORDS)
    wide = (F.col("out_degree") >= least) & (F.col("out_degree") / F.greatest("in_degree", F.lit(1)) >= ratio)
    reason = (
        F.when(F.col("type") == "interface", "http_endpoint")
        .when(wide, "high_fan_out_low_fan_in")
        .when((F.col("type") == "symbol") & F.lower("name").rlike(words), "name_pattern")
    )
    return degree.withColumn("reason", reason).where(F.col("reason").isNotNull())


class EntryPointPass:
    name = "entry_points"

    def analyze(self, graph: KnowledgeGraph, context: AnalysisContext) -> None:
        degree = context.found.get("degree_centrality")
        if degree is None:  # without the degree pass all degrees are 0
            degree = graph.nodes.withColumns({"in_degree": F.lit(0), "out_degree": F.lit(0)})
        context.found["entry_points"] = entry_points(degree)


def process_flows(graph: KnowledgeGraph, entries: DataFrame, most: int = rules.FLOW_DEPTH, degree: DataFrame | None = None) -> DataFrame:
    """entry, names (by depth, then name), files_touched, depth and reaches_external of flows longer than a step.

    degree: a stored table of degrees(), which saves counting the ends of calls again where all of them are nodes."""
    if degree is not None and degree.agg(F.sum(F.col("in_degree") + F.col("out_degree"))).first()[0] != 2 * graph.edges.count():
        degree = None
    return flows(graph.nodes, graph.edges.where(F.col("kind") == "calls").select("src", "dst"), entries, most, degree)


class FlowPass:
    name = "process_flows"

    def analyze(self, graph: KnowledgeGraph, context: AnalysisContext) -> None:
        context.found["process_flows"] = drop_prefixes(process_flows(graph, context.found["entry_points"]))


class CyclePass:
    name = "cycles"

    def analyze(self, graph: KnowledgeGraph, context: AnalysisContext) -> None:
        context.found["cycles"] = cycles(graph.edges)


class AnalysisPipeline:
    """Passes in order; one that fails is logged and skipped."""

    def __init__(self, passes: list[GraphPass] | None = None):
        self.passes = list(passes or [])

    @classmethod
    def standard(cls) -> AnalysisPipeline:
        return cls([DegreePass(), EntryPointPass(), FlowPass(), CyclePass()])

    def with_pass(self, one: GraphPass) -> AnalysisPipeline:
        return AnalysisPipeline([*self.passes, one])

    def run(self, graph: KnowledgeGraph) -> AnalysisContext:
        context = AnalysisContext()
        for p in self.passes:
            try:
                p.analyze(graph, context)
            except Exception as e:  # noqa: BLE001 - a pass is the caller's code
                log.warning("pass %s failed: %s", p.name, e)
                context.failed[p.name] = str(e)
        return context
