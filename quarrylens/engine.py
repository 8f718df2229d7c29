"""The facade: analyse a tree, follow its changes, ask its graph."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quarrylens.operators.aggregate import file_churn
from quarrylens.operators.diff import semantic_diff
from quarrylens.operators.extract import extract
from quarrylens.operators.graph import KnowledgeGraph
from quarrylens.plans.model import CodeModel, build_model
from quarrylens.plans.passes import AnalysisContext, AnalysisPipeline
from quarrylens.sources import gitlog
from quarrylens.sources.files import describe, scan
from quarrylens.sources.workspace import Workspace, detect_workspace
from quarrylens.streaming.state import FactStore


@dataclass
class ExtractionResult:
    model: CodeModel
    graph: KnowledgeGraph
    diff: dict[str, DataFrame] | None
    files_analyzed: int
    timing: dict[str, float] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, files: DataFrame | None = None, store: FactStore | None = None, strict_compat: bool = False):
        """Either a root to scan or a table files(path, content)."""
        self.spark, self.root, self._files = spark, root, files
        self.project = os.path.basename((root or "project").rstrip("/"))
        self.workspace: Workspace | None = detect_workspace(root) if root and os.path.isdir(root) else None
        self.store = store or FactStore(spark)
        self.strict_compat = strict_compat
        self.history: DataFrame | None = None
        self.last: ExtractionResult | None = None

    def full_analysis(self, with_history: bool = True) -> ExtractionResult:
        """Everything from scratch: earlier state is forgotten, and there is no diff."""
        start = time.perf_counter()
        files = self._files if self._files is not None else scan(self.spark, self.root).select("path", "content")
        if self._files is not None:
            self.workspace = detect_workspace(self._files)
        self.store.replace_all(files)
        self.last = None
        commits = gitlog.commits(self.spark, self.root) if with_history and self.root and os.path.isdir(self.root) else None
        self.history = None if commits is None else file_churn(commits)
        return self._result(start, False)

    def apply_changes(self, upserts: DataFrame | None = None, deletes: list[str] | DataFrame | None = None) -> ExtractionResult:
        """Changed or new files(path, content) and deleted paths, as one batch."""
        start = time.perf_counter()
        if isinstance(deletes, list):
            deletes = self.spark.createDataFrame([(p,) for p in deletes], "path string") if deletes else None
        self.store.apply(upserts, deletes)
        return self._result(start, True)

    def on_file_changed(self, path: str, content: str) -> ExtractionResult:
        return self.apply_changes(self.spark.createDataFrame([(path, content)], "path string, content string"))

    def on_file_deleted(self, path: str) -> ExtractionResult:
        return self.apply_changes(None, [path])

    def on_files_changed(self, changes: dict[str, str | None]) -> ExtractionResult:
        """path -> new text, or none if the file is gone."""
        kept = [(p, t) for p, t in changes.items() if t is not None]
        up = self.spark.createDataFrame(kept, "path string, content string") if kept else None
        return self.apply_changes(up, [p for p, t in changes.items() if t is None])

    def _model(self, back: int = 0) -> CodeModel | None:
        rows = self.store.rows(back)
        if rows is None:
            return None
        described = ("path", "content", "language", "file_role", "estimated_tokens", "content_hash")
        packages = self.workspace.table(self.spark) if self.workspace else None
        return build_model(rows.select(*described), rows.drop(*described[1:]), self.project, packages, self.history, "", self.strict_compat)

    def _result(self, start: float, compare: bool) -> ExtractionResult:
        model = self._model()
        stored = time.perf_counter()
        old = self._model(1) if compare else None
        diff = semantic_diff(old.facts, model.facts) if old is not None else None
        graph = model.graph()
        self.last = ExtractionResult(model, graph, diff, model.files.count(), {"extract_s": stored - start, "total_s": time.perf_counter() - start})
        return self.last

    # --- lookups

    @property
    def files(self) -> DataFrame | None:
        return self.store.rows()

    @property
    def facts(self) -> dict[str, DataFrame]:
        return self.last.model.facts if self.last else {}

    @property
    def graph(self) -> KnowledgeGraph | None:
        return self.last.graph if self.last else None

    def set_graph(self, graph: KnowledgeGraph) -> None:
        if self.last:
            self.last.graph = graph

    def get_source(self, path: str) -> str | None:
        row = self.files.where(F.col("path") == path).select("content").first() if self.files is not None else None
        return row.content if row else None

    def get_extraction(self, path: str) -> Row | None:
        return self.files.where(F.col("path") == path).first() if self.files is not None else None

    def analyze_single_file(self, path: str, content: str) -> Row | None:
        """Facts of one text; nothing is kept."""
        one = describe(self.spark.createDataFrame([(path, content)], "path string, content string"))
        return extract(one).first()

    def run_graph_analysis(self, pipeline: AnalysisPipeline | None = None) -> AnalysisContext:
        return (pipeline or AnalysisPipeline.standard()).run(self.graph)
