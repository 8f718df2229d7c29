"""The code model: fact tables of a tree, resolved references, modules, directories and figures over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from quarrylens.operators import aggregate as A, resolve as R
from quarrylens.operators.extract import fact_tables
from quarrylens.operators.graph import KnowledgeGraph
from quarrylens.session import Scratch

FACTS = ("interfaces", "dependencies", "sinks", "symbols", "imports", "references", "data_models", "env_dependencies")


@dataclass
class CodeModel:
    project: str
    files: DataFrame
    facts: dict[str, DataFrame]
    modules: DataFrame

    @property
    def references(self) -> DataFrame:
        return self.facts["references"]

    def stats(self) -> DataFrame:
        return A.model_stats(self.files, self.facts | {"modules": self.modules}, self.references)

    def components(self) -> DataFrame:
        """One row for each package with its files and dominant language, by name."""
        n = self.files.groupBy("component").agg(F.count(F.lit(1)).alias("files"))
        return n.join(A.dominant_language(self.files, ["component"]), "component", "left").orderBy("component")

    def directories(self) -> DataFrame:
        return A.directory_rollup(self.files).join(A.directory_roles(self.files), "directory", "left")

    def directory_dependencies(self) -> DataFrame:
        return A.directory_dependencies(self.references)

    def filtered(self, least: float) -> CodeModel:
        """The model with only the references of at least some confidence; figures over it follow."""
        return replace(self, facts=self.facts | {"references": A.filtered_references(self.references, least)})

    def graph(self) -> KnowledgeGraph:
        return KnowledgeGraph.from_facts(self.facts | {"files": self.files, "modules": self.modules})

    def ordered(self) -> dict[str, DataFrame]:
        return A.ordered(self.facts | {"modules": self.modules})

    def write(self, path: str, form: str = "parquet") -> None:
        """Every table of the model below a folder, as Parquet or JSON lines."""
        for name, df in (self.facts | {"files": self.files.drop("content"), "modules": self.modules}).items():
            df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def build_model(files: DataFrame, extracted: DataFrame, project: str = "project", packages: DataFrame | None = None, history: DataFrame | None = None, root: str = "", strict_compat: bool = False) -> CodeModel:
    """files (as described) and their extracted facts -> model; packages deal files to components.

    Probed imports and resolved references, which figures, modules and the graph all read, are written once."""
    scratch = Scratch(files.sparkSession, "model")
    facts = fact_tables(extracted)
    files = R.assign_component(files, packages, project) if packages is not None else files.withColumn("component", F.lit(project))
    if history is not None:
        files = R.merge_history(files, history)
    probed = scratch.table(R.probe_imports(facts["imports"], files, root), "probed")
    refs = R.resolve_references(facts["references"], facts["imports"], facts["symbols"], files, root, strict_compat, probed)
    facts["references"] = scratch.table(R.tag_tests(refs, files), "references")
    return CodeModel(project, files, facts, A.module_boundaries(files, facts["symbols"], facts["imports"].select("file", "source")))
