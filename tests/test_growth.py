"""Work that must not grow with the square of a module or the number of packages."""

from pyspark.sql import DataFrame

from quarrylens.operators import resolve
from quarrylens.sources import workspace


def test_exposed_symbols_never_pairs_all_files_and_symbols_of_a_module(spark):
    files = [f"api/{i}.ts" for i in range(5)]
    modules = spark.createDataFrame([("api", files, [f"s{i}" for i in range(5)] + ["all"])], "name string, files array<string>, exported_symbols array<string>")
    symbols = spark.createDataFrame([(f, n) for i, f in enumerate(files) for n in (f"s{i}", "all")], "file string, name string")
    out = resolve.exposed_symbols(modules, symbols)
    assert {(r.symbol, r.file) for r in out.collect()} == {(f"s{i}", f) for i, f in enumerate(files)} | {("all", files[0])}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert len(joins) == 2 and all("file" in x or "symbol" in x for x in joins)


def test_go_folders_without_a_manifest_are_looked_up_together(spark, monkeypatch):
    rows = [("go.work", "go 1.2\nuse (\n" + "".join(f"  ./libs/p{i}\n" for i in range(30)) + "  ./gone\n  .\n)\n")]
    rows += [(f"libs/p{i}/{name}", text) for i in range(30) for name, text in (("go.mod", f"module x/p{i}\n"), ("src/a.go", "package a"))[i % 2 :]]
    asked, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: asked.append(1) or real(self))
    found = workspace.detect_go(workspace.Files(spark.createDataFrame(rows, "path string, content string")))
    assert found.packages == (*((f"libs/p{i}" if i % 2 else f"x/p{i}", f"libs/p{i}") for i in range(30)), (".", "."))
    assert len(asked) <= 2
