"""Relational, graph and incremental operators on small tables with known results."""

import json
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.engine import Engine
from quarrylens.functions import rules, scalar as S
from quarrylens.operators import aggregate as A, diff as D, flows, graph as G, resolve as R, traverse as T
from quarrylens.operators.components import components
from quarrylens.plans import passes
from quarrylens.session import Scratch
from quarrylens.sources import gitlog, workspace
from quarrylens.sources.files import scan
from quarrylens.streaming.state import FactStore


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "role"),
    [
        ("vendor/a.go", "generated"), ("src/x.pb.go", "generated"), ("a/api.generated.ts", "generated"), ("tests/a.py", "test"), ("src/attestation/a.py", "impl"), ("src/a_test.go", "test"), ("test_a.py", "test"),
        ("UserTest.java", "test"), ("docs/a.py", "docs"), ("Makefile", "build"), ("go.mod", "build"), ("conf/a.yaml", "config"), (".env.local", "config"), ("README.md", "docs"), ("src/a.rs", "impl"), ("a.bin", "other"), ("LICENSE", "other"),
    ],
)
def test_file_roles(spark, path, role):
    assert one(spark, S.file_role(F.col("p")), p=path) == role


def test_languages_and_paths(spark):
    assert [one(spark, S.language(F.col("p")), p=p) for p in ("a.tsx", "x/b.h", "c.TS", ".ts", "d")] == ["tsx", "c", None, None, None]
    norm = lambda p, keep=True: one(spark, S.normalize_path(F.col("p"), keep), p=p)
    assert [norm(p) for p in ("a/b/../c/./d", "../a", "a/../../b", "/../a", "", "./")] == ["a/c/d", "../a", "../b", "/a", "", ""]
    assert norm("../../a/../b", False) == "b"
    assert [one(spark, S.module_name(F.col("p")), p=p) for p in ("a.ts", "src/a.ts", "src/api/a.ts", "src/api/v1/a.ts")] == ["__root__", "src", "src/api", "src/api"]
    assert one(spark, S.ancestors(F.col("p")), p="a/b/c.ts") == ["", "a", "a/b"] and one(spark, S.ancestors(F.col("p")), p="c.ts") == [""]
    assert one(spark, S.path_params(F.col("p")), p="/a/:id(\\d+)/{b:..}/<int:c>/{id}/{x y}/:") == ["id", "b", "c"]
    assert [one(spark, S.normalize_python_relative(F.col("p")), p=p) for p in (".", ".x", "..x.y", "...", "./x", "../x", "x")] == ["./", "./x", "../x.y", "../../", None, None, None]


def symbols(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, file string, line long, ordinal long")


def refs(spark, rows):
    return spark.createDataFrame(rows, "source_symbol string, source_file string, source_line long, target_symbol string, target_file string, target_line long, reference_kind string, confidence double, resolution_method string")


def ref(name, file="a/x.ts", confidence=0.0, target=None):
    return ("f", file, 1, name, target, None, "call", confidence, "unresolved")


def test_resolution_tiers(spark):
    s = symbols(spark, [("own", "a/x.ts", 3), ("own", "a/x.ts", 9), ("far", "b/y.ts", 4), ("two", "a/z.ts", 5), ("two", "b/y.ts", 6), ("amb", "c/q.ts", 8), ("amb", "b/y.ts", 7), ("imp", "b/y.ts", 2), ("imp", "a/x.ts", 1)])
    files = spark.createDataFrame([("a/x.ts",), ("a/z.ts",), ("b/y.ts",), ("c/q.ts",)], "path string")
    imports = spark.createDataFrame([(1, "a/x.ts", "../b/y", ["imp", "gone"], 1), (2, "a/x.ts", "react", [], 2), (3, "a/x.ts", "./nothing", ["n"], 3)], "import_id long, file string, source string, specifiers array<string>, line long")
    r = refs(spark, [ref(n) for n in ("obj.own", "x::far", "p->two", "amb", "imp", "none")] + [ref("none2", confidence=0.99, target="kept.ts"), ref("far", confidence=0.80)])
    got = {(x.target_symbol, x.reference_kind, x.confidence): (x.target_file, x.target_line, x.resolution_method) for x in R.resolve_references(r, imports, s, files).collect()}
    assert got == {
        ("obj.own", "call", 0.90): ("a/x.ts", 9, "same_file"),
        ("x::far", "call", 0.80): ("b/y.ts", 4, "global_unique"),
        ("p->two", "call", 0.60): ("a/z.ts", 5, "global_same_dir"),
        ("amb", "call", 0.40): ("b/y.ts", 7, "global_ambiguous"),
        ("imp", "call", 0.95): ("b/y.ts", 2, "import_based"),
        ("none", "call", 0.0): (None, None, "unresolved"),
        ("none2", "call", 0.99): ("kept.ts", None, "unresolved"),
        ("far", "call", 0.80): ("b/y.ts", 4, "global_unique"),
        ("imp", "import", 0.95): ("b/y.ts", 2, "import_based"),
        ("gone", "import", 0.50): ("b/y.ts", None, "import_based"),
        ("react", "import", 0.60): (None, None, "external"),
        ("n", "import", 0.0): (None, None, "unresolved"),
    }


def test_probe_order(spark):
    files = spark.createDataFrame([("d/u.ts",), ("d/u.tsx",), ("d/v/index.js",), ("d/w",), ("d/w.ts",), ("p/m.py",)], "path string")
    rows = [(1, "d/a.ts", "./u"), (2, "d/a.ts", "./v"), (3, "d/a.ts", "./w"), (4, "d/a.ts", "./zz"), (5, "p/a.py", ".m"), (6, "d/a.ts", "react"), (7, "d/e/a.ts", "../u.tsx")]
    i = spark.createDataFrame(rows, "import_id long, file string, source string")
    assert {r.import_id: r.target_file for r in R.probe_imports(i, files).collect()} == {1: "d/u.ts", 2: "d/v/index.js", 3: "d/w", 5: "p/m.py", 7: "d/u.tsx"}


def test_test_tags_components_and_history(spark):
    files = spark.createDataFrame([("t.py", "test"), ("s.py", "impl")], "path string, file_role string")
    r = spark.createDataFrame([("t.py", "s.py"), ("t.py", "t.py"), ("t.py", None), ("s.py", "s.py")], "source_file string, target_file string")
    assert [x.is_test_reference for x in R.tag_tests(r, files).orderBy("source_file", F.col("target_file").asc_nulls_first()).collect()] == [False, True, True, False]
    packages = spark.createDataFrame([("x", "a", 0), ("y", "a/b", 1), ("z", "a", 2)], "name string, root string, ordinal int")
    got = R.assign_component(spark.createDataFrame([("a/b/c.ts",), ("a/bc.ts",), ("ab.ts",), ("a",)], "path string"), packages, "d")
    assert {r.path: r.component for r in got.collect()} == {"a/b/c.ts": "y", "a/bc.ts": "x", "ab.ts": "d", "a": "x"}


def test_diff(spark):
    old = spark.createDataFrame([("GET", "/a", "jwt"), ("GET", "/b", None), (None, "/n", None)], "method string, path string, auth string")
    new = spark.createDataFrame([("GET", "/a", None), ("POST", "/c", None), ("POST", "/c", "x"), (None, "/n", None)], "method string, path string, auth string")
    got = D.diff_by_key(old, new, ("method", "path")).collect()
    assert sorted((r.method, r.path, r.change_type) for r in got) == [("GET", "/b", "removed"), ("POST", "/c", "added"), ("POST", "/c", "added")]
    assert not D.diff_by_key(old, old, ("method", "path")).count()
    none = spark.createDataFrame([], "change_type string, contains_pii boolean")
    risk = lambda rows, sinks=none: tuple(D.risk(spark.createDataFrame(rows, "change_type string, auth string"), sinks).first())
    assert risk([]) == ("low", "low") and risk([("added", None)]) == ("high", "medium") and risk([("removed", None)]) == ("medium", "medium") and risk([("added", "jwt")]) == ("medium", "medium")
    assert risk([], spark.createDataFrame([("added", True)], none.schema)) == ("high", "low") and risk([], spark.createDataFrame([("removed", True)], none.schema)) == ("medium", "low")
    flows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["b"]), (4, ["a", "b", "c"])], "id int, names array<string>")
    assert sorted(r.id for r in D.drop_prefixes(flows).collect()) == [2, 3, 4]


def test_directories_modules_history(spark):
    rows = [("src/a.ts", "impl"), ("src/b.test.ts", "test"), ("src/x/c.ts", "impl"), ("docs/d/e.md", "docs"), ("f.cfg", "config")]
    files = spark.createDataFrame([(p, r, "typescript" if p.endswith("ts") else None, 10) for p, r in rows], "path string, file_role string, language string, estimated_tokens long")
    roles = {r.directory: r.role for r in A.directory_roles(files).collect()}
    assert roles == {"": "config", "src": "source", "src/x": "source", "docs": "docs", "docs/d": "docs"}
    roll = {r.directory: (r.direct_file_count, r.total_file_count, r.total_estimated_tokens, r.depth) for r in A.directory_rollup(files).collect()}
    assert roll[""] == (1, 5, 50, 0) and roll["src"] == (2, 3, 30, 1) and roll["docs"] == (0, 1, 10, 1) and A.count_directories(files).first()[0] == 5
    assert A.dominant_language(spark.createDataFrame([("go",), ("rust",), (None,)], "language string")).first()[0] == "rust"
    assert A.dominant_language(files.limit(0)).first()[0] == "typescript"
    text = f"{gitlog.MARK}\nann\n100\n\na.py\nb.py\n{gitlog.MARK}\nbob\nnever\n\na.py\n{gitlog.MARK}\ncy\n100\n\na.py\n"
    churn = {r.path: r for r in A.file_churn(gitlog.parse_log(spark.createDataFrame([(text,)], "raw string"))).collect()}
    assert (churn["a.py"].commit_count, churn["a.py"].distinct_authors, churn["a.py"].last_author) == (2, 2, "ann") and churn["b.py"].commit_count == 1


def model_graph(spark):
    facts = {
        "files": spark.createDataFrame([("src/routes.ts",), ("src/services.ts",)], "path string"),
        "symbols": spark.createDataFrame([("handler", "src/routes.ts", 5, "function"), ("getUser", "src/services.ts", 10, "method")], "name string, file string, line long, kind string"),
        "interfaces": spark.createDataFrame([("GET", "/u", "src/routes.ts", 10)], "method string, path string, file string, line long"),
        "data_models": spark.createDataFrame([("User", "src/services.ts", 1, "class")], "name string, file string, line long, model_kind string"),
        "references": refs(spark, [("handler", "src/routes.ts", 6, "getUser", "src/services.ts", 10, "call", 0.95, "import_based"), ("handler", "src/routes.ts", 7, "ext", None, None, "call", 0.0, "unresolved"), ("", "src/routes.ts", 1, "getUser", "src/services.ts", 10, "import", 0.95, "import_based"), ("User", "src/services.ts", 1, "Base", None, None, "extends", 0.8, "global_unique")]),
        "modules": spark.createDataFrame([("routes", ["src/routes.ts"], ["handler"], ["services"]), ("services", ["src/services.ts"], ["getUser"], [])], "name string, files array<string>, exported_symbols array<string>, depends_on array<string>"),
    }
    return G.KnowledgeGraph.from_facts(facts)


def test_graph_build_and_queries(spark):
    g = model_graph(spark)
    assert {r.type: r["count"] for r in g.nodes.groupBy("type").count().collect()} == {"module": 2, "file": 2, "symbol": 3, "interface": 1, "data_model": 1, "external": 2}
    assert {r.kind: r["count"] for r in g.edges.groupBy("kind").count().collect()} == {"defines": 4, "calls": 2, "extends": 1, "imports": 1, "contains": 2, "exposes": 2, "depends_on": 1}
    names = {r.id: r.name for r in g.nodes.collect()}
    assert {names[r.id] for r in T.callees(g, "handler").collect()} == {"getUser", "ext"} and {names[r.id] for r in T.callers(g, "getUser").collect()} == {"handler"}
    assert [(names[r.id], r.depth, r.confidence) for r in T.impact(g, "getUser").collect()] == [("handler", 1, 0.95)]
    stats = g.stats().first()
    assert stats.total_nodes == 11 and stats.total_edges == 13 and stats.cycle_count == 0 and stats.connected_components >= 1
    lines = [json.loads(r.value) for r in g.to_json().collect()]
    assert len(lines) == 24 and {"id", "label", "data"} <= set(lines[0])
    context = passes.AnalysisPipeline.standard().run(g)
    assert not context.failed and {r.reason for r in context.found["entry_points"].collect()} >= {"http_endpoint", "name_pattern"}

    class Bad:
        name = "bad"

        def analyze(self, graph, context):
            raise ValueError("no")

    assert passes.AnalysisPipeline([Bad(), passes.DegreePass()]).run(g).failed == {"bad": "no"}


def test_impact_prunes_and_multiplies(spark):
    e = spark.createDataFrame([("b", "a", "calls", 0.5), ("c", "b", "calls", 0.5), ("d", "c", "calls", 0.3), ("a", "a", "calls", 1.0), ("x", "a", "calls", 0.05)], "src string, dst string, kind string, confidence double")
    got = T.breadth_first(e, spark.createDataFrame([("a",)], "id string"), T.IMPACT_KINDS, False, 9, rules.IMPACT_FLOOR).collect()
    assert {r.id: (r.depth, r.confidence) for r in got} == {"b": (1, 0.5), "c": (2, 0.25)}


def random_edges(rng, n, m):
    return [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)]


def test_traversals_equal_plain_python(spark):
    rng = random.Random(11)
    for n, m in ((30, 40), (40, 90)):
        edges = random_edges(rng, n, m)
        df = spark.createDataFrame(edges, "src string, dst string").withColumns({"kind": F.lit("calls"), "confidence": F.lit(1.0)})
        depth, todo = {"0": 0}, ["0"]
        for v in todo:
            for a, b in edges:
                if a == v and b not in depth:
                    depth[b] = depth[v] + 1
                    todo.append(b)
        got = {r.id: r.depth for r in T.breadth_first(df, spark.createDataFrame([("0",)], "id string"), None, True, 4).collect()}
        assert got == {k: d for k, d in depth.items() if 0 < d <= 4}
        reach = {v: {v} for e in edges for v in e}
        for _ in range(n):
            for a, b in edges:
                reach[a] |= reach[b]
        want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach if sum(v in reach[w] for w in reach[v]) > 1}
        assert {r.id: r.component for r in T.cycles(df).collect()} == want
        assert {r.id: r.component for r in T.cycles(df, most_edges=0).collect()} == want
        plain = {v: v for v in reach}
        for _ in range(n):
            for a, b in edges:
                plain[a] = plain[b] = min(plain[a], plain[b])
        linked = {v for a, b in edges if a != b for v in (a, b)}
        assert {r.node: r.component for r in components(df, "src", "dst").collect()} == {v: plain[v] for v in linked}


def test_strong_components_plain():
    label = T.strong_components(np.array([0, 1, 2, 2, 3]), np.array([1, 2, 0, 3, 3]), 5)
    assert len({label[0], label[1], label[2]}) == 1 and len(set(label.tolist())) == 3


def test_flows_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")], "src string, dst string").withColumns({"kind": F.lit("calls"), "confidence": F.lit(1.0)})
    nodes = spark.createDataFrame([(i, "external" if i == "x" else "symbol", i, f"{i}.ts") for i in "abcxz"], "id string, type string, name string, file string")
    flows = passes.process_flows(G.KnowledgeGraph(nodes, e), nodes.where("id in ('a', 'z')")).collect()
    assert [(r.entry, r.names, r.depth, r.reaches_external) for r in flows] == [("a", ["a", "b", "c", "x"], 3, True)]


@pytest.mark.parametrize("held", [0, 6, 2000])
def test_flows_by_plain_search(spark, monkeypatch, held):
    """Repeated calls, cycles, calls of ids that are no nodes, equal and null names, null files; whether workers hold names or not."""
    monkeypatch.setattr(flows, "COMMON", max(held, 1))
    monkeypatch.setattr(flows, "COMMON_BYTES", 2000 if held else -1)
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    nodes = {i: (rng.choice(["external", "symbol", None]), rng.choice([None, "x", "é", "yy", f"f{i}"]), rng.choice([None, "a.ts", "é.ts", "b.ts"])) for i in ids[:34]}
    calls = [(rng.choice(ids[:30]), rng.choice(ids[:6] if rng.random() < 0.4 else ids)) for _ in range(70)]
    df = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id string, type string, name string, file string")
    e = spark.createDataFrame([(a, b, "calls", 1.0) for a, b in calls] + [("n0", "n33", "uses_type", 1.0)], "src string, dst string, kind string, confidence double")
    for most in (1, 3, 15):
        want = {}
        for start in nodes:
            seen, level = {start: 0}, {start}
            for depth in range(1, most + 1):
                level = {b for a, b in calls if a in level} - set(seen)
                seen |= dict.fromkeys(level, depth)
            steps = sorted((d, nodes[i][1] is not None, nodes[i][1] or "", i) for i, d in seen.items() if i in nodes)
            if len(steps) > 1:
                files = sorted({nodes[i][2] for *_, i in steps} - {None})
                want[start] = ([nodes[i][1] for *_, i in steps], files, steps[-1][0], any(nodes[i][0] == "external" for *_, i in steps))
        graph = G.KnowledgeGraph(df, e)
        got = passes.process_flows(graph, df, most, G.degrees(df, e) if most == 3 else None).collect()  # some ends are no nodes
        assert len(got) == len(want) and {r.entry: (r.names, r.files_touched, r.depth, r.reaches_external) for r in got} == want


def test_flows_have_no_row_for_each_step(spark, monkeypatch):
    """A level of the search stores a row for each entry, however many nodes it reaches."""
    nodes = spark.range(200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("symbol").alias("type"), F.lit("x").alias("name"), F.lit("f").alias("file"))
    e = nodes.where("id in ('n0', 'n1', 'n2')").select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).withColumns({"kind": F.lit("calls"), "confidence": F.lit(1.0)})
    stored, table = [], Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name == "level":
            stored.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    got = passes.process_flows(G.KnowledgeGraph(nodes, e), nodes).collect()
    assert [len(r.names) for r in got] == [200] * 3 and stored and max(stored) <= 3


@pytest.mark.parametrize("kind", ["pnpm", "npm", "cargo", "go", "uv"])
def test_workspaces(spark, tmp_path, kind):
    for name in ("one", "two"):
        d = tmp_path / "packages" / name
        d.mkdir(parents=True)
        (d / "package.json").write_text(json.dumps({"name": f"@x/{name}"}))
        (d / "Cargo.toml").write_text(f'[package]\nname = "@x/{name}"\n')
        (d / "pyproject.toml").write_text(f'[project]\nname = "@x/{name}"\n')
        (d / "go.mod").write_text(f"module @x/{name}\n")
    text = {
        "pnpm": ("pnpm-workspace.yaml", "packages:\n  # all\n  - 'packages/*'\n  - \"!packages/none\"\nother: 1\n"),
        "npm": ("package.json", '{"workspaces": {"packages": ["packages/*"]}}'),
        "cargo": ("Cargo.toml", '[workspace]\nmembers = ["packages/*"]\n'),
        "go": ("go.work", "go 1.2\nuse (\n  ./packages/one // x\n  ./gone\n)\nuse ./packages/two\n"),
        "uv": ("pyproject.toml", '[tool.uv.workspace]\nmembers = ["packages/*"]\n'),
    }
    (tmp_path / text[kind][0]).write_text(text[kind][1])
    found = workspace.detect_workspace(str(tmp_path))
    assert (found.kind, found.packages) == (kind, (("@x/one", "packages/one"), ("@x/two", "packages/two")))
    assert workspace.detect_workspace(str(tmp_path / "packages")) is None
    rows = [(p.relative_to(tmp_path).as_posix(), p.read_text()) for p in tmp_path.rglob("*") if p.is_file()]
    assert workspace.detect_workspace(spark.createDataFrame(rows, "path string, content string")) == found


def test_folder_patterns_match_as_in_a_folder(spark, tmp_path):
    for d in ("a/b/c", "a/.h/x", "ab/c", "a/b2", "z", ".q"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f.txt").write_text("x")
    rows = [(p.relative_to(tmp_path).as_posix(), "x") for p in tmp_path.rglob("*") if p.is_file()]
    table = workspace.Files(spark.createDataFrame(rows, "path string, content string"))
    for pattern in ("*", "a/*", "a/b?", "a/**", "**/c", "./a/b", "a*/c", "none/*", ".q", "a/.h/*"):
        assert table.folders(pattern) == workspace.Folder(str(tmp_path)).folders(pattern), pattern


def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("import { h } from './b';\nexport function main() { return h(1); }\napp.get('/a/:id', auth, main);\nconsole.log('x');\n")
    (tmp_path / "src/b.ts").write_text("export function h(x) { return x; }\n")
    (tmp_path / "node_modules/c.ts").write_text("export function no() {}\n")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_engine_full_and_incremental(spark, tmp_path):
    root = tree(tmp_path)
    assert sorted(r.path for r in scan(spark, root).collect()) == ["src/a.ts", "src/b.ts"]
    engine = Engine(spark, root)
    first = engine.full_analysis()
    assert first.diff is None and first.files_analyzed == 2
    calls = {r.target_symbol: r.resolution_method for r in first.model.references.where("reference_kind = 'call'").collect()}
    assert calls["h"] == "import_based" and engine.get_source("src/b.ts").startswith("export")
    second = engine.on_file_changed("src/b.ts", "export function h(x) { return x; }\napp.post('/new', h);\n")
    assert [(r.method, r.path, r.change_type) for r in second.diff["interfaces"].collect()] == [("POST", "/new", "added")]
    assert tuple(second.diff["risk"].first()) == ("high", "medium")
    third = engine.on_file_deleted("src/b.ts")
    assert third.files_analyzed == 1 and third.diff["interfaces"].where("change_type = 'removed'").count() == 1
    fourth = engine.on_files_changed({"src/a.ts": None, "src/c.py": "def run():\n    pass\n"})
    assert [r.path for r in fourth.model.files.collect()] == ["src/c.py"] and engine.analyze_single_file("x.go", "package x\nfunc F() {}\n").symbols[0].name == "F"
    again = engine.apply_changes(spark.createDataFrame([("src/c.py", "def run():\n    pass\n")], "path string, content string"))
    assert not again.diff["sinks"].count() and again.files_analyzed == 1


def test_engine_reads_history(spark, tmp_path):
    root = tree(tmp_path)
    git = ["git", "-C", root, "-c", "user.name=ann", "-c", "user.email=a@b"]
    for args in (["init", "-q"], ["add", "src"], ["commit", "-qm", "x"]):
        subprocess.run([*git, *args], check=True)
    model = Engine(spark, root).full_analysis().model
    assert {r.path: r.git_metadata.commit_count for r in model.files.collect()} == {"src/a.ts": 1, "src/b.ts": 1}
    stats = model.stats().first()
    assert stats.total_files == 2 and stats.total_interfaces == 1 and stats.total_sinks == 1
    assert model.filtered(0.9).references.where("confidence < 0.9").count() == 0 and model.components().first().dominant_language == "typescript"


def test_stream_of_changes(spark, tmp_path):
    folder = tmp_path / "in"
    batches = [[("a.py", "x = 1\n", 1, False), ("b.py", "def f():\n    g()\n", 1, False)], [("a.py", "def a():\n    pass\n", 3, False), ("a.py", "old\n", 2, False)], [("b.py", None, 4, True)]]
    schema = "path string, content string, seq long, deleted boolean"
    store = FactStore(spark, str(tmp_path / "store"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        store.follow(spark.readStream.schema(schema).json(str(folder)), str(tmp_path / "ck")).awaitTermination()
    assert [(r.path, r.content) for r in store.rows().collect()] == [("a.py", "def a():\n    pass\n")] and store.version == 3


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=8)
    files = [(f"d/f{i}.py", f"def f{i}():\n    g{i}()\n") for i in range(40)]
    store.replace_all(spark.createDataFrame(files, "path string, content string"))
    before = store._now()["buckets"]
    up = spark.createDataFrame([("d/f3.py", "x = 1\n"), ("d/f3.py", "def new():\n    pass\n")], "path string, content string")
    store.apply(up, batch=("a stream", 0))
    after = store._now()["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.version == 2
    assert store.apply(up, batch=("a stream", 0)) == 2  # a batch that is run twice
    rows = store.rows().collect()
    assert len(rows) == 40 and next(r.content for r in rows if r.path == "d/f3.py") == "x = 1\n"
    assert next(r.content for r in store.rows(1).collect() if r.path == "d/f3.py") == files[3][1]
    for i in range(3):
        store.apply(None, spark.createDataFrame([(f"d/f{i}.py",)], "path string"))
    assert store.version == 5 and store.rows().count() == 37 and store.rows(1).count() == 38 and store.rows(2) is None
    named = {f for n in store._manifests() for f in store._read(n)["buckets"].values()}
    assert len([p for p in (tmp_path / "s" / "data").rglob("bucket=*")]) == len(named)


def test_stream_takes_the_last_row_of_a_path(spark, tmp_path):
    rows = [("a.py", "x = 1\n", 1, False), ("a.py", None, 2, True), ("b.py", None, 1, True), ("b.py", "y = 2\n", 2, False)]
    schema = "path string, content string, seq long, deleted boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    store = FactStore(spark, str(tmp_path / "store"))
    store.follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert [(r.path, r.content) for r in store.rows().collect()] == [("b.py", "y = 2\n")]


def test_edits(spark):
    from quarrylens.sources.edits import edits, input_edit

    assert input_edit("same", "same") is None
    e = input_edit("a\nbé1c\n", "a\nbé22c\n")
    assert (e["start_byte"], e["old_end_byte"], e["new_end_byte"], e["start_row"], e["start_column"]) == (5, 6, 7, 1, 3)
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab\né", k=rng.randint(0, 12))) for _ in range(2))
        e = input_edit(a, b)
        x, y = a.encode(), b.encode()
        if e:
            assert x[: e["start_byte"]] + y[e["start_byte"] : e["new_end_byte"]] + x[e["old_end_byte"] :] == y
    old = spark.createDataFrame([("p", "x = 1"), ("q", "same")], "path string, content string")
    new = spark.createDataFrame([("p", "x = 12"), ("q", "same"), ("r", "new")], "path string, content string")
    assert [(r.path, r.start_byte, r.old_end_byte, r.new_end_byte) for r in edits(old, new).collect()] == [("p", 5, 5, 6)]


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, small):
    from quarrylens.operators import components as C

    monkeypatch.setattr(C, "SMALL", small)
    rng = random.Random(31)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(30)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    words = [(f"n{a}é", f"n{b}é") for a, b in links]
    named = {r.node: r.component for r in components(spark.createDataFrame(words, "a string, b string")).collect()}
    group = {}
    for x in linked:
        group.setdefault(find(x), []).append(f"n{x}é")
    assert named == {x: min(g) for g in group.values() for x in g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
