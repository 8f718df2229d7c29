"""Queries over whole models: source trees, workspaces, the full graph, differences between two models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrylens.functions import scalar as S
from quarrylens.operators import diff as D, extract as X, graph as G, resolve as R, traverse as T
from quarrylens.plans import views as V
from quarrylens.plans.model import build_model
from quarrylens.plans.registry import query
from quarrylens.plans.source_queries import _extracted, service_files
from quarrylens.session import Scratch
from quarrylens.sources.edits import edits
from quarrylens.sources.files import describe, scan
from quarrylens.sources.workspace import detect_workspace

# --- a tree of real files

_TREE = """v_tree AS (SELECT 'src/' || n_nationkey || '.py' AS path, 'def f' || n_nationkey || '():' || chr(10) || '    return ''' || n_name || '''' || chr(10) AS content, 'python' AS language, 'impl' AS file_role FROM nation
UNION ALL SELECT 'tests/t' || n_nationkey || '.go', 'package t' || n_nationkey, 'go', 'test' FROM nation WHERE n_regionkey = 1)"""


@query(f"WITH {_TREE} SELECT path, language, file_role, sha256(content) AS content_hash, strlen(content)::BIGINT // 4 AS estimated_tokens FROM v_tree")
def source_scan(spark, sf_dir):
    """A small tree is written to the shared folder (a file or two for each of the 25 nations, some of them to be left out), then scanned."""
    scratch = Scratch(spark, "tree")
    root = scratch.path("root")
    jvm = spark.sparkContext._jvm
    for r in V.table(spark, sf_dir, "nation").collect():  # a fixed table of 25 rows
        k = r.n_nationkey
        files = {f"src/{k}.py": f"def f{k}():\n    return '{r.n_name}'\n".encode(), f"node_modules/m{k}/i.js": b"x", f"src/{k}.dat": b"x", f"src/bad{k}.rs": b"fn f() {} // \xff\xfe"}
        if r.n_regionkey == 1:
            files[f"tests/t{k}.go"] = f"package t{k}".encode()
        for path, content in files.items():
            stream = scratch._fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"))
            stream.write(bytearray(content))
            stream.close()
    return scan(spark, root).select("path", "language", "file_role", "content_hash", F.col("estimated_tokens").cast("long").alias("estimated_tokens"))


@query(f"""WITH {V.FILES}, e AS (SELECT path, content, left(content, (doc_id % 50)::INT) AS head FROM v_files WHERE length(content) > 60)
SELECT path, strlen(head)::BIGINT AS start_byte, strlen(head)::BIGINT AS old_end_byte, (strlen(head) + 3)::BIGINT AS new_end_byte, (length(head) - length(replace(head, chr(10), '')))::BIGINT AS start_row,
strlen(list_last(string_split(head, chr(10))))::BIGINT AS start_column FROM e""")
def input_edits(spark, sf_dir):
    """A mark of three bytes goes into every long file; the edit is what lies between the common ends."""
    f = V.files(spark, sf_dir).where(F.length("content") > 60)
    at = (F.col("doc_id") % 50).cast("int")
    new = f.select("path", F.concat(F.substring("content", F.lit(1), at), F.lit("⌘"), F.substring(F.col("content"), at + 1, F.length("content"))).alias("content"))
    return edits(f.select("path", "content"), new).select("path", "start_byte", "old_end_byte", "new_end_byte", "start_row", "start_column")


# --- workspaces

_KINDS = ("pnpm", "npm", "cargo", "go", "uv")


def _workspace_files(spark, sf_dir, kind: str) -> DataFrame:
    """A tree whose packages are the suppliers: `libs/p<key>`, of which every seventh has no name of its own."""
    k = F.col("s_suppkey").cast("string")
    own = {
        "pnpm": ("package.json", F.concat(F.lit('{"name": "@x/p'), k, F.lit('"}'))),
        "npm": ("package.json", F.concat(F.lit('{"name": "@x/p'), k, F.lit('"}'))),
        "cargo": ("Cargo.toml", F.concat(F.lit('[package]\nname = "@x/p'), k, F.lit('"\n'))),
        "go": ("go.mod", F.concat(F.lit("module @x/p"), k, F.lit("\n"))),
        "uv": ("pyproject.toml", F.concat(F.lit('[project]\nname = "@x/p'), k, F.lit('"\n'))),
    }[kind]
    s = V.table(spark, sf_dir, "supplier")
    named = s.where(F.col("s_suppkey") % 7 != 3).select(F.concat(F.lit("libs/p"), k, F.lit(f"/{own[0]}")).alias("path"), own[1].alias("content"))
    code = s.select(F.concat(F.lit("libs/p"), k, F.lit("/src/a.py")).alias("path"), F.lit("x = 1\n").alias("content"))
    used = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("\n  ./libs/p"), x.cast("string"))), "").alias("u"))
    text = {
        "pnpm": F.lit("packages:\n  - 'libs/*'\n  - '!libs/p0'\n"), "npm": F.lit('{"workspaces": ["libs/*", "!libs/p0"]}'), "cargo": F.lit('[workspace]\nmembers = ["libs/*", "!libs/p0"]\n'),
        "go": F.concat(F.lit("go 1.2\nuse ("), "u", F.lit("\n  ./gone // not there\n)\n")), "uv": F.lit('[tool.uv.workspace]\nmembers = ["libs/*", "!libs/p0"]\n'),
    }
    name = {"pnpm": "pnpm-workspace.yaml", "npm": "package.json", "cargo": "Cargo.toml", "go": "go.work", "uv": "pyproject.toml"}[kind]
    top = used.select(F.lit(name).alias("path"), text[kind].alias("content"))
    other = spark.createDataFrame([("tools/x.py", "y = 2\n")], "path string, content string")
    return top.unionByName(named).unionByName(code).unionByName(other)


@query(f"""SELECT kind, CASE WHEN s_suppkey % 7 = 3 THEN 'libs/p' || s_suppkey ELSE '@x/p' || s_suppkey END AS name, 'libs/p' || s_suppkey AS root FROM supplier, (SELECT unnest({list(_KINDS)}) AS kind)
WHERE kind = 'go' OR s_suppkey <> 0""")
def workspace_packages(spark, sf_dir):
    out = None
    for kind in _KINDS:
        found = detect_workspace(_workspace_files(spark, sf_dir, kind))
        rows = found.table(spark).select(F.lit(found.kind).alias("kind"), "name", "root")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT 'libs/p' || s_suppkey || '/src/a.py' AS path, CASE WHEN s_suppkey = 0 THEN 'main' WHEN s_suppkey % 7 = 3 THEN 'libs/p' || s_suppkey ELSE '@x/p' || s_suppkey END AS component, 1::BIGINT AS files, 'python' AS language
FROM supplier WHERE s_suppkey <> 0 UNION ALL SELECT p, 'main', 1 + (SELECT count(*) FROM supplier WHERE s_suppkey = 0), 'python' FROM (SELECT 'tools/x.py' AS p UNION ALL SELECT 'libs/p0/src/a.py' FROM supplier WHERE s_suppkey = 0)""")
def component_routing(spark, sf_dir):
    """Every file of a workspace goes to its package, the rest to the project; with each component's figures."""
    files = _workspace_files(spark, sf_dir, "npm")
    code = Scratch(spark, "routing").table(describe(files), "files")
    model = build_model(code, X.extract(code), "main", detect_workspace(files).table(spark))
    n = model.components()
    return model.files.select("path", "component").join(n.select("component", "files", F.col(next(c for c in n.columns if c not in ("component", "files"))).alias("language")), "component")


# --- the graph of a model

_SERVICE = "v_s AS (SELECT s_suppkey AS k, 'api/s' || s_suppkey || '.ts' AS f FROM supplier), v_u AS (SELECT 'api/util' || range || '.ts' AS f FROM range(3))"
_NODE_ROWS = """SELECT 'file' AS type, f AS name, f AS file FROM v_s UNION ALL SELECT 'file', f, f FROM v_u UNION ALL SELECT 'module', 'api', NULL
UNION ALL SELECT 'symbol', 'Svc' || k, f FROM v_s UNION ALL SELECT 'symbol', 'run', f FROM v_s UNION ALL SELECT 'symbol', 'helper', f FROM v_u UNION ALL SELECT 'symbol', '', f FROM v_s
UNION ALL SELECT 'interface', 'GET /s' || k || '/:id', f FROM v_s UNION ALL SELECT 'data_model', 'Svc' || k, f FROM v_s UNION ALL SELECT 'external', unnest(['Base', 'app.get', 'fetch', 'logger.info']), NULL"""
_SERVICE_NODES = f"WITH {_SERVICE} {_NODE_ROWS}"
_SERVICE_EDGES = f"""{_SERVICE}, v_e AS (SELECT 'calls' AS kind, 'symbol:run' AS s, 'symbol:helper' AS t, 0.95 AS c FROM v_s UNION ALL SELECT 'calls', 'symbol:', 'external:' || x, 0 FROM v_s, (SELECT unnest(['app.get', 'fetch', 'logger.info']) AS x)
UNION ALL SELECT 'contains', 'module:api', 'file:' || f, 1 FROM (SELECT f FROM v_s UNION ALL SELECT f FROM v_u) UNION ALL SELECT 'defines', 'file:' || f, unnest(['data_model:Svc' || k, 'symbol:Svc' || k, 'symbol:run', 'interface:GET /s' || k || '/:id']), 1 FROM v_s
UNION ALL SELECT 'defines', 'file:' || f, 'symbol:helper', 1 FROM v_u UNION ALL SELECT 'exposes', 'module:api', 'symbol:Svc' || k, 1 FROM v_s UNION ALL SELECT 'exposes', 'module:api', unnest(['symbol:run', 'symbol:helper']), 1
UNION ALL SELECT 'extends', 'symbol:Svc' || k, 'external:Base', 0 FROM v_s UNION ALL SELECT 'imports', 'file:' || f, 'file:api/util' || k % 3 || '.ts', 0.95 FROM v_s)"""


def _service_graph(spark, sf_dir):
    return build_model(*_extracted(spark, sf_dir)).graph()


@query(_SERVICE_NODES)
def model_graph_nodes(spark, sf_dir):
    return _service_graph(spark, sf_dir).nodes.select("type", "name", "file")


@query(f"WITH {_SERVICE_EDGES} SELECT kind, s AS source, t AS target, count(*)::BIGINT AS n, round(sum(c), 6)::DOUBLE AS confidence FROM v_e GROUP BY 1, 2, 3")
def model_graph_edges(spark, sf_dir):
    g = _service_graph(spark, sf_dir)
    label = F.concat_ws(":", "type", "name")
    e = g.edges.join(g.nodes.select(F.col("id").alias("src"), label.alias("source")), "src").join(g.nodes.select(F.col("id").alias("dst"), label.alias("target")), "dst")
    return e.groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"""WITH {_SERVICE_EDGES}, v_n AS ({_NODE_ROWS}) SELECT 'node' AS part, type || ':' || name AS label, NULL AS type, count(*)::BIGINT AS n FROM v_n GROUP BY 1, 2, 3
UNION ALL SELECT 'edge', s || '>' || t, kind, count(*) FROM v_e GROUP BY 1, 2, 3""")
def model_graph_json(spark, sf_dir):
    """Every JSON line of the graph, read back: nodes by label, edges by the labels of their ends."""
    lines = Scratch(spark, "json").table(_service_graph(spark, sf_dir).to_json(), "lines")
    node = lines.where("part = 'node'").select(F.from_json("value", "id string, label string, data struct<type string>").alias("v")).select("v.id", F.concat_ws(":", "v.data.type", "v.label").alias("label"))
    edge = lines.where("part = 'edge'").select(F.from_json("value", "source string, target string, type string, confidence double").alias("v")).select("v.*")
    ends = edge.join(node.select(F.col("id").alias("source"), F.col("label").alias("s")), "source").join(node.select(F.col("id").alias("target"), F.col("label").alias("t")), "target")
    rows = node.select(F.lit("node").alias("part"), "label", F.lit(None).cast("string").alias("type")).unionByName(ends.select(F.lit("edge").alias("part"), F.concat_ws(">", "s", "t").alias("label"), "type"))
    return rows.groupBy("part", "label", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {V.EDGES}, b AS (SELECT src AS x, dst AS y FROM v_edges UNION SELECT dst, src FROM v_edges),
w(x, c) USING KEY (x) AS (SELECT p_partkey::VARCHAR, p_partkey::VARCHAR FROM part UNION SELECT b.y, min(w.c) FROM w JOIN b ON w.x = b.x JOIN recurring.w AS o ON o.x = b.y WHERE w.c < o.c GROUP BY b.y),
r AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT a, dst FROM r JOIN v_edges ON b = src),
scc AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT (SELECT count(*) FROM part)::BIGINT AS symbols, (SELECT count(*) FROM part)::BIGINT AS total_nodes, (SELECT count(*) FROM v_edges)::BIGINT AS calls, (SELECT count(*) FROM v_edges)::BIGINT AS total_edges,
(SELECT count(DISTINCT c) FROM w)::BIGINT AS connected_components, (SELECT count(DISTINCT component) FROM scc)::BIGINT AS cycle_count""")
def graph_stats(spark, sf_dir):
    from quarrylens.plans.registry import _part_graph

    s = _part_graph(spark, sf_dir).stats()
    return s.select(F.col("nodes_by_type")["symbol"].alias("symbols"), "total_nodes", F.col("edges_by_type")["calls"].alias("calls"), "total_edges", "connected_components", "cycle_count")


@query(f"""WITH {V.TRADE} SELECT src, dst, 'out' AS side FROM v_calls JOIN customer ON src = 'c' || c_custkey WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT src, dst, 'in' FROM v_calls JOIN part ON dst = 'p' || p_partkey WHERE p_size = 7""")
def graph_neighbours(spark, sf_dir):
    g = G.KnowledgeGraph(V.trade_nodes(spark, sf_dir), V.trade_edges(spark, sf_dir))
    some = lambda t, mark, key, cond: V.table(spark, sf_dir, t).where(cond).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"))
    a = g.neighbours(some("customer", "c", "c_custkey", "c_mktsegment = 'BUILDING'"), ("calls",)).withColumn("side", F.lit("out"))
    b = g.neighbours(some("part", "p", "p_partkey", "p_size = 7"), ("calls",), False).withColumn("side", F.lit("in"))
    return a.unionByName(b).select("src", "dst", "side")


@query("""SELECT min('m' || n_regionkey || '_' || n_nationkey) OVER (PARTITION BY n_regionkey) AS component, n_name AS name FROM nation
QUALIFY count(*) OVER (PARTITION BY n_regionkey) > 1""")
def module_cycles(spark, sf_dir):
    """Nations of a region depend on each other in a ring, and on the next region's first nation; only rings are cycles."""
    n = V.table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    key = F.concat(F.lit("m"), F.col("n_regionkey").cast("string"), F.lit("_"), F.col("n_nationkey").cast("string"))
    n = n.withColumn("id", key).withColumn("first", F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))
    first = F.concat(F.lit("m"), F.col("n_regionkey").cast("string"), F.lit("_"), F.col("first").cast("string"))
    ring = n.select(F.col("id").alias("src"), F.coalesce(F.lead("id").over(w), first).alias("dst")).where("src <> dst")
    heads = n.select("n_regionkey", first.alias("head")).distinct()
    up = n.select(F.col("id").alias("src"), (F.col("n_regionkey") + 1).alias("n_regionkey")).join(heads, "n_regionkey").select("src", F.col("head").alias("dst"))
    edges = ring.withColumn("kind", F.lit("depends_on")).unionByName(up.withColumn("kind", F.lit("depends_on"))).unionByName(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("calls").alias("kind")))
    return T.module_cycles(G.KnowledgeGraph(n.select("id", F.lit("module").alias("type"), F.col("n_name").alias("name")), edges.withColumn("confidence", F.lit(1.0))))


@query("""WITH f AS (SELECT 'm' || p_size % 5 AS module, list(DISTINCT p_brand || '.ts' ORDER BY p_brand || '.ts' DESC) AS files FROM part GROUP BY 1),
p AS (SELECT module, unnest(files) AS file, generate_subscripts(files, 1) AS pos FROM f), e AS (SELECT DISTINCT 'm' || p_size % 5 AS module, p_type AS symbol FROM part)
SELECT module, symbol, arg_min(file, pos) AS file FROM e JOIN p USING (module) WHERE (file, symbol) IN (SELECT p_brand || '.ts', p_type FROM part) GROUP BY 1, 2""")
def exposed_symbols(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("module"), F.concat("p_brand", F.lit(".ts")).alias("file"), F.col("p_type").alias("name"))
    modules = p.groupBy(F.col("module").alias("name")).agg(F.sort_array(F.collect_set("file"), False).alias("files"), F.collect_set("name").alias("exported_symbols"))
    return R.exposed_symbols(modules, p.select("file", "name"))


# --- two models


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m, 'api/s' || s_suppkey || '.ts:' AS f, 'logger.info(''user '' + ' || CASE WHEN s_suppkey % 5 = 0 THEN 'email' ELSE 'name' END || ')' AS log FROM supplier)
SELECT 'interfaces' AS fact, 'removed' AS change_type, 'GET /s' || k || '/:id' AS key FROM s WHERE m < 2 UNION ALL SELECT 'interfaces', 'added', 'GET /t' || k || '/:id' FROM s WHERE m = 0
UNION ALL SELECT 'dependencies', 'removed', 'fetch(''http://x/' || k || ''')' FROM s WHERE m = 1 UNION ALL SELECT 'sinks', 'removed', f || '8 ' || log FROM s WHERE m IN (1, 2) UNION ALL SELECT 'sinks', 'added', f || '9 ' || log FROM s WHERE m = 2
UNION ALL SELECT 'risk', CASE WHEN (SELECT bool_or((m = 0 AND k % 2 = 1) OR (m = 2 AND k % 5 = 0)) FROM s) THEN 'high' ELSE 'medium' END, 'medium'""")
def model_semantic_diff(spark, sf_dir):
    """Every fourth file changes its route, the next is gone, the next gets an empty line at its top, the last stays."""
    old = service_files(spark, sf_dir).select("path", "content")
    k = F.coalesce(F.regexp_extract("path", r"api/s(\d+)\.ts", 1).try_cast("long") % 4, F.lit(3))
    new = old.where(k != 1).select("path", F.when(k == 0, F.replace("content", F.lit("app.get('/s"), F.lit("app.get('/t"))).when(k == 2, F.concat(F.lit("\n"), "content")).otherwise(F.col("content")).alias("content"))
    scratch = Scratch(spark, "diff")
    a, b = (X.fact_tables(scratch.table(X.extract(describe(x)), n)) for x, n in ((old, "old"), (new, "new")))
    d = D.semantic_diff(a, b)
    key = {"interfaces": F.concat_ws(" ", "method", "path"), "dependencies": F.col("target"), "sinks": F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "text")}
    out = d["risk"].select(F.lit("risk").alias("fact"), F.col("security").alias("change_type"), F.col("reliability").alias("key"))
    for name, c in key.items():
        out = out.unionByName(d[name].select(F.lit(name).alias("fact"), "change_type", c.alias("key")))
    return out


@query("""SELECT 'interfaces' AS fact, row_number() OVER (ORDER BY '/s' || s_suppkey || '/:id') AS place, '/s' || s_suppkey || '/:id' AS key FROM supplier
UNION ALL SELECT 'dependencies', row_number() OVER (ORDER BY 'fetch(''http://x/' || s_suppkey || ''')'), 'fetch(''http://x/' || s_suppkey || ''')' FROM supplier
UNION ALL SELECT 'imports', row_number() OVER (ORDER BY './util' || s_suppkey % 3, 'api/s' || s_suppkey || '.ts'), './util' || s_suppkey % 3 || ' api/s' || s_suppkey || '.ts' FROM supplier""")
def ordered_facts(spark, sf_dir):
    """The place of every row in the output order of its table."""
    model = build_model(*_extracted(spark, sf_dir))
    out, facts = None, model.ordered()
    for name, key in (("interfaces", F.col("path")), ("dependencies", F.col("target")), ("imports", F.concat_ws(" ", "source", "file"))):
        at = facts[name].select(key.alias("key"), F.monotonically_increasing_id().alias("at"))
        rows = at.select(F.lit(name).alias("fact"), F.row_number().over(Window.orderBy("at")).cast("long").alias("place"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'src/' || p_partkey || '.ts' WHEN p_partkey % 3 = 1 THEN 'other/' || p_partkey || '.ts' ELSE 'rootless/' || p_partkey || '.ts' END AS path FROM part""")
def relative_paths(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k"))
    at = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/root/src/"), "k")).when(F.col("id") % 3 == 1, F.concat(F.lit("other/"), "k")).otherwise(F.concat(F.lit("/root/rootless/"), "k"))
    return p.select("id", S.append_extension(S.make_relative(at, F.lit("/root")), ".ts").alias("path"))
