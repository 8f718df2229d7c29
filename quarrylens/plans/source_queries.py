"""Queries over source text that is generated from the driver's tables, so that SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylens.operators import extract as X
from quarrylens.operators.search import SearchPattern, StructuralSearch
from quarrylens.plans import passes, views as V
from quarrylens.plans.model import build_model
from quarrylens.plans.registry import query
from quarrylens.session import Scratch
from quarrylens.sources.files import describe
from quarrylens.sources.gitlog import MARK, parse_log
from quarrylens.streaming.state import FactStore


def service_files(spark, sf_dir) -> DataFrame:
    """One TypeScript file for each supplier, and three with helpers."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("import { helper } from './util"), (F.col("s_suppkey") % 3).cast("string"), F.lit("';\n"),
        F.lit("/** Service. */\nexport class Svc"), k, F.lit(" extends Base {\n  name: string;\n  run(id: string) { return helper(id); }\n}\n"),
        F.lit("app.get('/s"), k, F.lit("/:id', "), F.when(F.col("s_suppkey") % 2 == 0, F.lit("requireAuth, ")).otherwise(F.lit("")), F.lit("getS"), k, F.lit(");\n"),
        F.lit("logger.info('user ' + "), F.when(F.col("s_suppkey") % 5 == 0, F.lit("email")).otherwise(F.lit("name")), F.lit(");\n"),
        F.lit("const k = process.env.KEY_"), F.col("s_nationkey").cast("string"), F.lit(";\nfetch('http://x/"), k, F.lit("');\n"),
    )
    s = V.table(spark, sf_dir, "supplier").select(F.concat(F.lit("api/s"), k, F.lit(".ts")).alias("path"), text.alias("content"))
    util = spark.range(3).select(F.concat(F.lit("api/util"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("export function helper(x) { return x; }\n").alias("content"))
    return describe(s.unionByName(util))


def _extracted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files and their facts, extracted once and kept in the shared folder for all that reads them."""
    scratch = Scratch(spark, "model")
    f = scratch.table(service_files(spark, sf_dir), "files")
    return f, scratch.table(X.extract(f), "facts")


def _facts(spark, sf_dir) -> dict[str, DataFrame]:
    return X.fact_tables(X.extract(service_files(spark, sf_dir)))


@query("""SELECT 'api/s' || s_suppkey || '.ts' AS file, 'GET' AS method, '/s' || s_suppkey || '/:id' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'requireAuth' END AS auth, 'getS' || s_suppkey AS handler, 'id' AS params, 7::BIGINT AS line FROM supplier""")
def extract_routes(spark, sf_dir):
    return _facts(spark, sf_dir)["interfaces"].select("file", "method", "path", F.col("auth.name").alias("auth"), F.col("handler_name").alias("handler"), F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("params"), "line")


@query("SELECT 'api/s' || s_suppkey || '.ts' AS file, s_suppkey % 5 = 0 AS contains_pii, 8::BIGINT AS line FROM supplier")
def extract_sinks(spark, sf_dir):
    return _facts(spark, sf_dir)["sinks"].select("file", "contains_pii", "line")


@query("SELECT 'fetch(''http://x/' || s_suppkey || ''')' AS target, 'http_call' AS dependency_type FROM supplier")
def extract_http_calls(spark, sf_dir):
    return _facts(spark, sf_dir)["dependencies"].select("target", "dependency_type")


@query("""SELECT 'Svc' || s_suppkey AS name, 'class' AS kind, 'public' AS visibility, NULL AS parent, 'Service.' AS doc FROM supplier UNION ALL SELECT 'run', 'method', 'public', 'Svc' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 'helper', 'function', 'public', NULL, NULL FROM range(3)""")
def extract_symbols(spark, sf_dir):
    return _facts(spark, sf_dir)["symbols"].select("name", "kind", "visibility", "parent", "doc")


@query("SELECT 'KEY_' || s_nationkey AS var_name, count(*)::BIGINT AS n FROM supplier GROUP BY 1")
def extract_env(spark, sf_dir):
    return _facts(spark, sf_dir)["env_dependencies"].groupBy("var_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Svc' || s_suppkey AS name, 'class' AS model_kind, 'Base' AS parent_type, 'name:string' AS fields FROM supplier")
def extract_data_models(spark, sf_dir):
    m = _facts(spark, sf_dir)["data_models"]
    return m.select("name", "model_kind", "parent_type", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["field_type"])), ",").alias("fields"))


@query("""SELECT reference_kind, method AS resolution_method, round(c, 6)::DOUBLE AS confidence, count(*)::BIGINT AS n FROM (
SELECT 'import' AS reference_kind, 'import_based' AS method, 0.95 AS c FROM supplier UNION ALL SELECT 'call', 'import_based', 0.95 FROM supplier
UNION ALL SELECT 'call', 'unresolved', 0.0 FROM supplier, range(3) UNION ALL SELECT 'extends', 'unresolved', 0.0 FROM supplier) GROUP BY ALL""")
def model_references(spark, sf_dir):
    r = build_model(*_extracted(spark, sf_dir)).references
    return r.groupBy("reference_kind", "resolution_method", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (count(*) + 3)::BIGINT AS total_files, (6 * count(*))::BIGINT AS total_references, (2 * count(*))::BIGINT AS resolved_references, round(1.9 / 6, 6)::DOUBLE AS avg_confidence, count(*)::BIGINT AS total_interfaces,
sum(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS authenticated_interfaces, sum(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS pii_sinks, (2 * count(*) + 3)::BIGINT AS total_symbols, count(*)::BIGINT AS total_data_models, 'impl' AS roles FROM supplier""")
def model_stats(spark, sf_dir):
    s = build_model(*_extracted(spark, sf_dir)).stats()
    return s.select("total_files", "total_references", "resolved_references", F.round("avg_confidence", 6).alias("avg_confidence"), "total_interfaces", "authenticated_interfaces", "pii_sinks", "total_symbols", "total_data_models", F.array_join(F.map_keys("file_roles"), ",").alias("roles"))


@query("""SELECT reason, count(*)::BIGINT AS n FROM (SELECT 'http_endpoint' AS reason FROM supplier UNION ALL SELECT 'name_pattern' FROM supplier
UNION ALL SELECT 'high_fan_out_low_fan_in' FROM supplier UNION ALL SELECT 'high_fan_out_low_fan_in' FROM supplier UNION ALL SELECT 'high_fan_out_low_fan_in') GROUP BY 1""")
def model_entry_points(spark, sf_dir):
    graph = build_model(*_extracted(spark, sf_dir)).graph()
    found = passes.AnalysisPipeline([passes.DegreePass(), passes.EntryPointPass()]).run(graph).found
    return found["entry_points"].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT 'p' || page_id || '.js' AS path, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's'), chr(10)), 'track\((\d+)\)', 1)) AS captured FROM pages""")
def structural_search(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1)), "\n").alias("content"))
    found = StructuralSearch([SearchPattern("track", "javascript", "track($N)")]).search(p)
    return found.select("path", F.col("captured_vars")["N"].alias("captured"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'api/s' || s_suppkey || '.ts' AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'email' ELSE 'name' END AS w FROM supplier)
SELECT path, 'help' AS pattern_id, 5::BIGINT AS line, 'helper(id)' AS text, 'X=id' AS captured FROM s UNION ALL SELECT path, 'log', 8, 'logger.info(''user '' + ' || w || ')', 'ARGS=''user '' + ' || w FROM s
UNION ALL SELECT path, 'route', 7, 'app.get(''/s' || k || '/:id'', ' || CASE WHEN k % 2 = 0 THEN 'requireAuth, ' ELSE '' END || 'getS' || k || ')', 'PATH=''/s' || k || '/:id''' || CASE WHEN k % 2 = 0 THEN '' ELSE ';REST=getS' || k END FROM s
UNION ALL SELECT path, 'nested', 11, 'f(f(' || k || '))', 'X=f(' || k || ')' FROM s UNION ALL SELECT path, 'nested', 11, 'f(' || k || ')', 'X=' || k FROM s""")
def structural_search_calls(spark, sf_dir):
    """Patterns with one and with any number of arguments over service files; members and declarations are no calls of their names."""
    f = service_files(spark, sf_dir).where(F.col("path").rlike(r"/s\d+\.ts$")).withColumn("k", F.regexp_extract("path", r"(\d+)", 1))
    f = f.select("path", F.concat("content", F.lit("f(f("), "k", F.lit(")); o.f(1); function f(x) { return g.helper(x); }\n")).alias("content"))
    patterns = {"help": "helper($X)", "log": "logger.info($$$ARGS)", "route": "app.get($PATH, $$$REST)", "nested": "f($X)"}
    found = StructuralSearch([SearchPattern(i, "typescript", p) for i, p in patterns.items()]).search(f)
    named = F.transform(F.array_sort(F.map_entries("captured_vars")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("path", "pattern_id", "line", "text", F.array_join(named, ";").alias("captured"))


@query(f"""WITH {V.FILES} SELECT path, sha256(CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE content END) AS content_hash, true AS same_facts FROM v_files WHERE doc_id % 10 <> 3 AND doc_id % 10 IN (0, 1, 3, 4, 6, 8, 9)""")
def incremental_equals_full(spark, sf_dir):
    """Half of the files first, then the rest, changes and deletions as batches; the store ends in the final state, with the facts of a full run."""
    f = V.files(spark, sf_dir)
    store = FactStore(spark)
    store.replace_all(f.where("doc_id % 2 = 0").select("path", "content"))
    store.apply(f.where("doc_id % 2 = 1").select("path", "content"))
    changed = f.where("doc_id % 10 = 0").select("path", F.lit("changed").alias("content"))
    store.apply(changed, f.where("doc_id % 10 = 3").select("path"))
    final = f.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("content")).alias("content"))
    facts = lambda df: F.to_json(F.struct(*sorted(c for c in df.columns if c in X.FACT_NAMES)))
    full = X.extract(describe(final))
    full, kept = full.select("path", facts(full).alias("full")), store.rows()
    return kept.select("path", "content_hash", facts(kept).alias("kept")).join(full, "path", "full").select("path", "content_hash", F.col("kept").eqNullSafe(F.col("full")).alias("same_facts"))


@query("""SELECT 'u' || user_id AS author, count(*)::BIGINT AS files, count(DISTINCT event_id)::BIGINT AS commits FROM events, range(2) WHERE event_id % 9 <> 0 GROUP BY 1""")
def git_log_parse(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    ts = F.when(F.col("event_id") % 9 == 0, F.lit("never")).otherwise(F.col("event_id").cast("string"))
    raw = e.select(F.concat(F.lit(MARK + "\nu"), F.col("user_id").cast("string"), F.lit("\n"), ts, F.lit("\n\na.py\nb/"), "event_type", F.lit("\n")).alias("raw"), "event_id")
    rows = parse_log(raw.groupBy((F.col("event_id") % 16).alias("g")).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"])).alias("raw")))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("ts").alias("commits"))
