"""Registered queries of the engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions import rules, scalar as S
from quarrylens.operators import aggregate as A, diff as D, graph as G, resolve as R, traverse as T
from quarrylens.plans import passes, views as V
from quarrylens.session import Scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _words(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_DIR = r"regexp_extract({0}, '^(.*)/[^/]*$', 1)"
_ROLE = f"""CASE
  WHEN list_has_any(string_split_regex(path, '[/\\\\]'), {_list(rules.GENERATED_DIRECTORIES)}) OR regexp_matches(lower(name), '\\.generated\\.|({_words(rules.GENERATED_ENDINGS)})$') THEN 'generated'
  WHEN list_has_any(string_split_regex(path, '[/\\\\]'), {_list(rules.TEST_DIRECTORIES)}) OR regexp_matches(lower(name), '({_words(rules.TEST_ENDINGS)})$') OR regexp_matches(lower(name), '^test_.*\\.(py|rb)$') THEN 'test'
  WHEN list_contains(string_split_regex(path, '[/\\\\]'), 'docs') THEN 'docs'
  WHEN list_contains({_list(rules.BUILD_NAMES)}, name) THEN 'build'
  WHEN list_contains({_list(rules.CONFIG_EXTENSIONS)}, ext) OR starts_with(lower(name), '.env') OR list_contains({_list(rules.CONFIG_NAMES)}, name) THEN 'config'
  WHEN list_contains({_list(rules.DOC_EXTENSIONS)}, ext) THEN 'docs'
  WHEN list_contains({_list(rules.CODE_EXTENSIONS)}, ext) THEN 'impl' ELSE 'other' END"""
_NAMED = r"v_named AS (SELECT *, regexp_extract(path, '([^/\\]*)$', 1) AS name, regexp_extract(path, '[^/\\]\.([^./\\]*)$', 1) AS ext FROM v_files)"
_ROLES = f"WITH {V.FILES}, {_NAMED}, v_roles AS (SELECT *, {_ROLE} AS file_role FROM v_named)"

# --- scalar operators over text and paths


@query(f"""SELECT lang, count(*)::BIGINT AS files, sum(CASE WHEN regexp_matches(lower(text), '{_words(rules.PII_WORDS)}') THEN 1 ELSE 0 END)::BIGINT AS pii_files,
  sum(strlen(text) // 4)::BIGINT AS tokens FROM documents GROUP BY lang""")
def pii_scan_by_lang(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("lang", S.contains_pii(F.col("text")).alias("pii"), S.estimate_tokens(F.col("text")).alias("t"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("pii"), 1).otherwise(0)).alias("pii_files"), F.sum("t").alias("tokens"))


@query("SELECT source, count(*)::BIGINT AS files, sum(strlen(text) // 4)::BIGINT AS tokens, max(strlen(text) // 4)::BIGINT AS largest FROM documents GROUP BY source")
def token_estimate_by_source(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("source", S.estimate_tokens(F.col("text")).alias("t"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("t").alias("tokens"), F.max("t").alias("largest"))


@query("SELECT sha256(text) AS content_hash, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(f"SELECT role, sum(CASE WHEN regexp_matches(lower(text), '{_words(rules.AUTH_WORDS)}') THEN 1 ELSE 0 END)::BIGINT AS auth_turns, count(*)::BIGINT AS turns FROM conversations GROUP BY role")
def auth_indicator_scan(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select("role", S.is_auth_indicator(F.col("text")).alias("a"))
    return c.groupBy("role").agg(F.sum(F.when(F.col("a"), 1).otherwise(0)).alias("auth_turns"), F.count(F.lit(1)).alias("turns"))


@query(f"{_ROLES} SELECT file_role, count(*)::BIGINT AS n FROM v_roles GROUP BY 1")
def file_role_histogram(spark, sf_dir):
    return A.histogram(V.files(spark, sf_dir).select(S.file_role(F.col("path")).alias("file_role")), "file_role")


_LANG = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.LANGUAGE_OF_EXTENSION.items()) + " END"


@query(f"WITH {V.FILES}, {_NAMED} SELECT {_LANG} AS language, count(*)::BIGINT AS n FROM v_named GROUP BY 1")
def language_detect_histogram(spark, sf_dir):
    return A.histogram(V.files(spark, sf_dir).select(S.language(F.col("path")).alias("language")), "language")


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS params FROM (SELECT p_partkey,
  CASE WHEN p_size % 2 = 0 THEN ['p' || p_size::VARCHAR, 'size', 'key'] ELSE ['p' || p_size::VARCHAR, 'key'] END AS list_distinct_ordered FROM part)""")
def url_path_params(spark, sf_dir):
    size = F.col("p_size").cast("string")
    even = F.when(F.col("p_size") % 2 == 0, F.lit("/{size:\\d+}")).otherwise(F.lit("/{a b}/:/<>"))
    path = F.concat(F.lit("/"), "p_brand", F.lit("/:p"), size, F.lit("(\\d+)"), even, F.lit("/<int:key>/<key>/{key}"))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.path_params(path), ",").alias("params"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'd->' || p_name WHEN 2 THEN 'c' ELSE p_name END AS bare FROM part""")
def bare_name(spark, sf_dir):
    n = F.col("p_name")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("a.b::"), n)).when(F.col("p_size") % 4 == 1, F.concat(F.lit("x.y::d->"), n)).when(F.col("p_size") % 4 == 2, F.lit("a->b.c")).otherwise(F.concat(F.lit("a->"), n))
    return V.table(spark, sf_dir, "part").select("p_partkey", S.bare_name(text).alias("bare"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN './' || p_brand ELSE repeat('../', p_size % 5 - 1) || p_brand END AS js FROM part""")
def python_relative_normalize(spark, sf_dir):
    source = F.concat(F.repeat(F.lit("."), (F.col("p_size") % 5).cast("int")), "p_brand")
    return V.table(spark, sf_dir, "part").select("p_partkey", S.normalize_python_relative(source).alias("js"))


@query("""SELECT p_partkey, p_type || '/' || p_brand AS kept, '../' || p_brand AS up, p_brand AS dropped, '/' || p_brand AS rooted FROM part""")
def path_normalize(spark, sf_dir):
    b, t = F.col("p_brand"), F.col("p_type")
    inside, above = F.concat(t, F.lit("/./x/../"), b), F.concat(F.lit("a/../../"), b)
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", S.normalize_path(inside).alias("kept"), S.normalize_path(above).alias("up"), S.normalize_path(above, False).alias("dropped"), S.normalize_path(F.concat(F.lit("/../"), b)).alias("rooted")
    )


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents")
def string_truncate(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text"), 100).alias("short"))


@query(f"""WITH x AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'fetch' ELSE 'Post' END AS verb FROM part)
SELECT p_partkey, p_name AS unquoted, CASE p_size % 3 WHEN 0 THEN 'GET' WHEN 1 THEN NULL ELSE 'POST' END AS verb, '/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/x' ELSE '' END AS composed,
  p_size % 2 = 0 AS interface_name, p_size % 2 = 1 AS route_object, p_size % 2 = 0 AS file_like, CASE WHEN p_size % 2 = 0 THEN 'public' END AS visibility, p_size % 2 = 0 AS stdlib,
  'f(a)' AS signature, 'one' || chr(10) || 'two' AS doc, 'Text.' AS docstring, 'documentation' AS role FROM x""")  # fmt: skip
def scalar_rules(spark, sf_dir):
    n, even = F.col("p_name"), F.col("p_size") % 2 == 0
    q = F.when(F.col("p_size") % 3 == 0, F.lit("'")).when(F.col("p_size") % 3 == 1, F.lit('"')).otherwise(F.lit("`"))
    verb = F.when(F.col("p_size") % 3 == 0, F.lit("get")).when(F.col("p_size") % 3 == 1, F.lit("fetch")).otherwise(F.lit("Post"))
    pick = lambda a, b: F.when(even, F.lit(a)).otherwise(F.lit(b))
    lang = F.when(F.col("p_size") % 3 == 0, "python").when(F.col("p_size") % 3 == 1, "ruby").otherwise("go")
    cut = F.when(lang == "python", "f(a): x").when(lang == "ruby", "f(a)\n x").otherwise("f(a) { x")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey",
        S.unquote(F.concat(q, n, q)).alias("unquoted"),
        S.http_method(verb).alias("verb"),
        S.compose_path(F.concat(F.lit("/"), "p_brand", F.lit("/")), pick("/x/", "/")).alias("composed"),
        S.is_interface_name(pick("IThing", "Item")).alias("interface_name"),
        S.is_route_object(pick("apps", "router")).alias("route_object"),
        S.looks_like_file_path(pick("x/A.PY", "users/<int:id>/")).alias("file_like"),
        S.visibility_keyword(pick("public", "static")).alias("visibility"),
        S.is_stdlib_module(pick("os.path", "numpy")).alias("stdlib"),
        S.signature(cut, lang).alias("signature"),
        S.clean_block_comment(F.lit("/**\n * one\n *   two\n */")).alias("doc"),
        S.clean_docstring(F.lit('"""Text."""')).alias("docstring"),
        S.role_name(F.lit("docs")).alias("role"),
    )


# --- modules and directories

_MODULE = "CASE WHEN len(p) <= 1 THEN '__root__' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END"


@query(f"""WITH {V.FILES}, m AS (SELECT path, {_MODULE} AS name FROM (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM v_files)),
s AS (SELECT {_MODULE} AS name, sym FROM (SELECT list_filter(string_split(file, '/'), lambda x: x <> '') AS p, name AS sym FROM (WITH {V.SYMBOLS} SELECT * FROM v_symbols) WHERE visibility = 'public'))
SELECT m.name, count(DISTINCT path)::BIGINT AS files, min(path) AS first_file, coalesce((SELECT count(DISTINCT sym) FROM s WHERE s.name = m.name), 0)::BIGINT AS exported FROM m GROUP BY m.name
UNION ALL SELECT s.name, 0, NULL, count(DISTINCT sym)::BIGINT FROM s WHERE s.name NOT IN (SELECT name FROM m) GROUP BY s.name""")
def module_boundaries(spark, sf_dir):
    f, s = V.files(spark, sf_dir), V.symbols(spark, sf_dir)
    f = f.select("path").unionByName(s.select(F.col("file").alias("path")).distinct())
    m = A.module_boundaries(f, s, V.imports(spark, sf_dir))
    real = F.filter("files", lambda x: ~x.endswith(".ts") | x.endswith(".test.ts"))
    return m.select("name", F.size(real).cast("long").alias("files"), F.try_element_at(real, F.lit(1)).alias("first_file"), F.size("exported_symbols").cast("long").alias("exported"))


@query(f"""WITH {V.FILES}, {V.IMPORTS} SELECT DISTINCT src_dir || '/' || lang AS name, 'gone' AS target FROM v_imports WHERE doc_id % 4 = 3""")
def module_dependencies(spark, sf_dir):
    d = A.module_dependencies(V.imports(spark, sf_dir))
    return d.select("name", "target")


@query(f"""WITH {V.FILES}, {_NAMED}, l AS (SELECT path, {_LANG} AS language, strlen(content) // 4 AS t, source, lang FROM v_named),
a AS (SELECT '' AS directory, 0 AS direct, * FROM l UNION ALL SELECT source, 0, * FROM l UNION ALL SELECT source || '/' || lang, 1, * FROM l)
SELECT directory, sum(direct)::BIGINT AS direct_file_count, count(*)::BIGINT AS total_file_count, sum(t)::BIGINT AS total_estimated_tokens, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
  (CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END)::INT AS depth FROM a GROUP BY directory""")
def directory_rollup(spark, sf_dir):
    f = V.files(spark, sf_dir).select("path", S.language(F.col("path")).alias("language"), S.estimate_tokens(F.col("content")).alias("estimated_tokens"))
    return A.directory_rollup(f).withColumn("languages", F.array_join("languages", ","))


@query(f"""{_ROLES}, n AS (SELECT {_DIR.format('path')} AS directory, file_role, count(*) AS k FROM v_roles GROUP BY 1, 2),
d AS (SELECT directory, CASE arg_min(file_role, [-k, CASE WHEN file_role = 'impl' THEN 0 ELSE 1 END, rank]) WHEN 'impl' THEN 'source' WHEN 'other' THEN 'source' ELSE arg_min(file_role, [-k, CASE WHEN file_role = 'impl' THEN 0 ELSE 1 END, rank]) END AS role
  FROM (SELECT *, dense_rank() OVER (ORDER BY file_role) AS rank FROM n) GROUP BY directory),
p AS (SELECT {_DIR.format('directory')} AS directory, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'mixed' END AS role FROM d GROUP BY 1)
SELECT * FROM d UNION ALL SELECT * FROM p UNION ALL SELECT '' AS directory, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'mixed' END FROM p""")
def directory_role(spark, sf_dir):
    return A.directory_roles(V.files(spark, sf_dir).select("path", S.file_role(F.col("path")).alias("file_role")))


@query(f"WITH {V.FILES} SELECT count(DISTINCT d)::BIGINT AS directories FROM (SELECT '' AS d UNION ALL SELECT source FROM v_files UNION ALL SELECT source || '/' || lang FROM v_files)")
def directory_count(spark, sf_dir):
    return A.count_directories(V.files(spark, sf_dir))


@query(f"WITH {V.FILES}, {_NAMED}, l AS (SELECT source, {_LANG} AS language, count(*) AS n FROM v_named GROUP BY 1, 2) SELECT source, arg_max(language, n * 100 + r) AS dominant_language FROM (SELECT *, dense_rank() OVER (ORDER BY language) AS r FROM l WHERE language IS NOT NULL) GROUP BY source")
def dominant_language(spark, sf_dir):
    return A.dominant_language(V.files(spark, sf_dir).select("source", S.language(F.col("path")).alias("language")), ["source"])


# --- resolution

_TIERS = f"""{V.SYMBOLS}, {V.REFERENCES},
r AS (SELECT *, row_number() OVER () AS id, CASE WHEN strpos(target_symbol, '.') > 0 THEN split_part(target_symbol, '.', 2) ELSE target_symbol END AS bare, {_DIR.format('source_file')} AS dir FROM v_refs),
own AS (SELECT file, name, arg_max(line, ordinal) AS line FROM v_symbols GROUP BY 1, 2),
ord AS (SELECT *, {_DIR.format('file')} AS dir, row_number() OVER (PARTITION BY name ORDER BY file, line) AS k, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name, {_DIR.format('file')} ORDER BY file, line) AS kd FROM v_symbols),
best AS (SELECT r.*, CASE WHEN own.line IS NOT NULL THEN 'same_file' WHEN g.n = 1 THEN 'global_unique' WHEN h.line IS NOT NULL THEN 'global_same_dir' WHEN g.n > 1 THEN 'global_ambiguous' ELSE 'unresolved' END AS m,
  CASE WHEN own.line IS NOT NULL THEN r.source_file WHEN g.n = 1 THEN g.file WHEN h.line IS NOT NULL THEN h.file ELSE g.file END AS target_file,
  CASE WHEN own.line IS NOT NULL THEN own.line WHEN g.n = 1 THEN g.line WHEN h.line IS NOT NULL THEN h.line ELSE g.line END AS target_line
  FROM r LEFT JOIN own ON own.file = r.source_file AND own.name = r.bare LEFT JOIN ord g ON g.name = r.bare AND g.k = 1 LEFT JOIN ord h ON h.name = r.bare AND h.dir = r.dir AND h.kd = 1),
scored AS (SELECT *, CASE m WHEN 'same_file' THEN 0.90 WHEN 'global_unique' THEN 0.80 WHEN 'global_same_dir' THEN 0.60 WHEN 'global_ambiguous' THEN 0.40 ELSE 0.0 END AS rc FROM best),
final AS (SELECT *, greatest(confidence, rc) AS c, CASE WHEN confidence > rc THEN 'external' ELSE m END AS method FROM scored)"""


def _no_imports(spark):
    return spark.createDataFrame([], "import_id long, file string, source string, specifiers array<string>, line long")


def _no_files(spark):
    return spark.createDataFrame([], "path string")


def _resolved(spark, sf_dir):
    return R.resolve_references(V.references(spark, sf_dir), _no_imports(spark), V.symbols(spark, sf_dir), _no_files(spark))


@query(f"""WITH {_TIERS} SELECT source_file, method AS resolution_method, count(*)::BIGINT AS n, coalesce(sum(target_line), 0)::BIGINT AS lines, count(DISTINCT target_file)::BIGINT AS targets, round(avg(c), 6)::DOUBLE AS avg_confidence
FROM final GROUP BY 1, 2""")
def symbol_resolve_tiers(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.groupBy("source_file", "resolution_method").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target_line"), F.lit(0).cast("long")).alias("lines"), F.count_distinct("target_file").alias("targets"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


@query(f"WITH {_TIERS} SELECT method AS resolution_method, count(*)::BIGINT AS n FROM final GROUP BY 1")
def resolution_distribution(spark, sf_dir):
    return A.histogram(_resolved(spark, sf_dir), "resolution_method")


@query(f"""WITH {_TIERS} SELECT count(*)::BIGINT AS total, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END)::BIGINT AS resolved, round(avg(c), 6)::DOUBLE AS avg_confidence FROM final WHERE c >= 0.6""")
def filtered_model(spark, sf_dir):
    r = A.filtered_references(_resolved(spark, sf_dir), 0.6)
    return r.agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("confidence") > 0, 1).otherwise(0)).alias("resolved"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(f"""WITH {_TIERS} SELECT {_DIR.format('source_file')} AS source_dir, {_DIR.format('target_file')} AS target_dir, count(*)::BIGINT AS reference_count, round(avg(c), 6)::DOUBLE AS avg_confidence, max(c)::DOUBLE AS max_confidence
FROM final WHERE target_file IS NOT NULL AND m <> 'unresolved' AND {_DIR.format('source_file')} <> {_DIR.format('target_file')} GROUP BY 1, 2""")
def directory_dependencies(spark, sf_dir):
    return A.directory_dependencies(_resolved(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


_PROBE = f"""{V.FILES}, {V.IMPORTS}, tries AS (SELECT import_id, file, i.lang, i.src_dir, source, CASE doc_id % 4 WHEN 0 THEN src_dir || '/' || lang || substr(source, 2) WHEN 1 THEN src_dir || '/' || lang || '/d' || doc_id::VARCHAR || '.test.ts' ELSE 'gone/x' END AS base, doc_id FROM v_imports i WHERE doc_id % 4 <> 2),
cand AS (SELECT import_id, base || e AS path, pos FROM tries, (SELECT unnest({_list(('',) + rules.PROBE_EXTENSIONS + rules.PROBE_INDEXES)}) AS e, generate_subscripts({_list(('',) + rules.PROBE_EXTENSIONS + rules.PROBE_INDEXES)}, 1) AS pos)),
hit AS (SELECT import_id, arg_min(path, pos) AS target_file FROM cand WHERE path IN (SELECT path FROM v_files) GROUP BY 1)"""


@query(f"""WITH {_PROBE} SELECT i.import_id, h.target_file, CASE WHEN doc_id % 4 = 2 THEN 'external' WHEN h.target_file IS NOT NULL THEN 'import_based' ELSE 'unresolved' END AS resolution_method,
  (CASE WHEN doc_id % 4 = 2 THEN 0.6 WHEN h.target_file IS NOT NULL THEN 0.5 ELSE 0.0 END)::DOUBLE AS confidence, s AS target_symbol FROM v_imports i LEFT JOIN hit h USING (import_id), (SELECT unnest(['a', 'b']) AS s)""")
def import_candidate_probe(spark, sf_dir):
    f = V.files(spark, sf_dir)
    i = V.imports(spark, sf_dir)
    none = V.symbols(spark, sf_dir).where("false")
    r = R.resolve_imports(i, none, f)
    ids = i.select(F.col("file").alias("source_file"), "import_id")
    return r.join(ids, "source_file").select("import_id", "target_file", "resolution_method", "confidence", "target_symbol")


@query(f"WITH {V.FILES}, {V.IMPORTS} SELECT source AS target, count(*)::BIGINT AS n FROM v_imports WHERE doc_id % 4 = 2 GROUP BY 1")
def external_imports(spark, sf_dir):
    i = V.imports(spark, sf_dir).withColumn("specifiers", F.array().cast("array<string>"))
    r = R.resolve_imports(i, V.symbols(spark, sf_dir), V.files(spark, sf_dir)).where(F.col("resolution_method") == "external")
    return r.groupBy(F.col("target_symbol").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ROLES}, x AS (SELECT a.path AS s, a.file_role AS sr, b.path AS t, b.file_role AS tr FROM v_roles a LEFT JOIN v_roles b ON b.doc_id = a.doc_id + 7)
SELECT sr AS source_role, count(*)::BIGINT AS n, sum(CASE WHEN sr = 'test' AND coalesce(tr, '') <> 'test' THEN 1 ELSE 0 END)::BIGINT AS test_references FROM x GROUP BY 1""")
def test_reference_tag(spark, sf_dir):
    f = V.files(spark, sf_dir).select("doc_id", "path", S.file_role(F.col("path")).alias("file_role"))
    t = f.select((F.col("doc_id") - 7).alias("doc_id"), F.col("path").alias("target_file"))
    refs = f.select("doc_id", F.col("path").alias("source_file"), F.col("file_role").alias("source_role")).join(t, "doc_id", "left")
    tagged = R.tag_tests(refs, f)
    return tagged.groupBy("source_role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_test_reference"), 1).otherwise(0)).alias("test_references"))


@query(f"""WITH {V.FILES} SELECT CASE WHEN source = 'src1' AND lang = 'en' THEN 'english' WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN 'two' ELSE 'root' END AS component, count(*)::BIGINT AS files FROM v_files GROUP BY 1""")
def longest_prefix_component(spark, sf_dir):
    packages = spark.createDataFrame([("one", "src1", 0), ("again", "src1", 1), ("english", "src1/en", 2), ("two", "src2", 3), ("none", "sr", 4)], "name string, root string, ordinal int")
    return R.assign_component(V.files(spark, sf_dir), packages).groupBy("component").agg(F.count(F.lit(1)).alias("files"))


# --- history

_CHURN = f"""{V.COMMITS}, churn AS (SELECT file AS path, max(ts)::BIGINT AS last_modified, arg_max(author, ts * 1000000 - ordinal) AS last_author, count(*)::BIGINT AS commit_count, count(DISTINCT author)::BIGINT AS distinct_authors FROM v_commits GROUP BY 1)"""


@query(f"WITH {_CHURN} SELECT * FROM churn")
def git_file_churn(spark, sf_dir):
    return A.file_churn(V.commits(spark, sf_dir))


@query(f"WITH {_CHURN} SELECT count(DISTINCT last_author)::BIGINT AS total_authors, sum(commit_count)::BIGINT AS total_commits, round(avg(commit_count), 6)::DOUBLE AS avg_commits_per_file FROM churn")
def git_repo_stats(spark, sf_dir):
    return A.repo_stats(A.file_churn(V.commits(spark, sf_dir))).withColumn("avg_commits_per_file", F.round("avg_commits_per_file", 6))


@query(f"WITH {_CHURN} SELECT path, commit_count FROM churn ORDER BY commit_count DESC, path LIMIT 10")
def hottest_files(spark, sf_dir):
    return A.hottest_files(A.file_churn(V.commits(spark, sf_dir)))


@query(f"WITH {_CHURN}, f AS (SELECT DISTINCT event_type || '/' || (event_id % 41)::VARCHAR AS path FROM events) SELECT f.path, coalesce(commit_count, 0)::BIGINT AS commit_count, last_author FROM f LEFT JOIN churn USING (path)")
def merged_history(spark, sf_dir):
    f = V.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("event_id") % 41).cast("string")).alias("path")).distinct()
    m = R.merge_history(f, A.file_churn(V.commits(spark, sf_dir)))
    return m.select("path", F.coalesce(F.col("git_metadata.commit_count"), F.lit(0).cast("long")).alias("commit_count"), F.col("git_metadata.last_author").alias("last_author"))


# --- differences

_SNAP = """v_old AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate < (SELECT quantile_disc(o_orderdate, 0.5) FROM orders)),
v_new AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate >= (SELECT quantile_disc(o_orderdate, 0.5) FROM orders)),
changes AS (SELECT *, 'added' AS change_type FROM v_new n WHERE NOT EXISTS (SELECT 1 FROM v_old o WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority)
  UNION ALL SELECT *, 'removed' FROM v_old o WHERE NOT EXISTS (SELECT 1 FROM v_new n WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority))"""


def _snapshots(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    cut = o.select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t)").alias("cut"))
    o = o.crossJoin(F.broadcast(cut)).withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")))  # one row
    cols = ("o_custkey", "o_orderpriority", "o_totalprice")
    return o.where("t < cut").select(*cols), o.where("t >= cut").select(*cols)


@query(f"WITH {_SNAP} SELECT change_type, o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2)::DOUBLE AS total FROM changes GROUP BY 1, 2")
def snapshot_diff(spark, sf_dir):
    c = D.diff_by_key(*_snapshots(spark, sf_dir), ("o_custkey", "o_orderpriority"))
    return c.groupBy("change_type", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {_SNAP} SELECT CASE WHEN bool_or(change_type = 'added' AND o_totalprice > 400000) OR bool_or(change_type = 'added' AND o_orderpriority LIKE '1%') THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'low' END AS security, CASE WHEN count(*) > 0 THEN 'medium' ELSE 'low' END AS reliability FROM changes")
def diff_risk_summary(spark, sf_dir):
    c = D.diff_by_key(*_snapshots(spark, sf_dir), ("o_custkey", "o_orderpriority"))
    routes = c.withColumn("auth", F.when(F.col("o_totalprice") <= 400000, F.lit("jwt")))
    sinks = c.withColumn("contains_pii", F.col("o_orderpriority").startswith("1"))
    return D.risk(routes, sinks)


# --- the graph


def _facts(spark, sf_dir):
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    c = V.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(n, "n_nationkey")
    files = n.select(F.col("n_name").alias("path"))
    symbols = c.select(F.col("c_name").alias("name"), F.col("n_name").alias("file"), F.col("c_custkey").alias("line"), F.lit("class").alias("kind"))
    modules = r.join(n.withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey").groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("files")).select(F.col("r_name").alias("name"), "files", F.array().cast("array<string>").alias("exported_symbols"), F.array(F.lit("CORE")).alias("depends_on"))
    o = V.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").join(c, "c_custkey")
    refs = o.select(
        F.col("c_name").alias("source_symbol"), F.col("n_name").alias("source_file"), F.col("o_orderkey").alias("source_line"), F.col("o_orderpriority").alias("target_symbol"), F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("long").alias("target_line"),
        F.when(F.col("o_orderstatus") == "F", "extends").otherwise("call").alias("reference_kind"), F.lit(0.5).alias("confidence"),
    )
    routes = spark.createDataFrame([], "method string, path string, file string, line long")
    models = spark.createDataFrame([], "name string, file string, line long, model_kind string")
    return {"files": files, "symbols": symbols, "interfaces": routes, "data_models": models, "references": refs, "modules": modules}


@query("""SELECT 'module' AS type, r_name AS name, NULL AS file FROM region UNION ALL SELECT 'module', 'CORE', NULL UNION ALL SELECT 'file', n_name, n_name FROM nation
UNION ALL SELECT 'symbol', c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT DISTINCT 'external', o_orderpriority, NULL FROM orders JOIN customer ON c_custkey = o_custkey""")
def graph_nodes(spark, sf_dir):
    return G.KnowledgeGraph.from_facts(_facts(spark, sf_dir)).nodes.select("type", "name", "file")


_GRAPH_EDGES = """SELECT 'defines' AS kind, n_name AS a, c_name AS b, 1.0 AS c FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'contains', r_name, n_name, 1.0 FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'depends_on', r_name, 'CORE', 1.0 FROM region
UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'extends' ELSE 'calls' END, c_name, o_orderpriority, 0.5 FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(f"SELECT kind, a AS src_name, b AS dst_name, count(*)::BIGINT AS n, sum(c)::DOUBLE AS confidence FROM ({_GRAPH_EDGES}) GROUP BY 1, 2, 3")
def graph_edges(spark, sf_dir):
    g = G.KnowledgeGraph.from_facts(_facts(spark, sf_dir))
    names = g.nodes.select("id", "name")
    e = g.edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return e.groupBy("kind", "src_name", "dst_name").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))


@query(f"SELECT kind, count(*)::BIGINT AS n FROM ({_GRAPH_EDGES}) GROUP BY 1")
def graph_type_counts(spark, sf_dir):
    return A.histogram(G.KnowledgeGraph.from_facts(_facts(spark, sf_dir)).edges, "kind")


def _part_graph(spark, sf_dir):
    e = V.edges(spark, sf_dir)
    none = F.lit(None).cast("string")
    p = V.table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("symbol").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), none.alias("kind"), none.alias("method"), none.alias("path"))
    return G.KnowledgeGraph(nodes, e)


@query(f"""WITH {V.EDGES} SELECT p_partkey::VARCHAR AS id, (SELECT count(*) FROM v_edges WHERE dst = p_partkey::VARCHAR)::BIGINT AS in_degree, (SELECT count(*) FROM v_edges WHERE src = p_partkey::VARCHAR)::BIGINT AS out_degree FROM part""")
def degree_centrality(spark, sf_dir):
    g = _part_graph(spark, sf_dir)
    return G.degrees(g.nodes, g.edges).select("id", "in_degree", "out_degree")


def _walk_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {V.EDGES}, seed AS (SELECT p_partkey::VARCHAR AS id FROM part WHERE p_name = (SELECT min(p_name) FROM part)),
w AS (SELECT id, 0 AS depth FROM seed UNION SELECT {b}, depth + 1 FROM w JOIN v_edges ON {a} = id WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM w WHERE id NOT IN (SELECT id FROM seed) GROUP BY id"""


def _first_name(spark, sf_dir):
    return V.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]


@query(_walk_sql("dst", "src"))
def callers_depth3(spark, sf_dir):
    return T.callers(_part_graph(spark, sf_dir), _first_name(spark, sf_dir), 3)


@query(_walk_sql("src", "dst"))
def callees_depth3(spark, sf_dir):
    return T.callees(_part_graph(spark, sf_dir), _first_name(spark, sf_dir), 3)


def _levels_sql(n: int) -> str:
    out = "l0 AS (SELECT p_partkey::VARCHAR AS id, 1.0::DOUBLE AS c FROM part WHERE p_name = (SELECT min(p_name) FROM part)), s0 AS (SELECT id FROM l0)"
    for k in range(1, n + 1):
        out += f", l{k} AS (SELECT src AS id, max(c * confidence) AS c FROM l{k - 1} JOIN v_edges ON dst = id WHERE c * confidence >= 0.1 AND src NOT IN (SELECT id FROM s{k - 1}) GROUP BY src), s{k} AS (SELECT id FROM s{k - 1} UNION ALL SELECT id FROM l{k})"
    return out


@query(f"WITH {V.EDGES}, {_levels_sql(3)} " + " UNION ALL ".join(f"SELECT id, {k}::INT AS depth, round(c, 6)::DOUBLE AS confidence FROM l{k}" for k in (1, 2, 3)))
def impact_analysis(spark, sf_dir):
    return T.impact(_part_graph(spark, sf_dir), _first_name(spark, sf_dir), 3).withColumn("confidence", F.round("confidence", 6))


@query("SELECT 'down' AS direction, c_name AS name, 1::INT AS depth FROM customer UNION ALL SELECT 'up', 'top', 1")
def type_hierarchy(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    e = c.select(F.col("c_name").alias("src"), F.lit("base").alias("dst"), F.lit("extends").alias("kind"), F.lit(1.0).alias("confidence"))
    e = e.unionByName(spark.createDataFrame([("base", "top", "implements", 1.0)], e.schema))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select("id", F.lit("symbol").alias("type"), F.col("id").alias("name"))
    return T.type_hierarchy(G.KnowledgeGraph(nodes, e), "base", "both").select("direction", F.col("id").alias("name"), "depth")


@query(f"""WITH RECURSIVE {V.EDGES}, r AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT a, dst FROM r JOIN v_edges ON b = src)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def scc_cycles(spark, sf_dir):
    return T.cycles(V.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {V.EDGES}, b AS (SELECT src AS x, dst AS y FROM v_edges UNION SELECT dst, src FROM v_edges),
r(x, c) USING KEY (x) AS (SELECT p_partkey::VARCHAR, p_partkey::VARCHAR FROM part
  UNION SELECT b.y, min(r.c) FROM r JOIN b ON r.x = b.x JOIN recurring.r AS o ON o.x = b.y WHERE r.c < o.c GROUP BY b.y)
SELECT x AS id, c AS component FROM r""")
def wcc(spark, sf_dir):
    g = _part_graph(spark, sf_dir)
    return G.weak_components(g.nodes, g.edges)


_ENTRIES = f"""d AS (SELECT id, name, type, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM v_nodes LEFT JOIN (SELECT dst AS id, count(*) AS i FROM v_calls GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM v_calls GROUP BY 1) USING (id)),
v_entries AS (SELECT id, CASE WHEN o >= 2 AND o / greatest(i, 1) >= 3.0 THEN 'high_fan_out_low_fan_in' ELSE 'name_pattern' END AS reason, o::BIGINT AS out_degree, i::BIGINT AS in_degree FROM d
  WHERE (o >= 2 AND o / greatest(i, 1) >= 3.0) OR (type = 'symbol' AND regexp_matches(lower(name), '{_words(rules.ENTRY_WORDS)}')))"""


def _trade_graph(spark, sf_dir):
    return G.KnowledgeGraph(V.trade_nodes(spark, sf_dir), V.trade_edges(spark, sf_dir))


@query(f"WITH {V.TRADE}, {_ENTRIES} SELECT * FROM v_entries")
def entry_points(spark, sf_dir):
    g = _trade_graph(spark, sf_dir)
    return passes.entry_points(G.degrees(g.nodes, g.edges)).select("id", "reason", "out_degree", "in_degree")


@query(f"""WITH RECURSIVE {V.TRADE}, {_ENTRIES}, w(entry, id, depth) USING KEY (entry, id) AS (SELECT id, id, 0 FROM v_entries
  UNION SELECT DISTINCT w.entry, dst, w.depth + 1 FROM w JOIN v_calls ON src = w.id LEFT JOIN recurring.w AS o ON o.entry = w.entry AND o.id = dst WHERE w.depth < {rules.FLOW_DEPTH} AND o.id IS NULL)
SELECT entry, string_agg(name, '>' ORDER BY depth, name, id) AS names, coalesce(array_to_string(list_sort(list(DISTINCT file) FILTER (file IS NOT NULL)), ','), '') AS files, max(depth)::INT AS depth, bool_or(type = 'external') AS reaches_external
FROM w JOIN v_nodes USING (id) GROUP BY entry HAVING count(*) > 1""")
def process_flows(spark, sf_dir):
    g, scratch = _trade_graph(spark, sf_dir), Scratch(spark, "trade")
    g = G.KnowledgeGraph(g.nodes, scratch.table(g.edges, "edges"))  # read several times
    degree = scratch.table(G.degrees(g.nodes, g.edges), "degrees")
    return passes.process_flows(g, passes.entry_points(degree), degree=degree).select("entry", F.array_join("names", ">").alias("names"), F.array_join("files_touched", ",").alias("files"), "depth", "reaches_external")


@query("""WITH f AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderkey) AS names FROM orders GROUP BY 1)
SELECT id, array_to_string(names, '>') AS names FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE len(g.names) > len(f.names) AND g.names[1:len(f.names)] = f.names)""")
def flow_dedup(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    f = o.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("names"))
    return D.drop_prefixes(f).select("id", F.array_join("names", ">").alias("names"))


@query("SELECT count(*)::BIGINT AS lines, count(DISTINCT id)::BIGINT AS nodes FROM (SELECT c_name AS id FROM customer UNION ALL SELECT n_name FROM nation)")
def graph_json(spark, sf_dir):
    lines = G.KnowledgeGraph.from_facts(_facts(spark, sf_dir)).to_json().where(F.col("part") == "node").select(F.from_json("value", "id string, label string, data struct<type string>").alias("v"))
    return lines.where(F.col("v.data.type").isin("symbol", "file")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("v.label").alias("nodes"))


def queries() -> dict[str, Query]:
    from quarrylens.plans import language_queries, model_queries, source_queries  # noqa: F401 - register the queries over source text

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
