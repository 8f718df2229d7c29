"""Adapter views: the driver's tables seen as source files, symbols, references, commits and graphs.

Each view is a Spark function and the DuckDB text of the same view, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ENDINGS = (".py", ".test.ts", ".md", ".go", ".pb.go", ".yaml", "_test.py", ".txt", ".tsx", ".rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files `source/lang/doc_id<ending>`."""
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*(F.lit(e) for e in ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("content"), "doc_id", "lang", "source")


FILES = f"""v_files AS (SELECT source || '/' || lang || '/d' || doc_id::VARCHAR || list_extract({list(ENDINGS)}, (doc_id % {len(ENDINGS)} + 1)::INT) AS path,
  text AS content, doc_id, lang, source FROM documents)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: name p_name, file `p_type/p_brand.ts`, line and ordinal p_partkey."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_name").alias("name"), F.concat("p_type", F.lit("/"), "p_brand", F.lit(".ts")).alias("file"), F.col("p_partkey").alias("line"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility")
    )


SYMBOLS = """v_symbols AS (SELECT p_name AS name, p_type || '/' || p_brand || '.ts' AS file, p_partkey AS line, p_partkey AS ordinal,
  CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM part)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as calls from the part's file to the name of another part."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("l_partkey"), F.concat("p_type", F.lit("/"), "p_brand", F.lit(".ts")).alias("source_file"), F.col("p_name").alias("source_symbol"))
    b = p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("callee"))
    r = li.join(a, "l_partkey").join(b, "l_suppkey")
    target = F.when(F.col("l_linenumber") % 7 == 0, F.lit("nowhere")).when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("obj."), "callee")).otherwise(F.col("callee"))
    return r.select(
        "source_symbol", "source_file", F.col("l_orderkey").alias("source_line"), target.alias("target_symbol"), F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("long").alias("target_line"),
        F.lit("call").alias("reference_kind"), F.when(F.col("l_linenumber") == 5, 0.85).otherwise(0.0).alias("confidence"), F.lit("external").alias("resolution_method"),
    )


REFERENCES = """v_refs AS (SELECT a.p_name AS source_symbol, a.p_type || '/' || a.p_brand || '.ts' AS source_file, l_orderkey AS source_line,
  CASE WHEN l_linenumber % 7 = 0 THEN 'nowhere' WHEN l_linenumber % 2 = 0 THEN 'obj.' || b.p_name ELSE b.p_name END AS target_symbol,
  CASE WHEN l_linenumber = 5 THEN 0.85 ELSE 0.0 END AS confidence
  FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from a part to the next part of its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.lead("l_partkey").over(w).cast("string").alias("dst"), (1 - F.col("l_discount")).alias("c"))
    e = li.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return e.groupBy("src", "dst").agg(F.max("c").alias("confidence")).withColumn("kind", F.lit("calls"))


EDGES = """v_edges AS (SELECT src, dst, max(c) AS confidence FROM (SELECT l_partkey::VARCHAR AS src,
  (lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::VARCHAR AS dst, 1 - l_discount AS c FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name and file of customers, orders and parts as symbols and of nations as external."""
    of = lambda t, mark, key, name, file, kind="symbol": table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), name.alias("name"), file.alias("file"))
    parts = [
        of("customer", "c", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
        of("orders", "o", "o_orderkey", F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")),
        of("part", "p", "p_partkey", F.col("p_name"), F.col("p_brand")),
        of("nation", "n", "n_nationkey", F.col("n_name"), F.lit(None).cast("string"), "external"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of customers to their orders, of orders to their parts, of parts to the nations that supply them."""
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    pairs = lambda df, of, a, to, b: df.select(a, b).distinct().select(name(of, a).alias("src"), name(to, b).alias("dst"))
    li = table(spark, sf_dir, "lineitem")
    supplied = li.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    e = pairs(table(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey").union(pairs(li, "o", "l_orderkey", "p", "l_partkey")).union(pairs(supplied, "p", "l_partkey", "n", "s_nationkey"))
    return e.select("src", "dst", F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"))


TRADE = """v_nodes AS (SELECT 'c' || c_custkey AS id, 'symbol' AS type, c_name AS name, c_mktsegment AS file FROM customer UNION ALL
  SELECT 'o' || o_orderkey, 'symbol', 'order' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'p' || p_partkey, 'symbol', p_name, p_brand FROM part UNION ALL
  SELECT 'n' || n_nationkey, 'external', n_name, NULL FROM nation),
v_calls AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION
  SELECT 'p' || l_partkey, 'n' || s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits of user_id to a file named by type and value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 37).cast("string")).alias("file"), F.col("event_id").alias("ordinal"))


COMMITS = "v_commits AS (SELECT 'u' || user_id::VARCHAR AS author, floor(epoch(ts::TIMESTAMP))::BIGINT AS ts, event_type || '/' || (event_id % 37)::VARCHAR AS file, event_id AS ordinal FROM events)"


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import a file: of a neighbour by relative path (with or without its ending), or of a package."""
    f = files(spark, sf_dir)
    k = F.col("doc_id") % 4
    near = F.concat(F.lit("./d"), (F.col("doc_id") + 10 * (F.col("doc_id") % 3)).cast("string"))
    source = F.when(k == 0, near).when(k == 1, F.concat(F.lit("../"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".test.ts"))).when(k == 2, F.lit("react")).otherwise(F.lit("../../gone/x"))
    return f.select(F.col("doc_id").alias("import_id"), F.col("path").alias("file"), source.alias("source"), F.array(F.lit("a"), F.lit("b")).alias("specifiers"), F.lit(1).cast("long").alias("line"))


IMPORTS = """v_imports AS (SELECT doc_id AS import_id, path AS file, lang, source AS src_dir, CASE doc_id % 4 WHEN 0 THEN './d' || (doc_id + 10 * (doc_id % 3))::VARCHAR
  WHEN 1 THEN '../' || lang || '/d' || doc_id::VARCHAR || '.test.ts' WHEN 2 THEN 'react' ELSE '../../gone/x' END AS source, doc_id FROM v_files)"""
