"""Aggregations: whole-model statistics, modules, directories, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrylens.functions import rules, scalar as S


def dominant_language(files: DataFrame, by: list[str] | None = None, default: str = "typescript") -> DataFrame:
    """The most frequent language (ties: the greatest name) of all files, or of each group."""
    by = by or []
    n = files.where(F.col("language").isNotNull()).groupBy(*by, "language").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("language", F.struct("n", "language"))
    out = n.groupBy(*by).agg((best if by else F.coalesce(best, F.lit(default))).alias("dominant_language"))
    return out


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with a map from value to count."""
    h = histogram(df.where(F.col(column).isNotNull()), column)
    return h.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name))


def model_stats(files: DataFrame, facts: dict[str, DataFrame], references: DataFrame) -> DataFrame:
    """One row of counters over the fact tables; each table is read once, and only one-row results are joined."""
    one = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_estimated_tokens"))
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    refs = references.agg(
        F.count(F.lit(1)).alias("total_references"),
        flag(F.col("confidence") > 0).alias("resolved_references"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        flag(F.col("reference_kind") == "import").alias("total_imports"),
        flag(F.col("reference_kind") == "call").alias("total_calls"),
        flag(F.col("is_test_reference")).alias("test_references"),
    )
    parts = [one, refs, facts["interfaces"].agg(F.count(F.lit(1)).alias("total_interfaces"), flag(F.col("auth").isNotNull()).alias("authenticated_interfaces"))]
    parts.append(facts["sinks"].agg(F.count(F.lit(1)).alias("total_sinks"), flag(F.col("contains_pii")).alias("pii_sinks")))
    for name in ("dependencies", "symbols", "data_models", "env_dependencies", "modules"):
        if name in facts:
            parts.append(facts[name].agg(F.count(F.lit(1)).alias(f"total_{name}")))
    parts.append(histogram_map(files, "file_role", "file_roles"))
    parts.append(histogram_map(references, "resolution_method", "resolution_method_distribution"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def filtered_references(references: DataFrame, least: float) -> DataFrame:
    return references.where(F.col("confidence") >= least)


def module_boundaries(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """name, files, exported_symbols (public ones) and depends_on (relative imports into other modules)."""
    f = files.select("path", S.module_name(F.col("path")).alias("name"))
    out = f.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("files"))
    public = symbols.where(F.col("visibility") == "public").select(S.module_name(F.col("file")).alias("name"), F.col("name").alias("symbol"))
    out = out.join(public.groupBy("name").agg(F.sort_array(F.collect_set("symbol")).alias("exported_symbols")), "name", "left")
    out = out.join(module_dependencies(imports).groupBy("name").agg(F.sort_array(F.collect_set("target")).alias("depends_on")), "name", "left")
    empty = F.array().cast("array<string>")
    return out.select("name", "files", F.coalesce("exported_symbols", empty).alias("exported_symbols"), F.coalesce("depends_on", empty).alias("depends_on"))


def module_dependencies(imports: DataFrame) -> DataFrame:
    """imports(file, source) -> distinct (name, target) of different modules; only `./` and `../` sources count."""
    full = F.when(S.directory(F.col("file")) == "", F.col("source")).otherwise(F.concat_ws("/", S.directory(F.col("file")), F.col("source")))
    target = S.module_name(S.normalize_path(full, keep_leading_up=False))
    rows = imports.where(S.is_relative_import(F.col("source"))).select(S.module_name(F.col("file")).alias("name"), target.alias("target"))
    return rows.where(F.col("name") != F.col("target")).distinct()


def directory_dependencies(references: DataFrame) -> DataFrame:
    """References between different directories: count, mean and greatest confidence."""
    rows = references.where(F.col("target_file").isNotNull()).select(S.directory(F.col("source_file")).alias("source_dir"), S.directory(F.col("target_file")).alias("target_dir"), "confidence")
    return (
        rows.where(F.col("source_dir") != F.col("target_dir"))
        .groupBy("source_dir", "target_dir")
        .agg(F.count(F.lit(1)).alias("reference_count"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"))
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """files(path, language, estimated_tokens) -> every directory above a file with what lies in and below it."""
    rows = files.select("path", "language", "estimated_tokens", S.directory(F.col("path")).alias("own"), F.explode(S.ancestors(F.col("path"))).alias("directory"))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return (
        rows.groupBy("directory")
        .agg(
            F.sum(F.when(F.col("own") == F.col("directory"), 1).otherwise(0)).alias("direct_file_count"),
            F.count(F.lit(1)).alias("total_file_count"),
            F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_estimated_tokens"),
            F.sort_array(F.collect_set("language")).alias("languages"),
        )
        .withColumn("depth", depth.cast("int"))
    )


def directory_roles(files: DataFrame) -> DataFrame:
    """files(path, file_role) -> directory, role.

    A directory with files has their most frequent role (ties: implementation first, then by label).  One without
    takes its children's role if they agree, else `mixed`; that goes bottom-up, one small join for each level."""
    direct = files.select(S.directory(F.col("path")).alias("directory"), F.col("file_role").alias("label"))
    n = direct.groupBy("directory", "label").agg(F.count(F.lit(1)).alias("n"))
    pick = F.min_by("label", F.struct(-F.col("n"), F.when(F.col("label") == "impl", 0).otherwise(1), "label"))
    named = F.when(F.col("label") == "impl", "source").when(F.col("label") == "other", "source").otherwise(F.col("label"))
    done = n.groupBy("directory").agg(pick.alias("label")).select("directory", named.alias("role"))
    every = files.select(F.explode(S.ancestors(F.col("path"))).alias("directory")).distinct()
    every = every.withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))
    open_ = every.join(done, "directory", "left_anti")
    deepest = open_.agg(F.max("depth")).first()[0]
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        children = done.where(F.col("directory") != "").select(S.directory(F.col("directory")).alias("directory"), "role").groupBy("directory").agg(F.min("role").alias("a"), F.max("role").alias("b"))
        level = open_.where(F.col("depth") == depth).select("directory").join(children, "directory", "left")
        done = done.unionByName(level.select("directory", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("role")))
    return done


def count_directories(files: DataFrame) -> DataFrame:
    return files.select(F.explode(S.ancestors(F.col("path"))).alias("d")).agg(F.count_distinct("d").alias("directories"))


def file_churn(commits: DataFrame) -> DataFrame:
    """commits(author, ts, file, ordinal) -> history of each path; of equal times the commit seen first is latest."""
    return commits.groupBy(F.col("file").alias("path")).agg(
        F.max("ts").alias("last_modified"),
        F.max_by("author", F.struct("ts", -F.col("ordinal"))).alias("last_author"),
        F.count(F.lit(1)).alias("commit_count"),
        F.count_distinct("author").alias("distinct_authors"),
    )


def repo_stats(churn: DataFrame) -> DataFrame:
    """One row over file_churn: authors count as the last of some file."""
    return churn.agg(
        F.count_distinct("last_author").alias("total_authors"),
        F.coalesce(F.sum("commit_count"), F.lit(0)).alias("total_commits"),
        F.coalesce(F.avg("commit_count"), F.lit(0.0)).alias("avg_commits_per_file"),
    )


def hottest_files(churn: DataFrame, n: int = 10) -> DataFrame:
    """The n paths with most commits (ties: by path)."""
    return churn.select("path", "commit_count").orderBy(F.desc("commit_count"), "path").limit(n)


def ordered(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fact tables in their output order; a range-partitioned sort, meant for the last step before a sink."""
    order = {
        "interfaces": ("path", "method", "file", "line"), "dependencies": ("target", "file", "line"), "sinks": ("file", "line"), "symbols": ("file", "line", "name"),
        "imports": ("source", "line", "file"), "references": ("source_file", "source_line", "target_symbol"), "data_models": ("file", "line", "name"), "env_dependencies": ("file", "line", "var_name"),
        "components": ("name",), "modules": ("name",),
    }
    return {k: df.orderBy(*order[k]) if k in order else df for k, df in facts.items()}


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


ROOT_MODULE = rules.ROOT_MODULE
