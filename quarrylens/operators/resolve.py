"""Reference resolution as ranked equi-joins: imports to files, names to symbols, paths to packages.

Row counts are kept: every import specifier and every reference comes out once.  Choices among several matches
(first file of a probe order, first or last symbol of a name) are min_by / max_by over explicit positions, so
they don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.functions import rules, scalar as S

REFERENCE_COLUMNS = (
    "source_symbol", "source_file", "source_line", "target_symbol", "target_file", "target_line", "reference_kind", "confidence", "resolution_method",
)


def probe_candidates(path: Column, root: str = "") -> Column:
    """All names under which a relative import may be found, in the order in which they are tried."""
    bases = [path] if not root else [path, S.make_relative(path, F.lit(root))]
    tries = [b if not tail else S.append_extension(b, tail) for b in bases for tail in ("", *rules.PROBE_EXTENSIONS, *rules.PROBE_INDEXES)]
    return F.array(*tries)


def probe_imports(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """imports(import_id, file, source) -> import_id, target_file of those relative imports that name a file.

    Candidates meet files by equality; Spark broadcasts the list of paths only if its size allows."""
    js = F.coalesce(S.normalize_python_relative(F.col("source")), F.col("source"))
    full = S.normalize_path(F.when(S.directory(F.col("file")) == "", js).otherwise(F.concat_ws("/", S.directory(F.col("file")), js)))
    tries = imports.withColumn("_js", js).where(S.is_relative_import(F.col("_js"))).select("import_id", F.posexplode(probe_candidates(full, root)).alias("pos", "path"))
    found = tries.join(files.select("path").distinct(), "path")
    return found.groupBy("import_id").agg(F.min_by("path", "pos").alias("target_file"))


def resolve_imports(imports: DataFrame, symbols: DataFrame, files: DataFrame, root: str = "", probed: DataFrame | None = None) -> DataFrame:
    """imports(import_id, file, source, specifiers, line) -> one reference for each effective specifier; probed is
    what probe_imports gives, if it is known already."""
    relative = S.is_relative_import(F.coalesce(S.normalize_python_relative(F.col("source")), F.col("source")))
    spec = imports.select("import_id", "file", "source", "line", relative.alias("relative"), F.explode(S.effective_specifiers(F.col("specifiers"), F.col("source"))).alias("specifier"))
    first = symbols.groupBy(F.col("file").alias("target_file"), F.col("name").alias("specifier")).agg(F.min("line").alias("target_line"))
    probed = probe_imports(imports, files, root) if probed is None else probed
    out = spec.join(probed, "import_id", "left").join(first, ["target_file", "specifier"], "left")
    found, inside = F.col("target_file").isNotNull(), F.col("relative")
    confidence = F.when(~inside, rules.CONFIDENCE["external"]).when(F.col("target_line").isNotNull(), rules.CONFIDENCE["import_based"]).when(found, rules.IMPORT_FILE_ONLY).otherwise(0.0)
    method = F.when(~inside, "external").when(found, "import_based").otherwise("unresolved")
    return out.select(
        F.lit("").alias("source_symbol"),
        F.col("file").alias("source_file"),
        F.col("line").alias("source_line"),
        F.col("specifier").alias("target_symbol"),
        F.when(inside, F.col("target_file")).alias("target_file"),
        F.when(inside, F.col("target_line")).alias("target_line"),
        F.lit("import").alias("reference_kind"),
        confidence.alias("confidence"),
        method.alias("resolution_method"),
    )


def import_index(imports: DataFrame, files: DataFrame, root: str = "", probed: DataFrame | None = None) -> DataFrame:
    """(source_file, name) -> target_file for names that a file imports from a file that exists; last import wins."""
    found = imports.join(probe_imports(imports, files, root) if probed is None else probed, "import_id")
    names = found.select(F.col("file").alias("source_file"), "line", "import_id", "target_file", F.explode(S.effective_specifiers(F.col("specifiers"), F.col("source"))).alias("name"))
    return names.groupBy("source_file", "name").agg(F.max_by("target_file", F.struct("line", "import_id")).alias("import_file"))


def symbol_table(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols(name, file, line, ordinal) -> by file (last duplicate), by name (count and first), by directory."""
    s = symbols.select("name", "file", "line", "ordinal", S.directory(F.col("file")).alias("dir"))
    order = F.struct("file", "line", "ordinal")
    by_file = s.groupBy("file", "name").agg(F.max_by("line", "ordinal").alias("line"))
    by_name = s.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line"), order).alias("first"))
    by_dir = s.groupBy("name", "dir").agg(F.min_by(F.struct("file", "line"), order).alias("near"))
    return by_file, by_name, by_dir


def resolve_names(refs: DataFrame, symbols: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Adds resolved_file, resolved_line, resolved_confidence, resolved_method to refs(source_file, target_symbol).

    Tiers: imported name 0.95, same file 0.90, only one symbol of that name 0.80, same directory 0.60, first of
    several 0.40, none 0.0; names are compared without their receiver."""
    by_file, by_name, by_dir = symbol_table(symbols)
    r = refs.withColumn("_bare", S.bare_name(F.col("target_symbol"))).withColumn("_dir", S.directory(F.col("source_file")))
    if imported is not None:
        at = by_file.select(F.col("file").alias("import_file"), F.col("name").alias("_bare"), F.col("line").alias("_import_line"))
        i = imported.select("source_file", F.col("name").alias("_bare"), "import_file")
        r = r.join(i, ["source_file", "_bare"], "left").join(at, ["import_file", "_bare"], "left")
    else:
        r = r.withColumns({"import_file": F.lit(None).cast("string"), "_import_line": F.lit(None).cast("long")})
    own = by_file.select(F.col("file").alias("source_file"), F.col("name").alias("_bare"), F.col("line").alias("_own_line"))
    r = r.join(own, ["source_file", "_bare"], "left").join(by_name.withColumnRenamed("name", "_bare"), "_bare", "left")
    r = r.join(by_dir.select(F.col("name").alias("_bare"), F.col("dir").alias("_dir"), "near"), ["_bare", "_dir"], "left")

    def tier(file: Column, line: Column, method: str) -> Column:
        return F.struct(file.alias("file"), line.cast("long").alias("line"), F.lit(rules.CONFIDENCE[method]).alias("confidence"), F.lit(method).alias("method"))

    none = F.lit(None)
    best = (
        F.when(F.col("import_file").isNotNull() & F.col("_import_line").isNotNull(), tier(F.col("import_file"), F.col("_import_line"), "import_based"))
        .when(F.col("_own_line").isNotNull(), tier(F.col("source_file"), F.col("_own_line"), "same_file"))
        .when(F.col("n") == 1, tier(F.col("first.file"), F.col("first.line"), "global_unique"))
        .when((F.col("n") > 1) & F.col("near").isNotNull(), tier(F.col("near.file"), F.col("near.line"), "global_same_dir"))
        .when(F.col("n") > 1, tier(F.col("first.file"), F.col("first.line"), "global_ambiguous"))
        .otherwise(tier(none.cast("string"), none, "unresolved"))
    )
    out = r.withColumn("_best", best)
    return out.select(*refs.columns, *(F.col(f"_best.{k}").alias(f"resolved_{k}") for k in ("file", "line", "confidence", "method")))


def resolve_references(refs: DataFrame, imports: DataFrame, symbols: DataFrame, files: DataFrame, root: str = "", strict_compat: bool = False, probed: DataFrame | None = None) -> DataFrame:
    """All references: those of imports, and refs with what resolution found.

    A reference keeps its own confidence and method if that is strictly higher, and its own target if nothing was
    found.  strict_compat leaves imports out of name resolution when paths are absolute below a root, as probing
    by root-relative names then finds nothing."""
    imported = None if strict_compat and root else import_index(imports, files, root, probed)
    r = resolve_names(refs, symbols, imported)
    better = F.col("confidence") > F.col("resolved_confidence")
    hit = F.col("resolved_method") != "unresolved"
    named = r.select(
        "source_symbol",
        "source_file",
        "source_line",
        "target_symbol",
        F.when(hit, F.col("resolved_file")).otherwise(F.col("target_file")).alias("target_file"),
        F.when(hit, F.col("resolved_line")).otherwise(F.col("target_line")).alias("target_line"),
        "reference_kind",
        F.greatest("confidence", "resolved_confidence").alias("confidence"),
        F.when(better, F.col("resolution_method")).otherwise(F.col("resolved_method")).alias("resolution_method"),
    )
    return resolve_imports(imports, symbols, files, root, probed).unionByName(named)


def tag_tests(refs: DataFrame, files: DataFrame) -> DataFrame:
    """is_test_reference: from a test file to anything that isn't one; no target counts as not one."""
    roles = files.select("path", (F.col("file_role") == "test").alias("is_test"))
    r = refs.join(roles.select(F.col("path").alias("source_file"), F.col("is_test").alias("_s")), "source_file", "left")
    r = r.join(roles.select(F.col("path").alias("target_file"), F.col("is_test").alias("_t")), "target_file", "left")
    return r.select(*refs.columns, (F.coalesce("_s", F.lit(False)) & ~F.coalesce("_t", F.lit(False))).alias("is_test_reference"))


def assign_component(files: DataFrame, packages: DataFrame, default: str = "root", path: str = "path") -> DataFrame:
    """Adds component: the package with the longest root above the file (ties: the first listed), else default.

    A file meets packages by its ancestors, an equi-join instead of comparing every file with every root."""
    own = files.select(F.col(path)).distinct()
    above = own.select(F.col(path), F.explode(F.array_append(S.ancestors(F.col(path)), F.col(path))).alias("root"))
    best = above.join(packages.select("root", "name", "ordinal"), "root").groupBy(path).agg(F.max_by("name", F.struct(F.length("root"), -F.col("ordinal"))).alias("_name"))
    return files.join(best, path, "left").select(*files.columns, F.coalesce("_name", F.lit(default)).alias("component"))


def exposed_symbols(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """modules(name, files, exported_symbols) -> module, symbol, file: the first listed file that has the symbol."""
    f = modules.select(F.col("name").alias("module"), F.posexplode("files").alias("pos", "file"))
    e = modules.select(F.col("name").alias("module"), F.explode("exported_symbols").alias("symbol"))
    have = symbols.select("file", F.col("name").alias("symbol")).distinct()
    own = f.join(have, "file")  # not modules first: that pairs every file of a module with every symbol
    return own.join(e, ["module", "symbol"]).groupBy("module", "symbol").agg(F.min_by("file", "pos").alias("file"))


def merge_history(files: DataFrame, history: DataFrame) -> DataFrame:
    """files with a git_metadata struct where the path has a history."""
    h = history.select("path", F.struct("last_modified", "last_author", "commit_count", "distinct_authors").alias("git_metadata"))
    return files.drop("git_metadata").join(h, "path", "left")


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
