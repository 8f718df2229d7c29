"""Source files as a table, from any file system that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions import rules, scalar as S


def scan(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """path (relative to root), content, language, file_role, estimated_tokens, content_hash of the source files
    below root (or of the given paths).

    Files in ignored directories, of no known language or not in UTF-8 are left out.  The listing is filtered by
    extension before any file is opened, and the directory filter runs on the path before content is decoded."""
    endings = ",".join(rules.LANGUAGE_OF_EXTENSION)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{endings}}}")
    raw = reader.load(paths or root).select("path", "content")
    bare = r"^[a-z0-9]+:(//[^/]*)?(?=/)"  # scheme and host
    base = re.sub(bare, "", root.rstrip("/"))
    relative = F.regexp_replace("path", bare, "")
    rows = raw.withColumn("path", S.make_relative(relative, F.lit(base)))
    ignored = F.arrays_overlap(S.parts(F.col("path")), F.array(*(F.lit(d) for d in rules.IGNORED_DIRECTORIES)))
    rows = rows.where(~ignored & F.is_valid_utf8("content"))
    return describe(rows.select("path", F.col("content").cast("string").alias("content")))


def describe(files: DataFrame) -> DataFrame:
    """files(path, content) with language, role, size estimate and hash; files of no known language go."""
    text = F.col("content")
    return files.select(
        "path", "content", S.language(F.col("path")).alias("language"), S.file_role(F.col("path")).alias("file_role"), S.estimate_tokens(text).alias("estimated_tokens"), S.content_hash(text).alias("content_hash")
    ).where(F.col("language").isNotNull())
