"""Commit history as a table, from `git log` or from its text."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

MARK, MOST_COMMITS = "===commit===", 1000


def read_log(root: str, most: int = MOST_COMMITS) -> str | None:
    """Text of the log of a work tree: a mark, author, epoch seconds, an empty line and paths for each commit;
    null if there is no repository."""
    got = subprocess.run(["git", "-C", root, "log", f"-{most}", "--name-only", f"--format={MARK}%n%an%n%ct"], capture_output=True, text=True, check=False)
    return got.stdout if got.returncode == 0 else None


def parse_log(raw: DataFrame, column: str = "raw") -> DataFrame:
    """author, ts, file, ordinal of every path of every commit; a commit without a proper time is skipped."""
    commits = raw.select(F.posexplode(F.split(column, MARK + "\n")).alias("ordinal", "c")).where(F.col("c") != "")
    lines = commits.select("ordinal", F.split("c", "\n").alias("l"))
    ts = F.expr("try_cast(trim(l[1]) AS bigint)")
    rows = lines.select("ordinal", F.trim(F.col("l")[0]).alias("author"), ts.alias("ts"), F.explode(F.slice("l", F.lit(3), F.greatest(F.size("l"), F.lit(1)))).alias("file"))
    return rows.where(F.col("ts").isNotNull() & (F.trim("file") != "")).select("author", "ts", F.trim("file").alias("file"), F.col("ordinal").cast("long").alias("ordinal"))


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    text = read_log(root)
    return None if text is None else parse_log(spark.createDataFrame([(text,)], "raw string"))
