"""A training corpus from raw documents: quality, near copies, benchmark leaks, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.llm import decontaminate, jaccard, mixing, quality, tokenstore
from quarrylens.llm.queries import table, tokenizer_path
from quarrylens.llm.rows import ROW, pack, unpack
from quarrylens.session import MERGE, Scratch, release_since, scratch_mark

#: near copies in the pipeline: five-word shingles, Jaccard of 0.8 or more
WORDS, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of similar documents the one with the smallest id; documents without words or without an
    id, which a group cannot name, all stay.  Rows that share an id but not their text are documents of their own, in
    text order; of rows that repeat both, the one whose other columns come first as JSON text stays."""
    packed = pack(docs, "doc_id", "text")
    named, nameless = packed.where("doc_id is not null"), packed.where("doc_id is null")
    if named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        scratch = Scratch(spark, "near_copies")
        named = named.groupBy("doc_id", "text").agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW))
        named = named.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        named = scratch.table(named.withColumn("place", F.monotonically_increasing_id()), "rows")
    else:
        named = named.withColumn("place", F.col("doc_id").cast("long"))
    groups = jaccard.similar_groups(named.select(F.col("place").alias("doc_id"), "text"), WORDS, PERCENT)
    firsts = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("place"))
    kept = named.join(firsts.hint(MERGE), "place", "left_semi").drop("place")
    return unpack(kept.unionByName(nameless), docs, "doc_id", "text")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents to its target; a document that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and describe each document in them."""
    return tokenstore.token_output(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("benchmark_leaks", leak_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
#: a trained classifier and a tokenizer have no SQL form; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what a stage kept
    there for itself goes when its result is written."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        release_since(mark)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
