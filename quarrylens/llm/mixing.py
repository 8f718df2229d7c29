"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Every document has a fixed 60-bit hash of its id and text.  A source whose target is `base` whole copies plus a
rest takes the rest from the documents with the smallest hashes.  The threshold comes from three nested histograms
of words: the first 12 hash bits over all rows, the next 12 over rows of the boundary bucket, and the few rows of
the boundary cell one by one; only per-source sums by bucket are ever shuffled.  Budgets nest: a larger budget
keeps every document of a smaller one.

The document at the threshold is taken if that brings the source nearer to its target.  Rows that repeat id and
text share a hash; where such a group lies at the threshold, as many of its rows are taken as come nearest, those
first in the order of their other columns.  Targets share `share` of all words by weight, but no source gets more
than `most` times its own words; what is cut off is shared again by weight until nothing is above.

Defined results: a null text has no words; the null source comes last; a null id hashes as the text `null`, with
its row's text like any other; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.llm.rows import ROW, pack, unpack
from quarrylens.session import Scratch

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of the id as text, a space and the text, as a long."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target.  One row a source; sources are ordered by code point, null last.

    Water filling in closed form: in order of cap / weight, a source is full if the level that the rest would
    share is at least its own ratio; the first source that is not full sets the level for all after it.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % n + 1).cast("int"))
    s = sources.select("source", "source_size", place.alias("place"), w.alias("weight")).withColumn("cap", F.col("source_size") * float(most))
    s = s.withColumn("budget", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * share).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weight_from")).withColumn("open", F.col("level") < F.col("ratio"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "place"))).over(Window.partitionBy(F.lit(1)))
    s = s.withColumn("_level", level)
    target = F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_level") * F.col("weight")))
    s = s.withColumn("target", target)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    return s.select("source", "source_size", "target", base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("rest"))


def _boundary(hist: DataFrame, plan: DataFrame, bucket: str, carried: str | None) -> DataFrame:
    """The bucket of each source in which its running sum of words passes the rest that it still needs."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    start = F.coalesce(F.sum("words").over(w), F.lit(0)) + (F.col(carried) if carried else F.lit(0))
    return h.withColumn("before", start).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all rows, and for each source (column _s) its target, whole copies and threshold.

    Rows with hashes up to `limit` are taken once more, and of those with the hash `edge` the first `edge_rows` (null:
    no such group).  Both are tables in the shared folder; the plan has one row a source, and Spark broadcasts it
    only if its file is below the session's broadcast threshold, else it deals both sides and splits a hot source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = pack(docs, doc_id=key, text=text, source=source)
    rows = scratch.table(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.table(targets(sources, weights, share, most), "targets")
    dealt = rows.withColumn("b1", F.shiftright("h", 60 - _BITS)).withColumn("b2", F.shiftright("h", 60 - 2 * _BITS))
    first = scratch.table(_boundary(dealt.groupBy("source", "b1").agg(F.sum("size").alias("words")), plan.select("source", "rest"), "b1", None).select("source", "b1", "before", "rest"), "first")

    def inside(bound: DataFrame, bucket: str) -> DataFrame:
        b = bound.select(F.col("source").alias("_s"), F.col(bucket).alias("_b"))
        return dealt.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col(bucket) == F.col("_b")), "left_semi")

    again = first.select("source", "rest", F.col("before").alias("_before"))
    second = scratch.table(_boundary(inside(first, "b1").groupBy("source", "b2").agg(F.sum("size").alias("words")), again, "b2", "_before").select("source", "b2", "before", "rest"), "second")
    cell = inside(second, "b2").groupBy("source", "h").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    again = second.select(F.col("source").alias("_s"), "rest", "b2", F.col("before").alias("_before"))
    w = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.join(again, F.col("source").eqNullSafe(F.col("_s"))).withColumn("before", F.col("_before") + F.coalesce(F.sum("words").over(w), F.lit(0)))
    one = F.col("words") / F.col("n")
    fits = F.when(one > 0, F.floor((F.col("rest") - F.col("before")) / one + F.lit(0.5))).otherwise(F.when(F.col("before") <= F.col("rest"), F.col("n")).otherwise(0))
    fits = F.greatest(F.lit(0), F.least(fits, F.col("n"))).cast("long")
    cell = cell.withColumn("fits", fits)
    edge = (F.col("fits") > 0) & (F.col("fits") < F.col("n"))
    near = F.when(F.col("fits") == F.col("n"), F.col("h")).otherwise(F.shiftleft("b2", 60 - 2 * _BITS) - 1)
    limit = cell.groupBy("source").agg(F.max(near).alias("limit"), F.max(F.when(edge, F.struct("h", "fits"))).alias("edge"))
    limit = limit.select(F.col("source").alias("_s"), "limit", F.col("edge.h").alias("edge"), F.col("edge.fits").alias("edge_rows"))
    whole = F.when(F.col("rest") >= F.col("source_size"), F.lit(1 << 60)).otherwise(F.lit(-1))
    plan = plan.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "base", F.when(F.col("rest") > 0, F.coalesce("limit", whole)).otherwise(F.lit(-1)).alias("limit"),
        F.when(F.col("rest") > 0, F.col("edge")).alias("edge"), "edge_rows",
    )
    return rows, scratch.table(plan, "limits")


def _taken(rows: DataFrame, plan: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows (with source and h) with their source's plan and copies, the number of times that each is taken.

    A group of repeated rows at a source's threshold is numbered in one sorted task, if there is any."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("base") + F.when(F.col("h") <= F.col("limit"), 1).otherwise(0)
    if not plan.where(F.col("edge").isNotNull()).head(1):
        return joined.withColumn("copies", copies.cast("int"))
    at_edge = F.col("h").eqNullSafe(F.col("edge"))
    place = F.row_number().over(Window.partitionBy("source", "h").orderBy(*order))
    split = joined.where(at_edge).withColumn("copies", (F.col("base") + F.when(place <= F.col("edge_rows"), 1).otherwise(0)).cast("int"))
    return joined.where(~at_edge).withColumn("copies", copies.cast("int")).unionByName(split)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of every row."""
    rows, plan = mix_plan(docs, **how)
    out = _taken(rows, plan, [F.col("doc_id"), F.col("size")])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, none to `most` times, all columns kept."""
    _, plan = mix_plan(docs, **how)
    names = {new: how.get(old, new) for old, new in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    rows = pack(docs, **names).withColumn("h", row_hash(F.col("doc_id"), F.col("text")))
    taken = _taken(rows, plan.drop("source_size", "target"), [F.col("doc_id"), F.to_json(ROW)]).where("copies > 0")
    return unpack(taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, **names)
