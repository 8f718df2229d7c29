"""Differences between two snapshots of facts, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: fixed values: what identifies a fact; a change that leaves the key alone is no change
KEYS = {"interfaces": ("method", "path"), "dependencies": ("target", "dependency_type"), "sinks": ("file", "line", "text")}


def _without(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of left whose key right hasn't; null parts are equal to each other."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, on, "left_anti")


def diff_by_key(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows only in new (`added`) and only in old (`removed`); repeated rows stay repeated."""
    added = _without(new, old, keys).withColumn("change_type", F.lit("added"))
    return added.unionByName(_without(old, new, keys).withColumn("change_type", F.lit("removed")))


def semantic_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Changes of endpoints, dependencies and sinks, and their risk."""
    out = {name: diff_by_key(old[name], new[name], keys) for name, keys in KEYS.items()}
    out["risk"] = risk(out["interfaces"], out["sinks"])
    return out


def risk(interfaces: DataFrame, sinks: DataFrame) -> DataFrame:
    """One row: security is high for an added endpoint without auth or an added sink with personal data, medium
    for any other change of either, else low; reliability is medium if any endpoint changed."""
    added = F.col("change_type") == "added"
    a = interfaces.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(added & F.col("auth").isNull()), F.lit(False)).alias("open"))
    b = sinks.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.bool_or(added & F.col("contains_pii")), F.lit(False)).alias("pii"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    security = F.when(F.col("open") | F.col("pii"), "high").when((F.col("n") > 0) | (F.col("m") > 0), "medium").otherwise("low")
    return both.select(security.alias("security"), F.when(F.col("n") > 0, "medium").otherwise("low").alias("reliability"))


def drop_prefixes(flows: DataFrame, names: str = "names") -> DataFrame:
    """Flows whose sequence of names isn't a strict prefix of another's.

    Every flow sends out its proper prefixes and flows meet them by equality, so no two flows are compared."""
    longer = flows.select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: i < F.size(names)), lambda i: F.slice(F.col(names), F.lit(1), i))).alias("_p"))
    return flows.join(longer.distinct(), flows[names] == F.col("_p"), "left_anti")
