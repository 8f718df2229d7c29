"""Columns by exact name, so that no other column of a table can clash with what an operator uses itself.

Operators read a few columns of a table and some give all others back.  The table's columns are first numbered by
place, which no name disturbs (dots, names that operators use, names that differ only in case, repeated names); the
wanted ones get the operator's names, and the rest travel in one struct column until they are put back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROW = "row"


def place_of(docs: DataFrame, name: str) -> int:
    """Place of the column of that name, or, if none has it, of the first whose name differs only in case."""
    if name in docs.columns:
        return docs.columns.index(name)
    folded = [c.lower() for c in docs.columns]
    if name.lower() not in folded:
        raise ValueError(f"no column {name!r} among {docs.columns}")
    return folded.index(name.lower())


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def pick(docs: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone; renamed gives new names to old ones."""
    wanted = {n: n for n in names} | renamed
    return _numbered(docs).select(*(F.col(f"c{place_of(docs, old)}").alias(new) for new, old in wanted.items()))


def pack(docs: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns, and a struct column `row` of all others."""
    wanted = {n: n for n in names} | renamed
    taken = {new: place_of(docs, old) for new, old in wanted.items()}
    rest = [F.col(f"c{i}") for i in range(len(docs.columns)) if i not in taken.values()]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    return _numbered(docs).select(*(F.col(f"c{i}").alias(new) for new, i in taken.items()), row.alias(ROW))


def unpack(packed: DataFrame, docs: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Packed rows with the columns of docs again, in their order and under their names."""
    wanted = {n: n for n in names} | renamed
    taken = {place_of(docs, old): new for new, old in wanted.items()}
    return packed.select(*(F.col(taken[i] if i in taken else f"{ROW}.c{i}").alias(name) for i, name in enumerate(docs.columns)))
