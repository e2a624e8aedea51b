"""Equi-joins whose heavy keys are split over many tasks, whatever follows the join.

Spark splits a hot partition of a join by itself, but not where its result is grouped by the key, as the grouping then relies on the
key's place. Here the keys that hold more than a ``1 / PARTS`` share of a side's rows, which a counting sketch of bounded size finds, are
dealt over ``PARTS`` parts by the row, and the other side's rows of those keys are repeated in each. A grouping by the key then first
combines the rows of each part. All of it is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import ROW_ID, column

PARTS = 64
#: Keys the sketch follows; one with a share over 1 / PARTS stays among them for certain.
FOLLOWED = 4096


def _heavy(df: DataFrame, keys: Sequence[str], nulls: bool = False) -> Column:
    """The hashes of the heavy keys, at most ``PARTS``; other keys of the same hash are dealt too, which does no harm."""
    key = F.xxhash64(*[column(k) for k in keys])
    there = df if nulls else df.where(~F.greatest(*[column(k).isNull() for k in keys], F.lit(False)))
    there = there.select(key.alias("k"))
    found = there.agg(F.expr(f"approx_top_k(k, {PARTS}, {FOLLOWED})").alias("top"), F.count(F.lit(1)).alias("n"))
    often = F.filter("top", lambda t: t["count"] * PARTS > F.col("n"))
    return found.select(F.coalesce(F.transform(often, lambda t: t["item"]), F.array().cast("array<bigint>"))).scalar()


def _dealt(df: DataFrame, keys: Sequence[str], heavy: Column, part: str) -> DataFrame:
    """Rows of heavy keys get a part by their row id, or else by their values, so that a rerun task gives the same.

    Maps and variants, which Spark does not hash, are left out of the values.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    row = [column(c) for c in ([ROW_ID] if ROW_ID in df.columns else hashed)]
    own = F.pmod(F.xxhash64(*row), F.lit(PARTS)).cast("int")
    return df.withColumn(part, F.when(F.array_contains(heavy, F.xxhash64(*[column(k) for k in keys])), own).otherwise(F.lit(0)))


def _repeated(df: DataFrame, keys: Sequence[str], heavy: Column, part: str) -> DataFrame:
    last = F.when(F.array_contains(heavy, F.xxhash64(*[column(k) for k in keys])), F.lit(PARTS - 1)).otherwise(F.lit(0))
    return df.withColumn(part, F.explode(F.sequence(F.lit(0), last)))


def facts_sides(rows: DataFrame, facts: DataFrame, keys: Sequence[str], fact_keys: Sequence[str], part: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a further key column ``part``, for a join of rows with the facts of their groups, where null is a key too."""
    heavy = _heavy(rows, keys, nulls=True)
    return _dealt(rows, keys, heavy, part), _repeated(facts, fact_keys, heavy, part)


def sides(left: DataFrame, right: DataFrame, lefts: Sequence[str], rights: Sequence[str], how: str, parts: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with further key columns ``parts``, for a join on the keys and these.

    The rows of a side that a join keeps without a match are never repeated, so an inner join deals the heavy keys of both sides
    and any other those of the side it keeps. Keys of different types must hash alike: they are cast by the caller.
    """
    a, b = parts
    if how == "right":
        heavy = _heavy(right, rights)
        return _repeated(left, lefts, heavy, b).withColumn(a, F.lit(0)), _dealt(right, rights, heavy, b).withColumn(a, F.lit(0))
    heavy = _heavy(left, lefts)
    left_out, right_out = _dealt(left, lefts, heavy, a), _repeated(right, rights, heavy, a)
    if how != "inner":
        return left_out.withColumn(b, F.lit(0)), right_out.withColumn(b, F.lit(0))
    other = _heavy(right, rights)
    return _repeated(left_out, lefts, other, b), _dealt(right_out, rights, other, b)
