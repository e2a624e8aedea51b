"""Joins of values with the intervals that hold them, without comparing every pair.

An interval lies in the cells of one level: the level's cells are at least as wide as the interval, so it touches two of them
or, at a border, one more. The finest cell is as wide as the median interval, which a sketch finds, and each level doubles the
width. A value is looked up in its cell of every level that has intervals. So values are copied once a level in use, a
number that grows with the spread of the widths and not with the rows, intervals at most a few times, and Spark joins the cells by equality,
splitting hot ones; the exact comparison follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..types import column

#: The level of one single cell, for intervals that no other level can hold.
TOP = 60
#: Cell numbers stay below this, where doubles count by ones; beyond it all share a cell.
LAST_CELL = float(2**52)
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _number(c: Column, kind: T.DataType) -> Column:
    """The value on a line of doubles, in the order of the values."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000_000.0
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise WorkspaceError("invalid_cleaning_step", f"A range needs numbers or moments, not {kind.simpleString()}")


def _cell(number: Column, width: float, level: Column) -> Column:
    place = F.floor(F.least(F.greatest(number / (F.lit(width) * F.pow(F.lit(2.0), level)), F.lit(-LAST_CELL)), F.lit(LAST_CELL)))
    return F.when(level >= TOP, F.lit(0).cast("long")).otherwise(place.cast("long"))


def range_join(
    points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, *, equal: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Rows of both tables where ``low <= value <= high``, and where the ``equal`` pairs of fields are equal.

    Nulls match nothing, an interval whose end lies before its start neither; repeated rows match each. Infinite bounds are allowed.
    NaN counts as the greatest number, as in any comparison of Spark. The fields of both tables must have different names.
    """
    clash = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if clash:
        raise WorkspaceError("invalid_cleaning_step", f"Both tables have a field {', '.join(sorted(clash))}")
    kinds = [points.schema[value].dataType, intervals.schema[low].dataType, intervals.schema[high].dataType]
    if len({isinstance(k, MOMENTS) and k.typeName() for k in kinds}) > 1:
        raise WorkspaceError("invalid_cleaning_step", "A range joins numbers with numbers and moments with moments of the same type")
    ends = intervals.where(column(low) <= column(high)).select(
        F.struct("*").alias("right"), _number(column(low), kinds[1]).alias("lo"), _number(column(high), kinds[2]).alias("hi")
    )
    length = F.col("hi") - F.col("lo")
    finite = (length > 0) & (length < float("inf"))
    width = ends.agg(F.percentile_approx(F.when(finite, length), 0.5, 1000)).first()[0] or 1.0  # one number
    level = F.when(finite | (length == 0), F.greatest(F.ceil(F.log2(length / width)), F.lit(0))).otherwise(F.lit(TOP))
    # a length of 0 has no logarithm, which greatest ignores; one that is no number lies on the top level
    placed = ends.withColumn("level", F.least(level, F.lit(TOP)).cast("int"))
    levels = [r[0] for r in placed.select("level").distinct().collect()]  # at most TOP + 1 numbers
    cells = F.sequence(_cell(F.col("lo"), width, F.col("level")), _cell(F.col("hi"), width, F.col("level")))
    right = placed.select("right", "level", F.explode(cells).alias("cell"))
    number = _number(column(value), kinds[0])
    left = points.where(column(value).isNotNull()).select(F.struct("*").alias("left"), number.alias("v"))
    left = left.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")))
    left = left.select("left", "level", _cell(F.col("v"), width, F.col("level")).alias("cell"))
    v, lo, hi = F.col("left").getField(value), F.col("right").getField(low), F.col("right").getField(high)
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("level", "cell")]
    keys += [F.col("left").getField(a) == F.col("right").getField(b) for a, b in equal]
    met = left.alias("l").join(right.alias("r"), keys).where((v >= lo) & (v <= hi))
    names = [F.col("left").getField(c).alias(c, metadata=points.schema[c].metadata) for c in points.columns]
    return met.select(*names, *[F.col("right").getField(c).alias(c, metadata=intervals.schema[c].metadata) for c in intervals.columns])
