"""Exact quantiles of groups of any size, by selection.

Spark's exact ``percentile`` keeps all distinct values of a group in one task.  Here a sketch brackets each wanted rank
first: its error is bounded, so the values at the rank lie between two sketched ones for certain.  A second pass counts
what lies below the bracket and keeps only the values inside it, equal values counted, from which the rank is picked.  Groups
so large that a bracket would still hold many values have it narrowed by further sketches of its inside.  All of it is one
lazy plan of aggregations: no sort of the values, nothing written, no job before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import column

#: Accuracy of a sketch: the rank error stays below rows / ACCURACY.
ACCURACY = 10_000
#: A bracket of about so many values is not narrowed further.
BRACKET_ROWS = 100_000
#: Sketched values inside a bracket when it is narrowed, and how often that may happen.
GRID, ROUNDS = 256, 1
#: Times the sketch's error that a bracket reaches to either side; one is the sketch's, one the rounding of ranks.
MARGIN = 3


def _between(v: Column, i: int) -> Column:
    return (v >= F.col(f"lo{i}")) & (v <= F.col(f"hi{i}"))


def _ranks(p: float) -> tuple[Column, Column]:
    """The two places, from 0, that the quantile lies between."""
    position = F.lit(float(p)) * (F.col("rows") - 1)
    return F.floor(position), F.ceil(position)


def _first_brackets(values: DataFrame, names: list[str], probabilities: Sequence[float], accuracy: int) -> DataFrame:
    edges = [(p - MARGIN / accuracy, p + MARGIN / accuracy) for p in probabilities]
    wanted = [min(max(e, 0.0), 1.0) for pair in edges for e in pair]
    facts = values.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("nan").alias("nans"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", wanted, accuracy).alias("sketch"),
    )
    small = F.col("rows") <= accuracy  # ranks of few rows are coarser than the margin
    lo = [F.when(small | F.lit(a <= 0), F.col("least")).otherwise(F.get("sketch", F.lit(2 * i))) for i, (a, _) in enumerate(edges)]
    hi = [F.when(small | F.lit(b >= 1), F.col("most")).otherwise(F.get("sketch", F.lit(2 * i + 1))) for i, (_, b) in enumerate(edges)]
    return facts.select(*names, "rows", "nans", *[c.alias(f"lo{i}") for i, c in enumerate(lo)], *[c.alias(f"hi{i}") for i, c in enumerate(hi)])


def _narrowed(values: DataFrame, facts: DataFrame, names: list[str], probabilities: Sequence[float], accuracy: int, above: int, few: bool) -> DataFrame:
    """The brackets of groups of more than ``above`` rows, narrowed by a sketch of what they hold."""
    n = len(probabilities)
    steps = [k / GRID for k in range(1, GRID)]
    large = facts.where(F.col("rows") > above)
    held = _joined(values, large, names, few)
    found = held.groupBy(*names).agg(*[x for i in range(n) for x in (
        F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"below{i}"), F.count_if(_between(F.col("v"), i)).alias(f"inside{i}"),
        F.percentile_approx(F.when(_between(F.col("v"), i), F.col("v")), steps, accuracy).alias(f"grid{i}"),
    )])
    renamed = found.select(*[F.col(k).alias(f"n_{k}") for k in names], *[c for c in found.columns if c not in names])
    match = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in names]
    both = facts.join(F.broadcast(renamed) if few else renamed, match, "left")
    edges = []
    for i, p in enumerate(probabilities):
        low, high = _ranks(p)
        first = F.floor((low - F.col(f"below{i}")) / F.col(f"inside{i}") * GRID) - 2
        last = F.ceil((high + 1 - F.col(f"below{i}")) / F.col(f"inside{i}") * GRID) + 2
        edges.append(F.when(first >= 1, F.get(f"grid{i}", (first - 1).cast("int"))).otherwise(F.col(f"lo{i}")).alias(f"lo{i}"))
        edges.append(F.when(last < GRID, F.get(f"grid{i}", (last - 1).cast("int"))).otherwise(F.col(f"hi{i}")).alias(f"hi{i}"))
    return both.select(*names, "rows", "nans", *edges)


def _joined(values: DataFrame, facts: DataFrame, names: list[str], few: bool) -> DataFrame:
    renamed = facts.select(*[F.col(k).alias(f"f_{k}") for k in names], *[c for c in facts.columns if c not in names])
    match = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in names]
    return values.join(F.broadcast(renamed) if few else renamed, match).drop(*[f"f_{k}" for k in names])


def _value_at(i: int, rank: Column) -> Column:
    """The value at a rank of the group, from the counted values inside bracket ``i``."""
    inside = F.filter("inside", lambda x: (x["w"] >= F.col(f"lo{i}")) & (x["w"] <= F.col(f"hi{i}")))
    start = F.struct(F.col(f"below{i}").cast("long").alias("upto"), F.lit(None).cast("double").alias("found"))

    def step(done: Column, x: Column) -> Column:
        upto = done["upto"] + x["n"]
        found = F.when(done["found"].isNull() & (rank < upto), x["w"]).otherwise(done["found"])
        return F.struct(upto.alias("upto"), found.alias("found"))

    picked = F.when(rank >= F.col(f"below{i}"), F.aggregate(inside, start, step, lambda done: done["found"]))
    picked = F.coalesce(picked, F.raise_error(F.lit("quantile: the bracket misses its rank")).cast("double"))
    return F.when(rank >= F.col("rows") - F.col("nans"), F.lit(float("nan"))).otherwise(picked)


def exact(
    df: DataFrame, group_by: Sequence[str], field: str, probabilities: Sequence[float], *, few_groups: bool = False,
    accuracy: int = ACCURACY, bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Interpolated quantiles (``percentile_cont``) per group, columns ``q0, q1, ...``; nulls ignored, NaN last.

    ``few_groups`` says that the number of groups does not grow with the data; their brackets are then broadcast.
    """
    names = [f"g{i}" for i in range(len(group_by))] or ["g0"]
    groups = [column(g).alias(n) for n, g in zip(names, group_by)] or [F.lit(0).alias("g0")]
    few = few_groups or not group_by
    number = column(field).cast("double")
    infinity = F.lit(float("inf"))  # sketches order no NaN
    values = df.select(*groups, F.when(F.isnan(number), infinity).otherwise(number).alias("v"), F.isnan(number).alias("nan")).filter("v IS NOT NULL")
    facts = _first_brackets(values, names, probabilities, accuracy)
    above = bracket_rows * accuracy // (2 * MARGIN + 2)
    for _ in range(ROUNDS):
        facts = _narrowed(values, facts, names, probabilities, accuracy, above, few)
        above *= GRID // 8
    n = len(probabilities)
    held = _joined(values, facts, names, few)
    some = _between(F.col("v"), 0)
    for i in range(1, n):
        some = some | _between(F.col("v"), i)
    # one pass: the values inside a bracket, all others by which brackets they lie below
    kept = held.select(*names, F.when(some, F.col("v")).alias("w"), *[(F.col("v") < F.col(f"lo{i}")).alias(f"b{i}") for i in range(n)])
    counted = kept.groupBy(*names, "w", *[f"b{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy(*names).agg(
        F.sort_array(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "n")))).alias("inside"),
        *[F.coalesce(F.sum(F.when(F.col(f"b{i}"), F.col("n"))), F.lit(0)).alias(f"below{i}") for i in range(n)],
    )
    placed = _joined(found, facts, names, few)
    quantiles = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("rows") - 1)
        low, high = _ranks(p)
        quantiles += [_value_at(i, low).alias(f"low{i}"), _value_at(i, high).alias(f"high{i}"), (position - low).alias(f"share{i}")]
    ends = placed.select(*names, *quantiles)
    between = [
        F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}"))
        .otherwise(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"share{i}"))
        .alias(f"q{i}")
        for i in range(n)
    ]
    return ends.select(*[F.col(k).alias(g) for k, g in zip(names, group_by)], *between)


def sketched(
    df: DataFrame, group_by: Sequence[str], field: str, probabilities: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Approximate quantiles in one pass; rank error below ``rows / accuracy``."""
    values = F.percentile_approx(column(field).cast("double"), list(probabilities), accuracy).alias("q")
    found = df.groupBy(*[column(g) for g in group_by]).agg(values)
    return found.select(*[column(g) for g in group_by], *[F.col("q")[i].alias(f"q{i}") for i in range(len(probabilities))])
