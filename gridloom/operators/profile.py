"""Data quality profile: nulls, distinct values, samples and warnings per field and per table.

All fields are profiled together: the table is turned into (field, value) pairs, which are counted
once with map-side combining.  Distinct counts and first-seen samples both come from those groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..functions import cells
from ..types import ROW_ID, Field, column, fields_of
from . import quantiles

SAMPLE_SIZE, HIGH_NULL_RATIO = 5, 0.5  # fixed values


def ratio(part: Column, whole: Column) -> Column:
    """Four decimals, halves to even; 0 of nothing is 0."""
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(0.0)


def warnings(*rules: tuple[str, Column]) -> Column:
    found = F.array(*[F.when(condition, name) for name, condition in rules])
    return F.filter(found, lambda w: w.isNotNull())


# How values are counted: as text, doubles or longs, whichever keeps them apart most cheaply.
def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double"
    whole = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return "long" if isinstance(kind, whole) else "string"


def _counted_as(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return cells.blank_to_null(c, kind).cast(_family(kind))


def _shown(v: Column, kind: T.DataType) -> Column:
    """The counted form of a value back as text."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(v.cast("int")).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        moment = F.timestamp_add("MICROSECOND", v, F.lit("1970-01-01").cast("timestamp_ntz"))
        return cells.to_text(moment, T.TimestampNTZType())
    if isinstance(kind, T.BooleanType):
        return cells.to_text(v.cast("boolean"), kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return cells.to_text(v.cast(kind), kind)
    return v.cast("string")


def _shown_as(kind: T.DataType) -> Callable[[Column], Column]:
    return lambda v: _shown(v, kind)


def _field_facts(df: DataFrame) -> DataFrame:
    """One row per declared field, known from the schema."""
    rows = [(f.order, f.name, f.type, f.nullable) for f in fields_of(df)]
    schema = "`order` int, name string, inferred_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def _finish(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Attach schema facts, ratios and warnings to the counts."""
    return _judged(_field_facts(df).join(counted, "order", "left"))


def _judged(known: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("row_count", "null_count", "distinct_count")}
    full = known.withColumns(zero)
    non_null = F.col("row_count") - F.col("null_count")
    null_ratio = ratio(F.col("null_count"), F.col("row_count"))
    empty = F.col("row_count") == 0
    return full.select(
        "order", "name", "inferred_type", "nullable", "row_count", "null_count",
        null_ratio.alias("null_ratio"), "distinct_count",
        F.greatest(non_null - F.col("distinct_count"), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        warnings(
            ("empty_dataset", empty),
            ("unexpected_nulls", ~empty & (F.col("null_count") > 0) & ~F.col("nullable")),
            ("high_null_ratio", ~empty & (null_ratio >= HIGH_NULL_RATIO)),
            ("single_distinct_value", (F.col("distinct_count") == 1) & (F.col("row_count") > 1)),
        ).alias("warnings"),
    )


def fields(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row per field.  ``approximate`` sketches the distinct counts in a single pass with no
    shuffle of values, and leaves the samples out.
    """
    if approximate:
        return _finish(df, _sketched(df))
    families: dict[str, list[Field]] = {}
    for f in fields_of(df):
        families.setdefault(_family(df.schema[f.name].dataType), []).append(f)
    by_digest = ROW_ID in df.columns
    parts = [(_count_digests if by_digest and family == "string" else _count_values)(df, members) for family, members in families.items()]
    counted = reduce(DataFrame.unionByName, parts)
    return _finish(df, counted).orderBy("order")


def _count_values(df: DataFrame, members: list[Field]) -> DataFrame:
    """Counts and samples of fields that are counted in the same form.

    A scan reads the columns of its members only, so several families still read each column once.
    """
    kinds = {str(f.order): df.schema[f.name].dataType for f in members}
    row_id = column(ROW_ID) if ROW_ID in df.columns else F.lit(0)
    forms = [_counted_as(column(f.name), kinds[str(f.order)]).alias(str(f.order)) for f in members]
    # an exploded array, as Spark does not share exchanges above an unpivot
    cell = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in kinds]))
    long = df.select(row_id.alias("r"), *forms).select("r", cell)
    groups = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first_row"))
    # always true; makes both branches below read the same columns, so that they share one exchange
    groups = groups.filter((F.col("n") > 0) & (F.col("first_row") >= 0))
    counts = groups.groupBy("field").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )
    # first values per field: the rank filter cuts each task to a few rows before they are shuffled
    seen = Window.partitionBy("field").orderBy(F.col("value").isNull(), "first_row", "value")
    first = groups.withColumn("rank", F.row_number().over(seen)).filter(F.col("rank") <= SAMPLE_SIZE)
    sample = F.when(F.col("value").isNotNull(), F.struct("rank", "value"))
    samples = first.groupBy("field").agg(F.sort_array(F.collect_list(sample)).alias("s"))
    both = counts.unionByName(samples, allowMissingColumns=True).groupBy("field").agg(
        *[F.max(c).alias(c) for c in ("row_count", "null_count", "distinct_count")], F.max("s.value").alias("s")
    )
    shown = F.transform("s", lambda v: v.cast("string"))
    for order, kind in kinds.items():
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            special = F.transform("s", _shown_as(kind))
            shown = F.when(F.col("field") == order, special).otherwise(shown)
    return both.select(
        F.col("field").cast("int").alias("order"), "row_count", "null_count", "distinct_count",
        shown.alias("sample_values"),
    )


def digest(*columns: Column) -> list[Column]:
    """128 bits of the columns' values: equal values give equal digests, nulls have their place."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *columns).alias(f"h{seed}") for seed in (1, 2)]


def _count_digests(df: DataFrame, members: list[Field]) -> DataFrame:
    """The same for texts of any length: digests are shuffled, not values, and the few samples fetched by row id."""
    forms = [_counted_as(column(f.name), df.schema[f.name].dataType).alias(str(f.order)) for f in members]
    names = [str(f.order) for f in members]
    cell = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names]))
    long = df.select(column(ROW_ID).alias("r"), *forms).select("r", cell)
    there = F.col("value").isNotNull().alias("there")
    groups = long.select("field", "r", there, *digest(F.col("value"))).groupBy("field", "there", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("first_row")
    )
    groups = groups.filter((F.col("n") > 0) & (F.col("first_row") >= 0))  # as above: one exchange for both branches
    counts = groups.groupBy("field").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(~F.col("there"), F.col("n"))).alias("null_count"), F.count_if("there").alias("distinct_count")
    )
    seen = Window.partitionBy("field").orderBy(~F.col("there"), "first_row")
    first = groups.withColumn("rank", F.row_number().over(seen)).filter((F.col("rank") <= SAMPLE_SIZE) & F.col("there"))
    first = first.select("field", "rank", F.col("first_row").alias("r"))
    sampled = long.join(F.broadcast(first), ["field", "r"])  # at most SAMPLE_SIZE rows of three numbers for each field
    samples = sampled.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s"))
    both = counts.unionByName(samples, allowMissingColumns=True).groupBy("field").agg(
        *[F.max(c).alias(c) for c in ("row_count", "null_count", "distinct_count")], F.max("s.value").alias("s")
    )
    return both.select(
        F.col("field").cast("int").alias("order"), "row_count", "null_count", "distinct_count", F.col("s").alias("sample_values")
    )


def _sketched(df: DataFrame) -> DataFrame:
    fields = fields_of(df)
    names = [str(f.order) for f in fields]
    forms = [_counted_as(column(f.name), df.schema[f.name].dataType).alias(str(f.order)) for f in fields]
    prepared = df.select(*forms)
    facts = [F.count(F.lit(1)).alias("rows")]
    for n in names:
        facts += [F.count(column(n)).alias(f"c{n}"), F.approx_count_distinct(column(n), 0.01).alias(f"d{n}")]
    rows = [
        F.struct(
            F.lit(int(n)).alias("order"), F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"c{n}")).alias("null_count"),
            F.least(F.col(f"d{n}"), F.col(f"c{n}")).alias("distinct_count"),
            F.lit(None).cast("array<string>").alias("sample_values"),
        )
        for n in names
    ]
    return prepared.agg(*facts).select(F.inline(F.array(*rows)))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, row id left out; digests of rows are shuffled, not rows."""
    values = [
        # one zero and one NaN
        F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        for c, kind in ((column(f.name), df.schema[f.name].dataType) for f in fields_of(df))
    ]
    copies = df.select(*digest(*values)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"))


def dataset(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """The roll-up of the field profiles, one row: counts in one pass, no distinct values and no samples.

    ``approximate`` sketches the distinct rows in the same pass instead of shuffling a digest of each, see ``dataset_of``.
    """
    if approximate:
        return dataset_of(state(df, samples=False))
    names = fields_of(df)
    present = [F.count(cells.blank_to_null(column(f.name), df.schema[f.name].dataType)).alias(f"c{i}") for i, f in enumerate(names)]
    nulls = [F.col("row_count") - F.col(f"c{i}") for i in range(len(names))]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *present)
    rolled = counted.select(
        "row_count", F.lit(len(names)).cast("bigint").alias("field_count"), reduce(Column.__add__, nulls).alias("null_cell_count"),
        F.greatest(*[ratio(n, F.col("row_count")) for n in nulls], F.lit(0.0)).alias("worst"),
    )
    full = rolled.withColumn("duplicate_row_count", duplicate_row_count(df).scalar())
    return full.select(
        "row_count", "field_count", "null_cell_count",
        ratio(F.col("null_cell_count"), F.col("row_count") * F.col("field_count")).alias("null_cell_ratio"),
        "duplicate_row_count",
        warnings(
            ("empty_dataset", F.col("row_count") == 0),
            ("duplicate_rows_detected", F.col("duplicate_row_count") > 0),
            ("high_null_fields_detected", F.col("worst") >= HIGH_NULL_RATIO),
        ).alias("warnings"),
    )


# -- profiles of growing tables -----------------------------------------------------------------

#: Sketches of 2^14 cells of a byte: 0.8 % standard error.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: The order of the row that stands for whole rows.
WHOLE = -1


def state(df: DataFrame, *, samples: bool = True) -> DataFrame:
    """What is known of one part of a table, to be stored and merged with that of other parts.

    One row a field, and one of order ``WHOLE`` for whole rows: counts, a sketch of the values, and the first values with their row
    ids if ``df`` has any. The counts and sketches take a single pass; samples shuffle digests of the part only.
    """
    declared = fields_of(df)
    forms = {f.order: _counted_as(column(f.name), df.schema[f.name].dataType) for f in declared}
    whole = [
        F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)) if isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType)) else c
        for f, c in ((f, column(f.name)) for f in declared)
    ]
    facts = [F.count(F.lit(1)).alias("rows")]
    if declared:
        facts.append(F.hll_sketch_agg(digest(*whole)[0], SKETCH_BITS).alias("s"))
    for order, c in forms.items():
        facts += [F.count(c).alias(f"c{order}"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), SKETCH_BITS).alias(f"s{order}")]
    entries = [(F.lit(order), F.col(f"c{order}"), F.col(f"s{order}")) for order in forms]
    entries.append((F.lit(WHOLE), F.col("rows"), F.col("s") if declared else F.lit(None).cast("binary")))
    rows = [F.struct(o.alias("order"), F.col("rows").alias("row_count"), n.alias("present"), k.alias("sketch")) for o, n, k in entries]
    counted = df.agg(*facts).select(F.inline(F.array(*rows)))
    known = _field_facts(df).unionByName(df.sparkSession.createDataFrame([(WHOLE, None, None, None)], "`order` int, name string, inferred_type string, nullable boolean"))
    full = known.join(counted, "order")
    if samples and declared and ROW_ID in df.columns:
        return full.join(_first_values(df, declared), "order", "left")
    return full.withColumn("firsts", F.lit(None).cast("array<struct<first_row:bigint,value:string>>"))


def _first_values(df: DataFrame, declared: list[Field]) -> DataFrame:
    """The first distinct values of each field with the row that shows them first."""
    kinds = {f.order: df.schema[f.name].dataType for f in declared}
    forms = [_counted_as(column(f.name), kinds[f.order]) for f in declared]
    shown = [_shown(c, kinds[f.order]).alias(str(f.order)) for f, c in zip(declared, forms)]
    cell = F.inline(F.array(*[F.struct(F.lit(f.order).alias("order"), F.col(str(f.order)).alias("value")) for f in declared]))
    long = df.select(column(ROW_ID).alias("first_row"), *shown).select("first_row", cell).where(F.col("value").isNotNull())
    groups = long.select("order", "first_row", *digest(F.col("value"))).groupBy("order", "h1", "h2").agg(F.min("first_row").alias("first_row"))
    seen = Window.partitionBy("order").orderBy("first_row")
    first = groups.withColumn("rank", F.row_number().over(seen)).where(F.col("rank") <= SAMPLE_SIZE).select("order", "first_row")
    found = long.join(F.broadcast(first), ["order", "first_row"])  # at most SAMPLE_SIZE rows of two numbers for each field
    return found.groupBy("order").agg(F.sort_array(F.collect_list(F.struct("first_row", "value"))).alias("firsts"))


def merge(states: DataFrame) -> DataFrame:
    """One state of many: the same as of all parts together, if their row ids go on from part to part."""
    names = ["order", "name", "inferred_type", "nullable"]
    counts = states.groupBy(*names).agg(
        F.sum("row_count").alias("row_count"), F.sum("present").alias("present"), F.hll_union_agg("sketch").alias("sketch")
    )
    values = states.select("order", F.inline("firsts")).groupBy("order", "value").agg(F.min("first_row").alias("first_row"))
    seen = Window.partitionBy("order").orderBy("first_row")
    first = values.withColumn("rank", F.row_number().over(seen)).where(F.col("rank") <= SAMPLE_SIZE)
    firsts = first.groupBy("order").agg(F.sort_array(F.collect_list(F.struct("first_row", "value"))).alias("firsts"))
    return counts.join(firsts, "order", "left").select(*states.columns)


def fields_of_state(known: DataFrame) -> DataFrame:
    """The field profile of a state: all columns exact but the distinct values, which are within the sketch's error."""
    distinct = F.least(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)), F.col("present"))
    return _judged(known.where(F.col("order") != WHOLE).select(
        "order", "name", "inferred_type", "nullable", "row_count", (F.col("row_count") - F.col("present")).alias("null_count"),
        distinct.alias("distinct_count"), F.col("firsts.value").alias("sample_values"),
    )).orderBy("order")


def dataset_of(known: DataFrame) -> DataFrame:
    """The roll-up of a state. Duplicate rows are estimated; fewer than three standard errors of the sketch count as none."""
    field = F.col("order") != WHOLE
    nulls = F.col("row_count") - F.col("present")
    rolled = known.agg(
        F.max("row_count").alias("row_count"), F.count_if(field).alias("field_count"), F.sum(F.when(field, nulls)).alias("null_cells"),
        F.max(F.when(field, ratio(nulls, F.col("row_count")))).alias("worst"),
        F.max(F.when(~field, F.hll_sketch_estimate("sketch"))).alias("different"),
    ).withColumn("null_cell_count", F.coalesce("null_cells", F.lit(0)))
    copies = F.col("row_count") - F.col("different")
    rolled = rolled.withColumn("duplicate_row_count", F.when(copies > F.col("row_count") * 3 * SKETCH_ERROR, copies).otherwise(F.lit(0)))
    return rolled.select(
        "row_count", "field_count", "null_cell_count",
        ratio(F.col("null_cell_count"), F.col("row_count") * F.col("field_count")).alias("null_cell_ratio"),
        "duplicate_row_count",
        warnings(
            ("empty_dataset", F.col("row_count") == 0),
            ("duplicate_rows_detected", F.col("duplicate_row_count") > 0),
            ("high_null_fields_detected", F.col("worst") >= HIGH_NULL_RATIO),
        ).alias("warnings"),
    )


def summary(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Summary statistics of the number fields: one row per field.

    Everything but the median is one aggregation.  The median is exact unless ``approximate``.
    """
    numeric = [f for f in fields_of(df) if f.type in ("integer", "decimal")]
    long = df.select(*[column(f.name).cast("double").alias(str(f.order)) for f in numeric]).unpivot(
        [], [str(f.order) for f in numeric], "field", "value"
    )
    basics = long.groupBy("field").agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
    )
    medians = (
        quantiles.sketched(long, ["field"], "value", [0.5]) if approximate
        else quantiles.exact(long, ["field"], "value", [0.5], few_groups=True)
    )
    joined = basics.join(medians, "field", "left").withColumn("order", F.col("field").cast("int"))
    named = _field_facts(df).select("order", "name").join(joined, "order")
    return named.select("order", "name", "count", "min", "max", "mean", "stddev", F.col("q0").alias("median")).orderBy("order")
