"""The cleaning steps.  Each takes a ``Flow`` and a config and returns the next ``Flow``.

Steps only add to the logical plan; nothing runs until the recipe is previewed or executed.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions import cells, conditions
from ..types import (
    BOOLEAN, DATE, DATETIME, DECIMAL, INTEGER, ROW_ID, SPARK_TYPES, column, field_type, quoted,
)
from . import heavy_join, quantiles
from .guard import bare, check_functions

CODE = "invalid_cleaning_step"


@dataclass(frozen=True)
class Step:
    operation: str
    order: int
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    """A table on its way through a recipe.

    ``unique_ids``: every row still has a row id of its own.  ``sorted``: the row order of the plan is
    the wanted one.  Both decide how the result is numbered.  ``dry``: only the schema matters, so no
    step may run a job.
    """

    df: DataFrame
    unique_ids: bool = True
    sorted: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)
    dry: bool = False

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    def to(self, df: DataFrame, **changes) -> Flow:
        return replace(self, df=df, **changes)


def fail(message: str) -> WorkspaceError:
    return WorkspaceError(CODE, message)


# -- config access --------------------------------------------------------------------------


def text(config: dict, key: str) -> str:
    value = config.get(key)
    if not isinstance(value, str) or not value.strip():
        raise fail(f"{key} must be a non-blank string")
    return value.strip()


def texts(config: dict, key: str) -> list[str]:
    value = config.get(key)
    if not isinstance(value, list) or not value:
        raise fail(f"{key} must be a non-empty list of strings")
    return [text({key: v}, key) for v in value]


def existing(flow: Flow, *names: str) -> None:
    missing = [n for n in names if n not in flow.names]
    if missing:
        raise fail(f"No such field: {', '.join(missing)}")


def one_field(flow: Flow, config: dict, key: str = "field") -> str:
    name = text(config, key)
    existing(flow, name)
    return name


def field_list(flow: Flow, config: dict, key: str = "fields") -> list[str]:
    names = texts(config, key)
    existing(flow, *names)
    return names


def new_name(flow: Flow, config: dict, key: str = "target", replaces: str | None = None) -> str:
    name = text(config, key)
    taken = {n.lower() for n in flow.names if n != replaces} | {ROW_ID}
    if name.lower() in taken:
        raise fail(f"Field {name!r} already exists")
    return name


def data_type(flow: Flow, name: str) -> T.DataType:
    return flow.df.schema[name].dataType


def is_nullable(flow: Flow, name: str) -> bool:
    f = flow.df.schema[name]
    return f.metadata.get("nullable", f.nullable)


def literal(value: object, kind: str) -> object:
    """A config value as a value of a field type; refuses what does not fit."""
    try:
        if value is None:
            return None
        if kind == INTEGER:
            if isinstance(value, float) and not value.is_integer():
                raise ValueError(value)
            return int(value)
        if kind == DECIMAL:
            return float(value)
        if kind == BOOLEAN:
            word = str(value).lower()
            if word not in cells.BOOLEAN_WORDS:
                raise ValueError(value)
            return word in cells.TRUE_WORDS
        if kind == DATE:
            return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value))
        if kind == DATETIME:
            return value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
        return str(value)
    except (TypeError, ValueError):
        raise fail(f"{value!r} is not a value of type {kind}") from None


def typed_literal(value: object, spark_type: T.DataType) -> Column:
    """The config value as a literal of the column's own type, so the schema does not move."""
    grid = conditions.grid_of(spark_type)
    if grid and value is not None:
        try:
            number = conditions.exact_number(value)
        except ValueError:
            raise fail(f"{value!r} is not a number") from None
        scale, least, most = grid
        if not least <= number <= most or conditions.on_grid(number, scale) != number:
            raise fail(f"{value!r} does not fit a field of type {spark_type.simpleString()}")
        return conditions.grid_literal(number, spark_type)
    return F.lit(literal(value, field_type(spark_type))).cast(spark_type)


# -- the four base steps ----------------------------------------------------------------------


def rename_field(flow: Flow, config: dict) -> Flow:
    source = one_field(flow, config, "source_field")
    target = new_name(flow, config, "target_field", replaces=source)
    return flow.to(flow.df.withColumnRenamed(source, target))


def fill_null(flow: Flow, config: dict) -> Flow:
    return per_field(flow, [one_field(flow, config)], "fill_null", config)


def _fill(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    if "value" not in config:
        raise fail("value is required")
    kind = data_type(flow, name)
    filled = F.when(cells.is_blank(column(name), kind), typed_literal(config["value"], kind)).otherwise(column(name))
    return filled, config["value"] is None


def drop_null_rows(flow: Flow, config: dict) -> Flow:
    df = flow.df
    for name in field_list(flow, config):
        df = df.filter(~cells.is_blank(column(name), data_type(flow, name)))
    return flow.to(df)


def deduplicate(flow: Flow, config: dict) -> Flow:
    """Keep the first row of each key.

    The rank filter lets Spark cut every key to one row per task before the shuffle, so a key with
    very many copies never meets in one task.
    """
    names = field_list(flow, config)
    if ROW_ID not in flow.df.columns:
        raise fail("deduplicate needs row ids; materialize the table first")
    # after a join several rows may carry one id: the other fields then decide
    ties = [] if flow.unique_ids else [column(n) for n in flow.names if n not in names]
    first = Window.partitionBy(*[column(n) for n in names]).orderBy(column(ROW_ID), *ties)
    df = flow.df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return flow.to(df, sorted=False)


# -- steps on single fields, also usable on many fields at once --------------------------------


def _convert(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    kind = text(config, "type")
    if kind not in SPARK_TYPES:
        raise fail(f"Unknown field type {kind!r}")
    strict = _choice(config, "on_error", ("fail", "null"), "fail") == "fail"
    source, c = data_type(flow, name), column(name)
    value = cells.normalize_cell(c) if isinstance(source, T.StringType) else c
    cast = cells.coerce(value, source, kind)
    if strict:
        message = F.concat(F.lit(f"invalid_field_value: {name}: "), c.cast("string"))
        cast = F.when(value.isNotNull() & cast.isNull(), F.raise_error(message)).otherwise(cast)
    return cast, is_nullable(flow, name) or not strict


def _choice(config: dict, key: str, allowed: tuple, default=None):
    value = config.get(key, default)
    if value not in allowed:
        raise fail(f"{key} must be one of {', '.join(map(str, allowed))}")
    return value


def _clean_text(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    if not isinstance(data_type(flow, name), T.StringType):
        raise fail(f"{name!r} is not a text field")
    actions = config.get("actions")
    if not isinstance(actions, list) or not actions:
        raise fail("actions must be a non-empty list")
    c = column(name)
    for action in actions:
        if action == "trim":
            c = F.btrim(c, F.lit(cells.WHITESPACE))
        elif action == "lower":
            c = F.lower(c)
        elif action == "upper":
            c = F.upper(c)
        elif action == "collapse_spaces":
            c = F.regexp_replace(c, r"\s+", " ")
        elif isinstance(action, dict) and set(action) == {"find", "replace"}:
            c = F.replace(c, F.lit(action["find"]), F.lit(action["replace"]))
        else:
            raise fail(f"Unknown text action {action!r}")
    return c, is_nullable(flow, name)


def _numeric(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    source, c = data_type(flow, name), column(name)
    if not isinstance(source, T.NumericType):
        raise fail(f"{name!r} is not a number field")
    action = _choice(config, "action", ("round", "abs", "clip", "scale"))
    if action == "round":
        c = F.round(c, int(config.get("digits", 0)))
    elif action == "abs":
        c = F.abs(c)
    elif action == "clip":
        try:
            bounds = {k: conditions.exact_number(config[k]) for k in ("min", "max") if config.get(k) is not None}
        except ValueError:
            raise fail(f"{config.get('min')!r} or {config.get('max')!r} is not a number") from None
        grid = conditions.grid_of(source)
        if grid and any(b.is_finite() and conditions.on_grid(b, grid[0]) != b for b in bounds.values()):
            source, c, grid = T.DoubleType(), c.cast("double"), None  # a bound between two values of the type makes doubles
        for key, op in (("min", "<"), ("max", ">")):
            if key not in bounds:
                continue
            b = bounds[key]
            if grid is None:
                beyond, limit = (c < float(b) if op == "<" else c > float(b)), F.lit(float(b)).cast(source)
            elif grid[1] <= b <= grid[2]:
                beyond, limit = conditions.compare_exactly(c, source, op, b), conditions.grid_literal(b, source)
            elif (b > grid[2]) == (op == ">"):
                continue  # no value of the type lies beyond
            else:
                raise fail(f"Every value of {name!r} lies beyond {key} {config[key]!r}, which its type cannot hold")
            c = F.when(beyond, limit).otherwise(c)
    else:
        c = c * float(config.get("factor", 1)) + float(config.get("offset", 0))
    return c, is_nullable(flow, name)


def _mask(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    strategy = _choice(config, "strategy", ("mask", "hash", "null", "last4"))
    c = cells.to_text(column(name), data_type(flow, name))
    if strategy == "mask":
        c = F.mask(c)
    elif strategy == "hash":
        c = F.sha2(c, 256)
    elif strategy == "last4":
        hidden = F.greatest(F.length(c) - 4, F.lit(0))
        c = F.concat(F.repeat(F.lit("*"), hidden), F.right(c, F.lit(4)))
    else:
        return F.lit(None).cast(data_type(flow, name)), True
    return c, is_nullable(flow, name)


def _set_blank(flow: Flow, name: str, config: dict) -> tuple[Column, bool]:
    return cells.blank_to_null(column(name), data_type(flow, name)), True


PER_FIELD: dict[str, Callable[[Flow, str, dict], tuple[Column, bool]]] = {
    "fill_null": _fill,
    "convert_type": _convert,
    "clean_text": _clean_text,
    "numeric": _numeric,
    "mask": _mask,
    "blank_to_null": _set_blank,
}


def per_field(flow: Flow, names: list[str], operation: str, config: dict) -> Flow:
    """Apply a single-field step to a list of fields, all in one projection."""
    if operation not in PER_FIELD:
        raise fail(f"{operation!r} cannot be applied to many fields")
    changed = {n: PER_FIELD[operation](flow, n, config) for n in names}
    projected = []
    for order, name in enumerate(flow.df.columns):
        if name in changed:
            value, nullable = changed[name]
            metadata = {**flow.df.schema[name].metadata, "nullable": nullable}
            projected.append(value.alias(name, metadata=metadata))
        else:
            projected.append(column(name))
    return flow.to(flow.df.select(*projected))


def _single(operation: str) -> Callable[[Flow, dict], Flow]:
    def apply(flow: Flow, config: dict) -> Flow:
        return per_field(flow, [one_field(flow, config)], operation, config)

    return apply


def batch(flow: Flow, config: dict) -> Flow:
    inner = config.get("step")
    if not isinstance(inner, dict):
        raise fail("step must name the operation to apply")
    return per_field(flow, field_list(flow, config), text(inner, "operation"), inner.get("config", {}))


# -- rows -------------------------------------------------------------------------------------


def filter_rows(flow: Flow, config: dict) -> Flow:
    return flow.to(flow.df.filter(conditions.build(config.get("condition"), flow.df.schema, CODE)))


def sort(flow: Flow, config: dict) -> Flow:
    """Order the rows; with ``limit``, the top rows only (no full sort then)."""
    keys = config.get("by")
    if not isinstance(keys, list) or not keys:
        raise fail("by must be a non-empty list")
    order = []
    for key in keys:
        c = column(one_field(flow, key))
        order.append(c.desc_nulls_last() if _choice(key, "direction", ("asc", "desc"), "asc") == "desc" else c.asc_nulls_last())
    if ROW_ID in flow.df.columns:
        order.append(column(ROW_ID))  # equal rows keep their order
    df = flow.df.orderBy(*order)
    if config.get("limit") is not None:
        df = df.limit(int(config["limit"]))
    return flow.to(df, sorted=True)


# -- new fields -------------------------------------------------------------------------------


def add(flow: Flow, name: str, value: Column) -> Flow:
    return flow.to(flow.df.withColumn(name, value))


def calculate(flow: Flow, config: dict) -> Flow:
    target, expression = new_name(flow, config), text(config, "expression")
    check_functions(expression)
    if re.search(r"(?i)\bselect\b", bare(expression)):
        raise fail("An expression computes from the fields of its row, not from queries")
    try:
        result = add(flow, target, F.expr(expression))
        result.df.schema  # resolve now, so a bad expression is a bad step
        return result
    except (AnalysisException, ParseException) as error:
        raise fail(f"expression: {str(error).splitlines()[0]}") from None


def split_field(flow: Flow, config: dict) -> Flow:
    name, separator = one_field(flow, config), config.get("separator")
    if not isinstance(separator, str) or not separator:
        raise fail("separator is required")
    # a separator is text, not a pattern
    parts = F.split(column(name).cast("string"), "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    for i, target in enumerate(texts(config, "targets")):
        flow = add(flow, new_name(flow, {"target": target}), F.get(parts, i))
    return flow


def merge_fields(flow: Flow, config: dict) -> Flow:
    """Join the non-null texts of several fields."""
    names = field_list(flow, config)
    parts = [cells.to_text(column(n), data_type(flow, n)) for n in names]
    return add(flow, new_name(flow, config), F.concat_ws(config.get("separator", ""), *parts))


def conditional_field(flow: Flow, config: dict) -> Flow:
    cases = config.get("cases")
    if not isinstance(cases, list) or not cases:
        raise fail("cases must be a non-empty list")
    kind = SPARK_TYPES[_choice(config, "type", tuple(SPARK_TYPES), "text")]
    value = typed_literal(config.get("otherwise"), kind)
    for case in reversed(cases):
        when = conditions.build(case.get("when"), flow.df.schema, CODE)
        value = F.when(when, typed_literal(case.get("then"), kind)).otherwise(value)
    return add(flow, new_name(flow, config), value)


def extract(flow: Flow, config: dict) -> Flow:
    """First match of a pattern; null where it does not match."""
    c, pattern = column(one_field(flow, config)).cast("string"), text(config, "pattern")
    found = F.regexp_extract(c, pattern, int(config.get("group", 1)))
    return add(flow, new_name(flow, config), F.when(c.rlike(pattern), found))


def _date_field(flow: Flow, config: dict) -> Column:
    name = one_field(flow, config)
    if not isinstance(data_type(flow, name), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise fail(f"{name!r} is not a date field")
    return column(name)


def format_date(flow: Flow, config: dict) -> Flow:
    return add(flow, new_name(flow, config), F.date_format(_date_field(flow, config), text(config, "format")))


DATE_PARTS = ("year", "quarter", "month", "week", "day", "dayofweek", "doy", "hour", "minute")


def date_part(flow: Flow, config: dict) -> Flow:
    part = _choice(config, "part", DATE_PARTS)
    return add(flow, new_name(flow, config), F.date_part(F.lit(part), _date_field(flow, config)).cast("long"))


def truncate_date(flow: Flow, config: dict) -> Flow:
    unit = _choice(config, "unit", ("year", "quarter", "month", "week", "day", "hour"))
    c = _date_field(flow, config)
    return add(flow, new_name(flow, config), F.date_trunc(unit, c).cast("timestamp_ntz"))


# -- groups, joins, reshaping -----------------------------------------------------------------

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


def _aggregate(flow: Flow, spec: dict) -> Column:
    function = _choice(spec, "function", tuple(AGGREGATES))
    if function == "count" and spec.get("field") is None:
        return F.count(F.lit(1))
    return AGGREGATES[function](column(one_field(flow, spec)))


def aggregate(flow: Flow, config: dict) -> Flow:
    keys = field_list(flow, config, "group_by") if config.get("group_by") else []
    specs = config.get("aggregations")
    if not isinstance(specs, list) or not specs:
        raise fail("aggregations must be a non-empty list")
    values = [_aggregate(flow, s).alias(text(s, "name")) for s in specs]
    return flow.to(flow.df.groupBy(*[column(k) for k in keys]).agg(*values), unique_ids=False, sorted=False)


def join(flow: Flow, config: dict) -> Flow:
    """Equi-join with another table of the recipe's scope.

    Spark broadcasts a side it knows to be small and otherwise shuffles, splitting hot keys. It does not where a step
    that groups by the key follows; with ``split_heavy`` they are split there as well.
    """
    how = _choice(config, "how", ("inner", "left", "right", "full", "semi", "anti"), "inner")
    other_name = text(config, "table")
    if other_name not in flow.tables:
        raise fail(f"No such table: {other_name}")
    other = flow.tables[other_name].drop(ROW_ID)
    pairs = config.get("on")
    if not isinstance(pairs, list) or not pairs:
        raise fail("on must be a non-empty list")
    lefts, rights = [], []
    for pair in pairs:
        lefts.append(one_field(flow, pair, "left"))
        rights.append(text(pair, "right"))
        if rights[-1] not in other.columns:
            raise fail(f"No such field: {rights[-1]}")
    left, right = flow.df, other
    match = [F.col(f"l.{quoted(a)}") == F.col(f"r.{quoted(b)}") for a, b in zip(lefts, rights)]
    if config.get("split_heavy"):
        alike = all(left.schema[a].dataType == right.schema[b].dataType for a, b in zip(lefts, rights))
        if not alike or {"_part_l", "_part_r"} & {c.lower() for c in (*left.columns, *right.columns)}:
            raise fail("split_heavy needs keys of equal types, and no fields named _part_l or _part_r")
        left, right = heavy_join.sides(left, right, lefts, rights, "left" if how == "full" else how, ("_part_l", "_part_r"))
        match += [F.col(f"l.{p}") == F.col(f"r.{p}") for p in ("_part_l", "_part_r")]
    left, right = left.alias("l"), right.alias("r")
    if how in ("semi", "anti"):
        return flow.to(left.join(right, match, f"left_{how}").select(*[F.col(f"l.{quoted(c)}") for c in flow.df.columns]), sorted=False)
    # a key of the same name on both sides is one column of the result
    shared = {a: b for a, b in zip(lefts, rights) if a == b}
    extra = [c for c in other.columns if c not in shared]
    clash = {c.lower() for c in extra} & {c.lower() for c in flow.df.columns}
    if clash:
        raise fail(f"Both tables have a field {', '.join(sorted(clash))}")

    others = [F.col(f"r.{quoted(c)}") for c in extra]
    joined = left.join(right, match, "left" if how == "full" else how)
    df = joined.select(*[_either(c, shared) for c in flow.df.columns], *others)
    if how == "full":
        # left join plus unmatched right rows: unlike a full join, Spark can split a hot key in both
        plain = match[: len(lefts)]
        unmatched = other.alias("r").join(flow.df.alias("l"), plain, "left_anti")
        alone = [
            (F.col(f"r.{quoted(shared[c])}") if c in shared else F.lit(None).cast(flow.df.schema[c].dataType)).alias(c)
            for c in flow.df.columns
        ]
        df = df.unionByName(unmatched.select(*alone, *others))
    return flow.to(df, unique_ids=False, sorted=False)


def _either(name: str, shared: dict[str, str]) -> Column:
    """A column of the left table; a shared key is taken from whichever side has the row."""
    mine = F.col(f"l.{quoted(name)}")
    return F.coalesce(mine, F.col(f"r.{quoted(shared[name])}")).alias(name) if name in shared else mine


def pivot(flow: Flow, config: dict) -> Flow:
    """Listed values of one field become fields."""
    keys, name = field_list(flow, config, "group_by"), one_field(flow, config, "column")
    values = config.get("values")
    if not isinstance(values, list) or not values:
        raise fail("values must list the values that become fields")
    listed = [literal(v, field_type(data_type(flow, name))) for v in values]
    grouped = flow.df.groupBy(*[column(k) for k in keys]).pivot(name, listed)
    return flow.to(grouped.agg(_aggregate(flow, config)), unique_ids=False, sorted=False)


def unpivot(flow: Flow, config: dict) -> Flow:
    """Fields become rows of (name, value)."""
    names = field_list(flow, config)
    kinds = {field_type(data_type(flow, n)) for n in names}
    kind = kinds.pop() if len(kinds) == 1 else "text"
    values = [cells.coerce(column(n), data_type(flow, n), kind).alias(n) for n in names]
    kept = [column(n) for n in flow.df.columns if n not in names]
    df = flow.df.select(*kept, *values).unpivot(
        kept, [column(n) for n in names],
        new_name(flow, config, "name_target"), new_name(flow, config, "value_target"),
    )
    return flow.to(df, unique_ids=False)


def flag_outliers(flow: Flow, config: dict) -> Flow:
    """A boolean field: is the value far from the rest of its group?

    ``zscore``: further than ``threshold`` standard deviations from the mean.  ``iqr``: further than
    ``threshold`` interquartile ranges outside the quartiles (exact ones).
    """
    name, method = one_field(flow, config), _choice(config, "method", ("zscore", "iqr"), "zscore")
    if not isinstance(data_type(flow, name), T.NumericType):
        raise fail(f"{name!r} is not a number field")
    keys = field_list(flow, config, "group_by") if config.get("group_by") else []
    target = new_name(flow, config)
    threshold = float(config.get("threshold", 3.0 if method == "zscore" else 1.5))
    if flow.dry:
        return add(flow, target, F.lit(False))
    if method == "zscore":
        facts = flow.df.groupBy(*[column(k) for k in keys]).agg(
            F.avg(column(name)).alias("a"), F.stddev_pop(column(name)).alias("b")
        )
        low, high = F.col("a") - threshold * F.col("b"), F.col("a") + threshold * F.col("b")
    else:
        facts = quantiles.exact(flow.df, keys, name, [0.25, 0.75])
        spread = threshold * (F.col("q1") - F.col("q0"))
        low, high = F.col("q0") - spread, F.col("q1") + spread
    limits = facts.select(*[column(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(low.alias("low"), high.alias("high")).alias("limits"))
    if not keys:
        bounds = limits.scalar()
        outside = (column(name) < bounds["low"]) | (column(name) > bounds["high"])
        return add(flow, target, F.coalesce(outside, F.lit(False)))
    # one row per group; Spark broadcasts it only if it turns out small, so large groups are dealt over several tasks
    part = "_part"
    while part in {c.lower() for c in flow.df.columns}:
        part += "_"
    rows, limits = heavy_join.facts_sides(flow.df, limits, keys, [f"k{i}" for i in range(len(keys))], part)
    limits = limits.withColumnRenamed(part, f"{part}_of")
    match = [*[column(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)], F.col(part) == F.col(f"{part}_of")]
    outside = (column(name) < F.col("limits.low")) | (column(name) > F.col("limits.high"))
    joined = rows.join(limits, match, "left")
    df = joined.select(*[column(c) for c in flow.df.columns], F.coalesce(outside, F.lit(False)).alias(target))
    return flow.to(df, sorted=False)


STEPS: dict[str, Callable[[Flow, dict], Flow]] = {
    "rename_field": rename_field,
    "fill_null": fill_null,
    "drop_null_rows": drop_null_rows,
    "deduplicate": deduplicate,
    "convert_type": _single("convert_type"),
    "clean_text": _single("clean_text"),
    "numeric": _single("numeric"),
    "mask": _single("mask"),
    "blank_to_null": _single("blank_to_null"),
    "batch": batch,
    "filter_rows": filter_rows,
    "sort": sort,
    "calculate": calculate,
    "split_field": split_field,
    "merge_fields": merge_fields,
    "conditional_field": conditional_field,
    "extract": extract,
    "format_date": format_date,
    "date_part": date_part,
    "truncate_date": truncate_date,
    "aggregate": aggregate,
    "join": join,
    "pivot": pivot,
    "unpivot": unpivot,
    "flag_outliers": flag_outliers,
}


def fold(flow: Flow, steps: list[Step]) -> Flow:
    """Apply the steps by their order; a step that cannot be applied is refused."""
    for step in sorted(steps, key=lambda s: s.order):
        if step.operation not in STEPS:
            raise fail(f"Unknown operation {step.operation!r}")
        flow = STEPS[step.operation](flow, step.config)
    return flow


__all__ = ["AGGREGATES", "Flow", "STEPS", "Step", "fold"]
