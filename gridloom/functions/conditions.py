"""Condition trees of recipe filters and dashboards, as one boolean Column.

A leaf is ``{"field", "op", "value"}``; nodes are ``{"and": [...]}``, ``{"or": [...]}``,
``{"not": {...}}``.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..types import column
from .cells import BOOLEAN_WORDS, TRUE_WORDS, is_blank

_BINARY: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "matches": lambda c, v: c.rlike(v),
}
OPERATORS = (*_BINARY, "in", "not_in", "between", "is_blank", "not_blank")


def build(tree: dict, schema: T.StructType, code: str = "invalid_cleaning_step") -> Column:
    if not isinstance(tree, dict):
        raise WorkspaceError(code, "A condition must be an object")
    for joiner in ("and", "or"):
        if joiner in tree:
            parts = [build(t, schema, code) for t in tree[joiner]]
            if not parts:
                raise WorkspaceError(code, f"{joiner!r} needs at least one condition")
            result = parts[0]
            for p in parts[1:]:
                result = result & p if joiner == "and" else result | p
            return result
    if "not" in tree:
        return ~build(tree["not"], schema, code)
    return _leaf(tree, schema, code)


#: Bits of the whole-number types.
WHOLE_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_DIGITS = decimal.Context(prec=400)


def exact_number(v: object) -> decimal.Decimal:
    """A config value as the number it is written as; infinities are kept, NaN is refused."""
    if not isinstance(v, (bool, int, float, str, decimal.Decimal)):
        raise ValueError(v)
    try:
        number = decimal.Decimal(int(v) if isinstance(v, bool) else repr(v) if isinstance(v, float) else v)
    except decimal.InvalidOperation:
        raise ValueError(v) from None
    if number.is_nan():
        raise ValueError(v)
    return number


def grid_of(data_type: T.DataType) -> tuple[int, decimal.Decimal, decimal.Decimal] | None:
    """(scale, least, greatest) of an exact number type; None for doubles."""
    if type(data_type) in WHOLE_BITS:
        half = 1 << WHOLE_BITS[type(data_type)] - 1
        return 0, decimal.Decimal(-half), decimal.Decimal(half - 1)
    if isinstance(data_type, T.DecimalType):
        most = decimal.Decimal(10**data_type.precision - 1).scaleb(-data_type.scale, _DIGITS)
        return data_type.scale, -most, most
    return None


def on_grid(v: decimal.Decimal, scale: int) -> decimal.Decimal:
    """The greatest number of ``scale`` places that is not above ``v``."""
    whole = v.scaleb(scale, _DIGITS).to_integral_value(decimal.ROUND_FLOOR, _DIGITS)
    return whole.scaleb(-scale, _DIGITS)


def grid_literal(v: decimal.Decimal, data_type: T.DataType) -> Column:
    return F.lit(int(v) if grid_of(data_type)[0] == 0 and not isinstance(data_type, T.DecimalType) else v).cast(data_type)


def compare_exactly(c: Column, data_type: T.DataType, op: str, v: decimal.Decimal) -> Column:
    """``c op v`` for a whole-number or decimal column and any number, never rounding either."""
    scale, least, most = grid_of(data_type)
    always, never = (F.when(c.isNotNull(), F.lit(x)) for x in (True, False))
    if v > most or v < least:
        below = v > most
        return always if op == "!=" or op in (("<", "<=") if below else (">", ">=")) else never
    low = on_grid(v, scale)
    bound = grid_literal(low, data_type)
    if low == v:
        return _BINARY[op](c, bound)
    return {"=": never, "!=": always, "<": c <= bound, "<=": c <= bound, ">": c > bound, ">=": c > bound}[op]


def _boolean(v: object) -> bool:
    word = str(v).strip().lower()
    if word not in BOOLEAN_WORDS:
        raise ValueError(v)
    return word in TRUE_WORDS


def _leaf(leaf: dict, schema: T.StructType, code: str) -> Column:
    name, op, value = leaf.get("field"), leaf.get("op"), leaf.get("value")
    if name not in schema.names:
        raise WorkspaceError(code, f"Condition field {name!r} does not exist")
    if op not in OPERATORS:
        raise WorkspaceError(code, f"Unknown condition operator {op!r}")
    data_type, c = schema[name].dataType, column(name)
    if op == "is_blank":
        return is_blank(c, data_type)
    if op == "not_blank":
        return ~is_blank(c, data_type)

    exact = grid_of(data_type) is not None and op not in ("like", "matches")

    def fitting(make: Callable, v: object):
        try:
            return make(v)
        except (TypeError, ValueError, OverflowError):
            raise WorkspaceError(code, f"{v!r} does not fit field {name!r}") from None

    def typed(v: object) -> Column:
        if v is None:
            return F.lit(None).cast(data_type)
        if isinstance(data_type, T.NumericType):
            return F.lit(fitting(lambda x: float(exact_number(x)), v)).cast(data_type)
        if isinstance(data_type, T.BooleanType):
            return F.lit(fitting(_boolean, v))
        if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(v, str):
            fitting(lambda x: datetime.datetime.fromisoformat(x.strip()), v)
        return F.lit(v).cast(data_type)

    def compared(how: str, v: object) -> Column:
        if v is None:
            return F.lit(None).cast("boolean")
        return compare_exactly(c, data_type, how, fitting(exact_number, v)) if exact else _BINARY[how](c, typed(v))

    if op in ("in", "not_in", "between"):
        if not isinstance(value, (list, tuple)) or not value or (op == "between" and len(value) != 2):
            raise WorkspaceError(code, f"{op!r} needs a list of values")
        if op == "between":
            return compared(">=", value[0]) & compared("<=", value[1])
        if exact:  # a value that the type cannot hold is in no row
            scale, least, most = grid_of(data_type)
            numbers = [v if v is None else fitting(exact_number, v) for v in value]
            held = [v for v in numbers if v is None or least <= v <= most and on_grid(v, scale) == v]
            literals = [F.lit(None).cast(data_type) if v is None else grid_literal(v, data_type) for v in held]
            inside = c.isin(*literals) if literals else F.when(c.isNotNull(), F.lit(False))
        else:
            inside = c.isin(*[typed(v) for v in value])
        return inside if op == "in" else ~inside
    if value is None:
        raise WorkspaceError(code, f"{op!r} needs a value")
    return _BINARY[op](c, value) if op in ("like", "matches") else compared(op, value)
