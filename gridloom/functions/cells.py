"""Column expressions on single cells: blanks, text-to-type predicates and casts.

Everything here is a tree of built-in functions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from ..types import BOOLEAN, DATE, DATETIME, DECIMAL, INTEGER, TEXT

# The characters that count as white space around a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The words a boolean column may hold, and those that mean true.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")
TRUE_WORDS = ("true", "yes", "1")

BITS = {BOOLEAN: 1, INTEGER: 2, DECIMAL: 4, DATE: 8, DATETIME: 16}

INTEGER_PATTERN = r"^[0-9]+$"
DECIMAL_PATTERN = (
    r"(?i)^[+-]?(([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(e[+-]?[0-9][0-9_]*)?|inf(inity)?|nan)$"
)
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
# date, optional time of day, optional offset
DATETIME_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9]){0,2})?)?$"
)
OFFSET_PATTERN = r"[+-][0-9:]+$"


def normalize_cell(c: Column) -> Column:
    """Strip white space on both sides; nothing left means null."""
    # most cells begin and end with a printable ASCII character, which is quick to see
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))
    clean = first.between(33, 126) & last.between(33, 126)
    return F.when(clean, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit("")))


def is_blank(c: Column, data_type: T.DataType) -> Column:
    """Null, or the empty string where the column can hold one."""
    if isinstance(data_type, T.StringType):
        return F.coalesce(c == "", F.lit(True))
    return c.isNull()


def blank_to_null(c: Column, data_type: T.DataType) -> Column:
    return F.nullif(c, F.lit("")) if isinstance(data_type, T.StringType) else c


# -- reading text ---------------------------------------------------------------------------


def text_to_double(c: Column) -> Column:
    return F.when(c.rlike(DECIMAL_PATTERN), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def text_to_date(c: Column) -> Column:
    return F.when(c.rlike(DATE_PATTERN), c.try_cast("date"))


def is_datetime_text(c: Column) -> Column:
    """The pattern checks the time of day, the cast the date."""
    return c.rlike(DATETIME_PATTERN) & F.substring(c, 1, 10).try_cast("date").isNotNull()


def text_to_datetime(c: Column) -> Column:
    """ISO 8601 text; an offset is applied, so the result is UTC wall-clock time."""
    day, clock = F.substring(c, 1, 10), F.replace(F.substr(c, F.lit(11)), F.lit(","), F.lit("."))
    offset = F.regexp_extract(clock, OFFSET_PATTERN, 0)
    local = F.concat(day, F.regexp_replace(clock, rf"(Z|{OFFSET_PATTERN[:-1]})$", ""))
    # an hour alone is not a time of day to Spark
    moment = F.when(F.length(local) == 13, F.concat(local, F.lit(":00"))).otherwise(local).try_cast("timestamp_ntz")
    hhmmss = F.rpad(F.replace(offset, F.lit(":"), F.lit("")), 7, "0").cast("int")
    # h*10000 + m*100 + s with one sign, as seconds
    seconds = hhmmss - 40 * (hhmmss / 100).cast("int") - 2400 * (hhmmss / 10000).cast("int")
    shifted = F.when(F.length(offset) > 0, F.timestamp_add("SECOND", -seconds, moment)).otherwise(moment)
    return F.when(c.rlike(DATETIME_PATTERN), shifted)


def type_mask(c: Column) -> Column:
    """Which types a non-null, stripped text reads as, one bit each; text in general has none.

    The cases exclude one another, so a cell is matched against few patterns.
    """

    def bit(kind: str, condition: Column) -> Column:
        return F.when(condition, BITS[kind]).otherwise(0)

    first = F.ascii(c)
    digits = F.lit(BITS[DECIMAL]) + bit(INTEGER, c.try_cast("long").isNotNull())
    temporal = bit(DATE, text_to_date(c).isNotNull()) + bit(DATETIME, is_datetime_text(c))
    other = bit(DECIMAL, c.rlike(DECIMAL_PATTERN))
    from_digit = F.when(c.rlike(INTEGER_PATTERN), digits).when(c.rlike("^[0-9]{4}-[0-9]"), temporal).otherwise(other)
    # a number that does not begin with a digit begins with one of + - . i n
    shape = (
        F.when(first.between(ord("0"), ord("9")), from_digit)
        .when(first.isin(*map(ord, "+-.iInN")), other)
        .otherwise(0)
    )
    word = bit(BOOLEAN, (F.length(c) <= 5) & F.lower(c).isin(*BOOLEAN_WORDS))
    return F.when(c.isNotNull(), word + shape)


def cast_text(c: Column, kind: str) -> Column:
    """Stripped text to a field type; null where the text does not fit the type."""
    if kind == BOOLEAN:
        return F.when(c.isNotNull(), F.lower(c).isin(*TRUE_WORDS))
    if kind == INTEGER:
        plain = F.replace(c, F.lit("_"), F.lit(""))
        return F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("long"))
    if kind == DECIMAL:
        return text_to_double(c)
    if kind == DATE:
        return text_to_date(c)
    if kind == DATETIME:
        return text_to_datetime(c)
    return c


# -- writing text ---------------------------------------------------------------------------


# Outside this range decimals are written with an exponent.
DECIMAL_PLAIN_BELOW, DECIMAL_PLAIN_FROM = 1e16, 1e-4


def decimal_text(c: Column) -> Column:
    """A double in its shortest form: ``12345678.5``, ``0.0005``, ``10000000.0``, ``1e-05``, ``1.5e+20``."""
    shortest, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    power = F.regexp_extract(shortest, r"E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(
        F.regexp_replace(F.regexp_extract(shortest, r"^[^E]*", 0), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(~shortest.contains("E"), shortest)
        .when((size >= DECIMAL_PLAIN_FROM) & (size < DECIMAL_PLAIN_BELOW), plain)
        .otherwise(exponent)
    )


def to_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a typed value as the workspace shows it: ISO dates, True/False, plain numbers."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return decimal_text(c if isinstance(data_type, T.DoubleType) else c.cast("string").cast("double"))
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    return c.cast("string")


def coerce(c: Column, data_type: T.DataType, kind: str) -> Column:
    """A value of any type to a field type; null in, null out, null where it does not fit."""
    source_text = isinstance(data_type, T.StringType)
    if source_text:
        return cast_text(c, kind)
    if kind == TEXT:
        return to_text(c, data_type)
    if kind == DECIMAL and isinstance(data_type, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if kind == INTEGER:
        if isinstance(data_type, T.BooleanType):
            return c.cast("long")
        if isinstance(data_type, T.NumericType):
            return c.try_cast("long")  # drops the fraction; out of range and NaN do not fit
    if kind == BOOLEAN:
        if isinstance(data_type, T.BooleanType):
            return c
        return cast_text(c.cast("string"), BOOLEAN)
    if isinstance(data_type, T.DateType):
        return c.cast("timestamp_ntz") if kind == DATETIME else (c if kind == DATE else _none(kind))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return c.cast({DATE: "date", DATETIME: "timestamp_ntz"}[kind]) if kind in (DATE, DATETIME) else _none(kind)
    return _none(kind)


def _none(kind: str) -> Column:
    from ..types import SPARK_TYPES

    return F.lit(None).cast(SPARK_TYPES[kind])
