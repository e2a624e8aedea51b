"""Number rules of the charts: how a value becomes a label, a number and a rounded point.

The charts follow the number rules of the browser, which differ from Spark's in printing whole
doubles, in reading text and in rounding halves.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from .cells import WHITESPACE

NULL_LABEL = "NULL"  # fixed value
# Outside this range numbers are printed with an exponent.
PLAIN_BELOW, PLAIN_FROM = 1e21, 1e-6


def number_label(c: Column) -> Column:
    """A double the way a browser prints it: ``1`` not ``1.0``, plain digits below 1e21."""
    shortest = c.cast("string")
    size = F.abs(c)

    def plain(decimal_type: str) -> Column:
        digits = shortest.try_cast(decimal_type).cast("string")
        return F.regexp_replace(digits, r"\.?0+$", "")

    with_exponent = F.regexp_replace(
        F.regexp_replace(F.lower(shortest), r"\.0e", "e"), r"e([0-9])", "e+$1"
    )
    return (
        F.when(c == 0, "0")
        .when(F.isnan(c), "NaN")
        .when(size == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity"))
        # whole values below 2^53 need no decimal arithmetic
        .when((size < 9007199254740992.0) & (c == F.floor(c)), c.cast("long").cast("string"))
        .when((size >= 1) & (size < PLAIN_BELOW), F.when(c == F.rint(c), F.regexp_replace(plain("decimal(38,1)"), r"\.$", "")).otherwise(plain("decimal(38,17)")))
        .when((size < 1) & (size >= PLAIN_FROM), plain("decimal(38,30)"))
        .otherwise(with_exponent)
    )


def group_label(c: Column, data_type: T.DataType) -> Column:
    """The label of a chart group: null and "" share the label ``NULL``."""
    if isinstance(data_type, T.StringType):
        text = F.nullif(c, F.lit(""))
    elif isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = number_label(c.cast("double"))
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        iso = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
        text = F.when(F.contains(iso, F.lit(".")), F.rpad(iso, 26, "0")).otherwise(iso)  # no or six decimals
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_LABEL))


def to_number(c: Column, data_type: T.DataType) -> Column:
    """A metric value: numbers as they are, numeric text read, everything else 0."""
    if isinstance(data_type, T.NumericType):
        value = c.cast("double")
    elif isinstance(data_type, T.StringType):
        text = F.btrim(c, F.lit(WHITESPACE + "\ufeff"))
        plain = F.when(
            text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")
        )
        value = (
            F.when(text.rlike(r"^0[xX][0-9a-fA-F]+$"), _based(text, 16, 4))
            .when(text.rlike(r"^0[oO][0-7]+$"), _based(text, 8, 3))
            .when(text.rlike(r"^0[bB][01]+$"), _based(text, 2, 1))
            .otherwise(plain)
        )
    else:
        return F.lit(0.0)
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, value).otherwise(0.0)


def _based(text: Column, base: int, bits: int) -> Column:
    """Digits of a base after a two-character mark, of any number, as the nearest double.

    The leading 60 bits and one more for "anything after them" round as the whole number would.
    """
    digits = F.regexp_replace(F.substr(text, F.lit(3)), "^0+(?=.)", "")
    lead = 60 // bits
    rest = F.substr(digits, F.lit(lead + 1))
    exact = F.conv(F.left(digits, F.lit(lead)), base, 10).try_cast("long")
    sticky = F.when(rest.rlike("[^0]"), 1).otherwise(0)
    scaled = (exact * 2 + sticky).cast("double") * F.pow(F.lit(2.0), (F.length(rest) * bits - 1).cast("double"))
    return F.when(F.length(digits) <= lead, exact.cast("double")).otherwise(scaled)


def round_point(c: Column) -> Column:
    """Two decimals, halves up (toward plus infinity), as ``floor(100 v + 1/2) / 100``."""
    scaled = c * 100
    # from 2^52 on a double holds no fraction, and the scaled value may not fit a long
    return F.when(F.abs(scaled) < 4503599627370496.0, F.floor(scaled + 0.5).cast("double") / 100).otherwise(
        scaled / 100
    )
