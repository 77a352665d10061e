"""Text forms of values as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def general(c: Column) -> Column:
    """A double with six significant digits, in the shorter of fixed and scientific notation ("%g" of C)."""
    sci = F.format_string("%.5e", c)
    sign = F.when(sci.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.substring_index(sci, "e", 1), r"[-.]", "")
    exp = F.substring_index(sci, "e", -1).try_cast("int")
    fixed = F.when(exp >= 0, F.concat(F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
    short = F.regexp_replace(fixed, r"\.?0+$", "")
    mantissa = F.regexp_replace(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))), r"\.?0+$", "")
    power = F.concat(F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    power = F.when(F.abs(exp) > 99, F.concat(F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(exp).cast("string"))).otherwise(power)
    body = F.when(exp.between(-4, 5), short).otherwise(F.concat(mantissa, power))
    return F.when(c.isNull(), F.lit(None)).when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).when(c == 0, F.lit("0")).otherwise(F.concat(sign, body))


def iso(c: Column) -> Column:
    """A timestamp in UTC with the fraction trimmed."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)), F.lit("Z"))


def as_text(c: Column, kind: str) -> Column:
    """kind: bool, int, float, string, date or timestamp."""
    if kind == "float":
        return general(c)
    if kind == "timestamp":
        return iso(c)
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")
