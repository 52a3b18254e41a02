"""Python's view of values as Spark columns: truth, text form, white space, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that Python's strip() removes, as a Java character class.
BLANKS = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANKS}+|{BLANKS}+\z", "")


def truthy(value: Column, kind: T.DataType) -> Column:
    """Python's bool() of a value of the given type; null is false."""
    if isinstance(kind, T.BooleanType):
        found = value
    elif isinstance(kind, T.NumericType):
        found = value != 0
    elif isinstance(kind, T.StringType):
        found = value != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        found = F.size(value) > 0
    elif isinstance(kind, T.NullType):
        found = F.lit(False)
    else:
        found = value.isNotNull()
    return F.coalesce(found, F.lit(False))


def text(value: Column, kind: T.DataType) -> Column:
    """Python's str() for null, booleans, whole and ordinary fractional numbers; others as Spark casts them."""
    if isinstance(kind, T.StringType):
        shown = value
    elif isinstance(kind, T.BooleanType):
        shown = F.when(value, "True").otherwise("False")
        shown = F.when(value.isNotNull(), shown)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        shown = F.to_json(value)
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("None"))


def number(value: Column) -> Column:
    """float() of a string: underscores between digits allowed, null where Python raises."""
    trimmed = F.regexp_replace(strip(value), r"(?<=\d)_(?=\d)", "")
    usable = trimmed.rlike(r"(?i)\A[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\z")
    return F.when(usable, trimmed.try_cast("double"))


def floored_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
