"""Text columns: flight mode and coercion of raw fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_mode(mode: Column) -> Column:
    """Null -> UNKNOWN; hex modes -> OFFBOARD (0xc0) or HEX_<digits>; else upper case."""
    text = F.trim(mode)
    # The reader of raw logs drops every prefix and bracket, wherever they stand.
    digits = F.trim(F.replace(F.replace(text, F.lit("Mode(0x"), F.lit("")), F.lit(")"), F.lit("")))
    return (F.when(mode.isNull(), F.lit("UNKNOWN"))
            .when(~text.startswith("Mode(0x"), F.upper(text))
            .when(F.lower(digits).isin("c0", "0xc0"), F.lit("OFFBOARD"))
            .otherwise(F.concat(F.lit("HEX_"), F.upper(digits))))


def number(column: Column, dtype: str = "string") -> Column:
    """Lenient cast: text that is not a number becomes null, and so does NaN."""
    if dtype != "string":
        value = column.cast("double")
        return F.when(~F.isnan(value), value) if dtype in ("double", "float") else value
    text = F.trim(column)
    value = text.try_cast("double")
    # Java also reads a type letter after the digits ("1.5d"), which is no number here.
    return F.when(~F.isnan(value) & ~text.rlike("[0-9.][dDfF]$"), value)


def number_of(df: DataFrame, column: str) -> Column:
    return number(F.col(column), df.schema[column].dataType.typeName())
