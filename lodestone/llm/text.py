"""Column expressions that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    The built-in lower() does the same on pure ASCII and is much faster there.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def null_last_key(value: Column) -> Column:
    """A non-null string that orders by code point with null last."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value.cast("string")))


def quoted(name: str) -> str:
    """A column's name as it stands in SQL, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(quoted(name))


def without_reserved(df: DataFrame, prefix: str) -> DataFrame:
    """df without the columns whose names an operator reserves for itself."""
    return df.drop(*(c for c in df.columns if c.lower().startswith(prefix)))


def all_of(df: DataFrame) -> list[Column]:
    """Every column of df."""
    return [named(c) for c in df.columns]
