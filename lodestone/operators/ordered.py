"""Insertion-order semantics on unordered tables: every rule orders by an explicit seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Lines of a long text that are joined before its blocks are.
LINES_A_BLOCK = 1024


def first_per(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row with the smallest order of each key; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(df.columns)


def last_value_first_place(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of each key the last row's values at the first row's place, as a dictionary would keep it."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    g = df.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(*keys, order, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(df.columns)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Catalyst turns rank <= n into a limit per group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def joined_lines(df: DataFrame, keys: list[str], line: Column, order: list[str], sep: str = "\n") -> DataFrame:
    """One text per key: its lines in order. Column text."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return g.select(*keys, F.array_join(F.transform("_l", lambda x: x["_line"]), sep).alias("text"))


def long_text(df: DataFrame, keys: list[str], line: Column, order: list[str], sep: str = "\n") -> DataFrame:
    """joined_lines for texts of any number of lines: a sort that spills places them, blocks of them are joined, then the blocks.

    Only a block's lines, and a key's blocks as text, are held as objects.
    """
    lines = df.select(*keys, F.struct(*order).alias("_o"), line.alias("_line"))
    at = F.row_number().over(W.partitionBy(*keys).orderBy("_o", "_line"))
    lines = lines.select(*keys, at.alias("_at"), "_line").withColumn("_b", F.expr(f"_at div {LINES_A_BLOCK}"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["_line"]), sep)
    blocks = lines.groupBy(*keys, "_b").agg(F.collect_list(F.struct("_at", "_line")).alias("_l"), F.count("_line").alias("_n"))
    # A block of nulls only adds no separator.
    blocks = blocks.select(*keys, F.struct("_b", F.when(F.col("_n") > 0, text(F.col("_l"))).alias("_line")).alias("_t"))
    return blocks.groupBy(*keys).agg(F.collect_list("_t").alias("_l")).select(*keys, text(F.col("_l")).alias("text"))
