"""Top-k and samples per group.

The k sits directly above the window as ``row_number() <= k``, so Spark cuts every map
task's share to k rows per group before the shuffle (up to its limit of a thousand) and a
hot group never moves into one task as a whole. All callers pass a handful; what may be
long, such as the members of a session, is a table of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group in a total order."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def listed(df: DataFrame, keys, order, k: int, value, name: str) -> DataFrame:
    """The first ``k`` values of every group as an array in that order."""
    return as_list(ranked(df.withColumn("value", value), keys, order, k), keys, k, name)


def as_list(ranked_values: DataFrame, keys, k: int, name: str) -> DataFrame:
    """Ranked values (``rank``, ``value``) as arrays of the first ``k``."""
    items = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("value"))))
    first = ranked_values.where(F.col("rank") <= k)
    return first.groupBy(*keys).agg(F.transform(items, lambda s: s["value"]).alias(name))


def counts(rows: DataFrame, keys, column: str) -> DataFrame:
    """How often every value occurs in every group, in long form (``value``, ``n``).

    Rows that are counted already say in ``n`` how many they stand for.
    """
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.groupBy(*keys, F.col(column).alias("value")).agg(n.alias("n"))


def top_counts(rows: DataFrame, keys, column: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values of every group as a map value -> count.

    Ties go to the smaller value.
    """
    pairs = listed(
        counts(rows, keys, column).withColumnRenamed("value", "item"),
        keys, [F.desc("n"), F.asc("item")], k, F.struct("item", "n"), "pairs",
    )
    return pairs.select(*keys, F.map_from_entries("pairs").alias(name))


def first_values(rows: DataFrame, keys, column: str, k: int, name: str) -> DataFrame:
    """The first ``k`` rows' values of every group in time order."""
    picked = rows.select(*keys, column, "timestamp", "lineno")
    return listed(picked, keys, [F.asc("timestamp"), F.asc("lineno")], k, F.col(column), name)


def first_distinct(rows: DataFrame, keys, column: str, k: int, name: str) -> DataFrame:
    """The first ``k`` different values of every group in the order they show up."""
    return listed(first_seen(rows, keys, column), keys, [F.asc("seen")], k, F.col(column), name)


def first_seen(rows: DataFrame, keys, column: str) -> DataFrame:
    """The different values of every group with time and line of their first row."""
    return rows.groupBy(*keys, column).agg(F.min(F.struct("timestamp", "lineno")).alias("seen"))
