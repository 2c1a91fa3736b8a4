"""Helpers shared by the training-text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Regular expression of the blanks that separate words.
BLANKS = "[\\x20\\x09-\\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local run may go without; it
    gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_REMEMBERED: dict[object, object] = {}


def remembered(key: object, make: Callable[[], T]) -> T:
    """What ``make`` makes, kept in this Python worker until another key is asked for.

    Workers are used again by later stages, so a worker holds the tables of one operator, not of all.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def free_prefix(*tables: DataFrame) -> str:
    """Underscores that no column of the tables begins with: names that helpers may take."""
    names, prefix = [c for t in tables for c in t.columns], "_"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row (from 0) in the given order, as column ``name``.

    Rows are range-partitioned and sorted where they are; only the number of rows of each
    partition goes through the driver. The result is checkpointed, so places stay the same.
    """
    placed = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    rows, starts = 0, []
    for found in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((found["part"], rows))
        rows += found["count"]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_at")
    )
