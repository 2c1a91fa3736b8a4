"""The stored request table: one folder per UTC day, in each day sorted by address.

Rows of a day are dealt by a hash of the address before they are written; adaptive execution
splits what is too large for a file (a huge day, an address with much of it) and joins what
is small, so there are few files of like size, whatever the days are like. Within a file rows are in order
of address and time, row groups are small, and a bloom filter tells which addresses a row
group holds. A look-up of some addresses so reads a few row groups of each file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the addresses of a day are dealt into; a small day has at most so many files.
DAY_PARTS = 16
#: Rows of a group are some hundred bytes each, so a group has about a hundred thousand.
ROW_GROUP_BYTES = 16 << 20
#: Up to so many addresses are told to the scan as a list; more are joined.
LISTED_ADDRESSES = 1000


def store_requests(
    requests: DataFrame, path: str, mode: str = "errorifexists", row_group_bytes: int = ROW_GROUP_BYTES, parts: int = DAY_PARTS
) -> None:
    """Write requests as parquet, one folder per UTC day, so day ranges prune files and addresses prune row groups.

    In mode ``overwrite`` only the days that occur in ``requests`` are replaced.
    """
    day = F.date_from_unix_date(F.floor(F.unix_seconds("timestamp") / 86400).cast("int"))
    dealt = requests.withColumns({"day": day, "part": F.pmod(F.xxhash64("ip"), F.lit(parts))}).hint("rebalance", "day", "part")
    (
        dealt.drop("part")
        .sortWithinPartitions("day", "ip", "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#ip", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("day")
        .parquet(path)
    )


def load_requests(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if first_day is not None:
        table = table.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        table = table.where(F.col("day") <= F.lit(last_day).cast("date"))
    return table


def among(column: str, addresses: Sequence[str]) -> Column:
    """Whether an address is one of a few, as a test that scans take over.

    It is put together from equalities: a list in one test would, when longer than a
    setting of the session allows, reach the scan as a range from the least to the greatest.
    """
    tests = [F.col(column) == a for a in sorted(set(addresses))] or [F.lit(False)]
    while len(tests) > 1:  # as a balanced tree
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def of_addresses(table: DataFrame, addresses: DataFrame | Sequence[str], column: str = "ip") -> DataFrame:
    """The rows of some addresses: a few are looked up, a table (or long list) of them is joined."""
    if not isinstance(addresses, DataFrame):
        if len(addresses) <= LISTED_ADDRESSES:
            return table.where(among(column, addresses))
        addresses = table.sparkSession.createDataFrame([(a,) for a in addresses], "ip string")
    wanted = addresses.select(F.col("ip").alias(column)).distinct()
    return table.join(wanted, column, "left_semi")
