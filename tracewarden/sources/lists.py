"""Address lists and country ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.schema import COUNTRY_RANGES


def _content(lines: DataFrame) -> DataFrame:
    text = F.trim(F.make_valid_utf8("value"))
    return lines.select(text.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def tor_exits(lines: DataFrame) -> DataFrame:
    """One address per line, ``#`` comments."""
    return _content(lines).select(F.col("value").alias("ip")).distinct()


def proxies(lines: DataFrame) -> DataFrame:
    """``IP:PORT`` per line; the port is dropped."""
    ip = F.trim(F.substring_index("value", ":", 1))
    return _content(lines).select(ip.alias("ip")).where("ip <> ''").distinct()


def _text_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _read_present(spark: SparkSession, paths) -> DataFrame:
    found = [df for df in (_text_or_none(spark, p) for p in paths) if df is not None]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "value string")


def read_tor_exits(spark: SparkSession, path: str) -> DataFrame:
    return tor_exits(_read_present(spark, [path]))


def read_proxies(spark: SparkSession, paths) -> DataFrame:
    """Several feeds as one list; feeds that do not exist are skipped."""
    return proxies(_read_present(spark, paths))


def read_country_ranges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(ip_from, ip_to, country)`` rows; the ranges must not overlap."""
    reader = spark.read.schema(COUNTRY_RANGES)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def read_networks(spark: SparkSession, path) -> DataFrame:
    """``network, country`` from lines ``network,country``; networks are prefixes, ``first-last`` or single addresses.

    Blank lines and lines that begin with ``#`` are skipped. What can't be read as a network is
    kept here and listed by ``dims.unreadable_networks``.
    """
    line = F.trim("value")
    lines = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return lines.select(
        F.trim(F.substring_index(line, ",", 1)).alias("network"), F.trim(F.regexp_extract(line, ",(.*)$", 1)).alias("country")
    )
