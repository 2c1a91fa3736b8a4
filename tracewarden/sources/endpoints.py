"""Endpoint categories: the built-in paths and what a site adds to them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.config import ENDPOINT_CATEGORIES
from tracewarden.schema import ENDPOINTS


def default_endpoints(spark: SparkSession) -> DataFrame:
    rows = [(c, p, i) for c, paths in ENDPOINT_CATEGORIES.items() for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "category string, path string, position int")


def read_custom_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of category to list of paths; missing or malformed gives no rows."""
    schema = ", ".join(f"{c} array<string>" for c in ENDPOINT_CATEGORIES)
    try:
        stored = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENDPOINTS)
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("paths")) for c in ENDPOINT_CATEGORIES])
    return stored.select(F.inline(entries)).select("category", F.explode("paths").alias("path")).where("path IS NOT NULL")


def merged_endpoints(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Defaults and additions without repeats; ``origin`` tells them apart."""
    both = defaults.select("category", "path", F.lit("default").alias("origin")).unionByName(
        custom.select("category", "path", F.lit("custom").alias("origin"))
    )
    # "default" sorts after "custom", so max keeps it when a path is in both
    return both.groupBy("category", "path").agg(F.max("origin").alias("origin"))


def custom_from_changes(changes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Custom paths left after an append-only log of ``add`` and ``remove`` rows.

    A path must start with ``/`` after trimming; default paths can be neither added
    nor removed; the latest change of a path wins.
    """
    valid = (
        changes.withColumn("path", F.trim("path"))
        .where(F.col("path").startswith("/") & F.col("category").isin(*ENDPOINT_CATEGORIES))
        .where(F.col("change").isin("add", "remove"))
        .join(defaults.select("category", "path"), ["category", "path"], "left_anti")
    )
    # on equal times "remove" wins over "add"
    latest = valid.groupBy("category", "path").agg(F.max(F.struct("set_at", "change")).alias("last"))
    return latest.where("last.change = 'add'").select("category", "path", F.col("last.set_at").alias("set_at"))
