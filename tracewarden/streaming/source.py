"""Log text as it arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.enrich import enrich
from tracewarden.sources.access_log import parse_lines


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files that show up in a folder."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.make_valid_utf8("value").alias("value")
    )


def stream_requests(lines: DataFrame, endpoints=None, cfg: Config = DEFAULT) -> DataFrame:
    """Parsed and enriched requests: the same columns and code as over stored text.

    Streams number no lines; ``lineno`` is null and ties in time stay open.
    """
    return enrich(parse_lines(lines), endpoints, cfg)


def watched(requests: DataFrame, delay: str, condition: Column) -> DataFrame:
    """Rows that meet a condition, under a watermark that all rows move forward.

    Spark moves filters below the watermark unless they name the event time; then
    only matching rows would move time on, and the last alert of an attack would
    wait for the next attack. No request is older than year one, so the added
    alternative keeps no row.
    """
    never = F.col("timestamp") < F.lit("0001-01-02").cast("timestamp")
    return requests.withWatermark("timestamp", delay).where(condition | never)
