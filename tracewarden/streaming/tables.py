"""Tables that micro-batches write.

Every batch owns one folder and overwrites it, so a batch that runs again after a
failure leaves no second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def write_updates(batch: DataFrame, folder: str, batch_id: int, keys, every: int = 64) -> None:
    """Write changed rows; every so many batches, first fold all earlier batches into the newest row per key.

    The folded table takes the place of the last of them before the others go, so a
    failure at any point leaves either the old batches or the folded table, ``latest`` gives
    the same rows, and a batch that runs again finds what was there before it.
    """
    if batch_id and batch_id % every == 0:
        fold(batch.sparkSession, folder, batch_id - 1, keys)
    write_batch(batch, folder, batch_id)


def fold(spark: SparkSession, folder: str, last: int, keys) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    place, made = at(f"{folder}/batch_id={last}"), f"{folder}/_folded-{last}"
    done = read_batches(spark, folder).where(F.col("batch_id") <= last)
    latest(done, keys).write.mode("overwrite").parquet(made)
    files.delete(place, True)
    files.rename(at(made), place)
    for entry in files.listStatus(at(folder)):
        name = entry.getPath().getName()
        if name.startswith("batch_id=") and int(name.partition("=")[2]) < last:
            files.delete(entry.getPath(), True)


def before(spark: SparkSession, folder: str, batch_id: int, keys) -> DataFrame | None:
    """The newest row per key as it was before a batch; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return latest(read_batches(spark, folder).where(F.col("batch_id") < batch_id), keys)


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def latest(table: DataFrame, keys) -> DataFrame:
    """The last written row per key."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")


def start(stream: DataFrame, checkpoint: str, handle, mode: str, refresh_seconds: int | None = 5):
    """Start a query that hands every batch to ``handle(batch, batch_id)``.

    ``refresh_seconds`` None works off what is there and stops; else a batch runs
    every so many seconds, one to thirty.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    if refresh_seconds is None:
        return writer.trigger(availableNow=True).start()
    if not 1 <= refresh_seconds <= 30:
        raise ValueError("refresh_seconds must be 1 to 30")
    return writer.trigger(processingTime=f"{refresh_seconds} seconds").start()
