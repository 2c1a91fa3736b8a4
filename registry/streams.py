"""Registered streaming queries: the derived log as a stream, worked off to its end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import fixture
from registry.files import new_folder
from tracewarden.streaming import bursts, logins, recompute, source, tables

DELAY = "31 days"  # the derived times are not in file order, and nothing may be late


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Through text lines, so the stream is parsed as an arriving log is."""
    lines = fixture.lines_of(fixture.requests_of(_event_stream(spark, folder))).select("value")
    return source.stream_requests(lines)


def _new_folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def stream_parse(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_folder(spark)

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(batch, f"{out}/requests", batch_id)

    tables.start(_requests(spark, folder), f"{out}/checkpoint", store, "append", None).awaitTermination()
    rows = tables.read_batches(spark, f"{out}/requests")
    return rows.groupBy("ip").agg(
        F.count("*").alias("requests"),
        F.count_if("is_failed_login").alias("failed_logins"),
        F.count_if("sqli_match").alias("sqli"),
        F.count_if("is_exfil_target").alias("exfil_hits"),
        F.sum("bytes").alias("bytes"),
        F.max("timestamp").alias("last_seen"),
    )


def stream_distributed_login(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_folder(spark)
    query = logins.follow(_requests(spark, folder), f"{out}/clients", f"{out}/checkpoint", delay=DELAY, refresh_seconds=None)
    query.awaitTermination()
    found = logins.alerts(spark, f"{out}/clients")
    return found.select(
        "ip", "ip_count", "start_time", "end_time", "request_count", "total_bytes", "coordinated", "shared_user_agent"
    )


def stream_recompute(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_folder(spark)
    delay = int(dt.timedelta(days=31).total_seconds())
    query = recompute.follow(_requests(spark, folder), out, f"{out}/checkpoint", refresh_seconds=None, delay_seconds=delay)
    query.awaitTermination()
    return recompute.current_scores(spark, out).drop("breakdown")


#: Hours of the log at which a new part begins. Bursts lie across some of them.
PART_HOURS = (9.5, 10.5, 13.2, 14.5, 24)


def _log_folder(spark: SparkSession, folder: str, out: str, files: int) -> str:
    """The derived log as text in six parts in order of time, each mixed in itself, then a file with the end of the log.

    A part is written by as many tasks as it has files. Each file has a comment of its own, so none is left out for
    want of lines, and ``files`` files at a time are one part.
    """
    rows = fixture.raw_requests(spark, folder)
    hour = (F.unix_seconds("timestamp") - int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())) / 3600
    number = sum((F.when(hour >= h, 1).otherwise(0) for h in PART_HOURS), F.lit(0))
    for part in range(len(PART_HOURS) + 1):
        lines = fixture.lines_of(rows.where(number == part)).select("value", F.xxhash64("lineno", "value").alias("place"))
        comments = spark.range(files).select(F.format_string("# file %d", "id").alias("value"), F.col("id").alias("place"))
        dealt = lines.union(comments).repartitionById(files, F.pmod("place", F.lit(files)).cast("int"))
        dealt.sortWithinPartitions("place").select("value").write.mode("append").text(f"{out}/log")
    end = bursts.END_OF_LOG.format(dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc))
    spark.createDataFrame([(end,)], "value string").coalesce(1).write.mode("append").text(f"{out}/log")
    return f"{out}/log"


def _alerted(spark: SparkSession, folder: str, alerts_of) -> DataFrame:
    """Alerts with their second and sums while the log arrives part by part, ten minutes of delay allowed."""
    out, files = _new_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(batch, f"{out}/alerts", batch_id)

    lines = source.stream_lines(spark, _log_folder(spark, folder, out, files), files_per_batch=files).select("value")
    with bursts.rocksdb_state(spark):
        query = tables.start(alerts_of(source.stream_requests(lines), delay="10 minutes"), f"{out}/checkpoint", store, "append", None)
    query.awaitTermination()
    return tables.read_batches(spark, f"{out}/alerts").select("ip", "second", "first_sum", "second_sum")


def stream_burst(spark: SparkSession, folder: str) -> DataFrame:
    return _alerted(spark, folder, bursts.download_burst_stream)


def stream_login_burst(spark: SparkSession, folder: str) -> DataFrame:
    return _alerted(spark, folder, bursts.login_burst_stream)


QUERIES = (stream_parse, stream_distributed_login, stream_burst, stream_login_burst, stream_recompute)
