"""Failed logins of external addresses by five-minute bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.functions.net import is_internal_ip


def is_failure(cfg: Config = DEFAULT) -> Column:
    return (
        (F.col("method") == "POST")
        & F.lower("url_path").contains("/login")
        & F.col("status").isin(*cfg.distributed_fail_statuses)
        & ~is_internal_ip(F.col("ip"))
    )


def bucket_start(cfg: Config = DEFAULT):
    """Epoch-aligned start of the bucket."""
    seconds = cfg.distributed_window_seconds
    return F.timestamp_seconds(F.floor(F.unix_micros("timestamp") / (seconds * 1_000_000)) * seconds)


def client_totals():
    return [
        F.count("*").alias("failures"),
        F.sum("bytes").alias("bytes"),
        F.min(F.struct("timestamp", "lineno")).alias("seen"),
    ]


def failures_per_client(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Failures per (bucket, address, agent): all later steps start from these sums."""
    return requests.where(is_failure(cfg)).groupBy(bucket_start(cfg).alias("bucket"), "ip", "user_agent").agg(*client_totals())
