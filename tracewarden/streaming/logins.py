"""Live alerts on distributed logins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators import failed_logins
from tracewarden.operators.detectors import distributed_login
from tracewarden.streaming import tables
from tracewarden.streaming.source import watched

_KEYS = ("bucket", "ip", "user_agent")


def client_stream(requests: DataFrame, cfg: Config = DEFAULT, delay: str = "10 minutes") -> DataFrame:
    """Running failures per (bucket, address, agent).

    State is keyed finer than any hot bucket or address and is dropped once the
    watermark passes the bucket. Rows later than that are ignored here.
    """
    failed = watched(requests, delay, failed_logins.is_failure(cfg))
    window = F.window("timestamp", f"{cfg.distributed_window_seconds} seconds")
    return (
        failed.groupBy(window.alias("window"), "ip", "user_agent")
        .agg(*failed_logins.client_totals())
        .select(F.col("window.start").alias("bucket"), "ip", "user_agent", "failures", "bytes", "seen")
    )


def follow(
    requests: DataFrame, folder: str, checkpoint: str, cfg: Config = DEFAULT, delay: str = "10 minutes",
    refresh_seconds: int | None = 5,
):
    """Keep the running sums in ``folder``. Changed sums go out with every batch,
    so a bucket raises its alert as soon as it is over the limit."""

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_updates(batch, folder, batch_id, _KEYS)

    return tables.start(client_stream(requests, cfg, delay), checkpoint, store, "update", refresh_seconds)


def alerts(spark: SparkSession, folder: str, cfg: Config = DEFAULT) -> DataFrame:
    """Sessions as of the last batch, by the rules of the batch detector."""
    return distributed_login.sessions_of(tables.latest(tables.read_batches(spark, folder), _KEYS), cfg)
