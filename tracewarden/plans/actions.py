"""Actions analysts set on addresses, kept as an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.config import IP_ACTIONS
from tracewarden.functions.text import first_ip

ACTION_COLUMNS = ("ip", "action", "note", "set_at")
CLEAR = "clear"


def action_rows(spark: SparkSession, changes) -> DataFrame:
    """Log rows for ``(ip, action, note)`` entries, stamped with the current time."""
    for _, action, _ in changes:
        if action not in (*IP_ACTIONS, CLEAR):
            raise ValueError(f"unknown action: {action}")
    rows = spark.createDataFrame(list(changes), "ip string, action string, note string")
    return rows.withColumn("set_at", F.current_timestamp())


def append_actions(changes: DataFrame, path: str) -> None:
    changes.select(*ACTION_COLUMNS).write.mode("append").parquet(path)


def current_actions(log: DataFrame) -> DataFrame:
    """Latest action per address; a cleared address has none. Unknown actions are ignored."""
    valid = log.where(F.col("action").isin(*IP_ACTIONS, CLEAR))
    last = valid.groupBy("ip").agg(F.max(F.struct("set_at", "action", "note")).alias("last"))
    return last.where(F.col("last.action") != CLEAR).select("ip", "last.action", "last.note", "last.set_at")


def ips_with_action(ips: DataFrame, log: DataFrame, action: str) -> DataFrame:
    return ips.join(current_actions(log).where(F.col("action") == action), "ip", "left_semi")


def sessions_with_actions(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions with the current action of their first address, null without one."""
    now = current_actions(log).select(F.col("ip").alias("first_ip"), "action")
    return sessions.withColumn("first_ip", first_ip(F.col("ip"))).join(now, "first_ip", "left").drop("first_ip")
