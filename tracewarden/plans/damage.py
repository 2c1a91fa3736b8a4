"""Estimated damage in money."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config


def suspicious_transactions(sessions: DataFrame, paths: DataFrame) -> DataFrame:
    """Successful transactions of addresses with a HIGH or CRITICAL single-address session.

    ``paths`` are the facts' counts per (address, path), so the join moves one row per
    address however many requests an address made.
    """
    count_of = lambda path: F.sum(F.when(F.col("url_path") == path, F.col("n_transactions")).otherwise(0))
    per_ip = (
        paths.where("n_transactions > 0")
        .groupBy("ip")
        .agg(
            F.sum("n_transactions").alias("transactions"),
            count_of("/api/transfer").alias("transfers"),
            count_of("/api/payment").alias("payments"),
        )
    )
    suspects = sessions.where(F.col("severity").isin("HIGH", "CRITICAL") & (F.col("ip_count") == 1)).select("ip")
    return per_ip.join(suspects, "ip", "left_semi")


def damage(sessions: DataFrame, paths: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of totals. Versioned API transfers count as suspicious but carry no amount."""
    stolen = sessions.where("attack_type = 'data_exfiltration'").select(
        F.col("total_bytes").alias("exfil_bytes"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("transactions", "transfers", "payments")],
    )
    moved = suspicious_transactions(sessions, paths).select(
        F.lit(0).cast("bigint").alias("exfil_bytes"), "transactions", "transfers", "payments"
    )
    sums = stolen.unionByName(moved).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exfil_bytes", "transactions", "transfers", "payments")]
    )
    records = F.col("estimated_records")
    direct = F.col("dark_market_loss_usd") + F.col("compliance_fine_usd")
    extra = (direct * (cfg.total_multiplier - 1)).cast("bigint")
    return (
        sums.withColumn("estimated_records", F.expr(f"exfil_bytes div {cfg.record_bytes}"))
        .withColumns(
            {
                "exfil_mb": F.bround(F.col("exfil_bytes") / 1_000_000, 2),
                "dark_market_loss_usd": records * cfg.record_usd,
                "compliance_fine_usd": records * cfg.fine_usd,
                "fraud_potential_usd": F.col("transfers") * cfg.transfer_usd + F.col("payments") * cfg.payment_usd,
            }
        )
        .withColumn("reputation_loss_usd", extra)
        .withColumn("total_loss_usd", direct + F.col("reputation_loss_usd") + F.col("fraud_potential_usd"))
        .select(
            "estimated_records", "exfil_bytes", "exfil_mb", "dark_market_loss_usd", "compliance_fine_usd",
            "reputation_loss_usd", "fraud_potential_usd", F.col("transactions").alias("suspicious_transfers"),
            "total_loss_usd", (F.col("total_loss_usd") * cfg.uzs_per_usd).alias("total_loss_uzs"),
        )
    )
