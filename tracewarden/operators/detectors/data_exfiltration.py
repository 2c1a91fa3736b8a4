"""Bulk downloads of one address from export endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, basic_totals, join_on
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.ranking import as_list
from tracewarden.operators.trailing import trailing_hits

ATTACK_TYPE = "data_exfiltration"


def download_bursts(downloads: DataFrame, cfg: Config = DEFAULT, slices: DataFrame | None = None) -> DataFrame:
    """Addresses with a trailing window of enough bytes and downloads; ``slices`` are the facts', if at hand."""

    def enough(totals):
        return (totals["volume"] >= cfg.burst_exfil_bytes) & (totals["requests"] >= cfg.burst_exfil_requests)

    return trailing_hits(
        downloads,
        "ip",
        {"volume": F.col("bytes"), "requests": F.lit(1).cast("bigint")},
        cfg.burst_seconds,
        cfg.slice_seconds,
        hit=enough,
        surely=lambda low, high: enough(low),
        possibly=lambda low, high: enough(high),
        slices=slices,
    )


def is_download() -> Column:
    return F.col("is_exfil_target") & (F.col("status") == 200)


def downloads_of(requests: DataFrame) -> DataFrame:
    return requests.where(is_download())


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    facts = facts or lazy_facts(requests, cfg)
    totals = facts.kind("is_download").groupBy("ip").agg(*basic_totals(F.max("max_bytes").alias("max_single_response_bytes")))
    bursts = download_bursts(downloads_of(requests), cfg, facts.stored_slices).withColumn("burst", F.lit(True))
    volume, n = F.col("total_bytes"), F.col("request_count")
    layer = (
        F.when(F.col("burst"), "L1_burst")
        .when((volume >= cfg.session_exfil_bytes) & (n >= cfg.session_exfil_requests), "L2_session")
        .when(volume >= cfg.long_exfil_bytes, "L3_long_term")
    )
    flagged = totals.join(bursts, "ip", "left").withColumn("layer", layer).where("layer IS NOT NULL")
    found = join_on(
        "ip",
        flagged,
        as_list(facts.samples.where(F.col("attack_type") == ATTACK_TYPE), ["ip"], 5, "sample_payloads"),
    )
    evidence = F.struct(
        "max_single_response_bytes",
        F.expr("total_bytes div request_count").alias("avg_response_bytes"),
        F.expr(f"total_bytes div {cfg.record_bytes}").alias("estimated_records"),
        "sample_payloads",
    )
    return as_sessions(found.withColumn("evidence", evidence), ATTACK_TYPE, cfg)
