"""Normal against attacking addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import bytes_text, duration_text
from tracewarden.operators.profile import requests_per_minute
from tracewarden.operators.ranking import counts, ranked

COHORTS = ("normal", "attacker")


def cohorts(reputation: DataFrame) -> DataFrame:
    """Attackers are the HIGH and CRITICAL addresses, all others are normal."""
    attacker = F.col("severity").isin("HIGH", "CRITICAL")
    return reputation.select("ip", F.when(attacker, "attacker").otherwise("normal").alias("cohort"))


def cohort_counts(requests: DataFrame, cohort: DataFrame, column: str) -> DataFrame:
    """Requests per (cohort, value); counted per address first, then joined."""
    per_ip = counts(requests, ["ip"], column)
    return per_ip.join(cohort, "ip").groupBy("cohort", "value").agg(F.sum("n").alias("n"))


def cohort_profiles(profile: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row per cohort; both rows exist even when a cohort is empty."""
    rate = F.col("request_rate")
    found = (
        profile.join(cohort, "ip")
        .groupBy("cohort")
        .agg(
            F.avg("span_seconds").alias("avg_session_duration"),
            F.coalesce(F.avg(F.when(rate > 0, rate)), F.lit(0.0)).alias("avg_request_rate"),
            F.avg("total_bytes").alias("avg_bytes_per_ip"),
            F.sum("total_requests").alias("total_requests"),
            F.count("*").alias("unique_ips"),
        )
    )
    every = profile.sparkSession.createDataFrame([(c,) for c in COHORTS], "cohort string")
    return every.join(found, "cohort", "left").fillna(0)


def hourly(requests: DataFrame, cohort: DataFrame) -> DataFrame:
    return cohort_counts(requests, cohort, "hour_local").select("cohort", F.col("value").alias("hour_local"), "n")


def peak_hours(requests: DataFrame, cohort: DataFrame, k: int = 3) -> DataFrame:
    return ranked(hourly(requests, cohort), ["cohort"], [F.desc("n"), F.asc("hour_local")], k)


def top_values(requests: DataFrame, cohort: DataFrame, column: str, k: int) -> DataFrame:
    table = cohort_counts(requests, cohort, column)
    return ranked(table, ["cohort"], [F.desc("n"), F.asc("value")], k).withColumnRenamed("value", column)


def top_endpoints(requests: DataFrame, cohort: DataFrame, k: int = 10) -> DataFrame:
    return top_values(requests, cohort, "url_path", k)


def top_user_agents(requests: DataFrame, cohort: DataFrame, k: int = 5) -> DataFrame:
    return top_values(requests, cohort, "user_agent", k)


def main_endpoint(requests: DataFrame) -> DataFrame:
    """Most frequent path per address, ties to the smaller path."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "value"))["value"]
    return counts(requests, ["ip"], "url_path").groupBy("ip").agg(best.alias("top_endpoint"))


def ip_vs_normal(profile: DataFrame, requests: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every address beside the normal profile, whose one row enters as scalars."""
    normal = cohort_profiles(profile, cohort).where("cohort = 'normal'")
    busiest = top_endpoints(requests, cohort, 1).where("cohort = 'normal'")

    def scalar(df: DataFrame, name: str) -> Column:
        return df.select(name).scalar()

    rate = requests_per_minute(F.col("total_requests"), F.col("first_seen"), F.col("last_seen"), least_minutes=1)
    beside = profile.join(main_endpoint(requests), "ip", "left").select(
        "ip",
        "span_seconds",
        "total_bytes",
        rate.alias("requests_per_minute"),
        "top_endpoint",
        scalar(normal, "avg_session_duration").alias("normal_span_seconds"),
        scalar(normal, "avg_bytes_per_ip").alias("normal_bytes"),
        scalar(normal, "avg_request_rate").alias("normal_requests_per_minute"),
        scalar(busiest, "url_path").alias("normal_top_endpoint"),
    )
    # shown only when there is a normal profile to compare with
    return beside.where("normal_span_seconds <> 0").withColumns(
        {
            "span_text": duration_text("span_seconds"),
            "normal_span_text": duration_text("normal_span_seconds"),
            "bytes_text": bytes_text("total_bytes"),
            "normal_bytes_text": bytes_text("normal_bytes"),
        }
    )
