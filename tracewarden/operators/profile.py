"""Per-address totals and the rhythm of requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.functions.net import is_internal_ip

_SUMS = (
    "total_requests", "total_bytes", "failed_logins", "successful_logins", "sqli_payloads", "sensitive_ok",
    "sensitive_bytes", "admin_hits", "deep_admin_hits", "bot_requests", "tor_requests", "off_hours_requests",
)


AGENT_TOTALS = """
    count(*) AS total_requests
    sum(bytes) AS total_bytes
    min(bytes) AS min_bytes
    max(bytes) AS max_bytes
    min(timestamp) AS first_seen
    max(timestamp) AS last_seen
    count_if(is_failed_login) AS failed_logins
    count_if(is_success_login) AS successful_logins
    count_if(sqli_match) AS sqli_payloads
    count_if(is_sensitive AND status = 200) AS sensitive_ok
    sum(if(is_sensitive, bytes, 0L)) AS sensitive_bytes
    count_if(is_admin) AS admin_hits
    count_if(is_deep_admin) AS deep_admin_hits
    count_if(is_bot_ua) AS bot_requests
    count_if(is_tor_ua) AS tor_requests
    count_if(is_off_hours) AS off_hours_requests
""".strip().splitlines()


def agent_profile(requests: DataFrame) -> DataFrame:
    """Totals per (address, user agent)."""
    return requests.groupBy("ip", "user_agent").agg(*[F.expr(line) for line in AGENT_TOTALS])


def merged_agents(parts: DataFrame) -> DataFrame:
    """Totals per (address, user agent) from totals of parts of the log."""
    return parts.groupBy("ip", "user_agent").agg(
        *[F.expr(f"sum({c}) AS {c}") for c in _SUMS],
        *[F.expr(f"min({c}) AS {c}") for c in ("min_bytes", "first_seen")],
        *[F.expr(f"max({c}) AS {c}") for c in ("max_bytes", "last_seen")],
    )


def ip_totals(requests: DataFrame) -> DataFrame:
    """Totals per address."""
    return totals_of_agents(agent_profile(requests))


def totals_of_agents(agents: DataFrame) -> DataFrame:
    """Totals per address, folded from the (address, agent) totals.

    The two steps give the exact number of agents and the most used one without
    holding an address's agents in memory.
    """
    return (
        agents.groupBy("ip")
        .agg(
            F.expr("min(struct(-total_requests, user_agent)).user_agent AS dominant_user_agent"),
            F.expr("count(user_agent) AS unique_user_agents"),
            *[F.expr(f"sum({c}) AS {c}") for c in _SUMS],
            *[F.expr(f"min({c}) AS {c}") for c in ("min_bytes", "first_seen")],
            *[F.expr(f"max({c}) AS {c}") for c in ("max_bytes", "last_seen")],
        )
    )


def interval_cv(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Coefficient of variation of the gaps between an address's requests.

    Null below five requests or when all share one instant. A hot address is cut
    into (address, slice) groups: rows are shuffled once, gaps inside a slice come
    from a window over them, gaps between slices from a second window over one row
    per slice. Mean gap is the span over the number of gaps, so only the squares
    have to be summed. Equal gaps give exactly zero.
    """
    return rhythm_of_slices(slice_rhythm(requests, cfg), cfg)


def instants(requests: DataFrame, cfg: Config = DEFAULT, more: Mapping[str, Column] | None = None) -> DataFrame:
    us = F.unix_micros("timestamp")
    more = [value.alias(name) for name, value in (more or {}).items()]
    return requests.select("ip", us.alias("us"), F.floor(us / (cfg.slice_seconds * 1_000_000)).alias("slice"), *more)


def slice_rhythm(requests: DataFrame, cfg: Config = DEFAULT, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Number, ends and gaps of the requests of every (address, slice), and further ``sums``."""
    inside = F.col("us") - F.lag("us").over(Window.partitionBy("ip", "slice").orderBy("us"))
    return (
        instants(requests, cfg, sums)
        .withColumn("gap", inside)
        .groupBy("ip", "slice")
        .agg(
            F.expr("count(*) AS n"),
            F.expr("min(us) AS first"),
            F.expr("max(us) AS last"),
            F.expr("min(gap) AS low"),
            F.expr("max(gap) AS high"),
            F.expr("sum(power(gap / 1e6D, 2)) AS squares"),
            *[F.sum(name).alias(name) for name in sums or {}],
        )
    )


def rhythm_of_slices(slices: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The coefficient per address from its slices."""
    between = F.col("first") - F.lag("last").over(Window.partitionBy("ip").orderBy("slice"))
    per_ip = (
        slices.withColumn("gap", between)
        .groupBy("ip")
        .agg(
            F.expr("sum(n) AS n"),
            F.expr("(max(last) - min(first)) / 1e6D AS span"),
            F.expr("least(min(low), min(gap)) AS low"),
            F.expr("greatest(max(high), max(gap)) AS high"),
            F.expr("coalesce(sum(squares), 0D) + coalesce(sum(power(gap / 1e6D, 2)), 0D) AS squares"),
        )
    )
    # the least value keeps rounding from turning unequal gaps into zero
    unequal = "sqrt(greatest((squares * (n - 1) * (n - 1) / (span * span) - (n - 1)) / (n - 2), 1e-24D))"
    return per_ip.select(
        "ip",
        F.expr(
            f"CASE WHEN n >= {cfg.rhythm_min_rows} AND span > 0 THEN "
            f"CASE WHEN low = high THEN 0D ELSE {unequal} END END AS interval_cv"
        ),
    )


def requests_per_minute(n: Column, first: Column, last: Column, least_minutes: float | None = None) -> Column:
    """Requests per minute over the span; a least span turns the zero-span rule off."""
    minutes = (F.unix_micros(last) - F.unix_micros(first)) / 1e6 / 60
    if least_minutes is not None:
        return n / F.greatest(minutes, F.lit(float(least_minutes)))
    return F.when((n >= 2) & (minutes > 0), n / minutes).otherwise(F.lit(0.0))


def span_seconds(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / 1e6


def ip_profile(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per address: totals, rhythm, request rate and internal flag."""
    return profile_of(ip_totals(requests), interval_cv(requests, cfg))


def profile_of(totals: DataFrame, rhythm: DataFrame) -> DataFrame:
    rate = requests_per_minute(F.col("total_requests"), F.col("first_seen"), F.col("last_seen"))
    return totals.join(rhythm, "ip", "left").withColumns(
        {
            "request_rate": rate,
            "span_seconds": span_seconds(F.col("first_seen"), F.col("last_seen")),
            "is_internal": is_internal_ip(F.col("ip")),
        }
    )


def bot_rhythm(cfg: Config = DEFAULT) -> Column:
    return F.coalesce(F.col("interval_cv") < cfg.rhythm_cv, F.lit(False)) & (
        F.col("total_requests") >= cfg.rhythm_min_requests
    )
