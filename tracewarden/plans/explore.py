"""Questions asked of the result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import bytes_text, duration_text, first_ip, severity_rank
from tracewarden.operators.ranking import counts, listed, ranked
from tracewarden.sources.tables import of_addresses

ORDERED_KEYS = ("attack_type", "ip")


def filter_sessions(
    sessions: DataFrame,
    severities=None,
    attack_types=None,
    duration: str = "all",
    internal: bool = True,
    anonymizer: bool = False,
) -> DataFrame:
    """Sessions by severity, type, length (``short`` is under ten minutes) and the two toggles.

    The anonymizer toggle decides alone about anonymizer sessions, whatever types are chosen.
    """
    if duration not in ("all", "short", "long"):
        raise ValueError(f"unknown duration filter: {duration}")
    is_anonymizer = F.col("attack_type") == "anonymizer"
    keep = F.lit(True) if anonymizer else ~is_anonymizer
    if severities is not None:
        keep = keep & F.col("severity").isin(*severities)
    if attack_types is not None:
        keep = keep & (is_anonymizer | F.col("attack_type").isin(*attack_types))
    if duration == "short":
        keep = keep & (F.col("duration_seconds") < 600)
    elif duration == "long":
        keep = keep & (F.col("duration_seconds") >= 600)
    if not internal:
        keep = keep & ~F.col("is_internal")
    return sessions.where(keep)


def by_score(sessions: DataFrame) -> DataFrame:
    """Highest score first, then start; type and address make the order total."""
    return sessions.orderBy(F.desc("score"), "start_time", *ORDERED_KEYS)


def top_sessions(sessions: DataFrame, k: int = 15) -> DataFrame:
    return by_score(sessions).limit(k)


def top_ips(profile: DataFrame, k: int = 15) -> DataFrame:
    """Addresses by volume, with the volume in words."""
    top = profile.select("ip", F.col("total_requests").alias("requests"), F.col("total_bytes").alias("bytes"))
    return top.orderBy(F.desc("bytes"), "ip").limit(k).withColumn("volume", bytes_text("bytes"))


def headline(profile: DataFrame, sessions: DataFrame, chains: DataFrame, damage: DataFrame) -> DataFrame:
    """One row of totals. Anonymizer sessions repeat other sessions' bytes and do not count."""
    parts = [
        profile.agg(F.sum("total_requests").alias("total_requests"), F.count("*").alias("unique_ips")),
        sessions.agg(
            F.count("*").alias("sessions"),
            F.sum(F.when(F.col("attack_type") != "anonymizer", F.col("total_bytes"))).alias("stolen_bytes"),
        ),
        chains.agg(F.count("*").alias("chains")),
        damage.select("estimated_records"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def hourly_activity(requests: DataFrame) -> DataFrame:
    return requests.groupBy("hour_local").agg(F.count("*").alias("n"))


def hourly_per_ip(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip", "hour_local").agg(F.count("*").alias("n"))


def status_per_ip(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip", "status").agg(F.count("*").alias("n"))


def top_paths_per_ip(requests: DataFrame, k: int = 10) -> DataFrame:
    top = ranked(counts(requests, ["ip"], "url_path"), ["ip"], [F.desc("n"), F.asc("value")], k)
    return top.withColumnRenamed("value", "url_path")


def top_agents_per_ip(requests: DataFrame, k: int = 5) -> DataFrame:
    top = ranked(counts(requests, ["ip"], "user_agent"), ["ip"], [F.desc("n"), F.asc("value")], k)
    return top.withColumnRenamed("value", "user_agent")


def timeline(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "ip", F.col("start_time").alias("start"), F.col("end_time").alias("finish"), "attack_type", "severity"
    )


def session_ips(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """(attack_type, session_key, ip): every address of every session, one per row."""
    single = sessions.where("ip_count = 1").select("attack_type", "session_key", "ip")
    return single.unionByName(members.select("attack_type", "session_key", "ip"))


def sessions_with_ip(sessions: DataFrame, members: DataFrame, ip: str) -> DataFrame:
    """Sessions an address takes part in, at any place of a joint session."""
    own = of_addresses(session_ips(sessions, members), [ip]).select("attack_type", "session_key").distinct()
    return sessions.join(own, ["attack_type", "session_key"], "left_semi")


def mitre_per_ip(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """Technique ids of every address, sorted; there are only as many as attack types."""
    techniques = sessions.select("attack_type", "session_key", "mitre_id")
    return (
        session_ips(sessions, members)
        .join(techniques, ["attack_type", "session_key"])
        .select("ip", "mitre_id")
        .distinct()
        .groupBy("ip")
        .agg(F.array_sort(F.collect_list("mitre_id")).alias("mitre_ids"))
    )


def layer_agreement(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """Number of different layers that flag an address; two or more mean high confidence."""
    layers = sessions.select("attack_type", "session_key", "layer")
    return (
        session_ips(sessions, members)
        .join(layers, ["attack_type", "session_key"])
        .select("ip", "layer")
        .distinct()
        .groupBy("ip")
        .agg(F.count("*").alias("layers"))
        .withColumn("high_confidence", F.col("layers") >= 2)
    )


def _paths_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda s: F.format_string("%s (%d)", s["path"], -s["minus_n"])), "  |  ")


def top_evidence(evidence: DataFrame) -> DataFrame:
    """The three most hit paths of every (attack_type, ip) as text, from ``evidence_counts``."""
    shown = evidence.where(F.col("attack_type").isin("sql_injection", "data_exfiltration"))
    top = ranked(shown, ["attack_type", "ip"], [F.desc("n"), F.asc("url_path")], 3)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), F.col("url_path").alias("path"))))
    return top.groupBy("attack_type", "ip").agg(_paths_text(pairs).alias("top_paths"))


def session_endpoints(evidence: Column) -> Column:
    """The three most hit paths of a session whose evidence lists its top paths, as text."""
    hits = F.from_json(F.get_json_object(evidence, "$.endpoints_targeted"), "map<string,bigint>")
    ordered = F.array_sort(
        F.transform(F.map_entries(hits), lambda e: F.struct((-e["value"]).alias("minus_n"), e["key"].alias("path")))
    )
    return F.coalesce(_paths_text(F.slice(ordered, 1, 3)), F.lit(""))


def first_payload(evidence: Column, length: int = 80) -> Column:
    """Start of the first sample payload, for a table cell."""
    samples = F.from_json(F.get_json_object(evidence, "$.sample_payloads"), "array<string>")
    return F.coalesce(F.substring(F.get(samples, F.lit(0)), 1, length), F.lit(""))


def attack_table(sessions: DataFrame, evidence: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Sessions as an analyst reads them, with the action set on the first address.

    ``evidence`` are the path counts behind the sessions.
    """
    spark = sessions.sparkSession
    known = actions if actions is not None else spark.createDataFrame([], "ip string, action string")
    keyed = known.select(F.col("ip").alias("first_ip"), "action")
    shown = sessions.withColumn("first_ip", first_ip(F.col("ip"))).join(keyed, "first_ip", "left")
    shown = shown.join(top_evidence(evidence), ["attack_type", "ip"], "left")
    return shown.select(
        "severity", "score", "attack_type", "ip", "country",
        F.when(F.col("via_tor"), "TOR").when(F.col("via_proxy"), "Proxy").otherwise("").alias("anonymizer"),
        "ip_rotation_detected", "is_internal", "start_time", "end_time",
        duration_text("duration_seconds").alias("duration"),
        F.col("request_count").alias("requests"),
        bytes_text("total_bytes").alias("volume"),
        F.coalesce("top_paths", session_endpoints(F.col("evidence"))).alias("endpoints"),
        first_payload(F.col("evidence")).alias("payload"),
        F.coalesce("action", F.lit("")).alias("action"),
    )


def ip_detail(result, ips: DataFrame | Sequence[str]) -> dict[str, DataFrame]:
    """Everything known about some addresses, as one table per kind of answer.

    ``ips`` is a list of addresses or a table with a column ``ip``. A short list is a test that
    the scans take over: buckets of the facts and row groups of the requests are skipped by it.
    """
    only = lambda df: of_addresses(df, ips)
    requests = only(result.requests)
    part_of = session_ips(result.sessions, result.members)
    theirs = only(part_of).withColumnRenamed("ip", "detail_ip")
    in_chain = of_addresses(
        result.chains.withColumn("detail_ip", F.explode(F.array_distinct(F.transform("steps", lambda s: s["ip"])))), ips, "detail_ip"
    )
    # the first chain in order of importance is the one shown for an address
    order = [F.desc(severity_rank(F.col("max_severity"))), F.desc("stages_count"), F.asc("first_seen"),
             F.asc("chain_type"), F.asc("ip")]
    return {
        "totals": only(result.profile),
        "reputation": only(result.reputation),
        "sessions": result.sessions.join(theirs, ["attack_type", "session_key"]),
        "chain": ranked(in_chain, ["detail_ip"], order, 1).drop("rank"),
        "reasons": only(result.reasons),
        "paths": top_paths_per_ip(only(result.facts.paths)),
        "agents": top_agents_per_ip(only(result.facts.agents).withColumnRenamed("total_requests", "n")),
        "statuses": status_per_ip(requests),
        "hours": hourly_per_ip(requests),
        "mitre": only(mitre_per_ip(result.sessions, result.members)),
    }


def listed_paths_per_ip(requests: DataFrame, k: int = 10) -> DataFrame:
    """Top paths of every address as one text, most frequent first."""
    table = counts(requests, ["ip"], "url_path")
    text = F.format_string("%s=%d", "value", "n")
    lists = listed(table, ["ip"], [F.desc("n"), F.asc("value")], k, text, "paths")
    return lists.select("ip", F.array_join("paths", ", ").alias("paths"))
