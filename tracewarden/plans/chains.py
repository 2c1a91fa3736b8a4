"""Attack chains of one address and campaigns over several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.functions.sql import quoted
from tracewarden.functions.text import severity_rank
from tracewarden.operators.nearest import next_point
from tracewarden.operators.profile import span_seconds
from tracewarden.storage import Kept, materialize

CHAIN_COLUMNS = (
    "chain_type", "ip", "stages_count", "stage_types", "is_internal", "first_seen", "last_seen", "total_duration",
    "total_requests", "total_bytes", "max_severity", "critical_combo", "steps",
)

_STAGE = (
    "start_time", "detector_order", "ip", "attack_type", "end_time", "duration_seconds", "request_count",
    "total_bytes", "mitre_id", "severity", "is_internal",
)


def single_ip_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("ip_count = 1")


def critical_combo(types: Column) -> Column:
    """Exfiltration together with injection, stuffing or reconnaissance."""
    has = lambda t: F.array_contains(types, t)
    return has("data_exfiltration") & (has("sql_injection") | has("credential_stuffing") | has("admin_recon"))


def chain_steps(stages: Column) -> Column:
    return F.transform(
        stages,
        lambda s: F.struct(
            s["attack_type"].alias("stage"),
            s["ip"].alias("ip"),
            s["start_time"].alias("start"),
            s["end_time"].alias("end"),
            s["duration_seconds"].alias("duration"),
            s["request_count"].alias("requests"),
            s["total_bytes"].alias("bytes"),
            s["mitre_id"].alias("mitre"),
        ),
    )


def _worst(stages: Column) -> Column:
    rank = lambda s: severity_rank(s["severity"])
    worst = F.array_max(F.transform(stages, lambda s: F.struct(rank(s).alias("r"), s["severity"].alias("severity"))))
    return worst["severity"]


def _described(df: DataFrame, stages: Column) -> DataFrame:
    """Columns every chain derives from its ordered stages.

    The last time is the end of the last-started stage, which need not be the
    latest end.
    """
    total = lambda name: F.aggregate(
        stages, F.lit(0).cast("bigint"), lambda acc, s: acc + s[name]
    )
    return df.withColumns(
        {
            "first_seen": stages[0]["start_time"],
            "last_seen": F.element_at(stages, -1)["end_time"],
            "total_requests": total("request_count"),
            "total_bytes": total("total_bytes"),
            "max_severity": _worst(stages),
            "steps": chain_steps(stages),
        }
    ).withColumn("total_duration", span_seconds(F.col("first_seen"), F.col("last_seen")))


def single_ip_chains(sessions: DataFrame) -> DataFrame:
    """Addresses with at least two kinds of attack.

    An address has at most one session per detector here, so the list per address
    is as short as the list of detectors.
    """
    per_ip = single_ip_sessions(sessions).groupBy("ip").agg(
        F.array_sort(F.collect_list(F.struct(*_STAGE))).alias("stages")
    )
    types = F.array_sort(F.array_distinct(F.transform("stages", lambda s: s["attack_type"])))
    stages = F.col("stages")
    chains = _described(per_ip.withColumn("stage_types", types).where(F.size("stage_types") >= 2), stages)
    return chains.withColumns(
        {
            "chain_type": F.lit("single_ip"),
            "stages_count": F.size("stage_types"),
            "is_internal": stages[0]["is_internal"],
            "critical_combo": critical_combo(F.col("stage_types")),
        }
    ).select(*CHAIN_COLUMNS)


def next_stages(sessions: DataFrame, pairs, cfg: Config = DEFAULT) -> DataFrame:
    """For each session and each type that may follow it, the earliest such session.

    It must start within the gap after the session's end; equal starts go to the
    smaller address. The look-up runs over distinct times, so sessions ending or
    starting together cost one entry, and no two sessions are ever paired to be
    filtered later.
    """
    single = single_ip_sessions(sessions)
    follows: dict[str, list[str]] = {}
    for kind, after in sorted(set(pairs)):
        follows.setdefault(kind, []).append(after)
    cases = " ".join(
        f"WHEN {quoted(kind)} THEN array({', '.join(map(quoted, after))})" for kind, after in follows.items()
    )
    probes = single.select(*_STAGE).distinct().select(
        F.struct(*_STAGE).alias("stage"),
        F.unix_micros("end_time").alias("at"),
        F.explode(F.expr(f"CASE attack_type {cases} END")).alias("next_type"),
    )
    points = (
        single.groupBy(F.col("attack_type").alias("next_type"), F.unix_micros("start_time").alias("at"))
        .agg(F.min(F.struct("ip", F.struct(*_STAGE).alias("stage"))).alias("first"))
        .select("next_type", "at", F.col("first.stage").alias("payload"))
    )
    found = next_point(
        probes.select("next_type", "at").distinct(),
        points,
        "next_type",
        cfg.campaign_gap_seconds * 1_000_000,
        cfg.slice_seconds * 1_000_000,
    )
    return probes.join(found, ["next_type", "at"]).select(
        F.col("stage").alias("from_stage"),
        "next_type",
        F.col("payload").alias("next_stage"),
    )


def campaigns(sessions: DataFrame, cfg: Config = DEFAULT, kept: Kept | None = None) -> DataFrame:
    """Sequences of attacks, each starting within the gap after the previous one ended.

    Every first session greedily takes the earliest next stage; incomplete
    sequences are dropped. The addresses may differ or be the same.
    """
    sequences = list(dict.fromkeys(tuple(s) for s in cfg.campaign_sequences if len(s) > 1))
    pairs = [pair for s in sequences for pair in zip(s, s[1:])]
    hops = materialize(next_stages(sessions, pairs, cfg), "next-stages", kept)
    # The few sequences are part of the plan: nothing is joined to lay them out.
    table = ", ".join(f"array({', '.join(map(quoted, s))})" for s in sequences)
    starting = F.expr(f"filter(array({table}), kinds -> kinds[0] = attack_type)")
    paths = single_ip_sessions(sessions).select(
        F.array(F.struct(*_STAGE)).alias("stages"), F.explode(starting).alias("kinds")
    )
    complete = []
    for length in range(1, max(map(len, sequences))):
        last = F.element_at("stages", -1)
        paths = (
            paths.where(F.size("kinds") > length)
            .withColumns(
                {"from_stage": last, "next_type": F.col("kinds")[length]}
            )
            .join(hops, ["from_stage", "next_type"])
            .select("kinds", F.concat("stages", F.array("next_stage")).alias("stages"))
        )
        complete.append(paths.where(F.size("kinds") == length + 1))
    stages = F.col("stages")
    found = _described(reduce(DataFrame.unionByName, complete), stages)
    return found.withColumns(
        {
            "chain_type": F.lit("multi_ip_campaign"),
            "ip": F.array_join(F.transform(stages, lambda s: s["ip"]), " → "),
            "stages_count": F.size(stages),
            "stage_types": F.transform(stages, lambda s: s["attack_type"]),
            "is_internal": F.lit(False),
            "critical_combo": F.lit(True),
        }
    ).select(*CHAIN_COLUMNS)


def attack_chains(sessions: DataFrame, cfg: Config = DEFAULT, kept: Kept | None = None) -> DataFrame:
    single = single_ip_chains(sessions)
    if not any(len(s) > 1 for s in cfg.campaign_sequences):
        return single
    return single.unionByName(campaigns(sessions, cfg, kept))


def by_importance(chains: DataFrame) -> DataFrame:
    """Severity, then stages; the rest makes the order total."""
    return chains.orderBy(
        F.desc(severity_rank(F.col("max_severity"))), F.desc("stages_count"), "first_seen", "chain_type", "ip"
    )


def chains_with_ip(chains: DataFrame, ip: str) -> DataFrame:
    return chains.where((F.col("ip") == ip) | F.exists("steps", lambda s: s["ip"] == ip))
