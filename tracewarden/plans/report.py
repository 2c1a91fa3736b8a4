"""Report tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import duration_hms
from tracewarden.plans import chains as chain_plans
from tracewarden.plans.explore import by_score

_MARK = "✓"
_SESSION_FIELDS = (
    "attack_type", "ip", "start_time", "end_time", "duration_seconds", "request_count", "total_bytes", "layer",
    "is_internal", "mitre_id", "evidence", "score", "severity", "country", "via_tor", "via_proxy",
    "ip_rotation_detected", "coordinated", "shared_user_agent",
)


def report_table(sessions: DataFrame) -> DataFrame:
    """The seventeen report columns, unordered."""
    mark = lambda c: F.when(F.col(c), _MARK).otherwise("")
    return sessions.select(
        "attack_type",
        "severity",
        "score",
        "ip",
        "country",
        mark("via_tor").alias("tor"),
        mark("ip_rotation_detected").alias("ip_rotation"),
        mark("coordinated").alias("coordination"),
        F.col("is_internal").alias("internal"),
        F.col("start_time").alias("start"),
        F.col("end_time").alias("end"),
        F.col("duration_seconds").cast("bigint").alias("duration_s"),
        duration_hms("duration_seconds").alias("duration"),
        F.col("request_count").alias("requests"),
        F.col("total_bytes").alias("bytes"),
        "layer",
        F.col("mitre_id").alias("mitre"),
    )


def narrative(sessions: DataFrame) -> DataFrame:
    """One line per session plus its place in the arrow chain.

    ``arrow_step`` holds the session's part of the chain ``a (09:00) -> b (09:05)``;
    the chain is kept as rows because it grows with the sessions.
    """
    clock = lambda pattern: F.date_format("start_time", pattern)
    mb = F.col("total_bytes") / (1024 * 1024)
    volume = F.when(mb >= 1, F.format_string(" | %.1f MB", F.bround(mb, 1))).otherwise("")
    country = F.when(F.col("country").isin("Unknown", ""), "").otherwise(F.format_string(" [%s]", "country"))
    # Fixed output format of a narrative line.
    line = F.concat(
        F.format_string(
            "  [%s] %-40s | %-32s | %d reqs", clock("HH:mm:ss"), F.col("attack_type"), F.col("ip"), "request_count"
        ),
        volume,
        F.when(F.col("via_tor"), " [TOR]").otherwise(""),
        F.when(F.col("ip_rotation_detected"), " [IP ROTATION]").otherwise(""),
        country,
    )
    step = F.format_string("%s (%s)", F.col("attack_type"), clock("HH:mm"))
    return sessions.select("start_time", "detector_order", "ip", line.alias("line"), step.alias("arrow_step"))


def narrative_text(sessions: DataFrame) -> DataFrame:
    """The narrative as ordered lines of text: heading, sessions, then the chain, one step a line."""
    rows = narrative(sessions)
    spark = sessions.sparkSession
    order = ["start_time", "detector_order", "ip"]
    heading = spark.createDataFrame(
        [(0, "=" * 70), (1, "  ATTACK CHAIN"), (2, "=" * 70), (4, ""), (5, "  Chain:")], "part int, value string"
    )
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in order}
    lines = rows.select(F.lit(3).alias("part"), *order, F.col("line").alias("value"))
    steps = rows.select(F.lit(6).alias("part"), *order, F.concat(F.lit("  -> "), "arrow_step").alias("value"))
    everything = heading.withColumns(nothing).unionByName(lines).unionByName(steps)
    return everything.orderBy("part", *order).select("value")


def write_report(result, folder: str, table_format: str = "parquet", mode: str = "errorifexists") -> dict[str, str]:
    """Write all tables, one folder each; returns name -> path.

    Sessions also go out as CSV (without byte-order mark) and JSON lines, reputation
    as CSV, chains and damage as JSON lines, the narrative as text.
    """
    sessions = result.sessions
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame, fmt: str, **options) -> None:
        paths[name] = f"{folder}/{name}"
        if fmt in ("csv", "json"):
            options["timestampFormat"] = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # without it, milliseconds are all that is written
        df.write.mode(mode).format(fmt).options(**options).save(paths[name])

    ordered = report_table(sessions).orderBy(F.desc("score"), "start", "attack_type", "ip")
    save("attacks_csv", ordered, "csv", header=True)
    save("attacks_json", by_score(sessions).select(*_SESSION_FIELDS), "json", ignoreNullFields=False)
    ranked = result.reputation.orderBy(F.desc("score"), "ip")
    save("ip_reputation_csv", ranked.withColumn("breakdown", F.to_json("breakdown")), "csv", header=True)
    save("attack_chains_json", chain_plans.by_importance(result.chains), "json")
    save("economic_damage_json", result.damage, "json")
    save("narrative_text", narrative_text(sessions), "text")
    for name in ("sessions", "members", "evidence_counts", "reputation", "reasons", "chains", "damage", "baseline"):
        save(name, getattr(result, name), table_format)
    return paths


def write_rejects(rejects: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    rejects.write.mode(mode).parquet(folder)

