"""The registered queries: every operator over the log derived from the given tables.

Results are plain columns: lists and maps as joined text, times without zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import files, fixture, streams
from tracewarden.config import DEFAULT, ENDPOINT_CATEGORIES
from tracewarden.functions import net, text
from tracewarden.operators import dims, profile
from tracewarden.operators.detectors import (
    DETECTORS,
    credential_stuffing,
    data_exfiltration,
    distributed_login,
    evidence_counts,
    fingerprint,
    session_members,
)
from tracewarden.operators.enrich import path_flags
from tracewarden.operators.failed_logins import failures_per_client
from tracewarden.operators.facts import Facts, stored_facts
from tracewarden.plans import actions, analysis, baseline, chains, damage, explore, report, reputation
from tracewarden.sources import access_log, endpoints
from tracewarden.storage import materialize, materialize_by

Query = Callable[[SparkSession, str], DataFrame]
SUSPECT = "103.44.55.66"


def plain(df: DataFrame) -> DataFrame:
    """Times without zone, doubles to six places."""
    out = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            out[field.name] = F.col(field.name).cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            out[field.name] = F.round(field.name, 6)
    return df.withColumns(out) if out else df


def joined(items: str | Column) -> Column:
    return F.array_join(items, ", ")


def map_text(pairs: str) -> Column:
    return joined(F.transform(F.map_entries(pairs), lambda e: F.format_string("%s=%d", e["key"], e["value"])))


def _utc(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(query(spark, folder))

    return run


class _Tables:
    """The derived tables of one run; each is built at its first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def lines(self) -> DataFrame:
        return self._once("lines", lambda: fixture.log_lines(self.spark, self.folder))

    @property
    def requests(self) -> DataFrame:
        return self._once("requests", lambda: fixture.requests(self.spark, self.folder))

    @property
    def stored(self) -> DataFrame:
        """Requests as a stored table, for plans that read them many times."""
        return self._once("stored", lambda: materialize(self.requests, "requests"))

    @property
    def profile(self) -> DataFrame:
        return self._once("profile", lambda: profile.ip_profile(self.requests))

    @property
    def scores(self) -> DataFrame:
        return self._once("scores", lambda: reputation.ip_reputation(self.profile))

    @property
    def cohort(self) -> DataFrame:
        return self._once("cohort", lambda: baseline.cohorts(self.stored_scores))

    @property
    def facts(self) -> Facts:
        return self._once("facts", lambda: stored_facts(self.stored))

    @property
    def stored_profile(self) -> DataFrame:
        return self._once("stored_profile", lambda: materialize_by(self.facts.profile(), "profile", "ip"))

    @property
    def stored_scores(self) -> DataFrame:
        return self._once("stored_scores", lambda: reputation.ip_reputation(self.stored_profile))

    @property
    def dims(self) -> analysis.Dims:
        return analysis.Dims(
            fixture.tor(self.spark), fixture.proxy_list(self.spark), fixture.country_ranges(self.spark)
        )

    @property
    def sessions(self) -> DataFrame:
        return self._once(
            "sessions",
            lambda: materialize(
                analysis.enriched_sessions(self.stored, self.stored_profile, self.stored_scores, self.dims, facts=self.facts),
                "sessions",
            ),
        )

    @property
    def members(self) -> DataFrame:
        return self._once("members", lambda: session_members(self.stored, self.stored_profile, facts=self.facts))

    @property
    def chains(self) -> DataFrame:
        return self._once("chains", lambda: chains.attack_chains(self.sessions))

    @property
    def action_log(self) -> DataFrame:
        """One log row per request: the address, an action by turns, the request's time."""
        return self.requests.selectExpr(
            "ip",
            "array('watchlist', 'ignore', 'block', 'clear', 'shrug')[int(lineno div 12 % 5)] AS action",
            "concat('note ', lineno) AS note",
            "timestamp AS set_at",
        )

    @property
    def endpoint_changes(self) -> DataFrame:
        """One change per event: a path by user, some invalid, added or removed by turns."""
        names = ", ".join(f"'{c}'" for c in ENDPOINT_CATEGORIES)
        return fixture.events(self.spark, self.folder).selectExpr(
            f"array({names})[int(user_id % {len(ENDPOINT_CATEGORIES)})] AS category",
            "CASE WHEN event_id % 11 = 0 THEN '/api/export' WHEN event_id % 13 = 0 THEN concat('custom/', user_id) "
            "ELSE concat(' /custom/', user_id) END AS path",
            "if(event_id % 3 = 0, 'remove', 'add') AS change",
            "ts AS set_at",
        )


# ---------------------------------------------------------------- parsing

def parse_log(t: _Tables) -> DataFrame:
    return access_log.parse_lines(t.lines)


def parse_rejects(t: _Tables) -> DataFrame:
    return access_log.parse_rejects(t.lines)


def parse_enrich(t: _Tables) -> DataFrame:
    """From text lines to the request table, and its flags summed per address."""
    from tracewarden.operators.enrich import enrich

    rows = enrich(access_log.parse_lines(t.lines))
    return rows.groupBy("ip").agg(
        F.count("*").alias("requests"),
        F.count_if("is_failed_login").alias("failed_logins"),
        F.count_if("sqli_match").alias("sqli"),
        F.count_if("is_exfil_target").alias("exfil_hits"),
        F.sum("bytes").alias("bytes"),
        F.max("timestamp").alias("last_seen"),
    )


def enrich_flags(t: _Tables) -> DataFrame:
    return t.requests.select(
        "lineno", "timestamp", "timestamp_local", "ip", "method", "url_path", "url_query", "status", "bytes",
        "is_sensitive", "is_admin", "is_deep_admin", "is_transaction", "is_exfil_target", "is_login",
        "is_failed_login", "is_success_login", "is_bot_ua", "is_tor_ua", "hour_local", "is_off_hours",
    )


def url_decode_flags(t: _Tables) -> DataFrame:
    return t.requests.select("lineno", "url_full", "url_decoded", "sqli_match")


def endpoint_join_flags(t: _Tables) -> DataFrame:
    """Flags of paths from an endpoint table: a join, whatever its size."""
    custom = endpoints.custom_from_changes(t.endpoint_changes, endpoints.default_endpoints(t.spark))
    table = endpoints.merged_endpoints(endpoints.default_endpoints(t.spark), custom)
    return path_flags(t.requests, table)


def ip_flags(t: _Tables) -> DataFrame:
    ip = F.col("ip")
    return t.requests.select("ip").distinct().select(
        "ip", net.is_valid_ip(ip).alias("is_valid"), net.is_internal_ip(ip).alias("is_internal"),
        net.ipv4_number(ip).alias("ip_number"),
    )


# ---------------------------------------------------------------- profiles and scores

def ip_profile(t: _Tables) -> DataFrame:
    return t.profile


def iat_cv(t: _Tables) -> DataFrame:
    return profile.interval_cv(t.requests)


def ip_reputation(t: _Tables) -> DataFrame:
    names = F.array_sort(F.map_keys("breakdown"))
    parts = F.transform(names, lambda n: F.format_string("%s=%d", n, F.try_element_at("breakdown", n)))
    return t.scores.withColumn("breakdown", joined(parts))


def score_reasons(t: _Tables) -> DataFrame:
    return reputation.score_reasons(t.profile)


def top_reputation(t: _Tables) -> DataFrame:
    return reputation.by_score(t.scores.drop("breakdown")).limit(15)


# ---------------------------------------------------------------- detectors

def _flat(name: str, t: _Tables, lists=(), maps=()) -> DataFrame:
    found = DETECTORS[name](t.requests, t.profile, DEFAULT)
    fields = found.schema["evidence"].dataType.fieldNames()
    taken = [f for f in fields if f not in found.columns]
    flat = found.select(*[c for c in found.columns if c != "evidence"], *[f"evidence.{f}" for f in taken])
    return flat.withColumns({**{c: joined(c) for c in lists}, **{c: map_text(c) for c in maps}})


def det_credential_stuffing(t: _Tables) -> DataFrame:
    return _flat("credential_stuffing", t)


def det_distributed_login(t: _Tables) -> DataFrame:
    return _flat("distributed_credential_stuffing", t)


def det_sql_injection(t: _Tables) -> DataFrame:
    return _flat("sql_injection", t, lists=["sample_payloads", "user_agents"])


def det_data_exfiltration(t: _Tables) -> DataFrame:
    return _flat("data_exfiltration", t, lists=["sample_payloads"])


def det_anonymizer(t: _Tables) -> DataFrame:
    return _flat("anonymizer", t, lists=["signals"], maps=["user_agents", "endpoints_targeted"])


def det_admin_recon(t: _Tables) -> DataFrame:
    return _flat("admin_recon", t, lists=["user_agents"])


def det_fingerprint(t: _Tables) -> DataFrame:
    return _flat("distributed_fingerprint", t, lists=["common_endpoints"])


def login_bursts(t: _Tables) -> DataFrame:
    return credential_stuffing.login_bursts(t.requests.where("is_login"))


def download_bursts(t: _Tables) -> DataFrame:
    return data_exfiltration.download_bursts(data_exfiltration.downloads_of(t.requests))


def login_buckets(t: _Tables) -> DataFrame:
    clients = failures_per_client(t.requests)
    return distributed_login.flagged_buckets(clients)


def ip_fingerprints(t: _Tables) -> DataFrame:
    prints = fingerprint.fingerprints(t.requests, t.profile)
    return prints.withColumn("common_endpoints", joined("common_endpoints"))


def members(t: _Tables) -> DataFrame:
    return t.members


def evidence_paths(t: _Tables) -> DataFrame:
    return evidence_counts(t.requests)


# ---------------------------------------------------------------- sessions and dimensions

def _session_columns(df: DataFrame) -> DataFrame:
    return df.drop("evidence", "detector_order")


def sessions_enriched(t: _Tables) -> DataFrame:
    return _session_columns(t.sessions)


def detector_subset(t: _Tables) -> DataFrame:
    """Two detectors chosen by name, as a caller of the library would."""
    from tracewarden.operators.detectors import detect_all

    chosen = {name: DETECTORS[name] for name in ("sql_injection", "admin_recon")}
    found = detect_all(t.requests, t.profile, DEFAULT, chosen)
    return found.select("attack_type", "ip", "request_count", "layer")


def geo_range_join(t: _Tables) -> DataFrame:
    return dims.countries(t.requests, fixture.country_ranges(t.spark))


def tor_proxy_flags(t: _Tables) -> DataFrame:
    ips = t.requests.select("ip").distinct()
    return dims.network_flags(ips, fixture.tor(t.spark), fixture.proxy_list(t.spark))


# ---------------------------------------------------------------- chains, damage, baseline

def _chain_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("stage_types", joined("stage_types")).drop("steps")


def chains_single_ip(t: _Tables) -> DataFrame:
    return _chain_columns(chains.single_ip_chains(t.sessions))


def campaigns(t: _Tables) -> DataFrame:
    return _chain_columns(chains.campaigns(t.sessions))


def chain_steps(t: _Tables) -> DataFrame:
    steps = t.chains.select("chain_type", F.col("ip").alias("chain_ip"), joined("stage_types").alias("stage_types"),
                            F.posexplode("steps").alias("position", "step"))
    return steps.select("chain_type", "chain_ip", "stage_types", "position", "step.*")


def chains_by_importance(t: _Tables) -> DataFrame:
    return _chain_columns(chains.by_importance(t.chains).limit(5))


def chains_with_ip(t: _Tables) -> DataFrame:
    return _chain_columns(chains.chains_with_ip(t.chains, SUSPECT)).select("chain_type", "ip", "stage_types")


def damage_estimate(t: _Tables) -> DataFrame:
    return damage.damage(t.sessions, t.facts.paths)


def baseline_profile(t: _Tables) -> DataFrame:
    return baseline.cohort_profiles(t.stored_profile, t.cohort)


def cohort_hours(t: _Tables) -> DataFrame:
    return baseline.hourly(t.stored, t.cohort)


def peak_hours(t: _Tables) -> DataFrame:
    return baseline.peak_hours(t.stored, t.cohort)


def top_endpoints(t: _Tables) -> DataFrame:
    return baseline.top_endpoints(t.facts.paths, t.cohort)


def top_user_agents(t: _Tables) -> DataFrame:
    return baseline.top_user_agents(t.stored, t.cohort)


def ip_vs_normal(t: _Tables) -> DataFrame:
    return baseline.ip_vs_normal(t.stored_profile, t.facts.paths, t.cohort)


# ---------------------------------------------------------------- exploration and reports

def hourly_activity(t: _Tables) -> DataFrame:
    return explore.hourly_activity(t.requests)


def hourly_per_ip(t: _Tables) -> DataFrame:
    return explore.hourly_per_ip(t.requests)


def status_distribution(t: _Tables) -> DataFrame:
    return explore.status_per_ip(t.requests)


def top_paths_per_ip(t: _Tables) -> DataFrame:
    return explore.top_paths_per_ip(t.requests)


def top_agents_per_ip(t: _Tables) -> DataFrame:
    return explore.top_agents_per_ip(t.requests)


def top_ips(t: _Tables) -> DataFrame:
    return explore.top_ips(t.profile)


def top_sessions(t: _Tables) -> DataFrame:
    top = explore.top_sessions(t.sessions)
    return top.select("attack_type", "ip", "score", "severity", "request_count", "total_bytes")


def filtered_sessions(t: _Tables) -> DataFrame:
    kept = explore.filter_sessions(
        t.sessions, severities=["CRITICAL", "HIGH"], duration="long", internal=False, anonymizer=True
    )
    return kept.select("attack_type", "ip", "severity", "duration_seconds")


def headline(t: _Tables) -> DataFrame:
    money = damage.damage(t.sessions, t.facts.paths)
    return explore.headline(t.stored_profile, t.sessions, t.chains, money)


def layer_agreement(t: _Tables) -> DataFrame:
    return explore.layer_agreement(t.sessions, t.members)


def mitre_per_ip(t: _Tables) -> DataFrame:
    return explore.mitre_per_ip(t.sessions, t.members).withColumn("mitre_ids", joined("mitre_ids"))


def sessions_with_ip(t: _Tables) -> DataFrame:
    return explore.sessions_with_ip(t.sessions, t.members, "45.142.0.3").select("attack_type", "ip", "start_time")


def timeline(t: _Tables) -> DataFrame:
    return explore.timeline(t.sessions)


def narrative(t: _Tables) -> DataFrame:
    return report.narrative(t.sessions).drop("detector_order")


def report_table(t: _Tables) -> DataFrame:
    return report.report_table(t.sessions)


def attack_table(t: _Tables) -> DataFrame:
    current = actions.current_actions(t.action_log)
    shown = explore.attack_table(t.sessions, evidence_counts(t.stored, t.facts), current)
    return shown.select("attack_type", "ip", "anonymizer", "duration", "volume", "endpoints", "payload", "action")


def ip_actions_current(t: _Tables) -> DataFrame:
    return actions.current_actions(t.action_log)


def ips_with_action(t: _Tables) -> DataFrame:
    return actions.ips_with_action(t.requests.select("ip").distinct(), t.action_log, "block")


def endpoints_merged(t: _Tables) -> DataFrame:
    defaults = endpoints.default_endpoints(t.spark)
    return endpoints.merged_endpoints(defaults, endpoints.custom_from_changes(t.endpoint_changes, defaults))


def format_texts(t: _Tables) -> DataFrame:
    """Sizes and spans of every address in words."""
    return t.profile.select(
        "ip",
        text.bytes_text("total_bytes").alias("volume"),
        text.duration_text("span_seconds").alias("span"),
        text.duration_hms("span_seconds").alias("span_hms"),
        text.severity(F.col("total_requests")).alias("tier"),
        text.severity_rank(text.severity(F.col("total_requests"))).alias("tier_rank"),
    )


QUERIES = (
    parse_log, parse_rejects, parse_enrich, enrich_flags, url_decode_flags, endpoint_join_flags, ip_flags,
    ip_profile, iat_cv, ip_reputation, score_reasons, top_reputation,
    det_credential_stuffing, det_distributed_login, det_sql_injection, det_data_exfiltration, det_anonymizer,
    det_admin_recon, det_fingerprint, login_bursts, download_bursts, login_buckets, ip_fingerprints, members,
    evidence_paths, sessions_enriched, detector_subset, geo_range_join, tor_proxy_flags,
    chains_single_ip, campaigns, chain_steps, chains_by_importance, chains_with_ip, damage_estimate,
    baseline_profile, cohort_hours, peak_hours, top_endpoints, top_user_agents, ip_vs_normal,
    hourly_activity, hourly_per_ip, status_distribution, top_paths_per_ip, top_agents_per_ip, top_ips, top_sessions,
    filtered_sessions, headline, layer_agreement, mitre_per_ip, sessions_with_ip, timeline, narrative, report_table,
    attack_table, ip_actions_current, ips_with_action, endpoints_merged, format_texts,
)


def _over_tables(query: Callable[[_Tables], DataFrame]) -> Query:
    return _utc(lambda spark, folder: query(_Tables(spark, folder)))


def all_queries() -> dict[str, Query]:
    batch = {q.__name__: _over_tables(q) for q in QUERIES}
    return {**batch, **{q.__name__: _utc(q) for q in (*files.QUERIES, *streams.QUERIES)}}
