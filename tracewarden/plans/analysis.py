"""The whole analysis of a request table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.functions.text import first_ip
from tracewarden.operators.detectors import evidence_counts, session_members, stored_findings
from tracewarden.operators.dims import with_network_dims
from tracewarden.operators.facts import Facts, stored_facts
from tracewarden.plans import baseline, chains, damage, reputation
from tracewarden.schema import COUNTRY_RANGES
from tracewarden.storage import Kept, materialize, materialize_by


@dataclass
class Dims:
    """Address lists to join; a missing one counts as empty."""

    tor: DataFrame | None = None
    proxies: DataFrame | None = None
    countries: DataFrame | None = None
    networks: DataFrame | None = None


@dataclass
class Result:
    """Lazy result tables over the stored facts, profile and sessions."""

    requests: DataFrame
    facts: Facts
    profile: DataFrame
    sessions: DataFrame
    members: DataFrame
    evidence_counts: DataFrame
    reputation: DataFrame
    reasons: DataFrame
    chains: DataFrame
    damage: DataFrame
    cohorts: DataFrame
    baseline: DataFrame
    kept: Kept = field(default_factory=Kept)

    def close(self) -> None:
        """Drop the tables kept for this result; its tables can't be read afterwards."""
        self.kept.close()


def attach_scores(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Score and severity of a session's first address; without one it stays 0 and LOW."""
    keyed = scores.select(F.col("ip").alias("first_ip"), "score", "severity")
    joined = sessions.withColumn("first_ip", first_ip(F.col("ip"))).join(keyed, "first_ip", "left").drop("first_ip")
    return joined.withColumns(
        {
            "score": F.coalesce("score", F.lit(0).cast("bigint")),
            "severity": F.coalesce("severity", F.lit("LOW")),
        }
    )


def enriched_sessions(
    requests: DataFrame, profile: DataFrame, scores: DataFrame, dims: Dims, cfg: Config = DEFAULT, detectors=None,
    kept: Kept | None = None, facts: Facts | None = None,
) -> DataFrame:
    """Findings of all detectors with score, severity, country, Tor and proxy."""
    spark = requests.sparkSession
    no_ips = spark.createDataFrame([], "ip string")
    return with_network_dims(
        attach_scores(stored_findings(requests, profile, cfg, detectors, kept, facts), scores),
        dims.tor if dims.tor is not None else no_ips,
        dims.proxies if dims.proxies is not None else no_ips,
        dims.countries if dims.countries is not None else spark.createDataFrame([], COUNTRY_RANGES),
        dims.networks,
    )


def analyze(requests: DataFrame, dims: Dims | None = None, cfg: Config = DEFAULT, detectors=None) -> Result:
    """All result tables of a request table.

    ``requests`` are read eight times at most (six facts, and the rows of undecided time
    slices twice), so pass a stored table (see ``sources.tables``), not a text scan. Facts,
    profile and sessions are stored once; everything behind them works on these.
    """
    kept = Kept()
    facts = stored_facts(requests, cfg, kept)
    profile = materialize_by(facts.profile(cfg), "profile", "ip", kept)
    scores = reputation.ip_reputation(profile, cfg)
    sessions = materialize(
        enriched_sessions(requests, profile, scores, dims or Dims(), cfg, detectors, kept, facts), "sessions", kept
    )
    cohort = baseline.cohorts(scores)
    return Result(
        requests=requests,
        facts=facts,
        profile=profile,
        sessions=sessions,
        members=session_members(requests, profile, cfg, facts),
        evidence_counts=evidence_counts(requests, facts),
        reputation=scores,
        reasons=reputation.score_reasons(profile, cfg),
        chains=chains.attack_chains(sessions, cfg, kept),
        damage=damage.damage(sessions, facts.paths, cfg),
        cohorts=cohort,
        baseline=baseline.cohort_profiles(profile, cohort),
        kept=kept,
    )
