"""The detectors, in the order their findings are listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors import (
    admin_recon,
    anonymizer,
    credential_stuffing,
    data_exfiltration,
    distributed_login,
    fingerprint,
    sql_injection,
)
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.storage import Kept, materialize_parts

DETECTORS = {
    module.ATTACK_TYPE: module.detect
    for module in (
        credential_stuffing, distributed_login, sql_injection, data_exfiltration, anonymizer, admin_recon, fingerprint
    )
}

BUILT_IN = frozenset(DETECTORS.values())

MEMBER_TABLES = {module.ATTACK_TYPE: module.members for module in (distributed_login, fingerprint)}


def findings(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, detectors=None, facts: Facts | None = None):
    """Makers of the chosen detectors' findings, the evidence as JSON.

    ``detectors`` is a mapping of name to function; a subset or additional
    functions ``(requests, profile, cfg) -> sessions`` can be passed. The built-in ones
    work on ``facts`` and read requests only where these leave a question open.
    ``detector_order`` keeps the order the findings are listed in.
    """

    def maker(order: int, detect):
        more = {"facts": facts} if detect in BUILT_IN else {}
        return lambda: detect(requests, profile, cfg, **more).withColumns(
            {"evidence": F.to_json("evidence", {"ignoreNullFields": "false"}), "detector_order": F.lit(order)}
        )

    chosen = DETECTORS if detectors is None else detectors
    return [maker(i, detect) for i, detect in enumerate(chosen.values())]


def detect_all(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, detectors=None) -> DataFrame:
    """Findings of the chosen detectors as one lazy table."""
    made = [make() for make in findings(requests, profile, cfg, detectors)]
    return reduce(DataFrame.unionByName, made) if made else no_findings(requests, profile, cfg)


def no_findings(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """An empty table of findings: what no chosen detector finds."""
    schema = findings(requests, profile, cfg)[0]().schema
    return requests.sparkSession.createDataFrame([], schema)


def stored_findings(
    requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, detectors=None, kept: Kept | None = None,
    facts: Facts | None = None,
) -> DataFrame:
    """The same table, each detector run as its own job and stored."""
    makers = findings(requests, profile, cfg, detectors, facts)
    if not makers:
        return no_findings(requests, profile, cfg)
    return materialize_parts(requests.sparkSession, makers, "findings", kept)


def session_members(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    """All addresses of the sessions that tie several together (attack_type, session_key, ip, seen)."""
    return reduce(DataFrame.unionByName, [of(requests, profile, cfg, facts) for of in MEMBER_TABLES.values()])


def evidence_counts(requests: DataFrame, facts: Facts | None = None) -> DataFrame:
    """All path counts behind the detectors' evidence, one row per path."""
    of = {sql_injection.ATTACK_TYPE: "n_sqli", data_exfiltration.ATTACK_TYPE: "n_downloads", admin_recon.ATTACK_TYPE: "n_admin"}
    kinds = [F.when(F.col(n) > 0, F.struct(F.lit(name).alias("attack_type"), F.col(n).alias("n"))) for name, n in of.items()]
    paths = (facts or lazy_facts(requests)).paths
    found = paths.select("ip", "url_path", F.inline(F.array_compact(F.array(*kinds))))
    return found.select("attack_type", "ip", "url_path", "n")
