"""What several detectors and reports need of the requests, worked out once.

Each table is one pass over the requests. Totals, paths and time slices are kept bucketed by
address, so that grouping or joining them by address later moves nothing. Everything
is counted before it is moved: an address with a third of all requests has as many rows here
as it has agents, paths or minutes.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.failed_logins import failures_per_client
from tracewarden.operators.profile import AGENT_TOTALS, merged_agents, profile_of, rhythm_of_slices, slice_rhythm, totals_of_agents
from tracewarden.operators.ranking import first_seen, ranked
from tracewarden.storage import Kept, materialize, materialize_by

#: Kinds of requests that detectors count apart; a request can be of several.
KINDS = ("is_login", "sqli_match", "is_download", "is_admin")
LONGEST_LIST = 5


def with_download(requests: DataFrame) -> DataFrame:
    return requests.withColumn("is_download", F.coalesce(F.expr("is_exfil_target AND status = 200"), F.lit(False)))


def agent_facts(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Totals per (address, user agent, kinds)."""
    totals = [F.expr(line) for line in AGENT_TOTALS]
    more = [
        F.expr("count_if(status = 200) AS ok_responses"),
        F.count_if(F.col("status").isin(*cfg.recon_success_statuses)).alias("recon_responses"),
    ]
    return with_download(requests).groupBy("ip", "user_agent", *KINDS).agg(*totals, *more)


def path_facts(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Requests per (address, path), in all and of the kinds that evidence and damage count."""
    return with_download(requests).groupBy("ip", "url_path").agg(
        F.expr("count(*) AS n"),
        F.expr("count_if(sqli_match) AS n_sqli"),
        F.expr("count_if(is_download) AS n_downloads"),
        F.expr("count_if(is_admin) AS n_admin"),
        F.expr("count_if(is_transaction AND status = 200) AS n_transactions"),
    )


def slice_facts(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rhythm, logins and downloads per (address, time slice)."""
    sums = {
        "failed": "if(is_login AND is_failed_login, 1L, 0L)",
        "others": "if(is_login AND NOT is_failed_login, 1L, 0L)",
        "volume": "if(is_download, bytes, 0L)",
        "requests": "if(is_download, 1L, 0L)",
    }
    return slice_rhythm(with_download(requests), cfg, {name: F.expr(value) for name, value in sums.items()})


def _kinds_of(requests: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per request and kind: ``attack_type`` and ``value``; ``of`` names each kind's test and column."""
    kinds = [F.when(F.col(test), F.struct(F.lit(name).alias("attack_type"), F.col(c).alias("value"))) for name, (test, c) in of.items()]
    found = with_download(requests).where(" OR ".join(test for test, _ in of.values()))
    return found.select("ip", "timestamp", "lineno", F.inline(F.array_compact(F.array(*kinds))))


def sample_facts(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The first payloads and downloads of every address, in order of time."""
    of = {"sql_injection": ("sqli_match", "url_query"), "data_exfiltration": ("is_download", "url_full")}
    order = [F.asc("timestamp"), F.asc("lineno")]
    return ranked(_kinds_of(requests, of), ["attack_type", "ip"], order, LONGEST_LIST).drop("timestamp", "lineno")


def agent_order(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The first different agents with which every address sends payloads or visits admin paths."""
    of = {"sql_injection": ("sqli_match", "user_agent"), "admin_recon": ("is_admin", "user_agent")}
    seen = first_seen(_kinds_of(requests, of), ["attack_type", "ip"], "value")
    return ranked(seen, ["attack_type", "ip"], [F.asc("seen")], LONGEST_LIST).drop("seen")


@dataclass
class Facts:
    """The tables over one request table. Lazy ones are planned anew wherever they are used."""

    agents: DataFrame
    paths: DataFrame
    slices: DataFrame
    samples: DataFrame
    agent_order: DataFrame
    clients: DataFrame
    stored: bool = False

    @property
    def stored_slices(self) -> DataFrame | None:
        """Slices that are worth reading in place of the rows that they come from."""
        return self.slices if self.stored else None

    def kind(self, name: str) -> DataFrame:
        """Totals per (address, agent) of the requests of one kind."""
        return self.agents.where(F.col(name))

    def profile(self, cfg: Config = DEFAULT) -> DataFrame:
        """The per-address profile, as ``profile.ip_profile`` makes it from requests."""
        return profile_of(totals_of_agents(merged_agents(self.agents)), rhythm_of_slices(self.slices, cfg))


_MAKERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "agents": agent_facts,
    "paths": path_facts,
    "slices": slice_facts,
    "samples": sample_facts,
    "agent_order": agent_order,
    "clients": failures_per_client,
}


def lazy_facts(requests: DataFrame, cfg: Config = DEFAULT) -> Facts:
    return Facts(**{name: make(requests, cfg) for name, make in _MAKERS.items()})


def stored_facts(requests: DataFrame, cfg: Config = DEFAULT, kept: Kept | None = None) -> Facts:
    """The tables worked out and kept; their jobs are independent and run together."""
    kept = kept or Kept()

    def store(name: str) -> DataFrame:
        made = _MAKERS[name](requests, cfg)
        return materialize(made, name, kept) if name == "clients" else materialize_by(made, name, "ip", kept)

    with ThreadPoolExecutor(len(_MAKERS)) as pool:
        return Facts(**dict(zip(_MAKERS, pool.map(store, _MAKERS))), stored=True)
