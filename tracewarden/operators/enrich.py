"""Parsed rows to the request table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, ENDPOINT_CATEGORIES, Config
from tracewarden.functions import text
from tracewarden.schema import REQUEST_COLUMNS

def hour_of(moment: Column, offset_hours: int) -> Column:
    """Hour of day at a fixed offset from UTC, whatever the session time zone is."""
    return F.pmod(F.floor(F.unix_seconds(moment) / 3600) + offset_hours, F.lit(24)).cast("int")


def _path_flags(paths: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    flags = {
        "is_sensitive": text.has_prefix("url_path", paths.get("sensitive_prefixes", ())),
        "is_admin": text.has_prefix("url_path", paths.get("admin_endpoints", ())),
        "is_transaction": text.has_prefix("url_path", paths.get("transaction", ())),
        "is_exfil_target": text.has_prefix("url_path", paths.get("exfil_targets", ())),
        "is_login": text.is_login(paths.get("login_paths", ())),
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


_CATEGORY_FLAGS = {
    "is_sensitive": "sensitive_prefixes",
    "is_admin": "admin_endpoints",
    "is_transaction": "transaction",
    "is_exfil_target": "exfil_targets",
    "is_login_path": "login_paths",
}


def _joined_flags(rows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Flags from an endpoint table of any size, for tables and streams alike.

    The endpoint side becomes one row per path. An endpoint with n slashes covers the
    paths whose text before slash n + 1 equals it, so the table is looked up once for
    each number of slashes that occurs in it (a handful); ``rows`` are only joined.
    """
    of = lambda c: F.coalesce(F.bool_or(F.col("category") == c), F.lit(False))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    table = endpoints.where("path IS NOT NULL").groupBy("path").agg(*[of(c).alias(n) for n, c in _CATEGORY_FLAGS.items()])
    table = table.withColumn("slashes", slashes)
    flags = {name: F.lit(False) for name in _CATEGORY_FLAGS}
    for (n,) in sorted(table.select("slashes").distinct().collect()):
        part = table.where(F.col("slashes") == n).select(
            F.col("path").alias(f"_path{n}"), *[F.col(f).alias(f"_{f}{n}") for f in _CATEGORY_FLAGS]
        )
        rows = rows.join(part, F.substring_index("url_path", "/", n + 1) == F.col(f"_path{n}"), "left")
        for name in flags:
            found = F.col(f"_{name}{n}")
            found = found & (F.col("url_path") == F.col(f"_path{n}")) if name == "is_login_path" else found
            flags[name] = flags[name] | F.coalesce(found, F.lit(False))
    login = F.coalesce((F.col("method") == "POST") & flags.pop("is_login_path"), F.lit(False))
    return rows.withColumns({**flags, "is_login": login})


def path_flags(paths: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Flags of each distinct ``url_path`` that an endpoint table covers."""
    rows = paths.select("url_path").distinct().withColumn("method", F.lit("POST"))
    found = _joined_flags(rows, endpoints).select(
        "url_path", "is_sensitive", "is_admin", "is_transaction", "is_exfil_target", F.col("is_login").alias("is_login_path")
    )
    return found.where("is_sensitive OR is_admin OR is_transaction OR is_exfil_target OR is_login_path")


def enrich(raw: DataFrame, endpoints=None, cfg: Config = DEFAULT) -> DataFrame:
    """Add the derived request columns.

    ``endpoints`` is a table ``(category, path)``, which is joined whatever its size, or a
    mapping of category to paths or None for the defaults, which become constants of the
    plan. No global sort: order matters only inside windows.
    """
    url = F.col("url_full")
    rows = raw if "lineno" in raw.columns else raw.withColumn("lineno", F.lit(None).cast("bigint"))
    rows = rows.withColumns(
        {
            "url_path": text.url_path(url),
            "url_query": text.url_query(url),
            "url_decoded": text.percent_decode(url),  # once here, the second time below
            "timestamp_local": F.col("timestamp") + F.expr(f"INTERVAL {cfg.local_offset_hours} HOURS"),
            "hour_local": hour_of(F.col("timestamp"), cfg.local_offset_hours),
        }
    )
    rows = rows.withColumn("url_decoded", F.lower(text.percent_decode(F.col("url_decoded"))))
    if isinstance(endpoints, DataFrame):
        rows = _joined_flags(rows, endpoints)
    else:
        rows = rows.withColumns(_path_flags(ENDPOINT_CATEGORIES if endpoints is None else endpoints))
    rows = rows.withColumns(
        {
            "is_deep_admin": F.coalesce(text.has_prefix("url_path", cfg.deep_admin_prefixes), F.lit(False)),
            "is_failed_login": F.expr(f"is_login AND status IN {tuple(cfg.failed_login_statuses)}"),
            "is_success_login": F.expr("is_login AND status = 200"),
            "is_bot_ua": text.is_bot_agent("user_agent", cfg),
            "is_tor_ua": text.is_tor_agent(F.col("user_agent"), cfg),
            "is_off_hours": F.expr(f"hour_local >= {cfg.off_hours_start} OR hour_local < {cfg.off_hours_end}"),
            "sqli_match": text.sqli_match(url, F.col("url_decoded"), cfg),
        }
    )
    extra = [c for c in ("file",) if c in raw.columns]
    return rows.select(*extra, *REQUEST_COLUMNS)
