"""Column expressions on URLs, user agents and report texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, SQLI_PATTERNS, SQLI_PRECHECK, Config
from tracewarden.functions.sql import one_of, quoted


def url_path(url: Column) -> Column:
    """Everything before the first ``?``; ``#`` has no special meaning."""
    return F.substring_index(url, "?", 1)


def url_query(url: Column) -> Column:
    """Everything after the first ``?``, an empty string without one."""
    return url.substr(F.length(url_path(url)) + 2, F.length(url))


def percent_decode(text: Column) -> Column:
    """Undo percent escapes only: ``+`` stays and a ``%`` without two hex digits stays."""
    protected = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(protected)).otherwise(text)


def url_decoded(url: Column) -> Column:
    """Twice decoded and lower-cased, so doubly escaped payloads show up."""
    return F.lower(percent_decode(percent_decode(url)))


def has_prefix(path: str, prefixes) -> Column:
    """True when the path column is one of the prefixes or lies below one.

    A prefix with n slashes covers exactly the paths whose text before slash n + 1
    equals it, so the path is cut after each number of slashes that occurs and
    looked up among the prefixes. A prefix with fewer slashes can equal a longer cut
    only when it is the whole path, so each look-up may use the whole list, which
    Spark turns into one hash set.
    """
    cuts = sorted({p.count("/") + 1 for p in prefixes})
    tests = [f"substring_index({path}, '/', {n}) IN {one_of(prefixes)}" for n in cuts]
    return F.expr(" OR ".join(tests) or "false")


def is_login(login_paths) -> Column:
    """A POST to exactly one of the login paths."""
    test = f"url_path IN {one_of(login_paths)}" if login_paths else "false"
    return F.expr(f"method = 'POST' AND {test}")


def _any_of(patterns, flags: str) -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


def wide_blanks(pattern: str) -> str:
    """``pattern`` with the separators \\x1c to \\x1f among the white space, as text tools see it."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        if part == r"\s":
            part = r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]"
            at += 1
        elif part == r"\S" and not inside:
            part = r"[^\s\x1c-\x1f]"
            at += 1
        elif part[0] == "\\":
            at += 1
        elif part == "[":
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
        at += 1
    return "".join(out)


def is_bot_agent(agent: str, cfg: Config = DEFAULT) -> Column:
    """Agent of a script or scanner, in any case.

    Plain words (most patterns are) are searched as text, which is several times
    faster than a regex over every agent; only the others become one.
    """
    tests, others = [], []
    for pattern in cfg.bot_agent_patterns:
        word = pattern.removeprefix("^").lower()
        if re.fullmatch("[a-z0-9 _/-]+", word):
            tests.append(f"{'startswith' if pattern[0] == '^' else 'contains'}(lower({agent}), {quoted(word)})")
        else:
            others.append(pattern)
    if others:
        tests.append(f"{agent} RLIKE {quoted(_any_of(others, '(?i)'))}")
    return F.expr(" OR ".join(tests) or "false")


def is_tor_agent(agent: Column, cfg: Config = DEFAULT) -> Column:
    """Agent of the Tor Browser. It is also the agent of desktop Firefox."""
    return F.coalesce(agent.rlike("^(?:" + cfg.tor_agent_pattern + ")"), F.lit(False))


def sqli_match(url: Column, decoded: Column, cfg: Config = DEFAULT) -> Column:
    """Injection signature in the decoded or the raw URL.

    ``U`` gives the Unicode meaning of ``\\s`` and ``\\b``, ``d`` lets only a
    newline end a line. The built-in patterns all imply a cheap precheck; other
    patterns are searched for as they are. An URL without escapes is searched
    once: its raw and decoded forms are equal.
    """
    signature = wide_blanks(_any_of(cfg.sqli_patterns, "(?iUd)"))
    precheck = "(?U)" + wide_blanks(SQLI_PRECHECK) if cfg.sqli_patterns == SQLI_PATTERNS else None

    def search(text: Column) -> Column:
        found = text.rlike(signature)
        return text.rlike(precheck) & found if precheck else found

    raw_hit = F.when(url.contains("%"), search(F.lower(url))).otherwise(F.lit(False))
    return F.coalesce(search(decoded) | raw_hit, F.lit(False))


def severity(score: Column, cfg: Config = DEFAULT) -> Column:
    return (
        F.when(score >= cfg.critical_score, "CRITICAL")
        .when(score >= cfg.high_score, "HIGH")
        .when(score >= cfg.medium_score, "MEDIUM")
        .otherwise("LOW")
    )


def severity_rank(level: Column) -> Column:
    return (
        F.when(level == "CRITICAL", 4).when(level == "HIGH", 3).when(level == "MEDIUM", 2).when(level == "LOW", 1)
        .otherwise(0)
    )


def mitre_id(attack_type: Column, cfg: Config = DEFAULT) -> Column:
    known = F.create_map(*[F.lit(x) for pair in cfg.mitre_ids.items() for x in pair])
    return F.try_element_at(known, attack_type)


def first_ip(ip_list: Column) -> Column:
    return F.trim(F.substring_index(ip_list, ",", 1))


def duration_hms(seconds: str) -> Column:
    """``1h 2m 3s`` of a column of seconds, leading zero units dropped."""
    s = f"bigint({seconds})"
    h, m, sec = f"{s} div 3600", f"{s} % 3600 div 60", f"{s} % 60"
    return F.expr(
        f"CASE WHEN {h} <> 0 THEN format_string('%dh %dm %ds', {h}, {m}, {sec}) "
        f"WHEN {m} <> 0 THEN format_string('%dm %ds', {m}, {sec}) ELSE format_string('%ds', {sec}) END"
    )


def duration_text(seconds: str) -> Column:
    """``2 d 3 h 5 m`` of a column of seconds; seconds only below one hour, ``0 s`` for nothing."""
    s = f"greatest(coalesce(bigint({seconds}), 0L), 0L)"
    d, h, m, sec = f"{s} div 86400", f"{s} % 86400 div 3600", f"{s} % 3600 div 60", f"{s} % 60"
    return F.expr(
        f"CASE WHEN {s} = 0 THEN '0 s' ELSE concat_ws(' ', CASE WHEN {d} > 0 THEN concat({d}, ' d') END, "
        f"CASE WHEN {h} > 0 THEN concat({h}, ' h') END, CASE WHEN {m} > 0 THEN concat({m}, ' m') END, "
        f"CASE WHEN {s} < 3600 AND {sec} > 0 THEN concat({sec}, ' s') END) END"
    )


def bytes_text(size: str) -> Column:
    """A column of byte counts in 1024 steps: whole bytes, one place for KB and MB, two above."""
    b = f"coalesce(double({size}), 0D)"

    def scaled(places: int, power: int, unit: str) -> str:
        return f"format_string('%.{places}f {unit}', bround({b} / {1024**power}D, {places}))"

    return F.expr(
        f"CASE WHEN {b} < 1024 THEN format_string('%d B', bigint({b})) WHEN {b} < {1024**2}D THEN {scaled(1, 1, 'KB')} "
        f"WHEN {b} < {1024**3}D THEN {scaled(1, 2, 'MB')} WHEN {b} < {1024**4}D THEN {scaled(2, 3, 'GB')} "
        f"ELSE {scaled(2, 4, 'TB')} END"
    )
