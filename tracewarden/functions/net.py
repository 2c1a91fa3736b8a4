"""Column expressions on IP addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9A-Fa-f]{1,4}"

# RFC 1918 networks (10/8, 172.16/12, 192.168/16) and loopback (127/8)
_INTERNAL = rf"\A(?:(?:10|127)\.{_OCTET}|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.{_OCTET}\.{_OCTET}\z"


def is_ipv4(ip: Column) -> Column:
    """Dotted quad without leading zeros."""
    return F.coalesce(ip.rlike(rf"\A{_V4}\z"), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a number, null for anything but a strict IPv4 address."""
    parts = F.split(ip, r"\.")
    value = reduce(lambda acc, i: acc * 256 + parts[i].cast("bigint"), range(1, 4), parts[0].cast("bigint"))
    return F.when(is_ipv4(ip), value)


def ipv6_bits(ip: Column) -> Column:
    """The 128 bits of an IPv6 address as text of 0 and 1, null for anything else.

    A zone is dropped, an IPv4 tail counts as its two groups, ``::`` fills up with zeros.
    """
    text = F.regexp_replace(ip, r"%[^%]+\z", "")
    tail = F.regexp_extract(text, rf"(?<=:)({_V4})\z", 1)
    number = ipv4_number(tail)
    groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(number, 16))), F.lower(F.hex(number.bitwiseAND(F.lit(0xFFFF)))))
    text = F.when(tail != "", F.concat(F.expr("''"), F.substr(text, F.lit(1), F.length(text) - F.length(tail)), groups)).otherwise(text)
    sides = F.split(text, "::")
    groups_of = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups_of(sides[0]), F.coalesce(groups_of(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    whole = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    bits = F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.when(is_valid_ip(ip) & ~is_ipv4(ip), bits)


def ip_bits(ip: Column) -> Column:
    """An address as text: its kind, 4 or 6, and 128 bits (of IPv4 the last 32 count), null for anything else."""
    four = F.lpad(F.conv(ipv4_number(ip).cast("string"), 10, 2), 128, "0")
    return F.coalesce(F.concat(F.lit("4"), four), F.concat(F.lit("6"), ipv6_bits(ip)))


def key_of_bits(bits: Column) -> Column:
    """The same with 32 hexadecimal digits for the bits; keys sort as the numbers do."""
    half = lambda start: F.lpad(F.lower(F.conv(F.substring(bits, start, 64), 2, 16)), 16, "0")
    return F.concat(F.substring(bits, 1, 1), half(2), half(66))


def is_internal_ip(ip: Column) -> Column:
    """Private or loopback IPv4; documentation networks, IPv6 and garbage are external."""
    return F.coalesce(ip.rlike(_INTERNAL), F.lit(False))


def is_valid_ip(ip: Column) -> Column:
    """IPv4 or IPv6, the latter with an optional zone and an optional IPv4 tail."""
    v6 = F.regexp_replace(F.regexp_replace(ip, r"%[^%]+\z", ""), rf"(?<=:){_V4}\z", "0:0")
    whole = v6.rlike(rf"\A(?:{_GROUP}:){{7}}{_GROUP}\z")
    groups = rf"(?:{_GROUP}(?::{_GROUP})*)?"
    shortened = v6.rlike(rf"\A{groups}::{groups}\z") & (F.regexp_count(v6, F.lit("[0-9A-Fa-f]+")) <= 7)
    return F.coalesce(is_ipv4(ip) | whole | shortened, F.lit(False))
