"""Tor, proxy and country of addresses.

No side is broadcast by hint: Spark broadcasts a list when its measured size is
below the session's threshold and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.net import ip_bits, ipv4_number, is_ipv4, key_of_bits
from tracewarden.functions.text import first_ip

_BLOCK = 65536  # addresses of one /16


def network_flags(ips: DataFrame, tor: DataFrame, proxies: DataFrame) -> DataFrame:
    """``via_tor`` and ``via_proxy`` per address; an exit node is not also called a proxy."""
    flag = lambda df, name: df.select("ip", F.lit(True).alias(name)).distinct()
    return (
        ips.join(flag(tor, "in_tor"), "ip", "left")
        .join(flag(proxies, "in_proxy"), "ip", "left")
        .withColumn("via_tor", F.col("in_tor").isNotNull())
        .withColumn("via_proxy", F.col("in_proxy").isNotNull() & F.col("in_tor").isNull())
        .drop("in_tor", "in_proxy")
    )


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that start inside an earlier one of their /16; a clean table has none."""
    pieces = _pieces(ranges)
    before = Window.partitionBy("block").orderBy("n", "ip_from", "upto").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("reach", F.max("upto").over(before)).where("reach >= n").select("ip_from", "ip_to", "country")


def _pieces(ranges: DataFrame) -> DataFrame:
    block = F.explode(F.sequence(F.floor(F.col("ip_from") / _BLOCK), F.floor(F.col("ip_to") / _BLOCK)))
    return ranges.where("ip_from <= ip_to").withColumn("block", block).select(
        "block",
        F.greatest("ip_from", F.col("block") * _BLOCK).alias("n"),
        F.least("ip_to", (F.col("block") + 1) * _BLOCK - 1).alias("upto"),
        "country", "ip_from", "ip_to",
    )


def network_bounds(networks: DataFrame) -> DataFrame:
    """``networks`` (``network``, ``country``) with the first and last key of each, ``low`` and ``high``.

    A network is a prefix (``2001:db8::/32``, ``10.0.0.0/8``), two addresses with a dash between them, or one
    address. Keys are the kind of address and 32 hexadecimal digits; both are null where the text can't be
    read, the last address lies before the first, or the two are of different kinds.
    """
    text = F.trim("network")
    ends, prefix = F.split(text, r"\s*-\s*"), F.split(text, "/")
    first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    bits = ip_bits(F.get(prefix, F.lit(0)))
    length = F.when(F.get(prefix, F.lit(1)).rlike(r"\A[0-9]{1,3}\z"), F.get(prefix, F.lit(1)).cast("int"))
    most = F.when(is_ipv4(F.get(prefix, F.lit(0))), 32).otherwise(128)
    fixed = F.when((length <= most) & (F.size(prefix) == 2), F.substr(bits, F.lit(1), 129 - most + length))
    by_prefix = F.struct(*[F.rpad(fixed, 129, fill).alias(n) for n, fill in (("low", "0"), ("high", "1"))])
    by_ends = F.struct(ip_bits(first).alias("low"), F.when(F.size(ends) <= 2, ip_bits(F.coalesce(last, first))).alias("high"))
    bounds = networks.withColumn("_bounds", F.when(text.contains("/"), by_prefix).otherwise(by_ends))
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    whole = (F.substring(low, 1, 1) == F.substring(high, 1, 1)) & (low <= high)
    keys = {n: F.when(whole, key_of_bits(F.col(f"_bounds.{n}"))) for n in ("low", "high")}
    return bounds.withColumns(keys).drop("_bounds")


def unreadable_networks(networks: DataFrame) -> DataFrame:
    """Rows of ``networks`` that no look-up sees."""
    return network_bounds(networks).where("low IS NULL OR high IS NULL").drop("low", "high")


#: Parts that a sweep cuts the addresses into at most.
SWEEP_PARTS = 256


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and key: a range is opened, a point asks for the last opened one that is still open."""
    part, opened = None, []
    for batch in batches:
        ips, found = [], []
        for own, key, high, country, ip in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "high", "country", "ip"))):
            if own != part:
                part, opened = own, []
            while opened and opened[-1][0] < key:
                opened.pop()
            if ip is None:
                opened.append((high, country))
            else:
                ips.append(ip)
                found.append(opened[-1][1] if opened else None)
        yield pa.RecordBatch.from_arrays([pa.array(ips, pa.string()), pa.array(found, pa.string())], ["ip", "country"])


def innermost(ips: DataFrame, bounds: DataFrame) -> DataFrame:
    """``ip, country`` of every address in ``ips``, by the innermost of the ranges ``low, high, country`` that hold it.

    Ranges may lie in one another or overlap: of those that hold an address, the one that begins last
    counts, then the shorter one. Keys are cut into parts of like size; a range is carried into every part that it
    reaches, and a part is swept once, in order of the keys, with the open ranges on a stack. So a part
    holds in memory as many ranges as lie in one another.
    """
    spark = ips.sparkSession
    points = ips.select("ip", key_of_bits(ip_bits(F.col("ip"))).alias("key"))
    ranges = bounds.where("low IS NOT NULL").select("low", "high", "country")
    parts = min(SWEEP_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = points.select("key").union(ranges.select("low")).where("key IS NOT NULL").repartitionByRange(parts, "key")
    first = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).collect()  # one row for each part
    borders = F.array(*[F.lit(k) for k in sorted(r["key"] for r in first)]).cast("array<string>")
    part_of = lambda key: F.size(F.filter(borders, lambda b: b <= key))
    reached = F.explode(F.sequence(part_of(F.col("low")), part_of(F.col("high"))))
    opened = ranges.select(reached.alias("part"), F.col("low").alias("key"), "high", "country", F.lit(None).cast("string").alias("ip"))
    asked = points.where("key IS NOT NULL").select(
        part_of(F.col("key")).alias("part"), "key", *[F.lit(None).cast("string").alias(c) for c in ("high", "country")], "ip"
    )
    order = ["part", "key", F.col("ip").asc_nulls_first(), F.desc("high"), F.desc("country")]
    placed = opened.unionByName(asked).repartition("part").sortWithinPartitions(*order).mapInArrow(_sweep, "ip string, country string")
    return placed.unionByName(points.where("key IS NULL").select("ip", F.lit(None).cast("string").alias("country")))


def countries(ips: DataFrame, ranges: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """Country of every distinct address, ``Unknown`` outside all ranges.

    ``ranges`` are of IPv4 numbers and must not overlap; ``networks`` (see ``network_bounds``) are of both
    kinds and may lie in one another. Where both are given, the innermost of all counts.

    Without networks, ranges are cut at /16 borders; addresses and range starts of one /16 share a
    time-line-like window where the last start at or below an address is its
    range. A /16 holds at most 65,536 of either, so groups stay small, and no
    address meets more than one range.
    """
    if networks is not None:
        key = lambda n: F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 32, "0"))
        numbers = ranges.select(key("ip_from").alias("low"), key("ip_to").alias("high"), "country")
        bounds = network_bounds(networks).select("low", "high", "country").unionByName(numbers)
        return innermost(ips.select("ip").distinct(), bounds).select("ip", F.coalesce("country", F.lit("Unknown")).alias("country"))
    distinct = ips.select("ip").distinct().withColumn("n", ipv4_number(F.col("ip")))
    pieces = _pieces(ranges).select("block", "n", F.struct("upto", "country").alias("piece"))
    line = pieces.unionByName(
        distinct.where("n IS NOT NULL").select("ip", "n", F.floor(F.col("n") / _BLOCK).alias("block")),
        allowMissingColumns=True,
    )
    upto_here = Window.partitionBy("block").orderBy("n").rangeBetween(Window.unboundedPreceding, 0)
    hit = line.withColumn("last", F.last("piece", ignorenulls=True).over(upto_here)).where("ip IS NOT NULL")
    known = hit.select("ip", F.when(F.col("last.upto") >= F.col("n"), F.col("last.country")).alias("country"))
    unplaced = distinct.where("n IS NULL").select("ip")
    unplaced = unplaced.withColumn("country", F.lit(None).cast("string"))
    return known.unionByName(unplaced).select("ip", F.coalesce("country", F.lit("Unknown")).alias("country"))


def with_network_dims(
    sessions: DataFrame, tor: DataFrame, proxies: DataFrame, ranges: DataFrame, networks: DataFrame | None = None
) -> DataFrame:
    """Country, Tor and proxy of the first address of every session."""
    keyed = sessions.withColumn("first_ip", first_ip(F.col("ip")))
    ips = keyed.select(F.col("first_ip").alias("ip")).distinct()
    known = network_flags(countries(ips, ranges, networks), tor, proxies).withColumnRenamed("ip", "first_ip")
    return keyed.join(known, "first_ip", "left").drop("first_ip")
