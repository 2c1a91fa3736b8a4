"""Registered queries that go through files: text logs, address lists, the whole analysis and its report."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import fixture
from registry.digests import digests
from tracewarden.operators import dims
from tracewarden.plans import analysis, explore, report
from tracewarden.sources import access_log, endpoints, lists, tables
from tracewarden.storage import shared_folder

SUSPECT = "103.44.55.66"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder for files: in the shared one, or for a local run one of its own."""
    folder = shared_folder(spark)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder or '/tmp/checkpoints'}/tracewarden/{kind}-{uuid.uuid4().hex}"


def text_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The derived lines as text files, with unreadable times and numbers among them, read back as a log."""
    path = new_folder(spark, "log")
    lines = fixture.log_lines(spark, folder)
    bad_time = lines.where("lineno % 89 = 0").select(F.format_string("2024-13-45T99:00:00Z 1.2.3.4 GET /t%d 200 5 a", "lineno"))
    bad_number = lines.where("lineno % 83 = 0").select(
        F.format_string("2024-01-01T00:00:00Z 1.2.3.4 GET /n%d 99999999999 5 a", "lineno")
    )
    lines.select("value").union(bad_time).union(bad_number).write.text(f"{path}/lines")
    spark.createDataFrame([], "value string").write.text(f"{path}/empty")
    parsed, rejects = access_log.read_log(spark, [f"{path}/lines", f"{path}/empty"])
    good = parsed.groupBy(F.col("ip").alias("what")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    bad = rejects.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n"), F.lit(None).cast("bigint").alias("bytes"))
    return good.union(bad)


def source_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Address feeds (one is missing), a country table and an endpoint file, written and read back."""
    path = new_folder(spark, "lists")
    ips = fixture.requests(spark, folder).select("ip").distinct()
    internal = F.col("ip").startswith("10.")
    note = spark.createDataFrame([("# feed",), ("",)], "value string")
    ips.where(internal).select(F.concat("ip", F.lit(":8080 ")).alias("value")).union(note).write.text(f"{path}/a")
    ips.where(~internal).select(F.concat("ip", F.lit(":80")).alias("value")).union(note).write.text(f"{path}/b")
    ips.select("ip").union(note).write.text(f"{path}/tor")
    fixture.country_ranges(spark).write.option("header", True).csv(f"{path}/ranges")
    custom = json.dumps({"exfil_targets": ["/dump", "/dump2"], "admin_endpoints": ["/root"]})
    spark.createDataFrame([(custom,)], "value string").coalesce(1).write.text(f"{path}/endpoints")
    found = {
        "proxy": lists.read_proxies(spark, [f"{path}/a", f"{path}/missing", f"{path}/b"]).select("ip"),
        "tor": lists.read_tor_exits(spark, f"{path}/tor").select("ip"),
        "country": lists.read_country_ranges(spark, f"{path}/ranges", "csv").select("country"),
        "endpoint": endpoints.read_custom_endpoints(spark, f"{path}/endpoints").select(F.concat_ws("=", "category", "path")),
    }
    rows = None
    for kind, df in found.items():
        part = df.toDF("value").select(F.lit(kind).alias("kind"), "value")
        rows = part if rows is None else rows.union(part)
    return rows


def geo_networks(spark: SparkSession, folder: str) -> DataFrame:
    """Countries of IPv4 and IPv6 addresses derived from events, by nested networks read from a file."""
    path = new_folder(spark, "networks")
    lines = [("# networks",), ("",), *[(f"{network}, {country}",) for network, _, _, country in fixture.NETWORKS], ("10.0.0.0/40, nowhere",)]
    spark.createDataFrame(lines, "value string").write.text(path)
    ips = fixture.events(spark, folder).selectExpr(f"explode(array({', '.join(fixture.DERIVED_IPS)})) AS ip")
    return dims.countries(ips, fixture.country_ranges(spark), lists.read_networks(spark, path))


def _analysis(spark: SparkSession, folder: str) -> analysis.Result:
    path = new_folder(spark, "requests")
    tables.store_requests(fixture.requests(spark, folder), path)
    known = analysis.Dims(fixture.tor(spark), fixture.proxy_list(spark), fixture.country_ranges(spark))
    return analysis.analyze(tables.load_requests(spark, path), known)


def _told(table: DataFrame) -> DataFrame:
    """A table with its lists and maps as text."""
    out = {}
    for field in table.schema.fields:
        if field.dataType.simpleString() == "array<string>":
            out[field.name] = F.array_join(field.name, ", ")
        elif field.dataType.typeName() == "map":
            pairs = F.array_sort(F.transform(F.map_entries(field.name), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
            out[field.name] = F.array_join(pairs, ", ")
    return table.withColumns(out) if out else table


def analysis_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table of the whole analysis, as digests of its columns and rows."""
    result = _analysis(spark, folder)
    names = ("profile", "sessions", "members", "evidence_counts", "reputation", "reasons", "chains", "damage", "cohorts", "baseline")
    return digests({name: _told(getattr(result, name)) for name in names})


def ip_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of one address's details, likewise."""
    detail = explore.ip_detail(_analysis(spark, folder), [SUSPECT])
    names = {"totals": "profile"}
    return digests({names.get(name, name): _told(table) for name, table in detail.items()})


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The report's CSV, JSON and text files, read back."""
    paths = report.write_report(_analysis(spark, folder), new_folder(spark, "report"))
    read = {name: spark.read.csv(paths[name], header=True) for name in ("attacks_csv", "ip_reputation_csv")}
    read |= {name: spark.read.json(paths[name]) for name in ("attacks_json", "attack_chains_json", "economic_damage_json")}
    scores = read["ip_reputation_csv"]
    read["ip_reputation_csv"] = scores.withColumn("breakdown", F.from_json("breakdown", "map<string,bigint>"))
    read["narrative_text"] = spark.read.text(paths["narrative_text"])
    return digests({name: _told(table) for name, table in read.items()})


QUERIES = (text_scan, source_lists, geo_networks, analysis_tables, ip_detail, report_files)
