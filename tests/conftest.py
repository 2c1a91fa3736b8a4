from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

ANDROID = "Mozilla/5.0 (Linux; Android 14)"
START = dt.datetime(2026, 4, 1, 9, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def row(seconds, ip="1.2.3.4", url="/", status=200, size=100, agent=ANDROID, method="GET"):
    """One parsed row, ``seconds`` after the start."""
    return (START + dt.timedelta(seconds=seconds), ip, method, url, status, size, agent)


def login(seconds, ip="1.2.3.4", status=401, **more):
    return row(seconds, ip, "/api/v1/login", status, method="POST", **more)


@pytest.fixture
def requests_of(spark):
    from tracewarden.operators.enrich import enrich

    def make(rows):
        numbered = [(i, *r) for i, r in enumerate(rows)]
        return enrich(
            spark.createDataFrame(
                numbered,
                "lineno bigint, timestamp timestamp, ip string, method string, url_full string, status int, "
                "bytes bigint, user_agent string",
            )
        )

    return make
