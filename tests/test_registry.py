"""Registered queries against their SQL on the smallest tables. ``tools/check_queries.py`` runs all of them."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from registry.oracle import all_oracles  # noqa: E402
from registry.queries import all_queries  # noqa: E402
from tools.check_queries import rows_of  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
CHECKED = ("parse_rejects", "enrich_flags", "ip_reputation", "det_anonymizer", "login_bursts", "campaigns", "top_endpoints")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    result = db.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, str(FOLDER))
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries()) and set(all_oracles()) <= set(entry.oracle_sql())
