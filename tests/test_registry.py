"""A sample of registered queries against their SQL on the smallest tables (``oracle.py`` runs them all)."""

import os

import duckdb
import pytest

import oracle

FOLDER = "/root/testdata/sf0.001"
NAMES = ["stats_by_source", "timeseries_week", "windowed_source_features", "extract_features", "cidr_lookup_join_wide", "parse_kv", "parse_json_flat", "map_fields", "validate",
         "ledger_chain", "template_drift_ewma", "feature_distributions", "compare_generations", "dead_letter_stats"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def entry():
    return oracle.load_entry()


def test_every_sql_belongs_to_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, entry, name):
    db = duckdb.connect()
    for t in oracle.TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    columns, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert oracle.rows_of(df.columns, df.collect()) == oracle.rows_of(columns, want)
