"""Counts of a condition over columns that are null in whole groups, and over tables without rows, are those of the SQL."""

import duckdb
import pytest
from tests.conftest import TABLES, assert_same

from rowsmith.plans import catalog

NULLS = {
    "events": "* REPLACE (CASE WHEN user_id % 3 = 0 OR event_type = 'view' THEN NULL ELSE value END AS value, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS event_type)",
    "orders": "* REPLACE (CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus)",
    "customer": "* REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal)",
    "part": "* REPLACE (CASE WHEN p_brand LIKE '%1' THEN NULL ELSE p_size END AS p_size)",
}
OF_NULLS = "contact_summary report_by_segment campaign_performance keyword_quality transition_matrix usable_rollup cost_model pipeline_quality nested_report retry_outcomes coverage_of_successes".split()
OF_NOTHING = "overview_stats quality_matrix run_statistics column_profile duplicate_profile scrape_report contact_summary".split()


def tables(data, folder, change):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY ({change(t, f'{data}/{t}.parquet')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def nulls(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nulls")
    return str(folder), tables(data, folder, lambda t, path: f"SELECT {NULLS.get(t, '*')} FROM '{path}'")


@pytest.fixture(scope="module")
def nothing(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    return str(folder), tables(data, folder, lambda t, path: f"SELECT * FROM '{path}' WHERE false")


@pytest.mark.parametrize("name", OF_NULLS)
def test_groups_of_nulls(name, spark, nulls):
    folder, con = nulls
    assert_same(catalog.queries()[name](spark, folder), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", OF_NOTHING)
def test_no_rows(name, spark, nothing):
    folder, con = nothing
    assert_same(catalog.queries()[name](spark, folder), con, catalog.oracle_sql()[name])
