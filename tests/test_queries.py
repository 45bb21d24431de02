import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.registry import CHECKS, QUERIES
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["issue_counts", "marker_normalize", "parse_structure", "default_fill", "sanitize_allowlist", "catalogue_upsert", "checksum_diff", "fn_slug"]


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_one_exchange_for_the_passes(spark):
    plan = entry.queries()["html_passes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
