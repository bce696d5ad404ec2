"""The registered queries: contract, plans, and a comparison with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from textweave.registry.frames import TOKENS  # noqa: F401
from tools.check_oracle import TABLES, normal

QUICK = [
    "agg01_temporal_summary", "jn02_nearest_time", "jn03_time_window", "jn04_same_period", "flt10_id_sync", "fea05_oversample",
    "agg04_describe", "scl02_chunks", "src08_row_ids", "sem02_search", "txt07_coding_dictionary", "gr09_graph_counts", "tda03_balls",
]
JOINS = [
    "jn01_link_by_id", "jn02_nearest_time", "jn03_time_window", "jn04_same_period", "jn06_keyword_hubs", "jn08_text_outcome",
    "agg03_period_topics", "sem02_search", "gr10_subgraph_edges", "tda03_membership", "flt11_rows_linked_from_documents",
]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "document_count" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_as_duckdb(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = entry.queries()[name](spark, small)
    cur = con.execute(entry.oracle_sql()[name])
    assert normal(df.columns, df.collect()) == normal([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", JOINS)
def test_no_cross_product(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = entry.queries()["flt05_rows_equal"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_size,20)" in plan and "p_name" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, small):
    plan = entry.queries()["agg03_period_topics"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
