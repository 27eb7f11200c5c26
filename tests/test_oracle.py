"""Queries against their SQL in DuckDB on the smallest tables, where these are at hand."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "p1_found", "p1_kept", "p7_found", "p7_report", "p7_composite", "scan_ordered_walk", "where_three_valued", "where_not_in_with_null", "where_like_ascii", "fn_datetime", "group_first_row", "group_order_limit_offset",
    "order_nulls_first", "set_except", "join_asof", "join_validity", "join_incident_topk", "join_two_hops", "events_follow_pairs", "tags_co_occurrence", "window_average_percentile", "window_budget_pack", "window_consensus_votes",
    "text_tokens", "text_epistemic", "text_age_labels", "lexical_search_any", "lexical_search_soft_and", "hybrid_rrf", "knn_exact", "fused_score", "claim_check", "write_upsert_columns", "write_boost_edges", "maintain_edge_decay",
    "graph_clustering", "graph_modularity", "graph_rich_club", "stream_exactly_once", "stream_around_strong",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (bool, int)):
        return repr(int(v))
    return None if v is None else str(v).replace("+00:00", "")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
