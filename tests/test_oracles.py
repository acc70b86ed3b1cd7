"""Every catalogue query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lumenlake.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["q_5_sort", "q_5_sort_all"])
def test_sort_gives_all_rows_in_order(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = [(r.id, r.key) for r in queries()[name](spark, SF).collect()]
    assert got == con.sql(ORACLES[name]).fetchall() and len(got) == con.sql("SELECT count(*) FROM events").fetchall()[0][0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_restored_rows_where_ids_pass_a_million(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, value, props FROM '{SF}/events.parquet', range(2) t(k) WHERE event_id < 300) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = queries()["mut_9_restore_archive"](spark, str(tmp_path))
    rel = con.sql(ORACLES["mut_9_restore_archive"])
    got = sorted(repr([plain(r[c]) for c in rel.columns]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in rel.fetchall())
