import duckdb
from conftest import DATA

from millrace.llm.queries import QUERIES
from millrace.llm.sql import ORACLES


def test_all_queries_run_on_whole_tables(spark):
    for name, fn in QUERIES.items():
        assert fn(spark, DATA).count() >= 0, name


def test_queries_match_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view pretrain_records as select * from '{DATA}/pretrain_records.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, DATA)
        want = c.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want, name
