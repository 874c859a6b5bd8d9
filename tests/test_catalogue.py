import pytest

import __spark_entry__ as entry
from tests.oracle import database, same

from millrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_oracle(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir).toPandas(), database(sf_dir).sql(catalogue.ORACLES[name]).df())


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["user_id", "event_type", "value", "ts", "begin_date", "end_date", "is_current"]
    assert found.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    catalogue.QUERIES["filter_and"](spark, sf_dir).select("o_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(o_orderstatus,O)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_run_status_reads_all_events(spark, sf_dir):
    found = catalogue.QUERIES["run_status"](spark, sf_dir).toPandas()
    runs = database(sf_dir).sql("SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events").df()
    assert len(found) == found.run_id.nunique() == len(runs)
    assert set(found.status) == {"failed", "running", "success", "unknown"}


def test_join_full_and_filter_null_read_whole_tables(spark, sf_dir):
    joined = catalogue.QUERIES["join_full"](spark, sf_dir).toPandas()
    suppliers, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("supplier", "customer"))
    assert sorted(joined.s_suppkey.dropna()) == sorted(suppliers.s_suppkey)
    assert sorted(joined.c_custkey.dropna()) == sorted(customers.c_custkey)
    assert joined.s_suppkey.isna().any() and joined.c_custkey.isna().any() and joined.notna().all(axis=1).any()
    assert sorted(catalogue.QUERIES["filter_null"](spark, sf_dir).toPandas().c_custkey) == sorted(customers.c_custkey)
