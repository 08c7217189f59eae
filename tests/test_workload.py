"""A sample of the registered queries against their SQL on the smallest tables. check_oracles.py runs all of them."""

import duckdb
import pytest

import check_oracles
from workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["crosswalk_orders", "same_value", "scan_rules", "match_advisories", "classify_scan", "repair_rounds", "failure_reasons"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert check_oracles.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check_oracles.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_catalog_tables_scan_the_customers_once(spark, tmp_path):
    """Each scan costs the driver a broadcast of the whole configuration, and a plan reads these tables often."""
    from workload.base import entities, fields
    spark.sql("SELECT * FROM VALUES (1L, 'a', 3), (3L, 'b', NULL), (NULL, 'c', 5) AS t(c_custkey, c_name, c_nationkey)").write.parquet(f"{tmp_path}/customer.parquet")
    found = [make(spark, str(tmp_path)) for make in (fields, entities)]
    assert [table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") for table in found] == [1, 1]
    assert [table.count() for table in found] == [3 * 26, 3 * 4 + 1]
    of_one = sorted((r["service"], r["entity_ord"], r["entity"], r["kind"], len(r["values"])) for r in found[1].filter("service LIKE '%-1'").collect())
    assert of_one == [("cons-1", 0, "Booking", "class", 0), ("cons-1", 1, "ClientRecord", "class", 0), ("prov-1", 0, "OrderItem", "class", 0),
                      ("prov-1", 1, "Account", "class", 0), ("prov-1", 2, "OrderStatus", "enum", 3)]
