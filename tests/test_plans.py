"""What the plans look like: filters reach the files, limits are fused, joins are hashed on common conditions."""

import re

import pytest

from quernlight.engine import Engine
from quernlight.operators.partitioning import sorter_bytes
from quernlight.queries.api import keyed_engine
from quernlight.queries.relational import engine_over

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tpch(spark):
    return engine_over(spark, DATA)


def plan(engine, text):
    return engine.run(f"EXPLAIN {text}").rows[0]["EXPLAIN_PLAN"]


def test_filters_and_columns_reach_the_scan(tpch):
    made = plan(tpch, "SELECT c_name FROM customer WHERE c_acctbal > 100.0 AND c_mktsegment = 'BUILDING'")
    assert "GreaterThan(c_acctbal,100.0)" in made and "EqualTo(c_mktsegment,BUILDING)" in made
    assert "ReadSchema: struct<c_name:string,c_acctbal:double,c_mktsegment:string>" in made


def test_order_and_limit_are_one(tpch):
    assert "TakeOrderedAndProject" in plan(tpch, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3")


def test_a_row_number_that_only_orders_is_its_keys(tpch):
    made = plan(tpch, "SELECT o_orderkey FROM orders ORDER BY ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) DESC LIMIT 3")
    assert "TakeOrderedAndProject" in made and "Window" not in made


def test_a_condition_common_to_or_branches_is_a_key(tpch):
    made = plan(tpch, "SELECT 1 FROM lineitem JOIN part ON (p_partkey = l_partkey AND p_size = 1) OR (p_partkey = l_partkey AND l_quantity < 5.0)")
    assert "HashJoin" in made or "SortMergeJoin" in made
    assert "NestedLoop" not in made


def test_an_unread_outer_join_vanishes(tpch):
    assert "Join" not in plan(tpch, "SELECT DISTINCT c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey")


def test_exists_is_a_semi_join(tpch):
    assert "LeftSemi" in plan(tpch, "SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


def test_buckets_spare_exchanges_and_reads(spark):
    e = keyed_engine(spark, DATA, 4)
    # a look-up skips buckets without a bucketed scan too, but only such a scan says how many it reads
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    for setting, value in settings.items():
        spark.conf.set(setting, value)
    try:
        joined = plan(e, "SELECT o_custkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
        point = plan(e, "SELECT o_custkey FROM orders WHERE o_orderkey = 17")
        e.run("CREATE TABLE big AS SELECT o_orderkey, o_custkey FROM orders")
        e.analyze("big")
        costs = spark.sql(e.spark_sql("SELECT o_custkey FROM big WHERE o_orderkey < 10"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    assert "SelectedBucketsCount: 1 out of 4" in point and "EqualTo(o_orderkey,17)" in point
    assert "rowCount" in costs


def bucketed(e, text):
    """The plan with bucketed scans wherever they can be."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    for setting, value in settings.items():
        e.spark.conf.set(setting, value)
    try:
        return plan(e, text)
    finally:
        for setting in settings:
            e.spark.conf.unset(setting)


def test_larger_tables_get_more_buckets(spark, monkeypatch):
    """Tasks that write keyed tables don't grow with them, and a look-up reads its bucket alone."""
    monkeypatch.setattr("quernlight.engine.BUCKET_BYTES", 200_000, raising=False)
    e, asked = keyed_engine(spark, DATA, 4), 4
    orders, lineitem = e.catalog.entry("orders"), e.catalog.entry("lineitem")
    assert orders.buckets == lineitem.buckets > asked
    parts = spark.table(lineitem.view).groupBy("_metadata.file_path").count().collect()
    assert asked < len(parts) <= lineitem.buckets and sum(p["count"] for p in parts) == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert max(p["count"] for p in parts) * 148 < 300_000  # 11 columns of 8 bytes, bits for nulls, two texts, and 36 beside
    e.register_table("notes", [{"o": i, "note": "x" * 100} for i in range(9)], primary_key=["o"])
    e.build_indexes(2)
    assert e.catalog.entry("notes").buckets == orders.buckets
    assert [r["o_orderkey"] for r in e.run("SELECT o_orderkey FROM orders WHERE o_orderkey = 17").rows] == [17]
    assert f"SelectedBucketsCount: 1 out of {orders.buckets}" in bucketed(e, "SELECT o_custkey FROM orders WHERE o_orderkey = 17")


def test_a_range_of_keys_over_more_buckets_is_whole(spark, monkeypatch):
    monkeypatch.setattr("quernlight.engine.BUCKET_BYTES", 100_000, raising=False)
    e = keyed_engine(spark, DATA, 2)
    assert e.catalog.entry("orders").buckets > 2
    text = "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 40 AND 90"
    assert "GreaterThanOrEqual(o_orderkey,40), LessThanOrEqual(o_orderkey,90)" in bucketed(e, text)
    kept = spark.read.parquet(f"{DATA}/orders.parquet").filter("o_orderkey BETWEEN 40 AND 90").select("o_orderkey").collect()
    assert sorted(r["o_orderkey"] for r in e.run(text).rows) == sorted(r["o_orderkey"] for r in kept)


def test_tables_of_more_buckets_join_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr("quernlight.engine.BUCKET_BYTES", 200_000, raising=False)
    e = keyed_engine(spark, DATA, 2)
    assert e.catalog.entry("orders").buckets == e.catalog.entry("lineitem").buckets > 2
    text = "SELECT o_orderkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    joined = bucketed(e, text)
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    assert len(e.run(text).rows) == spark.read.parquet(f"{DATA}/lineitem.parquet").count()  # each has an order


def test_the_size_of_sorted_rows_follows_rows_and_texts(spark):
    rows = spark.range(1000).selectExpr("id", "repeat('x', 100) AS `t``1`", "array(id, id) AS a", "CAST(NULL AS STRING) AS n")
    flat = sorter_bytes(rows.select("id"))
    assert flat == 1000 * (8 + 8 + 36) and sorter_bytes(rows.union(rows).select("id")) == 2 * flat
    assert sorter_bytes(rows) > flat + 1000 * (100 + 3 * 8) and sorter_bytes(rows.limit(0)) == 0


def test_large_tables_are_summed_up_before_joins(spark):
    e = Engine(spark, eager_rows=1)
    e.register_table("f", [{"id": i, "k": i % 7, "g": i % 3, "x": i} for i in range(60)], primary_key=["id"])
    e.register_table("d", [{"k": i % 5, "y": i} for i in range(12)])
    text = "SELECT g, COUNT(*), SUM(x) AS s, AVG(x) + 1 AS a, MIN(x) FROM f JOIN d ON f.k = d.k AND d.y > 1 WHERE f.x > 3 AND f.x + d.y < 60 GROUP BY g HAVING SUM(x) > 10 ORDER BY s DESC, 1"
    before = e.run(text)
    e.build_indexes(2)
    e.analyze("f")
    made = plan(e, text)
    assert e.run(text).rows == before.rows and e.run(text).columns == before.columns == ["g", "count_star", "s", "a", "min"]
    assert "__part" in e.spark_sql(text)
    assert made.index("Join") < made.rindex("Aggregate")
    for other in ("SELECT g, COUNT(DISTINCT x) FROM f JOIN d ON f.k = d.k GROUP BY g", "SELECT g, SUM(y) FROM f JOIN d ON f.k = d.k GROUP BY g", "SELECT y, SUM(x) FROM f JOIN d ON f.k = d.k GROUP BY y", "SELECT g, SUM(x) FROM f LEFT JOIN d ON f.k = d.k GROUP BY g"):
        assert "__part" not in e.spark_sql(other)


def test_first_rows_of_a_correlated_query_are_by_its_keys(tpch):
    """Local mode meets the rows in their order anyway, so the plan has to show the keys."""
    theirs = "FROM orders WHERE o_custkey = c_custkey"
    first = f"SELECT c_custkey, (SELECT o_orderkey {theirs} ORDER BY o_totalprice DESC, o_orderkey) AS best FROM customer"
    for text, keys in (
        (first, ("DESC NULLS FIRST", "ASC NULLS LAST")),
        (f"SELECT c_custkey, (SELECT o_orderkey {theirs} ORDER BY o_totalprice, 1 LIMIT 1 OFFSET 2) AS third FROM customer", ("ASC NULLS LAST", "ASC NULLS LAST")),
        (f"SELECT c_custkey, (SELECT o_orderstatus {theirs} GROUP BY o_orderstatus ORDER BY COUNT(*) DESC LIMIT 1) AS most FROM customer", ("DESC NULLS FIRST",)),
        (f"SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT o_orderkey % 25 {theirs} ORDER BY o_orderdate LIMIT 3)", ("ASC NULLS LAST",)),
        (f"SELECT c_custkey FROM customer WHERE 300000.0 < ANY (SELECT o_totalprice {theirs} ORDER BY o_orderdate LIMIT 3)", ("ASC NULLS LAST",)),
    ):
        assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L, " + ", ".join(rf"\w+#\d+L? {k}" for k in keys) + ", specified", plan(tpch, text)), text
    best = {}
    for r in tpch.run("SELECT o_custkey, o_totalprice, o_orderkey FROM orders").rows:
        best[r["o_custkey"]] = min(best.get(r["o_custkey"], (0.0, None)), (-r["o_totalprice"], r["o_orderkey"]))
    found = tpch.run(first).rows
    assert len(found) == 150 and all(r["best"] == best.get(r["c_custkey"], (0, None))[1] for r in found)


def test_a_cte_of_two_references_is_computed_once(spark, tpch):
    text = "WITH c AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM c a JOIN c b ON a.n = b.n AND a.o_custkey < b.o_custkey"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange" in plan(tpch, text)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_keys_spare_distinct_and_outer_joins(spark):
    from quernlight.engine import Engine

    e = Engine(spark)
    for name, key in (("orders", ["o_orderkey"]), ("customer", ["c_custkey"])):
        e.register(name, spark.read.parquet(f"{DATA}/{name}.parquet"), primary_key=key)
    unread = "SELECT o_orderkey FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c_acctbal > 0.0"
    assert "Join" not in plan(e, unread) and len(e.run(unread).rows) == len(e.run("SELECT o_orderkey FROM orders").rows)
    assert "Join" in plan(e, "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
    assert "Join" in plan(e, "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_name IS NULL")
    assert "Join" in plan(e, "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_nationkey = o_custkey")
    assert "Join" in plan(e, "SELECT * FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
    assert "Aggregate" not in plan(e, "SELECT DISTINCT O_ORDERKEY, o_custkey FROM orders")
    assert "Aggregate" in plan(e, "SELECT DISTINCT o_custkey FROM orders")
