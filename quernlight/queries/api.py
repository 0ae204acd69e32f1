"""Queries through the Python API: frames, parameters, statements, loaders, ingest, functions and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as Q
from ..engine import Engine
from ..operators import joins, partitioning, sketches
from ..session import scratch_path
from .relational import engine_over

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5 AND c_nationkey <> 3")
def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ["customer"]).sql("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = $1 AND c_acctbal > :2 AND c_nationkey <> $3", ["BUILDING", 100.5, 3]).df


@query("SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 5")
def ctas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ["customer"])
    e.run("CREATE TABLE counts AS SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
    return e.sql("SELECT k, n FROM counts WHERE n > 5").df


@query("SELECT n_nationkey, CAST(0 AS BIGINT) AS n FROM nation")
def create_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is there but empty beside one that has rows, and one that a second definition replaced."""
    e = engine_over(spark, sf_dir, ["nation", "region"])
    e.run("CREATE TABLE IF NOT EXISTS fresh (k INT, name VARCHAR, price DECIMAL(10, 2))")
    e.run("CREATE TABLE IF NOT EXISTS fresh (other INT)")
    e.run("DROP TABLE IF EXISTS absent")
    e.run("DROP TABLE region")
    e.run("CREATE TABLE region (r_regionkey BIGINT)")
    return e.sql("SELECT n_nationkey, COUNT(k) + COUNT(r_regionkey) AS n FROM nation LEFT JOIN fresh ON k = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY n_nationkey").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nation") + ".csv"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.csv(path, header=True)
    e = engine_over(spark, sf_dir, [])
    e.load(path, "nation")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation").df


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "region") + ".json"
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))  # a region table has a handful of rows
    rows.coalesce(1).write.text(path)
    e = engine_over(spark, sf_dir, [])
    e.load(path, "region")
    return e.sql("SELECT r_regionkey, r_name FROM region").df


@query("SELECT * FROM (VALUES (1, 1.5, 'a'), (2, 2.0, NULL), (3000000000, NULL, 'c')) t(id, price, name)".replace("(1, 1.5", "(CAST(1 AS BIGINT), CAST(1.5 AS DOUBLE)"))
def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, [])
    e.register_batches("t", iter([[{"id": 1, "price": 1.5, "name": "a"}, {"id": 2, "price": 2}], [], [{"id": 3_000_000_000, "price": None, "name": "c"}]]))
    return e.sql("SELECT id, price, name FROM t").df


@query("SELECT * FROM (VALUES (1, 'x', TRUE), (2, NULL, FALSE)) t(k, v, b)")
def rows_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, [])
    e.register_table("a", [{"k": 1, "v": "x"}, {"k": 2, "v": None}])
    e.register_columns("b", {"k": [1, 2], "b": [True, False]})
    return e.sql("SELECT a.k AS k, v, b FROM a JOIN b ON a.k = b.k").df


@query("SELECT n_nationkey, upper(n_name) || '!' AS loud, n_nationkey * 2 + 1 AS odd FROM nation".replace("n_nationkey * 2 + 1", "CAST(n_nationkey * 2 + 1 AS BIGINT)"))
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ["nation"])
    e.register_function("SHOUT", lambda s: None if s is None else s.upper() + "!", "VARCHAR", 1)
    e.register_function("ODD", lambda s: s * 2 + 1, "BIGINT", 1, vectorized=True)
    return e.sql("SELECT n_nationkey, SHOUT(n_name) AS loud, ODD(n_nationkey) AS odd FROM nation").df


@query("SELECT c_mktsegment AS seg, count(*) AS n, round(sum(c_acctbal * 2), 2) AS twice FROM customer WHERE c_nationkey BETWEEN 2 AND 20 AND c_mktsegment LIKE '%U%' GROUP BY 1")
def df_api_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine_over(spark, sf_dir, ["customer"]).table("customer")
    kept = t.filter(Q.col("c_nationkey").between(2, 20).and_(Q.col("c_mktsegment").like("%U%"))).with_column("twice", Q.col("c_acctbal").mul(2)).drop("c_name")
    made = kept.group_by(Q.col("c_mktsegment").alias("seg")).agg(Q.count_star().alias("n"), Q.sum("twice").alias("twice"))
    return made.select("seg", "n", Q.expr("ROUND(twice, 2)").alias("twice")).order_by(Q.col("n").desc()).df


@query(
    """SELECT coalesce(a.k, b.k) AS k, a.name, b.name AS name_1 FROM (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 15) a
       FULL JOIN (SELECT s_nationkey AS k, s_name AS name FROM supplier WHERE s_nationkey > 9) b ON a.k = b.k"""
)
def df_join_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ["nation", "supplier"])
    a = e.sql("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 15")
    b = e.sql("SELECT s_nationkey AS k, s_name AS name FROM supplier WHERE s_nationkey > 9")
    return a.join(b, "k", "FULL").df


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def df_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ["customer", "supplier"])
    return e.table("customer").select(Q.col("c_nationkey").alias("k")).union(e.table("supplier").select(Q.col("s_nationkey").alias("k"))).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def df_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine_over(spark, sf_dir, ["orders"]).table("orders")
    return t.select("o_orderkey", "o_totalprice").order_by("o_orderkey").order_by(Q.col("o_totalprice").desc(), "o_orderkey").limit(10, 5).df


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def df_self_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine_over(spark, sf_dir, ["customer"]).table("customer").filter("c_acctbal > 0.0")
    return t.sql("SELECT c_nationkey, COUNT(*) AS n FROM self GROUP BY c_nationkey").df


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def part_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.by_hash(spark.read.parquet(f"{sf_dir}/orders.parquet"), 3, "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS apart FROM orders")
def part_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = partitioning.with_partition(partitioning.by_range(spark.read.parquet(f"{sf_dir}/orders.parquet"), 4, "o_orderkey"))
    ranges = placed.groupBy("partition").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    pairs = ranges.alias("a").join(ranges.alias("b"), F.col("a.partition") < F.col("b.partition"), "left")
    return pairs.groupBy("a.partition", "a.n").agg(F.coalesce(F.min(F.col("a.hi") < F.col("b.lo")), F.lit(True)).alias("apart")).agg(F.sum("n").alias("n"), F.min("apart").alias("apart"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def part_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.round_robin(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 5).groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("s"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def part_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-by-status")
    partitioning.write_partitioned(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


def _pruned(name: str, kept: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, name)
        partitioning.write_partitioned(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), path, "c_nationkey")
        return spark.read.parquet(path).filter(kept).select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))

    run.__name__ = name
    query(f"SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer WHERE {kept}")(run)


for _name, _kept in (("part_pruned_range", "c_nationkey > 5 AND c_nationkey <= 9"), ("part_pruned_in", "c_nationkey IN (1, 3, 24)"), ("part_pruned_or", "c_nationkey = 2 OR c_nationkey >= 20")):
    _pruned(_name, _kept)


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_orderkey) AS a, max(o_totalprice) AS hi FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 2")
def eager_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the planner, once statistics say that orders is large (here: that it has any rows)."""
    e = Engine(spark, eager_rows=1)
    e.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    e.register("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), primary_key=["o_orderkey"])
    e.build_indexes(8)
    e.analyze("orders")
    return e.sql(
        """SELECT o_custkey, COUNT(*) AS n, SUM(o_orderkey) AS s, AVG(o_orderkey) AS a, MAX(o_totalprice) AS hi FROM orders JOIN customer ON c_custkey = o_custkey
           WHERE c_acctbal > 0.0 AND o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) > 2 ORDER BY n DESC"""
    ).df


def keyed_engine(spark: SparkSession, sf_dir: str, buckets: int = 8) -> Engine:
    """orders and lineitem in buckets by the order's key, in so many at least."""
    e = Engine(spark)
    e.register("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), primary_key=["o_orderkey"])
    e.register("lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet"), primary_key=["l_orderkey"])
    e.build_indexes(buckets)
    return e


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17")
def index_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_engine(spark, sf_dir).sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17").df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 40 AND 90")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_engine(spark, sf_dir).sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 40 AND 90").df


@query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def join_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_engine(spark, sf_dir).sql("SELECT o_orderstatus, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus").df


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def join_by_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with statistics, written in an order that would join the two largest first."""
    e = engine_over(spark, sf_dir, ["orders", "customer", "nation"])
    for name in ("orders", "customer", "nation"):
        e.run(f"CREATE TABLE {name}_ AS SELECT * FROM {name}")
        e.analyze(f"{name}_")
    return e.sql("SELECT n_name, COUNT(*) AS n FROM orders_ JOIN customer_ ON o_custkey = c_custkey JOIN nation_ ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name").df


@query("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey LIMIT 50")
def merge_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.merge_exchange(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_extendedprice"), "l_extendedprice", "l_orderkey", limit=50)


def _strategy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
        return joins.join_by(name, orders, customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))

    run.__name__ = f"join_{name}"
    return query("SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(run)


for _name in ("hash", "merge", "broadcast"):
    _strategy(_name)


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey > n_nationkey + 20")
def join_nested_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    return joins.join_by("nested_loop", s, n, s["s_nationkey"] > n["n_nationkey"] + 20).select("s_suppkey", "n_name")


@query("SELECT o_custkey, count(*) AS n FROM orders JOIN (SELECT c_custkey AS o_custkey, c_nationkey FROM customer) c USING (o_custkey) GROUP BY 1")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    right = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return joins.salted_join(orders.select("o_custkey", "o_orderkey"), right, "o_custkey", 4).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def eager_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    made = joins.eager_sum(orders, customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_nationkey"], "o_totalprice", "total")
    return made.select("c_nationkey", F.round("total", 2).alias("total"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 3) THEN TRUE END AS mark FROM nation")
def join_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    return joins.mark(nation, spark.createDataFrame([(1,), (3,), (None,)], "k int"), "n_nationkey", "k")


@query("SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    return joins.first_match(nation.select("n_nationkey"), supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), ["n_nationkey"], [F.col("s_suppkey")]).select("n_nationkey", "s_suppkey")


@query(
    """SELECT 'o_orderstatus' AS name, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, count(DISTINCT o_orderstatus) AS n_distinct, min(o_orderstatus) AS low, max(o_orderstatus) AS high,
       (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most FROM orders"""
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of so few values that the sketches count them exactly."""
    made = sketches.profile(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus"])
    return made.select("name", "n_rows", "n_null", "n_distinct", "low", "high", F.col("frequent")[0]["value"].alias("most"))


@query("SELECT TRUE AS distinct_near, TRUE AS bounds_near FROM orders LIMIT 1")
def statistics_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a column of many values: the estimated number within 10 % of the true one, the middle bound within 2 % of its rank."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = sketches.profile(orders, ["o_totalprice"], buckets=4)
    middle, about = made.select(F.col("bounds")[2]).scalar(), made.select("n_distinct").scalar()
    facts = orders.select("o_totalprice", (F.col("o_totalprice") <= middle).cast("int").alias("low")).agg(F.countDistinct("o_totalprice").alias("n"), F.avg("low").alias("share"))
    return facts.select((F.abs(about - F.col("n")) <= 0.1 * F.col("n")).alias("distinct_near"), (F.abs(F.col("share") - 0.5) <= 0.02).alias("bounds_near"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.round(sketches.correlated("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.heavy_hitters(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", 5)


@query("SELECT CAST(40 AS BIGINT) AS n, TRUE AS inside")
def fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    kept = sketches.fixed_sample(orders, 40, seed=3)
    return kept.join(orders.distinct(), "o_orderkey", "left_semi").agg(F.count("*").alias("n"), (F.count("*") == 40).alias("inside"))


@query("SELECT TRUE AS planned, CAST(5 AS BIGINT) AS n")
def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ["region"])
    plan = e.run("EXPLAIN SELECT * FROM region WHERE r_regionkey > 1").rows[0]["EXPLAIN_PLAN"]
    ran = e.run("EXPLAIN ANALYZE SELECT * FROM region").rows[0]["EXPLAIN_ANALYZE"]
    return spark.createDataFrame([("PushedFilters" in plan and "Execution Time" in ran, int(ran.rsplit("Rows Returned: ", 1)[1]))], "planned boolean, n bigint")


@query("SELECT count(*) AS n FROM events WHERE value > 1")
def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched in lists, by partition; here only their number is kept."""
    e = engine_over(spark, sf_dir, ["events"])
    n = sum(len(part) for part in e.stream("SELECT event_id FROM events WHERE value > 1.0"))
    return spark.createDataFrame([(n,)], "n bigint")
