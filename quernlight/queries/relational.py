"""Queries in the dialect's SQL.

Each has its text, and the DuckDB text where that must differ: other functions, casts of sums (which are wider there),
null order, or a construct that the dialect lacks. Sums of doubles are rounded on both sides, as their order varies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def engine_over(spark: SparkSession, sf_dir: str, names=TABLES) -> Engine:
    engine = Engine(spark)
    for name in names:
        engine.load(f"{sf_dir}/{name}.parquet", name)
    return engine


_NATION_OF = "(SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS maybe FROM nation)"

#: name -> text, or (text, DuckDB text)
SQL: dict[str, str | tuple[str, str]] = {
    # -- analytical queries over the star schema
    "q1_pricing_summary": (
        """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base,
                  ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
                  ROUND(AVG(l_quantity), 4) AS avg_qty, COUNT(*) AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
                  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
                  round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY ALL""",
    ),
    "q3_shipping_priority": (
        """SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
           FROM customer, orders, lineitem
           WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
             AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
           GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
           FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
           WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
           GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    ),
    "q5_local_supplier": """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name""",
    "q6_forecast_revenue": """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue, COUNT(*) AS n FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "q10_returned_items": """SELECT c_custkey, c_name, n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q14_promo_share": """SELECT ROUND(100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / SUM(l_extendedprice * (1 - l_discount)), 4) AS promo_share
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-12-01 00:00:00'""",
    "q17_small_quantity": """SELECT ROUND(SUM(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#1' AND l_quantity < (SELECT 0.4 * AVG(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""",
    "q18_large_orders": """SELECT o_orderkey, o_custkey, ROUND(SUM(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY o_orderkey, o_custkey""",
    "q19_or_branches": """SELECT ROUND(SUM(l_extendedprice), 2) AS revenue, COUNT(*) AS n FROM lineitem JOIN part
        ON (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11) OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 10 AND 20)""",
    "q22_idle_customers": """SELECT c_nationkey, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM customer
        WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey""",
    # -- projection and scalar functions
    "proj_arith_safe": (
        """SELECT o_orderkey, o_custkey * 2147483647 AS wide, o_custkey + o_orderkey AS added, -o_custkey AS minus, o_custkey / (o_custkey % 3) AS ratio, o_orderkey % (o_custkey % 4) AS rest, o_totalprice * 2 - 1 AS price FROM orders""",
        """SELECT o_orderkey, o_custkey * 2147483647 AS wide, o_custkey + o_orderkey AS added, -o_custkey AS minus, o_custkey::DOUBLE / nullif(o_custkey % 3, 0) AS ratio, o_orderkey % nullif(o_custkey % 4, 0) AS rest, o_totalprice * 2 - 1 AS price FROM orders""",
    ),
    "proj_single_row": ("SELECT 1 AS one, 'it''s' AS text, 2.5 AS half, TRUE AS yes, 3000000000 AS big", "SELECT 1 AS one, 'it''s' AS text, CAST(2.5 AS DOUBLE) AS half, TRUE AS yes, 3000000000 AS big"),
    "proj_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "from_first": "FROM nation WHERE n_regionkey = 1",
    "case_simple": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS kind FROM customer",
    "case_searched": "SELECT c_custkey, CASE WHEN c_acctbal < 0.0 THEN -1 WHEN c_acctbal < 1000.0 THEN 0 END AS band FROM customer",
    "cast_matrix": (
        "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS DOUBLE) AS d, CAST(p_name AS INT) AS bad, CAST('1.9' AS INT) AS cut, CAST(p_size AS VARCHAR) AS t, CAST('2020-01-31' AS DATE) AS day, CAST(p_retailprice AS DECIMAL) AS money FROM part",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(p_size AS DOUBLE) AS d, TRY_CAST(p_name AS INTEGER) AS bad, 1 AS cut, CAST(p_size AS VARCHAR) AS t, DATE '2020-01-31' AS day, CAST(p_retailprice AS DECIMAL(18,2)) AS money FROM part",
    ),
    "string_fns": (
        "SELECT c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS n, SUBSTRING(c_name, 3, 4) AS s, SUBSTRING(c_name FROM 2 FOR 3) AS f, REPLACE(c_name, 'C', 'K') AS r, TRIM('  ' || c_name || ' ') AS t, TRIM(LEADING 'C' FROM c_name) AS lead, c_name || '-' || c_custkey AS j FROM customer",
        "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, CAST(length(c_name) AS INTEGER) AS n, substr(c_name, 3, 4) AS s, substr(c_name, 2, 3) AS f, replace(c_name, 'C', 'K') AS r, trim('  ' || c_name || ' ') AS t, ltrim(c_name, 'C') AS lead, c_name || '-' || c_custkey AS j FROM customer",
    ),
    "math_fns": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r, ROUND(-2.5) AS half, ROUND(c_acctbal, 1) AS one, SQRT(ABS(c_acctbal)) AS q FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, CAST(-2 AS DOUBLE) AS half, floor(c_acctbal * 10 + 0.5) / 10 AS one, sqrt(abs(c_acctbal)) AS q FROM customer",
    ),
    "conditional_fns": (
        "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, IS_TRUE(c_acctbal > 0.0) AS pos, IS_FALSE(NULLIF(c_acctbal > 0.0, TRUE)) AS neg FROM customer",
        "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, (c_acctbal > 0) IS TRUE AS pos, nullif(c_acctbal > 0, TRUE) IS FALSE AS neg FROM customer",
    ),
    "date_fns": (
        "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(SECOND FROM o_orderdate) AS s, o_orderdate + INTERVAL '1' MONTH AS later, CAST(o_orderdate AS DATE) + 30 AS plus, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS days, DATE '2020-01-31' + INTERVAL '1' MONTH AS clamped FROM orders",
        "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m, CAST(extract(second FROM o_orderdate) AS INTEGER) AS s, o_orderdate + INTERVAL 1 MONTH AS later, CAST(o_orderdate AS DATE) + 30 AS plus, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days, DATE '2020-02-29' AS clamped FROM orders",
    ),
    # -- predicates
    "pred_compare": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000.0 AND o_orderstatus <> 'F' AND o_custkey != 7 AND NOT o_custkey > 900",
    "pred_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)",
    "pred_like": (r"SELECT p_partkey, p_name LIKE '%a_e%' AS has, p_type LIKE 'a\b%' AS slash FROM part WHERE p_type NOT LIKE 'PROMO%'", r"SELECT p_partkey, p_name LIKE '%a_e%' AS has, FALSE AS slash FROM part WHERE p_type NOT LIKE 'PROMO%'"),
    "pred_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 50000.0 AND o_orderdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-01-01 00:00:00'",
    "pred_is_true": f"SELECT n_nationkey, (maybe > 2) IS TRUE AS t, (maybe > 2) IS NOT FALSE AS f, maybe IS NULL AS n FROM {_NATION_OF} x",
    "pred_3vl": f"SELECT n_nationkey, maybe IN (1, NULL) AS i, maybe NOT IN (1, 2) AS o, maybe = 1 OR maybe IS NULL AS e, NOT (maybe = 1 AND n_nationkey > 3) AS a, maybe BETWEEN 1 AND NULL AS b FROM {_NATION_OF} x",
    "pred_literal_coercion": (
        "SELECT c_custkey FROM customer WHERE c_custkey < '50' AND c_acctbal > '0'",
        "SELECT c_custkey FROM customer WHERE c_custkey < 50 AND c_acctbal > 0",
    ),
    # -- joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000.0",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u ON o_custkey = c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000.0) u RIGHT OUTER JOIN customer ON o_custkey = c_custkey",
    "join_full": "SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_nationkey > 9) b ON a.c_custkey = b.c_custkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "join_using": "SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)",
    "join_natural": "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r",
    "join_natural_left": "SELECT n_nationkey, r_name FROM nation NATURAL LEFT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region WHERE r_regionkey < 3) r",
    "join_natural_right": "SELECT n_name, r_name FROM (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 4) n NATURAL RIGHT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r",
    "join_natural_full": "SELECT n_name, r_name FROM (SELECT n_regionkey, n_name FROM nation WHERE n_regionkey > 1) n NATURAL FULL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region WHERE r_regionkey < 4) r",
    "join_comma": "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey",
    "join_or_common": "SELECT COUNT(*) AS n FROM orders o JOIN customer c ON (o_custkey = c_custkey AND c_nationkey = 1) OR (o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_null_keys": f"SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {_NATION_OF} a LEFT JOIN {_NATION_OF} b ON a.maybe = b.maybe AND b.n_nationkey < 4",
    # -- subqueries
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000.0)",
    "anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "in_subq": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "not_in_subq_null": f"SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT maybe FROM {_NATION_OF} x WHERE n_nationkey < 3)",
    "any_subq": "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)",
    "some_subq": "SELECT c_custkey FROM customer WHERE c_nationkey = SOME (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0)",
    "all_subq": "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)",
    "exists_under_or": "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000.0)",
    "exists_as_value": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS open FROM customer",
    "any_as_value": f"SELECT r_regionkey, r_regionkey > ANY (SELECT maybe FROM {_NATION_OF} x WHERE n_nationkey < 8) AS some_, r_regionkey < ALL (SELECT maybe FROM {_NATION_OF} y WHERE n_nationkey < 4) AS all_, r_regionkey IN (SELECT maybe FROM {_NATION_OF} z WHERE n_nationkey < 3) AS in_, r_regionkey NOT IN (SELECT maybe FROM {_NATION_OF} w WHERE n_nationkey < 3) AS out_ FROM region",
    "scalar_corr_count": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS n FROM customer",
    "scalar_uncorrelated": "SELECT s_suppkey, s_acctbal > (SELECT AVG(s_acctbal) FROM supplier) AS rich FROM supplier",
    "scalar_first_row": "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer",
    "scalar_single_match": (
        "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation",
        "SELECT n_name, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    ),
    "scalar_outer_in_agg": (
        "SELECT n_nationkey, (SELECT SUM(s_nationkey + n_regionkey) FROM supplier WHERE s_nationkey = n_nationkey) AS total FROM nation",
        "SELECT n_nationkey, CAST(sum(s_nationkey + n_regionkey) AS BIGINT) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    ),
    "having_scalar_subq": "SELECT c_nationkey, COUNT(*) AS n FROM customer c GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey) * 10",
    "corr_non_equi": "SELECT n_nationkey, (SELECT COUNT(*) FROM region WHERE r_regionkey > n_regionkey) AS above FROM nation",
    "subq_limit": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)",
    "subq_window": "SELECT o_orderkey FROM orders o WHERE o_totalprice IN (SELECT MAX(x.o_totalprice) OVER (PARTITION BY x.o_custkey) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "subq_setop": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000.0)",
    "grouped_corr_scalar": "SELECT c_nationkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation, COUNT(*) AS n FROM customer GROUP BY c_nationkey",
    "grouped_corr_alias": "SELECT c.c_mktsegment AS seg, (SELECT COUNT(*) FROM customer d WHERE d.c_mktsegment = c.c_mktsegment AND d.c_acctbal > 0.0) AS paid, COUNT(*) AS n FROM customer c GROUP BY c.c_mktsegment ORDER BY n DESC, seg",
    "having_any_agg": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > ANY (SELECT COUNT(*) * 3 FROM supplier GROUP BY s_nationkey)",
    "select_any_agg": "SELECT o_custkey, COUNT(*) > ANY (SELECT n_regionkey + 8 FROM nation WHERE n_nationkey = o_custkey) AS more, COUNT(*) >= ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 9) AS most FROM orders GROUP BY o_custkey",
    "having_exists_agg": (
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING EXISTS (SELECT 1 FROM nation WHERE n_nationkey = COUNT(*) AND n_regionkey < 3)",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    ),
    "order_by_corr": "SELECT n_nationkey, n_name FROM nation ORDER BY (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) DESC, n_nationkey LIMIT 7",
    "order_by_corr_grouped": "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) DESC LIMIT 6",
    "join_on_any": "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > ANY (SELECT s_nationkey FROM supplier WHERE s_nationkey > r_regionkey + 10)",
    "cte_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey FROM big WHERE n > 12)",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE n > 10",
    "cte_multi": "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey, total FROM big WHERE total > 1000000.0) SELECT c_name, ROUND(total, 2) AS total FROM top JOIN customer ON c_custkey = o_custkey",
    "cte_cols": "WITH x(k, n) AS (SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey) SELECT a.k AS k, a.n + b.n AS both_ FROM x a JOIN x b ON a.k = b.k",
    # -- aggregation
    "agg_basic": (
        "SELECT l_returnflag, SUM(l_linenumber) AS s, COUNT(l_partkey) AS c, AVG(l_linenumber) AS a, MIN(l_shipdate) AS lo, MAX(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_partkey) AS c, avg(l_linenumber) AS a, min(l_shipdate) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_distinct": (
        "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, MAX(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a, max(l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_empty": ("SELECT COUNT(*) AS n, COUNT(n_name) AS c, SUM(n_nationkey) AS s, AVG(n_nationkey) AS a, MIN(n_name) AS lo FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n, count(n_name) AS c, CAST(sum(n_nationkey) AS BIGINT) AS s, avg(n_nationkey) AS a, min(n_name) AS lo FROM nation WHERE n_nationkey < 0"),
    "agg_null_group": f"SELECT maybe, COUNT(*) AS n, COUNT(maybe) AS c FROM {_NATION_OF} x GROUP BY maybe",
    "group_expr": ("SELECT EXTRACT(YEAR FROM o_orderdate) AS y, o_custkey % 2 AS odd, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), o_custkey % 2", "SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_custkey % 2 AS odd, count(*) AS n FROM orders GROUP BY ALL"),
    "group_ordinal": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2",
    "group_alias": ("SELECT n_nationkey % 3 AS n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT CAST(n_nationkey % 3 AS BIGINT) AS n_regionkey, count(*) AS n FROM nation GROUP BY n_nationkey % 3"),
    "group_zero_nan": (
        "SELECT CASE WHEN x > 100.0 THEN -1.0 ELSE x + 0.0 END AS x, COUNT(*) AS n FROM (SELECT CASE n_regionkey WHEN 0 THEN 0.0 WHEN 1 THEN -0.0 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE 1.0 END AS x FROM nation) v GROUP BY x",
        "SELECT CASE WHEN x > 100 THEN CAST(-1 AS DOUBLE) ELSE x END AS x, count(*) AS n FROM (SELECT CASE n_regionkey WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS x FROM nation) v GROUP BY ALL",
    ),
    "having_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000.0",
    "having_noagg": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'P'",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    # -- windows
    "win_rank_family": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d FROM orders",
    "win_lag_lead_default": "SELECT event_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before, LEAD(event_type, 2, 'end') OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events",
    "win_running": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts) AS n, MIN(value) OVER (PARTITION BY user_id ORDER BY ts) AS lo, MAX(value) OVER (PARTITION BY user_id) AS hi FROM events",
    "win_rows_bounded": "SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS hi, COUNT(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS n, MIN(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS later FROM events",
    "win_range_offset": "SELECT s_suppkey, COUNT(*) OVER (ORDER BY s_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near, COUNT(*) OVER (ORDER BY s_nationkey DESC RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS peers FROM supplier",
    "win_groups": (
        "SELECT c_custkey, COUNT(*) OVER (ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, MIN(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC GROUPS 2 PRECEDING) AS lo FROM customer",
        "SELECT c_custkey, count(*) OVER (ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, min(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS lo FROM customer",
    ),
    "win_over_agg": (
        "SELECT o_custkey, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total, RANK() OVER (ORDER BY COUNT(*) DESC) AS place FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, rank() OVER (ORDER BY count(*) DESC) AS place FROM orders GROUP BY o_custkey",
    ),
    "win_groups_over_agg": (
        "SELECT c_nationkey, SUM(COUNT(*)) OVER (ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, CAST(sum(count(*)) OVER (ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two FROM customer GROUP BY c_nationkey",
    ),
    "win_empty_frame": (
        f"SELECT n_nationkey, SUM(n_regionkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS s, COUNT(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) AS n FROM nation",
        "SELECT n_nationkey, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) AS n FROM nation",
    ),
    "win_null_order": (
        f"SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY maybe, n_nationkey) AS up, ROW_NUMBER() OVER (ORDER BY maybe DESC, n_nationkey) AS down FROM {_NATION_OF} x",
        f"SELECT n_nationkey, row_number() OVER (ORDER BY maybe NULLS LAST, n_nationkey) AS up, row_number() OVER (ORDER BY maybe DESC NULLS FIRST, n_nationkey) AS down FROM {_NATION_OF} x",
    ),
    "win_order_by": "SELECT o_orderkey, o_custkey FROM orders ORDER BY ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) LIMIT 10",
    # -- order, limit
    "sort_nulls": (
        f"SELECT n_nationkey, maybe FROM {_NATION_OF} x ORDER BY maybe DESC, n_nationkey LIMIT 8",
        f"SELECT n_nationkey, maybe FROM {_NATION_OF} x ORDER BY maybe DESC NULLS FIRST, n_nationkey LIMIT 8",
    ),
    "sort_explicit_nulls": f"SELECT n_nationkey, maybe FROM {_NATION_OF} x ORDER BY maybe NULLS FIRST, n_nationkey DESC LIMIT 7",
    "topn_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15",
    "order_distinct": "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3",
    "fetch_first": ("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 12 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12"),
    "order_unselected_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, MAX(o_totalprice) DESC, o_custkey LIMIT 10",
    # -- set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000.0 INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_nulls": f"SELECT maybe AS k FROM {_NATION_OF} x UNION SELECT r_regionkey FROM region INTERSECT SELECT maybe FROM {_NATION_OF} y",
    "setop_precedence": "SELECT 1 AS k UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 1",
    "setop_parens": "(SELECT 1 AS k UNION SELECT 2) INTERSECT (SELECT 2 UNION ALL SELECT 3)",
    "setop_tail": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region ORDER BY name DESC LIMIT 9 OFFSET 2",
    # -- text columns of the corpus
    "text_fns_documents": (
        "SELECT doc_id, LENGTH(text) AS n, UPPER(SUBSTRING(lang, 1, 1)) || lang AS tag, text LIKE '%License%' AS licensed FROM documents WHERE lang IN ('en', 'de')",
        "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, upper(substr(lang, 1, 1)) || lang AS tag, text LIKE '%License%' AS licensed FROM documents WHERE lang IN ('en', 'de')",
    ),
}


def _used(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", text)]


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, _used(text)).sql(text).df

    return run


QUERIES = {name: _query(text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
ORACLE_SQL = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}
