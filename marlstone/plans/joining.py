"""Joins of every kind, over two and more tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import joins

from .registry import query, table


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey + b.n_nationkey < 20")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey < b.n_regionkey AND a.n_nationkey + b.n_nationkey < 20")).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey") * 3, "full").select("c_custkey", "s_suppkey")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey > 3) FULL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) USING (k)")
def join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("b"))
    return joins.using(left, right, ["k"], "full")


@query("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
def join_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a"))
    return joins.natural(left, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")))


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier)")
def join_natural_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    return joins.natural(left, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("b")), "left")


@query("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "supplier").alias("a"), table(spark, sf_dir, "supplier").alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")).select(F.col("a.s_suppkey").alias("x"), F.col("b.s_suppkey").alias("y"))


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL""")
def join_chain5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    # Lines are added up by order before they meet the other tables: the join then moves one row for each order.
    per_order = lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.count(F.lit(1)).alias("m"))
    early = orders.where("o_orderdate < timestamp'1996-01-01'").select("o_orderkey", "o_custkey")
    joined = per_order.join(early, F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per_nation = joined.groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    named = per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.sum("m").alias("n"))


@query("SELECT n_nationkey, s.n FROM nation JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def join_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "nation").join(counted, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return joins.semi(table(spark, sf_dir, "customer"), done, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.anti(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 5) FROM supplier)")
def not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.nullif("s_nationkey", F.lit(5)).alias("k"))
    return joins.not_in(table(spark, sf_dir, "nation"), "n_nationkey", keys, "k").select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_in(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey").select("n_nationkey")


@query("SELECT n_nationkey, (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1) AS s_name FROM nation")
def scalar_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return joins.first_match(nation, supplier, "n_nationkey", "s_nationkey", [F.col("s_suppkey")]).select("n_nationkey", "s_name")
