"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marlstone.operators import windows

from .registry import query, table


def _by() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return _orders(spark, sf_dir).select("o_orderkey", F.row_number().over(_by()).cast("bigint").alias("rn"), F.rank().over(p).cast("bigint").alias("rk"), F.dense_rank().over(p).cast("bigint").alias("dr"))


@query("""SELECT o_orderkey, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(3) OVER w AS nt FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(F.percent_rank().over(p), 9).alias("pr"), F.round(F.cume_dist().over(p), 9).alias("cd"), F.ntile(3).over(_by()).cast("bigint").alias("nt"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.lag("o_totalprice").over(_by()).alias("before"), F.lead("o_totalprice", 2, -1.0).over(_by()).alias("after"))


@query("""SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def first_last_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.first("o_totalprice").over(_by()).alias("f"), F.last("o_totalprice").over(_by()).alias("l"), F.nth_value("o_totalprice", 2).over(_by()).alias("n"))


@query("""SELECT o_orderkey, count(*) OVER w AS c, round(sum(o_totalprice) OVER w, 2) AS s, round(avg(o_totalprice) OVER w, 6) AS a,
          min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def agg_over_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    price = "o_totalprice"
    return _orders(spark, sf_dir).select("o_orderkey", F.count(F.lit(1)).over(w).alias("c"), F.round(F.sum(price).over(w), 2).alias("s"), F.round(F.avg(price).over(w), 6).alias("a"), F.min(price).over(w).alias("lo"), F.max(price).over(w).alias("hi"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 2) AS s FROM orders")
def default_frame_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s,
          min(o_totalprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS lo, max(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "o_totalprice"
    return _orders(spark, sf_dir).select("o_orderkey", F.round(F.sum(price).over(_by().rowsBetween(-2, 1)), 2).alias("s"), F.min(price).over(_by().rowsBetween(1, 3)).alias("lo"), F.max(price).over(_by().rowsBetween(0, windows.FOLLOWING)).alias("hi"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
def range_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = windows.with_group_rank(table(spark, sf_dir, "part"), ["p_brand"], ["p_size"])
    return ranked.select("p_partkey", F.sum("p_partkey").over(windows.groups(["p_brand"], -1, 1)).alias("s"))


@query("SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def groups_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = windows.with_group_rank(table(spark, sf_dir, "part"), ["p_brand"], ["p_size"])
    return ranked.select("p_partkey", F.sum("p_partkey").over(windows.groups(["p_brand"], windows.PRECEDING, 0)).alias("s"))


@query("""SELECT p_partkey, CAST(sum(p_size) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s,
          count(p_size) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS c, max(p_size) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS hi
          FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def exclude_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-2, 2)
    return table(spark, sf_dir, "part").select("p_partkey", windows.sum_excluding_current("p_size", frame).alias("s"), windows.count_excluding_current("p_size", frame).alias("c"), windows.extreme_excluding_current("max", "p_size", ["p_brand"], ["p_partkey"], -2, 2).alias("hi"))


@query("""SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS g,
          CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS BIGINT) AS t FROM part""")
def exclude_group_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(windows.PRECEDING, 0)
    peers = Window.partitionBy("p_brand", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", windows.sum_excluding_peers("p_partkey", frame, peers).alias("g"), windows.sum_excluding_peers("p_partkey", frame, peers, True).alias("t"))


@query("SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) AS s FROM orders")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return _orders(spark, sf_dir).select("o_orderkey", F.round(F.sum(done).over(Window.partitionBy("o_custkey")), 2).alias("s"))


@query("""SELECT o_custkey, rn, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
          WHERE rn <= 2 ORDER BY o_custkey, rn LIMIT 50""")
def window_topk_outer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _orders(spark, sf_dir).select("o_custkey", rn.cast("bigint").alias("rn"), "o_orderkey").where("rn <= 2").orderBy("o_custkey", "rn").limit(50)


@query("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def count_distinct_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", windows.count_distinct_over("o_orderpriority", ["o_custkey"]).alias("n"))


@query("SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names FROM nation")
def group_concat_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("names"))
