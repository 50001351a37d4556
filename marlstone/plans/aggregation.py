"""Grouping and aggregate functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import aggregates

from .registry import query, table


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY ALL"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("SELECT count(*) AS n, count(k) AS nk, CAST(sum(k) AS BIGINT) AS s, round(avg(k), 9) AS a, min(k) AS lo, max(k) AS hi FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer)")
def agg_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.nullif("c_nationkey", F.lit(3))
    return table(spark, sf_dir, "customer").select(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("nk"), aggregates.sum_("k").alias("s"), F.round(F.avg("k"), 9).alias("a"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query("SELECT count(*) AS n, sum(c_acctbal) AS s, coalesce(sum(c_acctbal), 0.0) AS t, avg(c_acctbal) AS a, min(c_name) AS lo FROM customer WHERE c_custkey < 0")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = table(spark, sf_dir, "customer").where("c_custkey < 0")
    return none.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"), aggregates.total("c_acctbal").alias("t"), F.avg("c_acctbal").alias("a"), F.min("c_name").alias("lo"))


@query("SELECT nullif(c_nationkey, 3) AS k, c_mktsegment AS seg, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2")
def group_multi_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k"), F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
def group_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    return grouped.where("n > 12 AND hi > 300000").select("o_custkey", "n", F.round(F.col("hi") - F.col("lo"), 2).alias("spread"))


@query("SELECT max(o_totalprice) AS hi FROM orders HAVING count(*) > 1000000000")
def having_without_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1000000000").select("hi")


@query("SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS big FROM orders GROUP BY 1")
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = aggregates.filtered("o_totalprice", F.col("o_totalprice") > 200000)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.round(F.sum(big), 2).alias("big"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey % 3 AS m FROM customer")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_nationkey") % 3).alias("m")).distinct()


@query("SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey")
def distinct_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()


@query("SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS d FROM orders GROUP BY 1")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count_distinct("o_custkey").alias("n"), F.sum_distinct(F.col("o_custkey") % 100).alias("d"))


@query("SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(nullif(n_name, 'NATION_3'), '|' ORDER BY n_nationkey) AS bars FROM nation GROUP BY 1")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = F.nullif("n_name", F.lit("NATION_3"))
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(aggregates.group_concat("n_name", "n_nationkey").alias("names"), aggregates.group_concat(bars, "n_nationkey", "|").alias("bars"))


@query("SELECT n_regionkey AS r, '[' || string_agg(coalesce(nullif(n_nationkey, 7)::VARCHAR, 'null'), ',' ORDER BY n_nationkey) || ']' AS a FROM nation GROUP BY 1")
def json_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(aggregates.json_group_array(F.nullif("n_nationkey", F.lit(7)), "n_nationkey", "int").alias("a"))


@query("""SELECT n_regionkey AS r, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS o FROM nation GROUP BY 1""")
def json_group_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(aggregates.json_group_object("n_name", "n_nationkey", "n_nationkey", "int").alias("o"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 7")
def group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(7)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def bare_column_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"), F.max("o_totalprice").alias("top"))


@query("SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).rollup("s", "p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).cube("s", "p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey AS r, count(*) * 2 + 1 AS odd, max(n_name) || '!' AS loud FROM nation GROUP BY 1")
def project_over_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("m"))
    return grouped.select("r", (F.col("n") * 2 + 1).alias("odd"), F.concat("m", F.lit("!")).alias("loud"))
