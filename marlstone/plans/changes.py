"""Data changes and definitions: each query gives the table, or the rows, that a statement leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import dml
from marlstone.sources import tables
from marlstone.streaming import events as stream

from .registry import query, table


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, 'unnamed'")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    first = dml.insert(region, spark.createDataFrame([(100, "ATLANTIS")], "r_regionkey int, r_name string")).table
    return dml.insert(first, spark.createDataFrame([(101,)], "r_regionkey int"), {"r_name": F.lit("unnamed")}).table


@query("SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM region")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return dml.insert(table(spark, sf_dir, "region"), rows).table


def _new_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))


@query("SELECT * FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9 AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_or_ignore(table(spark, sf_dir, "region"), _new_regions(spark, sf_dir), ["r_regionkey"], [F.col("r_name")]).table


@query("SELECT * FROM region WHERE r_regionkey >= 9 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_or_replace(table(spark, sf_dir, "region"), _new_regions(spark, sf_dir), ["r_regionkey"], [F.col("r_name")]).table


@query("""SELECT coalesce(r_regionkey, n_nationkey) AS r_regionkey, CASE WHEN r_regionkey IS NULL THEN n_name WHEN n_nationkey > 1 THEN r_name || '/' || n_name ELSE r_name END AS r_name
          FROM region FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 9) ON r_regionkey = n_nationkey""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"r_name": F.concat(F.col("t.r_name"), F.lit("/"), F.col("excluded.r_name"))}
    return dml.upsert(table(spark, sf_dir, "region"), _new_regions(spark, sf_dir), ["r_regionkey"], sets, F.col("excluded.r_regionkey") > 1).table


@query("SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_nationkey < 9 AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def upsert_nothing_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(table(spark, sf_dir, "region"), _new_regions(spark, sf_dir), ["r_regionkey"], None).returning


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = dml.update(table(spark, sf_dir, "customer"), {"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("CHANGED")}, F.col("c_nationkey") == 3)
    return changed.table.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_nationkey = 4")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(table(spark, sf_dir, "customer"), {"c_acctbal": F.col("c_acctbal") * 2}, F.col("c_nationkey") == 4).returning.select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey, coalesce((SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1), n_name) AS n_name, n_regionkey FROM nation")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update_from(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), F.expr("t.n_nationkey = s.s_nationkey"), {"n_name": F.col("s.s_name")}, [F.col("s.s_suppkey")], ["n_nationkey"]).table


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN row_number() OVER (ORDER BY s_acctbal, s_suppkey) <= 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update_limited(table(spark, sf_dir, "supplier"), ["s_suppkey"], {"s_acctbal": F.lit(0.0)}, [F.col("s_acctbal"), F.col("s_suppkey")], 3).table


@query("SELECT * FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) > 10, FALSE)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(table(spark, sf_dir, "supplier"), F.nullif("s_nationkey", F.lit(3)) > 10).table


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey > 10")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(table(spark, sf_dir, "supplier"), F.col("s_nationkey") > 10).returning.select("s_suppkey")


@query("SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k > 4")
def delete_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete_limited(table(spark, sf_dir, "supplier"), ["s_suppkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 4).table.select("s_suppkey", "s_name")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1)")
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.orphans(table(spark, sf_dir, "nation"), ("n_regionkey",), table(spark, sf_dir, "region").where("r_regionkey > 1"), ("r_regionkey",)).select("n_nationkey")


@query("""SELECT 'CHECK balance' AS name, count(*) AS n FROM customer WHERE c_acctbal < 0
          UNION ALL SELECT 'NOT NULL c_nationkey', count(*) FROM customer WHERE c_nationkey = 3
          UNION ALL SELECT 'UNIQUE c_mktsegment', count(*) FROM customer""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return dml.Constraints(not_null=("c_nationkey", "c_custkey"), unique=(("c_mktsegment",), ("c_custkey",)), checks={"balance": F.col("c_acctbal") >= 0}).broken(rows)


@query("SELECT r_regionkey AS id, r_name, 'none' AS note FROM region WHERE r_regionkey <> 2")
def alter_and_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.Catalog(spark).load(sf_dir, ["region"])
    catalog.rename_column("region", "r_regionkey", "id")
    catalog.add_column("region", "note", "string", "none")
    catalog.begin()
    catalog.replace("region", dml.delete(catalog.table("region"), F.col("id") == 2).table)
    catalog.savepoint("s")
    catalog.drop_column("region", "r_name")
    catalog.rollback("s")
    catalog.commit()
    return catalog.table("region")


@query("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 3")
def view_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.Catalog(spark).load(sf_dir, ["nation"])
    catalog.create_view("big_regions", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 3")
    return catalog.sql("SELECT r, n FROM big_regions")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events"), "1 hour")
