"""Scans, projections, predicates, operators, sorting, limits, set operations, subqueries and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import core
from marlstone.operators import recursion, setops
from marlstone.sources import tables

from .registry import query, table


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount = 0.05")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_discount = 0.05D").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 100 OR o_orderkey BETWEEN 700 AND 900")
def scan_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 100 OR o_orderkey BETWEEN 700 AND 900").select("o_orderkey", "o_custkey")


@query("SELECT p_size FROM part WHERE p_size < 5 ORDER BY p_size")
def scan_covering_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_size").where("p_size < 5").orderBy("p_size")


@query("SELECT 1 AS one, 'a' AS letter, 2.5::DOUBLE AS real, NULL::BIGINT AS nothing, 1 AS yes, 255 AS hexed, 'ab'::BLOB AS bytes")
def constant_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_ = F.unhex(F.lit("6162"))
    return spark.range(1).select(F.lit(1).alias("one"), F.lit("a").alias("letter"), F.lit(2.5).alias("real"), F.lit(None).cast("bigint").alias("nothing"), core.truth(F.lit(True)).cast("int").alias("yes"), F.lit(0xFF).alias("hexed"), bytes_.alias("bytes"))


@query("SELECT * FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v(column1, column2)")
def values_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.values(spark, [(1, "x"), (2, None), (3, "z")], "int", "string")


@query("SELECT 'table' AS type, name, name AS tbl_name FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) AS v(name)")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Catalog(spark).load(sf_dir).schema_table().select("type", "name", "tbl_name")


@query("""SELECT 'nation' AS "table", column_index::INT AS cid, column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'INTEGER' ELSE 'TEXT' END AS type
          FROM (VALUES (0, 'n_nationkey', 'INTEGER'), (1, 'n_name', 'VARCHAR'), (2, 'n_regionkey', 'INTEGER')) AS v(column_index, column_name, data_type)""")
def pragma_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Catalog(spark).load(sf_dir).table_info("nation").select(F.lit("nation").alias("table"), "cid", "name", "type")


@query("SELECT c_custkey, c_name AS name, c_acctbal * 2 AS doubled FROM customer")
def project_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("doubled"))


@query("SELECT r.*, r_regionkey + 1 AS next FROM region r")
def project_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").alias("r").select("r.*", (F.col("r_regionkey") + 1).alias("next"))


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey - 3000) // l_linenumber AS q, (l_orderkey - 3000) % l_linenumber AS r,
          (l_orderkey - 3000) // nullif(l_linenumber - 1, 0) AS q0, (l_orderkey - 3000) % nullif(l_linenumber - 1, 0) AS r0 FROM lineitem""")
def int_div_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("l_orderkey") - 3000, F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", core.int_divide(n, d).alias("q"), core.modulo(n, d).alias("r"), core.int_divide(n, d - 1).alias("q0"), core.modulo(n, d - 1).alias("r0"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 5 AS o, ~l_orderkey AS n, l_orderkey << l_linenumber AS l, l_orderkey >> l_linenumber AS r FROM lineitem""")
def bit_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(k, n, core.bit_and(k, F.lit(12)).alias("a"), core.bit_or(k, F.lit(5)).alias("o"), core.bit_not(k).alias("n"), core.shift_left(k, n).alias("l"), core.shift_right(k, n).alias("r"))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, c_name || nullif(c_mktsegment, 'BUILDING') AS maybe FROM customer")
def concat_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("joined"), F.concat("c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("maybe"))


@query("""SELECT c_custkey, (b AND a)::INT::BIGINT AS both, (b OR a)::INT::BIGINT AS either, (NOT b)::INT::BIGINT AS no FROM
          (SELECT c_custkey, c_acctbal > 0 AS a, nullif(c_nationkey, 3) > 10 AS b FROM customer)""")
def null_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_acctbal") > 0, F.nullif("c_nationkey", F.lit(3)) > 10
    return table(spark, sf_dir, "customer").select("c_custkey", core.truth(b & a).alias("both"), core.truth(b | a).alias("either"), core.truth(~b).alias("no"))


@query("SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) WHERE k IS NOT DISTINCT FROM NULL OR k IS NOT DISTINCT FROM 7")
def is_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.nullif("c_nationkey", F.lit(3))
    return table(spark, sf_dir, "customer").where(core.is_(k, F.lit(None)) | core.is_(k, F.lit(7))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 1000 AND p_size NOT BETWEEN 10 AND 40")
def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").where(price.between(900, 1000) & ~size.between(10, 40)).select("p_partkey")


@query("""SELECT doc_id, (translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the a_%')::INT::BIGINT AS hit FROM documents""")
def like_ascii_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", core.truth(core.like("text", "%THE A_%")).alias("hit"))


@query("SELECT count(*) AS n FROM events WHERE event_type LIKE '%!_%' ESCAPE '!' OR props LIKE '%7}'")
def like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(core.like("event_type", "%!_%", escape="!") | core.like("props", "%7}")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand GLOB 'Brand#[1-3]?' OR p_type GLOB 'S[!M]*'")
def glob_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(core.glob("p_brand", "Brand#[1-3]?") | core.glob("p_type", "S[^M]*")).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{4}')")
def regexp_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.rlike("text", F.lit("[0-9]{4}"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS simple,
          CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS searched FROM orders""")
def case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    simple = F.when(status == "F", 1).when(status == "O", 2).otherwise(0)
    searched = F.when(price > 200000, "high").when(price > 100000, "mid")
    return table(spark, sf_dir, "orders").select("o_orderkey", simple.alias("simple"), searched.alias("searched"))


@query("""SELECT p_partkey, CAST(regexp_extract(p_size || 'cm', '^[0-9]+') AS BIGINT) AS size, CAST(regexp_extract(p_retailprice || ' EUR', '^[0-9.]+') AS DOUBLE) AS price,
          CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS VARCHAR) AS shown, 0::BIGINT AS none FROM part""")
def cast_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.concat(F.col("p_size").cast("string"), F.lit("cm")), F.concat(F.col("p_retailprice").cast("string"), F.lit(" EUR"))
    return table(spark, sf_dir, "part").select("p_partkey", core.cast_as(size, "INTEGER", "string").alias("size"), core.cast_as(price, "REAL", "string").alias("price"), core.cast_as("p_retailprice", "INT", "double").alias("whole"), core.cast_as("p_size", "VARCHAR(5)", "int").alias("shown"), core.cast_as("p_name", "INTEGER", "string").alias("none"))


@query("SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey % 2) IN (SELECT n_nationkey, 1 FROM nation WHERE n_regionkey = 2)")
def row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", F.lit(1).cast("bigint").alias("odd"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(keys, (supplier.s_nationkey == keys.n_nationkey) & (supplier.s_suppkey % 2 == keys.odd), "left_semi").select("s_suppkey")


@query("SELECT lower(n_name) AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT lower(n_name) FROM nation) GROUP BY lower(n_name)")
def collate_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name")
    both = nation.union(nation.select(core.ascii_lower("n_name")))
    return both.groupBy(core.collate("n_name", "NOCASE").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rtrim(r_name || '  ') AS name, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT r_name || '   ' FROM region) GROUP BY rtrim(r_name || '  ')")
def collate_rtrim(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select("r_name")
    both = region.union(region.select(F.concat("r_name", F.lit("   "))))
    return both.groupBy(core.collate("r_name", "RTRIM").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT'")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT count(*) AS n FROM {orders} WHERE o_totalprice > :price AND o_orderpriority = :priority", args={"price": 150000, "priority": "1-URGENT"}, orders=table(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 4) AS k FROM customer) ORDER BY k ASC NULLS FIRST, c_custkey DESC LIMIT 20 OFFSET 5")
def order_nulls_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(4)).alias("k")).orderBy(F.asc_nulls_first("k"), F.desc("c_custkey")).offset(5).limit(20)


@query("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 4) AS k FROM customer) ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 15")
def order_nulls_first_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(4)).alias("k")).orderBy(F.desc_nulls_first("k"), "c_custkey").limit(15)


@query("SELECT p_name, p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 12")
def order_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", "p_partkey").orderBy(core.collate("p_name", "NOCASE"), "p_partkey").limit(12)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "customer"), ("union all", _keys(spark, sf_dir, "supplier")))


def _keys(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(f"{name[0]}_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT nullif(s_nationkey, 3) FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "customer"), ("union", _keys(spark, sf_dir, "supplier").select(F.nullif("k", F.lit(3)).alias("k"))))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "customer"), ("intersect", _keys(spark, sf_dir, "supplier")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "nation").select("k"), ("except", _keys(spark, sf_dir, "supplier")))


@query("SELECT k FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 20 FROM supplier) INTERSECT SELECT n_nationkey + 5 FROM nation) EXCEPT SELECT 7")
def compound_left_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, nation = (_keys(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return setops.compound(customer, ("union", supplier.select((F.col("k") + 20).alias("k"))), ("intersect", nation.select((F.col("k") + 5).alias("k"))), ("except", spark.range(1).select(F.lit(7).alias("k"))))


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k DESC LIMIT 4")
def compound_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "customer"), ("union", _keys(spark, sf_dir, "supplier"))).orderBy(F.desc("k")).limit(4)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS v FROM region UNION SELECT r_name FROM region")
def compound_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return setops.compound(region.select(F.col("r_regionkey").alias("v")), ("union", region.select("r_name")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT o_custkey % 25 FROM orders")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("k"))
    return setops.compound(_keys(spark, sf_dir, "customer").select(F.col("k").cast("bigint").alias("k")), ("intersect all", orders))


@query("SELECT c_nationkey::BIGINT AS k FROM customer EXCEPT ALL SELECT s_nationkey::BIGINT FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.compound(_keys(spark, sf_dir, "customer").select(F.col("k").cast("bigint").alias("k")), ("except all", _keys(spark, sf_dir, "supplier").select(F.col("k").cast("bigint").alias("k"))))


@query("SELECT a.seg, a.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) AS a WHERE a.n > 5")
def from_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("""WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), named(k, label) AS (SELECT c_custkey, c_name FROM customer)
          SELECT label, round(total, 2) AS total FROM big JOIN named ON k = o_custkey WHERE total > 300000""")
def cte_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    return big.where("total > 300000").join(named, F.col("k") == F.col("o_custkey")).select("label", F.round("total", 2).alias("total"))


@query("WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 30) SELECT n, f FROM t")
def recursive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 30) SELECT n, f FROM t")


@query("WITH RECURSIVE t(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (n * 7 + 3) % 25 FROM t) SELECT n FROM t")
def recursive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "nation").where("n_nationkey = 1").select(F.col("n_nationkey").alias("n"))
    return recursion.recursive(start, lambda t: t.select(((F.col("n") * 7 + 3) % 25).alias("n")), distinct=True)


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def corr_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}", orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


@query("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")
def uncorrelated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM {customer}) AS above FROM {customer}", customer=table(spark, sf_dir, "customer"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exists_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has FROM nation")
def in_subquery_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM {supplier}) AS has FROM {nation}", supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))
