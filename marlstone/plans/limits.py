"""Constraints and conflicts, counters, virtual tables, names of columns and other rules of the dialect as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import core, dates, jsons, math, text
from marlstone.operators import dml, windows
from marlstone.sources import virtual
from marlstone.sources.tables import Catalog, CatalogError

from . import explain
from .registry import query, table


def _limits() -> dml.Constraints:
    return dml.Constraints(not_null=("c_name",), unique=(("c_custkey",),), checks={"balance": F.col("c_acctbal") > -500})


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


def _newcomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made of the suppliers: some keys are taken, some names and some keys NULL, some balances too low."""
    key = F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 100_000_000)
    name = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(key.cast("bigint").alias("c_custkey"), name.alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


_NEW = """(SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000000 END AS c_custkey,
          CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS c_name, s_acctbal AS c_acctbal FROM supplier)"""


@query(f"""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > -500 UNION ALL
           SELECT * FROM {_NEW} n WHERE c_name IS NOT NULL AND c_acctbal > -500 AND (c_custkey IS NULL OR c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500))""")
def insert_or_ignore_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_checked(_customers(spark, sf_dir).where("c_acctbal > -500"), _newcomers(spark, sf_dir), _limits(), "IGNORE").table


@query(f"""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > -500 AND c_custkey NOT IN (SELECT c_custkey FROM {_NEW} WHERE c_custkey IS NOT NULL AND c_acctbal > -500)
           UNION ALL SELECT c_custkey, coalesce(c_name, 'unnamed'), c_acctbal FROM {_NEW} WHERE c_acctbal > -500""")
def insert_or_replace_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _newcomers(spark, sf_dir).where("c_acctbal > -500")
    return dml.insert_checked(_customers(spark, sf_dir).where("c_acctbal > -500"), new, _limits(), "REPLACE", defaults={"c_name": F.lit("unnamed")}).table


@query("SELECT conflict, 1::BIGINT AS failed, (SELECT count(*) FROM customer) AS n FROM (VALUES ('ABORT'), ('FAIL'), ('ROLLBACK')) v(conflict)")
def insert_or_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that breaks a constraint fails as a whole and leaves the table as it was."""
    catalog, found = Catalog(spark), []
    catalog.create_table("c", _customers(spark, sf_dir), constraints=dml.Constraints(unique=(("c_custkey",),)))
    for conflict in ("ABORT", "FAIL", "ROLLBACK"):
        failed = 0
        try:
            catalog.insert("c", _newcomers(spark, sf_dir), conflict)
        except dml.ConstraintError:
            failed = 1
        found.append((conflict, failed, catalog.table("c").count()))
    return spark.createDataFrame(found, "conflict string, failed bigint, n bigint")


@query("""SELECT CASE WHEN c_custkey % 3 = 0 AND (c_custkey + 1000000) NOT IN (SELECT c_custkey FROM customer) AND c_acctbal * 2 > -500 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name,
          CASE WHEN c_custkey % 3 = 0 AND c_acctbal * 2 > -500 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal > -500""")
def update_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"c_custkey": F.col("c_custkey") + 1_000_000, "c_acctbal": F.col("c_acctbal") * 2}
    return dml.update_checked(_customers(spark, sf_dir).where("c_acctbal > -500"), sets, _limits(), ["c_custkey"], F.col("c_custkey") % 3 == 0, "IGNORE").table


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT c_custkey + 1 FROM customer WHERE c_custkey % 2 = 0)
          UNION ALL SELECT c_custkey + 1, c_name FROM customer WHERE c_custkey % 2 = 0""")
def update_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = dml.Constraints(unique=(("c_custkey",),))
    return dml.update_checked(_customers(spark, sf_dir).select("c_custkey", "c_name"), {"c_custkey": F.col("c_custkey") + 1}, limits, ["c_custkey"], F.col("c_custkey") % 2 == 0, "REPLACE").table


@query("SELECT * FROM region UNION ALL SELECT 7, 'nowhere'")
def insert_default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_default(table(spark, sf_dir, "region"), {"r_regionkey": F.lit(7), "r_name": F.lit("nowhere")}).table


@query("""SELECT 1 AS step, 1::BIGINT AS changes, 1::BIGINT AS total, (SELECT count(*) + 1 FROM region) AS last UNION ALL
          SELECT 2, (SELECT count(*) FROM region WHERE r_regionkey < 3), 1 + (SELECT count(*) FROM region WHERE r_regionkey < 3), (SELECT count(*) + 1 FROM region) UNION ALL
          SELECT 3, 1, 2 + (SELECT count(*) FROM region WHERE r_regionkey < 3), (SELECT count(*) + 1 FROM region)""")
def change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, rows = Catalog(spark), []
    catalog.create_table("r", table(spark, sf_dir, "region"), defaults={"r_regionkey": F.lit(50)})
    steps = (lambda: catalog.insert("r", None), lambda: catalog.update("r", {"r_name": F.lit("x")}, ["r_regionkey"], F.col("r_regionkey") < 3), lambda: catalog.delete("r", F.col("r_regionkey") == 50))
    for k, step in enumerate(steps):
        step()
        rows.append((k + 1, catalog.changes, catalog.total_changes, catalog.last_insert_rowid))
    return spark.createDataFrame(rows, "step int, changes bigint, total bigint, last bigint")


@query("""SELECT 'rows' AS what, (SELECT count(*) FROM nation)::VARCHAR AS value UNION ALL SELECT 'orphan', 'FOREIGN KEY n_regionkey' UNION ALL
          SELECT 'off', (SELECT count(*) + 1 FROM nation)::VARCHAR UNION ALL SELECT 'after rollback', (SELECT count(*) FROM nation)::VARCHAR""")
def foreign_key_on_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.create_table("region", table(spark, sf_dir, "region"))
    catalog.create_table("nation", table(spark, sf_dir, "nation"))
    catalog.foreign["nation"] = [(("n_regionkey",), "region", ("r_regionkey",))]
    bad, rows = spark.createDataFrame([(99, "NEW", 77)], "n_nationkey int, n_name string, n_regionkey int"), []
    catalog.pragma("foreign_keys", "on")
    catalog.begin()
    message = ""
    try:
        catalog.insert("nation", bad)
    except dml.ConstraintError as e:
        message = str(e).split(" constraint")[0]
    rows += [("rows", str(catalog.table("nation").count())), ("orphan", message)]
    catalog.pragma("foreign_keys", 0)
    catalog.insert("nation", bad)
    rows.append(("off", str(catalog.table("nation").count())))
    catalog.rollback()
    rows.append(("after rollback", str(catalog.table("nation").count())))
    return spark.createDataFrame(rows, "what string, value string")


@query("SELECT n_nationkey + 1 AS \"n_nationkey + 1\", upper(n_name) AS \"upper(n_name)\", n_regionkey FROM nation")
def expression_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column without an alias is called like the text of its expression."""
    texts = ("n_nationkey + 1", "upper(n_name)", "n_regionkey")
    return table(spark, sf_dir, "nation").select([F.expr(t).alias(t) for t in texts])


@query("SELECT c_custkey FROM customer WHERE c_custkey > 3 ORDER BY c_custkey OFFSET 5")
def negative_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.limited(table(spark, sf_dir, "customer").where("c_custkey > 3").orderBy("c_custkey").select("c_custkey"), -1, 5)


@query("""WITH k AS (SELECT n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
          SELECT c_custkey, (SELECT max(x) FROM k)::BIGINT AS top FROM customer WHERE c_nationkey IN (SELECT x FROM k)""")
def cte_compound_in_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("x"))
    k = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("x")).union(rich).distinct()
    some = table(spark, sf_dir, "customer").join(k, F.col("c_nationkey") == F.col("x"), "left_semi")
    return some.join(F.broadcast(k.agg(F.max("x").cast("bigint").alias("top")))).select("c_custkey", "top")  # one row


@query("""SELECT n_regionkey, s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey, s_nationkey), (n_regionkey), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sets = [[F.col("n_regionkey"), F.col("s_nationkey")], [F.col("n_regionkey")], []]
    return joined.groupingSets(sets, F.col("n_regionkey"), F.col("s_nationkey")).agg(F.count(F.lit(1)).alias("n")).select("n_regionkey", "s_nationkey", "n")


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, abs(count(DISTINCT o_custkey) - approx) <= 0.1 * count(DISTINCT o_custkey) AS near FROM (SELECT *, count(DISTINCT o_custkey) OVER (PARTITION BY o_orderpriority) AS approx FROM orders) GROUP BY o_orderpriority, approx")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates within a tenth of the counts; the relative error is set to 0.02."""
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"), F.approx_count_distinct("o_custkey", 0.02).alias("about"))
    return counted.select("o_orderpriority", (F.abs(F.col("n") - F.col("about")) <= 0.1 * F.col("n")).alias("near"))


@query("""SELECT n_nationkey, '[' || string_agg('"' || n_name || '"', ',') OVER w || ']' AS names, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',') OVER w || '}' AS keys
          FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS 2 PRECEDING)""")
def json_group_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", windows.json_group_array_over("n_name", w, "string").alias("names"), windows.json_group_object_over("n_name", "n_nationkey", w, "int").alias("keys"))


@query("""SELECT o_orderkey, (SELECT count(DISTINCT b.o_orderpriority) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey) AS n FROM orders a""")
def count_distinct_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.count_distinct_over("o_orderpriority", ["o_custkey"], ["o_orderkey"]).alias("n"))


@query("SELECT range AS value FROM range(3, 5000, 7)")
def generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.generate_series(spark, 3, 4999, 7)


@query("SELECT n_nationkey, range AS value FROM nation JOIN range(0, 25, 2) ON range = n_nationkey")
def virtual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = virtual.virtual_table(spark, virtual.Series, start=0, stop=24, step=2)
    return table(spark, sf_dir, "nation").join(series, F.col("n_nationkey") == F.col("value")).select("n_nationkey", "value")


@query("SELECT event_id, j.key AS key, j.value::VARCHAR AS value FROM events, json_each(props) j")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", F.explode(jsons.json_each("props")).alias("j"))
    return found.select("event_id", "j.key", "j.value")


@query("""SELECT event_id, '$' AS fullkey, NULL AS path, 'object' AS type, props::JSON::VARCHAR AS value FROM events UNION ALL
          SELECT event_id, '$.k', '$', 'integer', props->>'k' FROM events""")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", F.explode(jsons.json_tree(jsons.json_("props"))).alias("j"))
    value = F.when(F.col("j.fullkey") == "$", F.concat(F.lit('{"k": '), F.get_json_object("j.value", "$.k"), F.lit("}"))).otherwise(F.col("j.value"))
    return found.select("event_id", "j.fullkey", "j.path", "j.type", value.alias("value"))


@query("""SELECT event_id, props->>'k' AS a, '{"k":' || (props->>'k') || ',"n":1}' AS i, '{"k":"x"}' AS s, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS b,
          CASE WHEN event_id % 3 = 0 THEN 'true' ELSE event_type END AS t, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 5 END AS n FROM events""")
def json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """->, insert and set; a boolean is 1 or 0, a text 'true' stays; a length counted from the end."""
    made = F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("b"), F.when(F.col("event_id") % 3 == 0, "true").otherwise(F.col("event_type")).alias("t")))
    nested = F.to_json(F.array(F.array(F.lit(9)), F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (F.col("event_id") % 5).cast("int")), lambda x: x)))
    return table(spark, sf_dir, "events").select(
        "event_id",
        jsons.arrow("props", "k").alias("a"),
        jsons.json_insert("props", "$.n", 1, "$.k", 0).alias("i"),
        jsons.json_set("props", "$.k", "x").alias("s"),
        jsons.json_extract(made, "$.b").alias("b"),
        jsons.json_extract(made, "$.t").alias("t"),
        jsons.json_array_length(nested, "$[#-1]").alias("n"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN length(props) + 1 ELSE 0 END AS p, CASE WHEN event_id % 2 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS v FROM events""")
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 2 == 0, F.concat("props", F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", jsons.json_error_position(broken).alias("p"), jsons.json_valid(broken).alias("v"))


@query("""SELECT n_nationkey, n_name LIKE (CASE WHEN n_nationkey % 2 = 0 THEN '%A' ELSE 'I%' END) AS l, n_nationkey % 3 = 0 AS x, CASE WHEN n_nationkey > 1 THEN ln(8.0) / ln(n_nationkey) END AS g FROM nation""")
def like_and_log_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escape before an ordinary character, patterns from a column, bases up to one."""
    pattern = F.when(F.col("n_nationkey") % 2 == 0, "%!A").otherwise("!I%")
    probe = F.when(F.col("n_nationkey") % 3 == 0, "a%b").otherwise("axb")
    return table(spark, sf_dir, "nation").select("n_nationkey", core.like("n_name", pattern, "!", True).alias("l"), core.like(probe, "AX%Xb", "X").alias("x"), math.log("n_nationkey", F.lit(8)).alias("g"))


@query("""SELECT p_partkey, coalesce(try_cast(t AS DOUBLE) < p_size, FALSE) AS less, try_cast(t AS DOUBLE) = p_size AND t <> 'x' AS same FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE (p_partkey % 50)::VARCHAR || '.0' END AS t FROM part)""")
def affinity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text beside an INTEGER column: compared as a number if it is one, else greater than all numbers."""
    t = F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.concat((F.col("p_partkey") % 50).cast("string"), F.lit(".0")))
    kinds, sources = ("TEXT", "INTEGER"), ("string", "int")
    found = table(spark, sf_dir, "part").withColumn("t", t)
    return found.select("p_partkey", F.coalesce(core.compare("t", "p_size", "<", kinds, sources), F.lit(False)).alias("less"), core.compare("t", "p_size", "=", kinds, sources).alias("same"))


@query("SELECT n_nationkey, 255 + n_nationkey AS a, -1::BIGINT AS b, 9.5 + 0 AS c FROM nation")
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", (core.literal("0xFf") + F.col("n_nationkey")).alias("a"), core.literal("0xffffffffffffffff").alias("b"), core.literal("9.5").alias("c"))


@query("SELECT 'SEARCH nation USING PUSHED FILTER' AS detail UNION ALL SELECT 'USE TEMP B-TREE FOR GROUP BY' UNION ALL SELECT 'USE TEMP B-TREE FOR ORDER BY'")
def explain_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").where("n_regionkey = 1").groupBy("n_name").count().orderBy("n_name")
    return explain.query_plan(df).select("detail")


@query("SELECT * FROM (VALUES ('trigger t1'), ('user_version 5'), ('unique kept'), ('attached 5'), ('index on b'), ('index on a'), ('closed')) v(what)")
def catalog_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers are listed, settings set, constraints added, folders attached; ROLLBACK undoes a rename with its index."""
    catalog, found = Catalog.open(spark), []
    catalog.create_table("a", table(spark, sf_dir, "region"))
    catalog.create_trigger("t1", "a", "CREATE TRIGGER t1 AFTER INSERT ON a BEGIN SELECT 1; END")
    found += [f"trigger {r['name']}" for r in catalog.schema_table().where("type = 'trigger'").collect()]
    catalog.pragma("user_version", 5)
    found.append(f"user_version {catalog.pragma('user_version')}")
    catalog.alter_constraints("a", unique=(("r_regionkey",),))
    try:
        catalog.alter_constraints("a", checks={"none": F.col("r_regionkey") < 0})
    except dml.ConstraintError:
        found.append("unique kept" if not catalog.constraints["a"].checks else "")
    catalog.attach(sf_dir, "other", ["region"])
    found.append(f"attached {catalog.table('other.region').count()}")
    catalog.detach("other")
    catalog.create_index("i", "a", ["r_name"])
    catalog.begin()
    catalog.rename_table("a", "b")
    found.append(f"index on {catalog.indexes['i'].table}")
    catalog.rollback()
    found.append(f"index on {catalog.indexes['i'].table}")
    catalog.close()
    try:
        catalog.table("a")
    except CatalogError:
        found.append("closed")
    return spark.createDataFrame([(f,) for f in found], "what string")


@query("""SELECT * FROM (VALUES ('2023-02-31', '2023-03-03', '2023-03-03 00:00:00'), ('2024-01-05T06:07', '2024-01-05', '2024-01-05 06:07:00'), ('06:07:08', '2000-01-01', '2000-01-01 06:07:08'),
          ('2024-01-05 23:30:00+02:00', '2024-01-05', '2024-01-05 21:30:00'), ('2460314.5', '2024-01-05', '2024-01-05 00:00:00'), ('nonsense', NULL, NULL)) v(t, d, dt)""")
def time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("2023-02-31",), ("2024-01-05T06:07",), ("06:07:08",), ("2024-01-05 23:30:00+02:00",), ("2460314.5",), ("nonsense",)]
    return spark.createDataFrame(rows, "t string").select("t", dates.date("t").alias("d"), dates.datetime("t").alias("dt"))


@query("""SELECT * FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Tymczak', 'T522'), ('Pfister', 'P236'), ('Honeyman', 'H555'), ('', '?000')) v(w, s)""")
def soundex_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ("Robert", "Rupert", "Tymczak", "Pfister", "Honeyman", "")], "w string").select("w", text.soundex("w").alias("s"))


@query("""SELECT n_nationkey, n_name || chr(233) || '\\z' AS u, strlen(n_name)::BIGINT AS b FROM nation""")
def unistr_and_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.unistr(F.concat("n_name", F.lit(r"\u00e9\z"))).alias("u"), text.length(F.encode("n_name", "UTF-8")).cast("bigint").alias("b"))
