"""Scalar functions: text, numbers, dates, JSON, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import core, dates, jsons, math, printf, text

from .registry import query, table

_UP, _LOW = core.UPPER, core.LOWER


@query(f"SELECT doc_id, md5(translate(text, '{_UP}', '{_LOW}')) AS low, md5(translate(text, '{_LOW}', '{_UP}')) AS up FROM documents")
def ascii_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.lower("text")).alias("low"), F.md5(text.upper("text")).alias("up"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length(n_chars::VARCHAR) AS digits FROM documents")
def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.length("text").cast("bigint").alias("chars"), text.octet_length("text").cast("bigint").alias("bytes"), text.length("n_chars").cast("bigint").alias("digits"))


@query("""SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 2) AS b, right(p_name, 3) AS c, substr(p_name, 3) AS d, left(right(p_name, 4), 2) AS e, substr(p_name, 2, 2) AS f FROM part""")
def substr_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "p_name"
    return table(spark, sf_dir, "part").select("p_partkey", text.substr(n, 2, 3).alias("a"), text.substr(n, 0, 3).alias("b"), text.substr(n, -3).alias("c"), text.substr(n, 3).alias("d"), text.substr(n, -4, 2).alias("e"), text.substr(n, 4, -2).alias("f"))


@query("SELECT p_partkey, instr(p_type, 'N') AS i, replace(p_type, 'A', 'aa') AS r, trim(p_type, 'SML') AS t, ltrim(p_type, 'ESL') AS l, rtrim(p_type, 'LREP') AS rt FROM part")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "p_type"
    return table(spark, sf_dir, "part").select("p_partkey", text.instr(t, "N").cast("bigint").alias("i"), text.replace(t, "A", "aa").alias("r"), text.trim(t, "SML").alias("t"), text.ltrim(t, "ESL").alias("l"), text.rtrim(t, "LREP").alias("rt"))


@query("SELECT c_custkey, chr(65 + c_nationkey) || chr(8364) AS c, unicode(c_name) AS u, hex(c_mktsegment) AS h, unhex('4a4b') AS b FROM customer")
def char_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.char(F.col("c_nationkey") + 65, 8364).alias("c"), text.unicode("c_name").alias("u"), text.hex_("c_mktsegment").alias("h"), text.unhex_(F.lit("4a4b")).alias("b"))


@query("SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS c, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'x') AS w FROM customer")
def concat_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    maybe = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.concat("c_name", maybe, "c_nationkey").alias("c"), text.concat_ws("-", "c_name", maybe, F.lit("x")).alias("w"))


@query("SELECT c_custkey, coalesce('''' || replace(nullif(c_mktsegment, 'BUILDING'), '''', '''''') || '''', 'NULL') AS q, c_custkey::VARCHAR AS n FROM customer")
def quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", core.quote(F.nullif("c_mktsegment", F.lit("BUILDING")), "string").alias("q"), core.quote("c_custkey", "bigint").alias("n"))


@query("SELECT c_custkey, coalesce(k, -1) AS c, CASE WHEN k > 10 THEN 'y' ELSE 'n' END AS i, CASE WHEN k IS NULL THEN NULL ELSE greatest(k, 12) END AS hi, CASE WHEN k IS NULL THEN NULL ELSE least(k, 12) END AS lo, CASE WHEN k IS NULL THEN 'null' ELSE 'integer' END AS t FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)")
def null_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return df.select("c_custkey", F.coalesce("k", F.lit(-1)).alias("c"), core.iif(F.col("k") > 10, "y", F.lit("n")).alias("i"), core.scalar_max("k", F.lit(12)).alias("hi"), core.scalar_min("k", F.lit(12)).alias("lo"), core.type_of("k", "int").alias("t"))


@query("SELECT c_custkey, round(c_acctbal) AS r0, round(c_acctbal, 1) AS r1, abs(c_acctbal) AS a, sign(c_acctbal)::BIGINT AS s, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t FROM customer")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "c_acctbal"
    return table(spark, sf_dir, "customer").select("c_custkey", math.round_(b).alias("r0"), math.round_(b, 1).alias("r1"), math.abs_(b).alias("a"), math.sign(b).alias("s"), math.ceil(b).alias("c"), math.floor(b).alias("f"), math.trunc(b).alias("t"))


@query("""SELECT c_custkey, round(CASE WHEN b >= 0 THEN sqrt(b) END, 6) AS sq, round(CASE WHEN b > 0 THEN ln(b) END, 9) AS l, round(CASE WHEN b > 0 THEN log10(b) END, 9) AS lt, round(CASE WHEN b > 0 THEN log2(b) END, 9) AS lo,
          round(CASE WHEN b > 0 THEN ln(b) / ln(3) END, 9) AS lb, round(exp(b / 10000), 9) AS e, round(pow(b, 2), 2) AS p, b % 7 AS m FROM (SELECT c_custkey, c_acctbal AS b FROM customer)""")
def logarithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "c_acctbal"
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(math.sqrt(b), 6).alias("sq"), F.round(math.ln(b), 9).alias("l"), F.round(math.log(b), 9).alias("lt"), F.round(math.log2(b), 9).alias("lo"), F.round(math.log(F.lit(3), b), 9).alias("lb"), F.round(math.exp(F.col(b) / 10000), 9).alias("e"), F.round(math.power(b, F.lit(2)), 2).alias("p"), math.mod(b, F.lit(7)).alias("m"))


@query("""SELECT l_orderkey, l_linenumber, round(sin(q), 9) AS s, round(cos(q), 9) AS c, round(tan(q), 6) AS t, round(CASE WHEN d BETWEEN -1 AND 1 THEN asin(d) END, 9) AS a, round(CASE WHEN d BETWEEN -1 AND 1 THEN acos(d) END, 9) AS ac, round(atan(q), 9) AS at, round(atan2(q, d), 9) AS a2,
          round(sinh(d), 9) AS sh, round(cosh(d), 9) AS ch, round(tanh(d), 9) AS th, round(asinh(q), 9) AS ash, round(acosh(q), 9) AS ach, round(atanh(d), 9) AS ath, round(radians(q), 9) AS r, round(degrees(d), 9) AS dg, round(pi(), 9) AS pi
          FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem)""")
def trigonometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = "l_quantity", "l_discount"
    parts = {"s": math.sin(q), "c": math.cos(q), "a": math.asin(d), "ac": math.acos(d), "at": math.atan(q), "a2": math.atan2(q, d), "sh": math.sinh(d), "ch": math.cosh(d), "th": math.tanh(d), "ash": math.asinh(q), "ach": math.acosh(q), "ath": math.atanh(d), "r": math.radians(q), "dg": math.degrees(d), "pi": math.pi()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(math.tan(q), 6).alias("t"), *[F.round(v, 9).alias(k) for k, v in parts.items()])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, round(julian(ts) - 0.5, 4) AS j, floor(epoch(ts))::BIGINT AS u FROM events""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = {"source": "timestamp"}
    return table(spark, sf_dir, "events").select("event_id", dates.date("ts", **kind).alias("d"), dates.time("ts", **kind).alias("t"), dates.datetime("ts", **kind).alias("dt"), F.round(dates.julianday("ts", **kind), 4).alias("j"), dates.unixepoch("ts", **kind).alias("u"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d|%H|%j|%m|%M|%S|%w|%W|%U|%Y|%u|%G|%V|%p|%I') AS s FROM orders""")
def strftime_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.strftime("%d|%H|%j|%m|%M|%S|%w|%W|%U|%Y|%u|%G|%V|%p|%I", "o_orderdate", source="timestamp").alias("s"))


@query("""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS m,
          strftime(o_orderdate + INTERVAL 10 DAY - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS s, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS sm, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS sy,
          strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INT)), '%Y-%m-%d') AS w, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last FROM orders""")
def date_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = "o_orderdate", {"source": "timestamp"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.date(d, "+1 month", **kind).alias("m"), dates.datetime(d, "+10 days", "-90 minutes", **kind).alias("s"), dates.date(d, "start of month", **kind).alias("sm"), dates.date(d, "start of year", **kind).alias("sy"), dates.date(d, "weekday 0", **kind).alias("w"), dates.date(d, "start of month", "+1 month", "-1 day", **kind).alias("last")
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none, props->>'k' AS a FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsons.json_extract("props", "$.k").alias("s"), jsons.json_extract("props", "$.k", returns="bigint").alias("k"), jsons.json_extract("props", "$.none").alias("none"), jsons.double_arrow("props", "k").alias("a"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || ',"type":"' || event_type || '"}' AS s, '{"k":0}' AS r, '{}' AS d, json_merge_patch(props, '{"z":[1,2]}')::VARCHAR AS p FROM events""")
def json_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = jsons.json_object(("k", jsons.json_extract("props", "$.k", returns="bigint"), "bigint"), ("type", "event_type", "string"))
    return table(spark, sf_dir, "events").select("event_id", built.alias("s"), jsons.json_replace("props", "$.k", 0).alias("r"), jsons.json_remove("props", "$.k").alias("d"), jsons.json_patch("props", '{"z":[1,2]}').alias("p"))


@query("""SELECT event_id, 1::BIGINT AS v, 'integer' AS t, 'object' AS o, '[' || (props->>'k') || ',null,"' || event_type || '"]' AS a, 3::BIGINT AS n, '"' || event_type || '"' AS q FROM events""")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jsons.json_array((jsons.json_extract("props", "$.k", returns="bigint"), "bigint"), (F.lit(None).cast("string"), "string"), ("event_type", "string"))
    return table(spark, sf_dir, "events").select("event_id", jsons.json_valid("props").alias("v"), jsons.json_type("props", "$.k").alias("t"), jsons.json_type("props").alias("o"), made.alias("a"), jsons.json_array_length(made).alias("n"), jsons.json_quote("event_type").alias("q"))


@query("""SELECT p_partkey, printf('%05d|%-8s|%8.2f|%x', p_partkey, p_brand, p_retailprice, p_partkey) AS f FROM part""")
def printf_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", printf.printf("%05d|%-8s|%8.2f|%x", "p_partkey", "p_brand", "p_retailprice", "p_partkey").alias("f"))


@query()
def soundex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.soundex("p_name").alias("s"), text.unistr(F.lit(r"A\\")).alias("u"))


@query()
def time_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", dates.datetime("o_orderdate", source="timestamp").alias("d"))
    return orders.select("o_orderkey", dates.timediff("d", F.lit("1995-06-17 12:00:00")).alias("diff"))
