import pytest
from pyspark.sql import functions as F

from marlstone.operators import dml, recursion, setops
from marlstone.sources import tables
from marlstone.streaming import events

import __spark_entry__


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_compound_is_left_associative(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in v], "k int") for v in ((1, 2), (2, 3), (1, 9)))
    assert rows(setops.compound(a, ("union", b), ("intersect", c))) == [(1,)]
    with pytest.raises(ValueError):
        setops.compound(a, ("union", b.selectExpr("k", "k AS j")))


def test_recursion_ends_on_cycles(spark):
    start = spark.createDataFrame([(1,)], "n int")
    found = recursion.recursive(start, lambda t: t.select(((F.col("n") * 2) % 7).alias("n")), distinct=True)
    assert rows(found) == [(1,), (2,), (4,)]
    assert recursion.recursive(start, lambda t: t.select((F.col("n") + 1).alias("n")), limit=5).count() == 5


def test_constraints(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    with pytest.raises(dml.ConstraintError, match="UNIQUE k"):
        dml.Constraints(unique=(("k",),)).check(t)
    with pytest.raises(dml.ConstraintError, match="NOT NULL k"):
        dml.Constraints(not_null=("k",)).check(t)
    assert dml.Constraints(checks={"short": F.length("v") < 2}).check(t) is t


def test_catalog(spark):
    catalog = tables.Catalog(spark)
    catalog.create_table("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    catalog.create_index("i", "t", ["k"], unique=True)
    assert catalog.table("t", indexed_by="i").count() == 1
    with pytest.raises(tables.CatalogError, match="no such index"):
        catalog.table("t", indexed_by="j")
    with pytest.raises(tables.CatalogError, match="no such table"):
        catalog.table("u")
    catalog.begin()
    catalog.drop_table("t")
    catalog.rollback()
    assert rows(catalog.index_list("t")) == [(0, "i", 1, "c", 0)]
    assert catalog.affinities("t") == {"k": "INTEGER", "v": "TEXT"}


def test_stream_and_table_agree(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    static = spark.read.parquet(source).selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props")
    static.write.parquet(str(tmp_path / "in"))
    live = events.tumbling(events.read_events(spark, str(tmp_path / "in")), "1 day")
    query = live.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("tumbled")) == rows(events.tumbling(static, "1 day"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]


def test_plans(spark):
    from marlstone.plans import explain, registry

    queries = registry.queries()
    folder = "/root/testdata/sf0.001"
    assert explain.uses(queries["scan_filter"](spark, folder), "PushedFilters: [IsNotNull(l_quantity)")
    assert not explain.uses(queries["topk_orders"](spark, folder), "Exchange rangepartitioning")
    assert not explain.uses(queries["semi"](spark, folder), "CartesianProduct")


def test_chance_and_blobs(spark):
    from marlstone.functions import core

    row = spark.range(50).select(core.random_integer().alias("r"), core.random_blob(11).alias("b"), core.zeroblob(3).alias("z"), core.likelihood("id", 0.5).alias("i"))
    found = row.collect()
    assert len({r["r"] for r in found}) == 50 and {len(r["b"]) for r in found} == {11} and found[0]["z"] == b"\0\0\0"


def test_constraints_of_changes(spark):
    from marlstone.sources.tables import Catalog

    limits = dml.Constraints(not_null=("b",), unique=(("a",),), checks={"small": F.col("b") < 100})
    rows = spark.createDataFrame([(1, 5), (None, 6), (None, 7)], "a int, b int")
    more = spark.createDataFrame([(1, 8), (2, 9), (2, 10), (None, 11), (3, None), (4, 100)], "a int, b int")
    catalog = Catalog(spark)
    catalog.create_table("t", rows, constraints=limits, defaults={"b": F.lit(0)})
    with pytest.raises(dml.ConstraintError):
        catalog.insert("t", more)
    assert catalog.table("t").count() == 3 and catalog.total_changes == 0
    catalog.insert("t", more, "IGNORE", [F.col("b")])
    assert sorted(map(str, catalog.table("t").collect())) == sorted(map(str, [*rows.collect(), *more.where("b IN (9, 11)").collect()]))
    assert catalog.changes == 2
    catalog.insert("t", spark.createDataFrame([(1, 50), (9, None)], "a int, b int"), "REPLACE")
    assert {(r["a"], r["b"]) for r in catalog.table("t").where("a IS NOT NULL").collect()} == {(1, 50), (2, 9), (9, 0)}
    done = dml.update_checked(catalog.table("t"), {"a": F.lit(2)}, limits, ["a"], F.col("a") > 0, "REPLACE")
    assert {(r["a"], r["b"]) for r in done.table.where("a IS NOT NULL").collect()} == {(2, 0)} and done.table.count() == 4
    with pytest.raises(dml.ConstraintError):
        dml.update_checked(catalog.table("t"), {"a": F.lit(2)}, limits, ["a"], F.col("a") > 0)


def test_refused_modifiers(spark):
    from marlstone.functions import core
    from marlstone.operators import joins, windows

    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2)
    for wrong in ({"is_natural": True, "columns": ["id"]}, {"is_natural": True, "on": F.lit(True)}, {"columns": ["x"]}, {"columns": ["id"], "on": F.lit(True)}):
        with pytest.raises(ValueError):
            joins.join(a, b, **wrong)
    assert joins.join(a, b, columns=["id"]).count() == joins.join(a, b, is_natural=True).count() == 2
    with pytest.raises(ValueError, match="misuse of window function lag"):
        windows.misuse("lag", None)
    with pytest.raises(ValueError):
        core.match_("a", "b")


def test_like_escapes(spark):
    from marlstone.functions import core

    cases = [("a%c", "A\\%C", "\\", True), ("abc", "a\\%c", "\\", False), ("axb", "aXxb", "X", True), ("ax", "a_", "_", False), ("a_", "a__", "_", True), ("ab", "ab!", "!", False), ("a.c\n", "A.c_", "!", True), ("Ä", "ä", "!", False)]
    for text, pattern, escape, want in cases:
        row = spark.range(1).select(core.like(F.lit(text), pattern, escape).alias("a"), core.like(F.lit(text), F.lit(pattern), escape).alias("b")).first()
        assert (row["a"], row["b"]) == (want, want), (text, pattern)
