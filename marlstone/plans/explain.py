"""EXPLAIN as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """The plan of a query, a row a line: line, text. Modes are Spark's: simple, extended, codegen, cost, formatted."""
    text = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    return df.sparkSession.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


#: What a physical operator is called in a query plan; {} is the table.
_NODES = {"FileScan": "SCAN {}", "Scan ": "SCAN {}", "LocalTableScan": "SCAN CONSTANT ROW", "Range": "SCAN CONSTANT ROW", "Sort": "USE TEMP B-TREE FOR ORDER BY", "TakeOrderedAndProject": "USE TEMP B-TREE FOR ORDER BY", "Aggregate": "USE TEMP B-TREE FOR GROUP BY", "Union": "COMPOUND QUERY"}


def query_plan(df: DataFrame) -> DataFrame:
    """EXPLAIN QUERY PLAN: id, parent, notused, detail. A scan with a pushed equality is a SEARCH; sorts and the final step
    of aggregates are temporary trees; what serves joins and partitions only isn't listed."""
    text = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    rows: list[tuple[int, int, int, str]] = []
    above: list[tuple[int, int]] = []  # depth and id of the listed nodes over a line
    for number, line in enumerate(text.splitlines()):
        plain = line.lstrip(" :+-*").split(") ", 1)[-1] if line.lstrip(" :+-").startswith("*(") else line.lstrip(" :+-")
        depth = len(line) - len(line.lstrip(" :+-*"))
        found = None
        if plain.startswith("FileScan"):
            name = line.rsplit("/", 1)[-1].split(".parquet")[0].split("]")[0] if ".parquet" in line else "TABLE"
            pushed = line.split("PushedFilters: [", 1)[-1].split("]")[0]
            found = f"SEARCH {name} USING PUSHED FILTER" if "EqualTo(" in pushed else f"SCAN {name}"
        elif plain.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")) and "partial_" not in plain:
            found = _NODES["Aggregate"]
        elif plain.startswith("Sort ") and "true, 0" in plain or plain.startswith("TakeOrderedAndProject"):
            found = _NODES["Sort"]
        else:
            found = next((v for k, v in _NODES.items() if plain.startswith(k) and k not in ("FileScan", "Sort", "Aggregate", "TakeOrderedAndProject")), None)
        if found:
            while above and above[-1][0] >= depth:
                above.pop()
            rows.append((number, above[-1][1] if above else 0, 0, found.format("TABLE")))
            above.append((depth, number))
    return df.sparkSession.createDataFrame(rows, "id int, parent int, notused int, detail string")


def uses(df: DataFrame, name: str) -> bool:
    """Whether an operator stands in the physical plan, as 'BroadcastHashJoin' or 'PushedFilters'."""
    return any(name in row["text"] for row in explain(df).collect())
