"""Documents with the awkward cases that every operator must bear."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())

ODD = [
    (None, None, None), (None, "null id", "src1"), (900001, None, "src1"), (900002, "", None), (900003, " \t\n", "src2"),
    (900004, "twice the same", "src1"), (900004, "twice the same", "src1"), (900005, "🙂 ünïcödé́ Ä", "src2"),
    (900006, "word " * 30_000, "src1"), (900007, "x" * 50_000, "src2"), (900008, "a,\x00b\x1cc", "src1"),
]


def documents(n=120):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()
    return rows + ODD


def frame(spark, rows, extra=True):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    if extra:
        for name in ("row", "key", "words", "hash", "fp", "n", "block", "size", "salt", "start"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def random_texts(parts, n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]
