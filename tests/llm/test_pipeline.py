import random
import re

import corpus_pipeline

from marlstone.llm import decontam, mixing, quality, simhash

from .helpers import SF, frame


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    docs = docs.selectExpr("*", "'x' AS words", "1 AS row")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "token_ids":
            assert set(columns) <= set(docs.columns)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] and kept[3] == kept[4]
    assert corpus_pipeline.run(spark, SF).count() == kept[4]


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixture", "token_ids"]
    assert not re.search("except ImportError", open(corpus_pipeline.__file__).read())


def test_rows_without_an_own_id(spark):
    """Null and repeated ids: a row stays or goes by its own text."""
    rng = random.Random(8)
    prose = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(12)]
    item = " ".join(prose[11].split()[10:25])
    rows = [(1, prose[0], "s"), (None, prose[0], "s"), *((None, t, "s") for t in prose[1:6]), *((7, t, "s") for t in prose[6:11]), (7, prose[11], "s"), (None, prose[11].upper(), "s")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, [*rows, rows[3]])).collect()]
    assert len(kept) == len(set(kept)) == 12 and (1, prose[0]) in kept and set(prose[1:11]) <= {t for _, t in kept}
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean = decontam.drop_contaminated(frame(spark, rows), benchmark).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in clean))) == sorted(str(r[:2]) for r in rows if item not in r[1].lower())


def test_mixture_keeps_the_columns_of_every_row(spark):
    """Rows alike in id and text but not in other columns each get their even share, also under clashing names."""
    prose = " ".join(["word"] * 50)
    rows = [(None if i % 2 else 5, prose, "s", i) for i in range(12)] + [(9, "other text here", "t", 99)]
    names = "doc_id bigint, text string, source string, times int"
    docs = spark.createDataFrame(rows, names).selectExpr("*", "1 AS id", "2 AS key", "3 AS content", "4 AS row", "map('a', 1) AS m")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"] // r["size"]
    found = mixing.sample(docs)
    assert found.columns == docs.columns
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append(r["times"])
    assert {k: len(v) for k, v in got.items()} == {k: v for k, v in taken.items() if v}
    for times in got.values():
        shares = [times.count(t) for t in range(12)]
        if 99 not in times:
            own = [n for t, n in enumerate(shares) if (t % 2 == 0) == (times[0] % 2 == 0)]
            assert max(own) - min(own) <= 1


def test_stages_give_clashing_columns_back(spark):
    """Columns named as the stages' own are returned with their values, and rows without an id stay apart."""
    rows = [(i if i % 3 else None, " ".join(f"w{i}x{j}" for j in range(60)), f"s{i % 2}") for i in range(9)]
    names = ("__row", "__quality", "name", "row", "times", "content", "of_id", "of_key", "missing", "hash")
    docs = frame(spark, rows, extra=False).selectExpr("*", *[f"concat('{n}', text) AS `{n}`" for n in names])
    wanted = sorted(t for _, t, _ in rows)
    benchmark = spark.createDataFrame([(1, "none of these words stands in any document of this test here")], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for found in (simhash.keep_one(docs), decontam.drop_contaminated(docs, benchmark), mixing.sample(docs), quality.keep_good(docs, labels)):
        assert found.columns == docs.columns
        got = found.collect()
        assert all(r[n] == n + r["text"] for r in got for n in names)
        assert {r["text"] for r in got} <= set(wanted)
    for kept in (simhash.keep_one(docs), decontam.drop_contaminated(docs, benchmark)):
        assert sorted(r["text"] for r in kept.collect()) == wanted
