"""Every query of the subpackage and the pipeline, on small tables with nulls, empty and repeated rows, and columns with clashing names."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomledger.llm import queries
from tests.llm.test_llm import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, Ranges int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(i, text(40), "en", ["a", "b", None][i % 3], 0, "k", 1) for i in range(12)]
    passage = text(15)
    rows += [(20, rows[3][1] + " tail", "en", "a", 0, "k", 1), (21, rows[4][1], "en", "b", 0, "k", 1)]  # near and exact copies
    rows += [(22, f"{text(10)} {passage} {text(10)}", "en", "a", 0, "k", 1), (23, None, None, None, None, None, None), (24, "", "en", "b", 0, "k", 1)]
    rows += [rows[0], (None, text(40), "en", "a", 0, "k", 1)]
    where = {}
    for name, filled in (("full", True), ("empty", False)):
        d = str(tmp_path_factory.mktemp(name))
        keep = lambda x: x if filled else []  # noqa: E731, B023
        for table, own, schema in (
            ("documents", rows, DOCS),
            ("labels", [(i, 1, 0) for i in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int"),
            ("benchmark", [("b1", passage), ("b2", None), (None, "x")], "item_id string, text string"),
            ("conversations", [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "</s>")], "conv_id long, turn int, role string, text string"),
        ):
            spark.createDataFrame(keep(own), schema).write.parquet(f"{d}/{table}.parquet")
        where[name] = d
    return rows, where


def test_queries(spark, tables):
    rows, where = tables
    for name, query in queries.QUERIES.items():
        got = query(spark, where["full"]).collect()
        if name in ("op7_chat_format", "op13_conversation_repair"):
            assert {r["conv_id"] for r in got} == {1, 2} | ({-1} if name == "op7_chat_format" else set()), name
        elif name == "op12_spelling_variants":
            assert all(len(r["word"]) >= 5 and r["n"] >= 3 for r in got), name
        else:
            assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str), name
        left = query(spark, where["empty"]).count()
        assert left == (1 if name == "op7_chat_format" else 0), name


def test_twins(spark, tables):
    """The SQL gives the same rows, on nulls, repeated rows and empty tables too."""
    for d in tables[1].values():
        c = duckdb.connect()
        for name in ("documents", "labels", "benchmark", "conversations"):
            c.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
        for name, sql in queries.ORACLE.items():
            got = queries.QUERIES[name](spark, d)
            cols = ", ".join(sorted(got.columns))
            want = sorted(map(tuple, c.execute(f"select {cols} from ({sql})").fetchall()), key=repr)
            assert sorted((tuple(r) for r in got.selectExpr(*sorted(got.columns)).collect()), key=repr) == want, name


def test_pipeline(spark, tables):
    """No label is toxic, so no model rejects any; lines don't repeat but in copies, which go whole; the passage's text goes; each source takes its share of what is left."""
    rows, where = tables
    out = corpus_pipeline.run(spark, where["full"])
    assert out.columns[:7] == [c.split()[0] for c in DOCS.split(", ")]
    got = [r["doc_id"] for r in out.collect()]
    copies = {i for i, (_, c) in brute_components([(r[0], r[1]) for r in rows if r[0] is not None]).items() if i != c}
    assert copies == {20, 21}
    assert set(got) <= {r[0] for r in rows} - copies - {22}
    kept = spark.createDataFrame([r for r in rows if r[0] not in copies | {22}], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    want = [r["doc_id"] for r in stages["mixing to target weights"](spark, kept, where["full"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and None in got
    assert corpus_pipeline.run(spark, where["empty"]).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, kept.where(F.lit(False)), where["empty"]).columns == kept.columns, name
