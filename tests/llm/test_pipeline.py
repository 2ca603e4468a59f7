"""The pipeline's stages on small frames, and the registered queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from loomgraph.llm import decontaminate, entry, neardup, secrets


def view(con, data):
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    view(con, data)
    got = entry.QUERIES[name](spark, data)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLE_SQL)))
def test_queries_return_a_row_for_each_input(spark, data, name):
    got = entry.QUERIES[name](spark, data)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == n


def test_stages(spark, data):
    docs = start = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == start.columns, name
        out = spark.createDataFrame(out.collect(), start.schema)
        if name in ("quality_rules", "near_duplicates"):
            assert out.join(docs, start.columns, "left_anti").count() == 0  # rows are kept or go
        elif name == "decontamination":
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            hit = lambda d: decontaminate.scan_documents(d.select("doc_id", "text"), bench).where("size(spans) > 0")
            assert hit(out).count() == 0
            assert docs.join(out, "doc_id", "left_anti").join(hit(docs), "doc_id", "left_anti").count() == 0  # only hit ones go
        else:
            assert out.count() == docs.count()
        docs = out
    assert docs.count() == docs.select("doc_id").distinct().count()
    assert neardup.classes(docs).where("doc_id <> class_id").count() == 0
    assert secrets.scan_secrets(docs).where("size(secret_spans) > 0").count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, data)
    want = sorted(map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert want and {r[0] for r in want} == {r["doc_id"] for r in docs.collect()}
    run = corpus_pipeline.run(spark, data)
    assert run.agg({"length": "sum"}).first()[0] == sum(r[2] for r in want)


def test_stages_on_hard_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", None, 0, "a", "b"), (1, "", "en", None, 0, "a", "b"), (2, "w " * 50_000, None, "s", 1, None, None), (3, "token = abcdefghijklmnop and more words here " + "x y z q r " * 4, "en", "s", 9, "", "")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, data)
            assert name == "packing" or out.columns == frame.columns
            assert out.count() >= 0 if frame.count() else out.count() == 0
