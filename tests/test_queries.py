"""Every registered query with SQL against an independent engine."""

import glob
import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.SQL:
        assert ours[1]
        return
    rel = duck.sql(catalogue.SQL[name])
    assert ours == table(list(rel.columns), rel.fetchall())


def test_pure_queries_stay_in_the_jvm(spark, sf_dir):
    for name in ("doc_word_counts", "inline_cleanup", "bm25_topk", "section_split", "tfidf_topk", "rag_text"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    plan = catalogue.QUERIES["bm25_topk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    plan = catalogue.QUERIES["doc_word_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
