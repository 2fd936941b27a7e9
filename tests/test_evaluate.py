"""The evaluator's worked cases, and properties of the metrics."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.operators import evaluate

DOC = "struct<index: long, path: string, source_type: string, func_name: string, display: string>"
REL = "struct<entry_filename: string, path: string, index: long, func_name: string>"


def frame(spark, cases):
    rows = []
    for i, (found, relevant) in enumerate(cases):
        docs = [(n, p, "docs", f, "") for p, n, f in found]
        rows.append((i, f"q{i}", "t", docs, [(None, p, n, f) for p, n, f in relevant]))
    return spark.createDataFrame(rows, f"query_id int, query string, query_type string, retrieved_docs array<{DOC}>, relevant_docs array<{REL}>")


def metrics(spark, cases, **how):
    df = frame(spark, cases)
    return evaluate.per_query(df.drop("relevant_docs"), df.select("query", "relevant_docs"), **how).orderBy("query_id").collect()


def seen(text):
    return [(p.split("#")[0], int(p.split("#")[1]), "") for p in text.split()]


CASES = {
    "path alone counts": (seen("A#1 B#2 A#3 C#4 D#5"), [("A", 1, ""), ("A", 9, ""), ("E", 1, "")], (1, 0.4, 0.2), (0.333333, 0.666667, 0.666667), (1, 0.703918, 0.703918), 1, 0.555556),
    "greedy is not maximum": (seen("A#7 A#8"), [("A", None, ""), ("A", 7, "f")], (1, 0.2, 0.1), (0.5, 0.5, 0.5), (1, 0.613147, 0.613147), 1, 0.5),
    "function without index": (seen("src\\x.py#5"), [("src/x.py", None, "g")], (0, 0, 0), (0, 0, 0), (0, 0, 0), 0, 0),
    "slashes and blanks": ([("a\\b.py ", 4, ""), ("Z", 0, "")], [("a/b.py", 4, "g")], (1, 0.2, 0.1), (1, 1, 1), (1, 1, 1), 1, 1),
    "no hit": (seen("X#1 X#1 X#1 X#1 X#1"), [("A", 1, "")], (0, 0, 0), (0, 0, 0), (0, 0, 0), 0, 0),
}


def test_worked_cases(spark):
    got = metrics(spark, [(f, r) for f, r, *_ in CASES.values()])
    for row, (name, (_, _, p, r, n, mrr, ap)) in zip(got, CASES.items(), strict=True):
        for kind, want in (("precision", p), ("recall", r), ("ndcg", n)):
            for k, w in zip((1, 5, 10), want, strict=True):
                assert row[f"{kind}_at_{k}"] == pytest.approx(w, abs=1e-6), (name, kind, k)
        assert row["mrr"] == pytest.approx(mrr) and row["average_precision"] == pytest.approx(ap, abs=1e-6), name


def test_always_mode_and_index_mode(spark):
    always = metrics(spark, [CASES["no hit"][:2]], mode="always")[0]
    assert always["precision_at_1"] == 1 and always["mrr"] == 1
    strict = metrics(spark, [(seen("A#3"), [("A", 1, "")])], require_index=True)[0]
    assert strict["mrr"] == 0


def test_function_match_when_it_is_carried(spark):
    row = metrics(spark, [([("a.py", 3, "f")], [("a.py", None, "f")])])[0]
    assert row["mrr"] == 1


def test_queries_without_relevant_documents_are_skipped(spark):
    df = frame(spark, [(seen("A#1"), []), (seen("A#1"), [("A", 1, "")])])
    truth = df.select("query", "relevant_docs")
    assert evaluate.per_query(df.drop("relevant_docs"), truth).count() == 1
    assert [r["query"] for r in evaluate.skipped(df.drop("relevant_docs"), truth).collect()] == ["q0"]


def test_last_truth_wins(spark):
    rows = spark.createDataFrame([Row(query="a", o=1, v="x"), Row(query="a", o=2, v="y"), Row(query="b", o=3, v="z")])
    assert {(r["query"], r["v"]) for r in evaluate.last_wins(rows, "o").collect()} == {("a", "y"), ("b", "z")}


def test_aggregates_by_type_and_over_all(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 4.0), ("b", 1.0, 6.0)], "query_type string, mrr double, latency double")
    got = {r["query_type"]: r for r in evaluate.aggregates(df).collect()}
    assert got["a"]["mrr"] == 0.5 and got[None]["mrr"] == pytest.approx(2 / 3)
    assert got["a"]["latency_std"] == 1.0  # of the population


def greedy(found, relevant):
    used, out = set(), []
    for f in found:
        at = next((i for i, r in enumerate(relevant) if i not in used and r[0] == f[0] and ((r[1] is not None and r[1] == f[1]) or not r[2])), None)
        used |= {at} - {None}
        out.append(int(at is not None))
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 2)), max_size=6), st.lists(st.tuples(st.sampled_from("AB"), st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["", "f"])), min_size=1, max_size=4)), min_size=1, max_size=8))
def test_hits_follow_the_greedy_assignment(spark, cases):
    cases = [([(p, n, "") for p, n in f], r) for f, r in cases]
    df = frame(spark, cases).withColumn("h", evaluate.hits(F.col("retrieved_docs"), F.col("relevant_docs")))
    rows = df.orderBy("query_id").collect()
    assert [r["h"] for r in rows] == [greedy(f, r) for f, r in cases]
    for row in metrics(spark, cases):
        r = [row[f"recall_at_{k}"] for k in (1, 5, 10)]
        assert 0 <= r[0] <= r[1] <= r[2] <= 1
        assert all(0 <= row[f"ndcg_at_{k}"] <= 1 + 1e-9 for k in (1, 5, 10))
