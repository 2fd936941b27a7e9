"""Ordinals, neighbours, fusion, readers, writers, the crawl and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, evaluate, features, hybrid, knn, ordinals
from lodestone.plans import catalogue, retrieval
from lodestone.sources import arrays, crawl, readers, sinks
from lodestone.streaming.append import append_documents


def test_ordinal_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = ordinals.with_ordinal(df, [F.col("x")], "i", 1).orderBy("x").collect()
    assert [r["i"] for r in got] == list(range(1, 1001))


def test_capped_union_does_not_replace_failures(spark):
    a = spark.createDataFrame([(i, "bad" if i == 1 else None) for i in range(3)], "ordinal int, error string")
    b = spark.createDataFrame([(i, None) for i in range(5)], "ordinal int, error string")
    got = ordinals.capped_union([a, b], 4).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in got} == {0: 2, 1: 2}


def test_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asks = rows.where("vec_id < 20")
    flat = knn.exact(rows, asks).collect()
    assert all(r["doc_id"] == r["query_id"] and r["distance"] == 0 for r in flat if r["rank"] == 1)
    want = {(r["query_id"], r["doc_id"], r["rank"]) for r in flat}
    all_cells = knn.by_cells(rows, asks, probes=100).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in all_cells} == want
    got = {(r["query_id"], r["doc_id"]) for r in knn.by_hashing(rows, asks).collect()}
    assert len(got & {w[:2] for w in want}) >= 0.9 * len(want)
    assert knn.exact(rows.limit(2), asks.limit(1), k=5).count() == 2


@pytest.mark.parametrize("name, size", [("knn_ivf", "sf0.001"), ("knn_ivf", "sf0.01"), ("knn_ivf", "sf0.1"), ("knn_lsh", "sf0.01"), ("knn_lsh", "sf0.1")])
def test_index_query_finds_nine_of_ten(spark, name, size):
    """The registered setting against brute force."""
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    got = {(r["query_id"], r["doc_id"]) for r in catalogue.QUERIES[name](spark, f"/root/testdata/{size}").collect()}
    asks = rows.join(spark.createDataFrame([(q,) for q in {q for q, _ in got}], "vec_id long"), "vec_id", "left_semi")
    want = {(r["query_id"], r["doc_id"]) for r in knn.exact(rows, asks).collect()}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["knn_ivf", "knn_lsh"])
def test_every_fiftieth_vector_is_asked(spark, name):
    sf_dir = "/root/testdata/sf0.1"
    want = {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert {r["query_id"] for r in catalogue.QUERIES[name](spark, sf_dir).collect()} == want


def test_fusion_ties_and_gate(spark):
    dense = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.5, 2), (1, 12, 0.1, 3)], "query_id int, doc_id int, score double, rank int")
    sparse = spark.createDataFrame([(1, 12, 1.0), (1, 13, 0.1), (1, 9, 1.0), (1, 11, 0.0)], "query_id int, doc_id int, score double")
    got = hybrid.fuse(dense, sparse, 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(12, 0.37), (10, 0.35), (11, 0.35), (9, 0.3)]
    assert hybrid.fuse(dense, None, 2).count() == 2


def test_normalising_writes_a_row_a_query(spark, monkeypatch):
    written = []
    monkeypatch.setattr(bm25, "stored", lambda df: written.append(df.count()) or df)
    scored = spark.createDataFrame([(q, d, float(q * d)) for q in range(3) for d in range(1, 50)], "query_id int, doc_id int, score double")
    got = bm25.normalised(scored).where("score = 1").collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(1, 49), (2, 49)} and written == [3]


def test_fusion_limits_the_sparse_rows_before_the_shuffle(spark):
    """And a dense document of any rank keeps its sparse part, or goes without."""
    dense = spark.createDataFrame([(1, 10 + i, 0.5 - i / 100, i + 1) for i in range(4)], "query_id int, doc_id int, score double, rank int")
    sparse = spark.createDataFrame([(1, 13, 1.0), (1, 12, -0.5), (1, 11, 0.05), *[(1, i, 0.9) for i in range(20, 40)]], "query_id int, doc_id int, score double")
    got = hybrid.fuse(dense, sparse, 3)
    assert [(r["doc_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(13, 0.629), (11, 0.358), (10, 0.35)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftAnti" in plan
    assert [r["doc_id"] for r in hybrid.fuse(dense, sparse, 6).orderBy("rank").collect()] == [13, 11, 10, 20, 21, 22]


def test_bm25_repeats_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "d"), (4, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "c"), (2, "c c"), (3, "zzz")], "item_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.scores(docs, asks).collect()}
    assert set(got) == {(1, 2), (2, 2)} and got[2, 2] == pytest.approx(2 * got[1, 2])


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, sf_dir):
    """They are many times the input: they are summed up where their document is."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    for scored in (bm25.scores(docs, items), features.tfidf_scores(docs, items)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" in plan and "hashpartitioning(query_id" not in plan


def test_documents_that_share_an_id_are_scored_as_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a"), (3, "d")], "doc_id long, text string").repartition(4)
    asks = spark.createDataFrame([(1, "b c"), (2, "c")], "item_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.scores(docs, asks).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == pytest.approx(2 * got[2, 1])


def test_tfidf_rows_have_length_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = features.tfidf(docs, features=50).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in got)


def test_encoder_hook(spark):
    encode = features.encoder(lambda: lambda texts: [[float(len(t))] for t in texts])
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(encode(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [[2.0], [0.0]]


def test_retrieval_end_to_end(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps([{"index": i, "file": f"f{i}", "text": t} for i, t in enumerate(["red fox", "blue sea", "red sea"])]))
    (tmp_path / "cfg.json").write_text(json.dumps({"dataset_files": ["docs.json"], "top_k": 2, "max_docs": 3, "odd": 1}))
    settings = readers.load_settings(str(tmp_path / "cfg.json"))
    assert settings.top_k == 2 and settings.extra == {"odd": 1}
    docs = retrieval.load_corpus(spark, settings, "index long, file string, text string")
    (tmp_path / "req").mkdir()
    (tmp_path / "req/b.json").write_text(json.dumps(["blue"]))
    (tmp_path / "req/a.json").write_text(json.dumps([{"query": "red", "type": "x"}, {"query": "fox", "query_type": "y"}]))
    asks = readers.requests(spark, str(tmp_path / "req"))
    assert [(r["query_id"], r["query"], r["query_type"]) for r in asks.orderBy("query_id").collect()] == [(1, "red", "x"), (2, "fox", "y"), (3, "blue", "")]
    results, _ = retrieval.retrieve(docs, asks, k=2)
    got = {r["query"]: [d["path"] for d in r["retrieved_docs"]] for r in results.collect()}
    assert got["fox"] == ["f0"] and got["blue"] == ["f1"]
    sinks.json_array(results, str(tmp_path / "out"), "query_id")
    again = readers.results(spark, str(tmp_path / "out"))
    assert {r["query"]: [d["path"] for d in r["retrieved_docs"]] for r in again.collect()} == got
    assert sum(r["share"] for r in retrieval.statistics(results).collect()) == pytest.approx(100)


def test_json_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        readers.json_array(spark, str(tmp_path / "o.json"), "a long")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    rows = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a long")
    assert readers.counted(rows) == {"total": 3, "malformed": 1}
    assert [r["a"] for r in rows.where("NOT malformed").select("row.a").collect()] == [1, 3]


def test_ground_truth_in_both_shapes(spark, tmp_path):
    one = {"query": "q", "query_type": "t", "relevant_docs": [{"path": "p", "doc_index": 3, "func_name": "f"}]}
    (tmp_path / "a.json").write_text(json.dumps([one]))
    (tmp_path / "b.json").write_text(json.dumps({"1": one, "2": {"query": "r", "relevant_docs": []}}))
    got = readers.ground_truth(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).orderBy("ordinal").collect()
    assert [r["query"] for r in got] == ["q", "q", "r"] and got[0]["relevant_docs"][0]["index"] == 3


def test_source_tree(spark, tmp_path):
    for name in ("src/b.py", "src/a.py", "other.py", "src/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = readers.source_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"]) for r in got] == [("src/a.py", "src/a.py"), ("src/b.py", "src/b.py")]


def test_crawl(spark):
    page = lambda n, *links: (f"https://s/{n}.html", "".join(f'<a href="{x}">x</a>' for x in links))
    pages = spark.createDataFrame([page("a", "b.html", "#x", "c.txt", "https://other/z.html"), page("b", "a.html", "d", "/e.html"), page("e", "f.html")], "url string, html string")
    got = crawl.crawl(pages, ["https://s/a.html"], "https://s/").collect()
    assert [(r["url"], r["depth"]) for r in got] == [("https://s/a.html", 0), ("https://s/b.html", 1), ("https://s/d", 2), ("https://s/e.html", 2), ("https://s/f.html", 3)]
    assert crawl.crawl(pages, ["https://s/a.html"], "https://s/", max_items=2).count() == 2
    src = spark.createDataFrame([("https://s/a.html", "x" * 20)], "url string, text string")
    assert {r["status"] for r in crawl.with_sources(pages, src).collect()} == {"ok"}
    assert sorted(r["status"] for r in crawl.with_sources(pages, src, src.where("false")).collect()) == ["missing", "missing", "ok"]


def test_crawl_goes_on_to_the_end_of_a_chain(spark):
    pages = spark.createDataFrame([(f"https://s/{n}.html", f'<a href=\'{n + 1}.html\'>x</a>') for n in range(54)], "url string, html string")
    got = crawl.crawl(pages, ["https://s/0.html"], "https://s/").collect()
    assert [r["depth"] for r in got] == list(range(55))
    assert crawl.crawl(pages, ["https://s/0.html"], "https://s/", max_seen=7).count() == 7


def test_crawl_has_no_end_but_the_frontiers(spark):
    hub = "".join(f"<a href='{n}'>x</a>" for n in range(50_010))
    pages = spark.createDataFrame([("https://s/0.html", hub)], "url string, html string")
    assert crawl.crawl(pages, ["https://s/0.html"], "https://s/").count() == 50_011


def test_links_in_any_quotes_and_dot_segments(spark):
    html = """<a href="a">1</a><a class=x href='../b?q#f'>2</a><a href=../../../c>3</a><a href="./d/./e/..">4</a><a href="//h/x">5</a><a href="?q=1">6</a>"""
    got = crawl.links(spark.createDataFrame([("https://s/x/y/z.html", html)], "url string, html string")).collect()
    assert [r["target"] for r in got] == ["https://s/x/y/a", "https://s/x/b?q#f", "https://s/c", "https://s/x/y/d/", "https://h/x", "https://s/x/y/z.html?q=1"]


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0]), (1, [1.0, 2.0, 3.0]), (2, [5.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [nan]), (None, [1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = df.where("vec_id = 2")
    want = [(2, 0.0), (1, 34.0), (0, 41.0), (6, 50.0)]
    for found in (knn.exact(df, one), knn.by_cells(df, one), knn.by_hashing(df, one, width=100.0)):
        assert [(r["doc_id"], r["distance"]) for r in found.orderBy("rank").collect()] == want
    none = df.limit(0)
    for a, b in ((none, one), (df, none), (none, none)):
        assert knn.exact(a, b).count() == knn.by_cells(a, b, recall=0.9).count() == knn.by_hashing(a, b).count() == 0


def test_first_pages_stop(spark):
    page = lambda n, size, on: (n, None if size is None else [(n * 10 + i,) for i in range(size)], on)
    schema = "page long, nodes array<struct<id: long>>, has_next boolean"
    ids = lambda pages, most: [r["node"]["id"] for r in readers.first_pages(spark.createDataFrame(pages, schema), most).orderBy("ordinal").collect()]
    assert ids([page(0, 2, True), page(1, 2, True), page(2, 2, True)], 3) == [0, 1, 10, 11]
    assert ids([page(0, 2, True), page(1, 1, False), page(2, 2, True)], 100) == [0, 1, 10]
    assert ids([page(0, 2, True), page(1, None, None), page(2, 2, True)], 100) == [0, 1]


def test_discussion_pages(spark, tmp_path):
    node = lambda t: {"title": t, "url": "u", "bodyText": "b", "answer": None, "comments": {"nodes": [{"author": {"login": "a"}, "bodyText": "solved"}]}}
    for name, titles, more in (("p1.json", ["x", "y"], True), ("p2.json", ["z"], False)):
        answer = {"data": {"repository": {"discussions": {"pageInfo": {"hasNextPage": more, "endCursor": "c"}, "nodes": [node(t) for t in titles]}}}}
        (tmp_path / name).write_text(json.dumps(answer, indent=1))
    got = readers.discussion_pages(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["title"] for r in got] == ["x", "y", "z"] and got[0]["comments"]["nodes"][0]["bodyText"] == "solved"


def test_evaluation_is_written(spark, tmp_path):
    metrics = spark.createDataFrame([(1, "q", "t", 1.0, 0.5, 0.25), (2, "r", "u", 0.0, 0.5, 0.75)], "query_id long, query string, query_type string, mrr double, average_precision double, latency double")
    for c in ("precision", "recall", "ndcg"):
        for k in (1, 5, 10):
            metrics = metrics.withColumn(f"{c}_at_{k}", F.lit(0.5))
    means = evaluate.aggregates(metrics)
    sinks.evaluation(metrics, means, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/per_query")).count() == 2
    total = spark.read.json(str(tmp_path / "e/aggregate")).first()
    assert total["mrr"] == 0.5 and total["latency_mean"] == 0.5 and total["latency_std"] == 0.25
    assert {r["query_type"] for r in spark.read.json(str(tmp_path / "e/by_type")).collect()} == {"t", "u"}
    line = sinks.report_lines(means).where("query_type IS NULL").first()["line"]
    assert line.startswith("ALL (2 queries), MRR 0.5000") and line.endswith("latency 500.00 +- 250.00 ms")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id long, v string, part string")
    sinks.json_lines(df, str(tmp_path / "j"), "part")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.index_tables({"t": df}, str(tmp_path / "i"))
    sinks.upsert(df.where("id = 1").withColumn("v", F.lit("new")), str(tmp_path / "i/t"), "id")
    assert {(r["id"], r["v"]) for r in sinks.read_table(spark, str(tmp_path / "i/t")).collect()} == {(1, "new"), (2, "b")}
    page = sinks.html_page(spark.createDataFrame([(0, "<T>", "a & b")], "index long, title string, text string"))
    assert 'id="entry-0"' in page and "&lt;T&gt;" in page and "a &amp; b" in page and '#entry-1"' in page


def test_stream_append_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second run repeats the first batch
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        append_documents(stream, str(tmp_path / "index"), str(tmp_path / checkpoint)).awaitTermination()
    assert sinks.read_table(spark, str(tmp_path / "index/documents")).count() == 2
    assert sinks.read_table(spark, str(tmp_path / "index/postings")).count() == 3


def test_json_arrays_of_any_layout_are_cut_into_objects(spark, tmp_path):
    """However the file is laid out and split, and wherever runs end."""
    odd = ['a}b', '{"x": [', 'say "}" \\', "}\\\\", "", "é\n}", None, "y" * 200]
    rows = [{"n": i, "t": odd[i % len(odd)], "d": {"e": [{"f": i}]}} for i in range(24)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps(rows))
    (tmp_path / "j/b.json").write_text("\ufeff \n" + json.dumps(rows, indent=1, ensure_ascii=False))
    (tmp_path / "j/c.json").write_text("[ ]\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, run_bytes in (("1k", 40), (was, 1), (was, 1000)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = arrays.objects(spark, str(tmp_path / "j"), run_bytes)
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        got = [json.loads(r["text"]) for r in found.orderBy("path", "number", "at").collect()]
        assert got == rows + rows
    for n, text in enumerate(('[{"a": 1}, {"a": 2', '[{"a": "x', '{"a": []}', " ")):
        (tmp_path / f"bad{n}.json").write_text(text)
        with pytest.raises(ValueError):
            readers.json_array(spark, str(tmp_path / f"bad{n}.json"), "a long")


def test_a_json_array_is_read_by_many_tasks(spark, tmp_path):
    """One file in parts; Spark's own reader has the whole array in one task."""
    (tmp_path / "a.json").write_text(json.dumps([{"a": i, "t": "x" * 1000} for i in range(3000)]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        rows = readers.json_array(spark, str(tmp_path / "a.json"), "a long, t string")
        most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert most[1] == 3000 and most[0] <= 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
