"""The catalogue of registered queries; ``oracle`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code, docstrings, rst, text
from ..functions import vectors as V
from ..operators import bm25, corpus, evaluate, features, hybrid, knn, ordinals, sections
from ..sources import crawl, readers, scratch, sinks
from . import oracle, retrieval, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = oracle.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------ text


@query
def doc_word_counts(spark, sf_dir):
    n = text.word_count(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_words"), (n >= 40).alias("kept"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    block = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda t: t["b"])
    return turns.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("text"))  # a conversation's turns


@query
def section_split(spark, sf_dir):
    docs = _threads(spark, sf_dir).withColumnRenamed("conv_id", "index")
    out = ordinals.with_ordinal(sections.split_sections(docs), [F.col("parent_index"), F.col("position")])
    return out.select("index", "parent_index", F.col("position").cast("long"), "title", "text")


@query
def inline_cleanup(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("clean"))


@query
def strip_orphans(spark, sf_dir):
    marked = F.concat(F.lit(":orphan:\n\n.. _label-1:\n"), "text", F.lit("\n  :orphan:  \nend"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.strip_orphans(marked).alias("clean"))


@query
def title_sanitize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.sanitize_title(F.col("text")).alias("title"))


@query
def code_tokenize_text(spark, sf_dir):
    tokens = text.text_tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query
def summaries(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.summary(F.concat(F.lit("\n  \n"), "text")).alias("summary"), F.md5("text").alias("hash"))


@query
def display_string(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit(""))
    name = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.display(title, name, F.lit(None).cast("string"), F.col("text"), F.lit("path")).alias("display"))


@query
def viewer_search(spark, sf_dir):
    found = sinks.search(_t(spark, sf_dir, "documents").withColumnRenamed("source", "title"), "THAN")
    return found.select("doc_id", text.html_escape(F.col("text")).alias("escaped"))


@query
def html_cards(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", sinks.html_card(F.col("doc_id"), F.col("source"), F.col("text")).alias("card"))


# ------------------------------------------------------------ pages


@query
def html_title(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query
def html_links(spark, sf_dir):
    links = crawl.links(_t(spark, sf_dir, "pages"))
    keep = crawl.admitted(F.col("href"), F.col("target"), "http")
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("n_admitted"), F.count_if(text.is_doc_page(F.col("target"))).alias("n_pages"))


@query
def url_filter(spark, sf_dir):
    rel = text.rel_path(F.col("url"), "https://")
    rows = _t(spark, sf_dir, "pages").where(text.url_kept(F.col("url"), ("/FR/", "blog.")))
    rows = rows.where(text.prefix_kept(rel, ("www.", "th", "m."), ("m.th",)))
    return rows.select("page_id", rel.alias("rel"), F.replace("url", F.lit("https://"), F.lit("")).alias("file"))


@query
def crawl_frontier(spark, sf_dir):
    """The pages as a site whose page n links to 2n+1 and 2n+2."""
    n = F.col("page_id")
    url = lambda c: F.concat(F.lit("https://site.example/"), c.cast("string"), F.lit(".html"))
    link = lambda c: F.concat(F.lit('<a href="/'), c.cast("string"), F.lit('.html">x</a>'))
    pages = _t(spark, sf_dir, "pages").select(url(n).alias("url"), F.concat(link(2 * n + 1), link(2 * n + 2), F.lit('<a href="#top">t</a><a href="/a.txt">s</a>')).alias("html"))
    return crawl.crawl(pages, ["https://site.example/0.html"], "https://site.example/")


@query
def source_fetch(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), "text")
    raw = docs.where(F.col("doc_id") % 2 == 0).select("url", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.lit(" short ")).alias("text"))
    spare = docs.where(F.col("doc_id") % 3 == 0).select("url", "text")
    return crawl.with_sources(pages, raw, spare).drop("url")


@query
def unique_urls(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("url").distinct().orderBy("url")


# ------------------------------------------------------------ corpus


@query
def answered_threads(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    firsts = turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("bodies"),
    )
    comments = firsts.withColumn("comments", F.col("bodies"))
    kept = corpus.answered(comments, "comments", "answer", ("than", "der "))
    kept = kept.orderBy(F.col("conv_id").desc()).limit(50)
    return ordinals.with_ordinal(kept.select("conv_id"), [-F.col("conv_id")])


@query
def discussion_text(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    rows = turns.groupBy("conv_id").agg(first("user").alias("bodyText"), F.struct(first("assistant").alias("bodyText")).alias("answer"))
    rows = rows.withColumns({"title": F.concat(F.lit("thread "), F.col("conv_id").cast("string")), "index": F.col("conv_id")})
    return corpus.parse_discussion(rows).select("index", "path", "title", "text")


@query
def corpus_union(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("source").alias("file"), "text")
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("index"), F.lit("").alias("file"), F.col("url").alias("entry_filename"), F.col("html").alias("content"))
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.col("role").alias("title"), F.col("text").alias("bodyText"))
    united = corpus.union_corpora([corpus.parse(docs, None), corpus.parse(pages, None), corpus.parse(turns, "discussion")])
    return united.select("dataset", "index", "source_type", "path", "title", F.md5("text").alias("text_md5"))


@query
def capped_corpus(spark, sf_dir):
    """All documents but those that fail to parse, then pages up to the cap."""
    number = lambda t, c: ordinals.with_ordinal(_t(spark, sf_dir, t).select(F.col(c).alias("id")), [F.col("id")], "ordinal")
    docs = number("documents", "doc_id").withColumn("error", F.when(F.col("id") % 10 == 3, F.lit("bad")))
    pages = number("pages", "page_id").withColumn("error", F.lit(None).cast("string"))
    return ordinals.capped_union([docs, pages], 1100).select("dataset", "id")


@query
def dataset_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    n = docs.count()
    rows = ordinals.with_ordinal(docs.select("doc_id"), [F.col("doc_id")], "ordinal")
    return rows.groupBy(ordinals.split_of(F.col("ordinal"), n).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(samples.NAMES), "name string, entity_type string, class_name string, n_params int").withColumn(
        "parameters", F.transform(F.sequence(F.lit(1), F.col("n_params")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    ).withColumn("parameters", F.when(F.col("n_params") > 0, F.col("parameters")).otherwise(F.array().cast("array<string>")))


@query
def verb_docstring(spark, sf_dir):
    made = docstrings.function_doc(F.col("name"), F.col("entity_type"), F.col("class_name"), F.col("parameters"))
    return _names(spark).select("name", made.alias("doc"))


@query
def class_docstring(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.element_at(F.array(*[F.lit(p) for p, _ in docstrings.CLASS_KINDS], F.lit("Thing")), (F.col("p_partkey") % 9 + 1).cast("int")))
    parents = F.when(F.col("p_size") > 25, F.array(F.lit("Base"), "p_brand")).otherwise(F.array().cast("array<string>"))
    return part.select("p_partkey", docstrings.class_doc(name, parents).alias("doc"))


@query
def structured_parse(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("fn_"), F.col("doc_id").cast("string")))
    old = F.concat(
        F.lit("--- Meta Data ---\nRepo: r\nPath: src\\"), "source", F.lit(".py\nFunction Name: "), name, F.lit("\nLanguage: python\n\n--- Docstring ---\n"),
        F.col("text"), F.lit("\n\n--- Code ---\ndef f():\n    pass # "), "lang",
    )
    rows = docs.select(F.col("doc_id").alias("index"), "source", old.alias("text"))
    return corpus.parse_source(rows).select("index", "path", "func_name", "docstring_summary", "text", "error")


@query
def rag_text(spark, sf_dir):
    none = F.array().cast("array<string>")
    sized = lambda c: F.when(F.col("p_size") > 25, F.array(c, F.lit("x"))).otherwise(none)
    made = code.rag_text(
        F.lit("repo"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string")), F.col("p_name"), F.lit("method"), F.col("p_brand"), F.col("p_type"),
        sized(F.col("p_type")), none, sized(F.col("p_name")), F.when(F.col("p_size") > 10, F.col("p_name")), F.col("p_type"),
    )
    return _t(spark, sf_dir, "part").select("p_partkey", made.alias("text"), F.md5(made).alias("hash"))


@query
def file_filter(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    names = ("dist", "build", "distributed.py", "builder.py", "latest", "tests", "core")
    path = F.concat(F.lit("src\\"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("/f.py"))
    return part.select("p_partkey", text.path_excluded(path, ("dist", "build")).alias("out_segment"), text.path_excluded(path, ("dist", "build"), substring=True).alias("out_substring"))


# ------------------------------------------------------------ search


@query
def tf_df_stats(spark, sf_dir):
    tokens = bm25.tokenised(_t(spark, sf_dir, "documents"), "doc_id", "text")
    tf = bm25.term_frequencies(tokens)
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


@query
def idf_floor(spark, sf_dir):
    tokens = bm25.tokenised(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return bm25.idf(bm25.document_frequencies(tokens), bm25.totals(tokens)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


@query
def bm25_topk(spark, sf_dir):
    return bm25.top_k(_bm25(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


@query
def bm25_normalized(spark, sf_dir):
    scored = bm25.normalised(_bm25(spark, sf_dir))
    return bm25.top_k(scored.where(F.col("score") > 0.1), 20).select("query_id", "doc_id", "score", "rank")


@query
def tfidf_vectors(spark, sf_dir):
    return features.tfidf(_t(spark, sf_dir, "documents")).select("id", "term", "term_index", F.round("weight", 6).alias("weight"))


@query
def tfidf_topk(spark, sf_dir):
    scored = features.tfidf_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return bm25.top_k(scored, 5).select("query_id", "doc_id", "score", "rank")


def _asks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    rows = _t(spark, sf_dir, "embeddings")
    return rows, rows.where(F.col("vec_id") % 50 == 0)


@query
def knn_l2(spark, sf_dir):
    found = knn.exact(*_asks(spark, sf_dir))
    return found.select("query_id", "doc_id", "distance", F.round(V.distance_score(F.col("distance")), 6).alias("score"), "rank")


@query
def knn_cosine(spark, sf_dir):
    return knn.exact(*_asks(spark, sf_dir), metric="cosine")


@query
def knn_ivf(spark, sf_dir):
    return knn.by_cells(*_asks(spark, sf_dir), recall=0.9).select("query_id", "doc_id", "distance", "rank")


@query
def knn_lsh(spark, sf_dir):
    return knn.by_hashing(*_asks(spark, sf_dir)).select("query_id", "doc_id", "distance", "rank")


@query
def hybrid_topk(spark, sf_dir):
    """All documents by BM25, those that have a vector of their id also by it;
    it shows the mechanics, not quality."""
    vectors, docs, items = (_t(spark, sf_dir, t) for t in ("embeddings", "documents", "benchmark"))
    rows = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    points = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = knn.exact(rows, points, 10, "cosine")
    return hybrid.fuse(dense, bm25.normalised(bm25.scores(docs, items)), 5)


@query
def embedding_norms(spark, sf_dir):
    n = V.norm(V.doubles(F.col("embedding")))
    return _t(spark, sf_dir, "embeddings").agg(F.round(F.avg(n), 6).alias("mean_norm"), F.round(F.stddev_pop(n), 6).alias("std_norm"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ evaluation


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nearest neighbours as results; the truth of a query are the vectors of its
    label in its block of 500 ids."""
    rows, asks = _asks(spark, sf_dir)
    ranked = knn.exact(rows, asks, 10, "cosine")
    path = lambda c: F.concat(F.lit("v/"), c.cast("string"))
    docs = rows.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("index"), path(F.col("vec_id")).alias("path"), F.lit("docs").alias("source_type"), F.lit("").alias("func_name"), F.lit("").alias("display"))
    queries = asks.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("query_type"))
    results = hybrid.results(ranked, queries, docs)
    block = F.floor(F.col("vec_id") / 500).alias("block")
    pool = rows.select("label", block, F.struct(F.lit(None).cast("string").alias("entry_filename"), path(F.col("vec_id")).alias("path"), F.col("vec_id").alias("index"), F.lit("").alias("func_name")).alias("d"))
    pool = pool.groupBy("label", "block").agg(F.sort_array(F.collect_list("d")).alias("relevant_docs"))  # 500 rows at most
    truth = asks.withColumn("block", block).join(pool, ["label", "block"]).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), "relevant_docs")
    return results, truth


@query
def eval_per_query(spark, sf_dir):
    out = evaluate.per_query(*_judged(spark, sf_dir)).drop("query")
    return out.select("query_id", "query_type", *[F.col(c).cast("long").alias(c) for c in ("n_retrieved", "n_relevant")], *[F.round(c, 6).alias(c) for c in out.columns if "_at_" in c or c in ("mrr", "average_precision")])


@query
def eval_aggregate(spark, sf_dir):
    out = evaluate.aggregates(evaluate.per_query(*_judged(spark, sf_dir)))
    return out.select("query_type", "n_queries", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("query_type", "n_queries")])


@query
def hit_rate_at_k(spark, sf_dir):
    metrics = evaluate.per_query(*_judged(spark, sf_dir))
    return metrics.agg(*[F.round(F.avg((F.col(f"recall_at_{k}") > 0).cast("double")), 6).alias(f"hit_rate_at_{k}") for k in evaluate.CUTS])


@query
def gt_last_wins(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    truth = labels.select(F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("query"), "doc_id", "quality", "toxic")
    return evaluate.last_wins(truth, "doc_id")


@query
def skipped_queries(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    truth = labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("query"), F.when(F.col("toxic") == 0, F.array("doc_id")).otherwise(F.array().cast("array<long>")).alias("relevant_docs"))
    asked = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("query"))
    return evaluate.skipped(asked, truth).select("doc_id")


@query
def type_distribution(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy(F.col("role").alias("query_type")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())  # a row a type
    return rows.select("query_type", "n", F.round(share, 6).alias("share"))


@query
def metadata_sample(spark, sf_dir):
    return sinks.metadata(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


# ------------------------------------------------------------ parsers


@query
def entity_extract(spark, sf_dir):
    files = spark.createDataFrame(list(samples.SOURCES), "path string, content string")
    found = code.entities(files, "repo", "https://example.org/blob/main")
    lists = ("code_tokens", "parent_classes", "decorators", "parameters")
    plain = ("path", "func_name", "entity_type", "class_name", "class_docstring", "docstring_summary", "return_type", "start_line", "end_line", "complexity", "is_synthetic_docstring", "url")
    return found.select(*plain, *[F.array_join(c, " ").alias(c) for c in lists])


@query
def entity_summary(spark, sf_dir):
    files = spark.createDataFrame(list(samples.SOURCES), "path string, content string")
    entities = code.entities(files, "repo", "https://example.org/blob/main")
    row = sinks.summary_row(entities, "repo", "out", {"min_lines": 1}, {"files": 3})
    return row.withColumns({"entity_type_counts": F.to_json("entity_type_counts"), "classes": F.array_join("classes", " ")})


@query
def rst_clean(spark, sf_dir):
    docs = spark.createDataFrame(list(samples.RST), "id long, text string")
    blocks = F.transform("r.code_blocks", lambda b: F.concat(b["lang"], F.lit(":"), b["code"]))
    return docs.select("id", rst.clean_rst(F.col("text")).alias("r")).select("id", "r.text", F.array_join(blocks, "|").alias("code_blocks"))


# ------------------------------------------------------------ sources and sinks


@query
def paginated_discussions(spark, sf_dir):
    """Conversations as pages of 100, newest first, up to the page that reaches
    1,000."""
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    rows = ordinals.with_ordinal(rows, [-F.col("conv_id")], "at").withColumn("page", F.floor(F.col("at") / 100))
    pages = rows.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "conv_id", "turns"))), lambda r: F.struct(r["conv_id"], r["turns"])).alias("nodes"))  # 100 a page
    found = readers.first_pages(pages.withColumn("has_next", F.lit(True)))
    return found.select("ordinal", "page", F.col("node.conv_id").alias("conv_id"), F.col("node.turns").alias("turns"))


@query
def enriched_truth(spark, sf_dir):
    """Each query's documents of three sources, by number, and one of none."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.concat("source", F.lit("\n"), "text").alias("text"))
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("index"), F.col("html").alias("text"))
    turns = _t(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("index"), "text")
    item = lambda file, i: F.struct(F.lit(file).alias("file"), i.alias("index"), F.lit("as it was").alias("text"))
    n = F.col("item_id")
    given = F.array(item("x/docs_cleaned.json", n), item("x/discussions.json", n * 2), item("y/src_filtered_data.json", n * 3), item("other.json", n))
    truth = _t(spark, sf_dir, "benchmark").select(n.cast("string").alias("query"), given.alias("relevant_docs"))
    full = corpus.enrich_relevant(truth, {"docs": docs, "discussions": turns, "source": pages})
    return full.select("query", F.posexplode("relevant_docs").alias("place", "d")).select("query", "place", F.col("d.file").alias("file"), F.md5("d.text").alias("text_md5"))


@query
def output_path_filter(spark, sf_dir):
    path = F.concat(F.lit("src\\"), "p_type", F.lit("/"), "p_name")
    rows = _t(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.where(text.path_kept(F.col("path"), ("src\\STANDARD", "BRASS"))).select("p_partkey")


@query
def source_urls(spark, sf_dir):
    rel = text.rel_path(F.col("url"), "https://")
    return _t(spark, sf_dir, "pages").select("page_id", text.source_url(rel, "https://raw.example.org/docs").alias("raw"), text.sources_txt_url(rel, F.lit("https://docs.example.org/stable/")).alias("txt"))


@query
def clean_counters(spark, sf_dir):
    """Documents with code by number: the short ones of them are kept."""
    blocks = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("code"))).otherwise(F.array().cast("array<string>"))
    rows = _t(spark, sf_dir, "documents").withColumns({"blocks": blocks, "url": F.concat(F.lit("https://x/"), "source", F.lit("/"))})
    return sections.counters(sections.clean_outcomes(rows, "url", "text", ["/SRC1/"], "blocks"))


@query
def kept_documents(spark, sf_dir):
    blocks = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("code"))).otherwise(F.array().cast("array<string>"))
    rows = _t(spark, sf_dir, "documents").withColumn("blocks", blocks)
    labelled = ordinals.with_ordinal(sections.kept_docs(rows, "text", "blocks").select("doc_id"), [F.col("doc_id")])
    return labelled.select("doc_id", "index", F.lit("docs").alias("label"), F.lit("docs_cleaned.json").alias("file"))


@query
def collection_created(spark, sf_dir):
    """A collection that was there, dropped and made anew, then filled twice."""
    path = f"{scratch.folder(spark)}/collection"
    rows = _t(spark, sf_dir, "embeddings")
    sinks.create_collection(spark, path, 8, "L2")
    sinks.create_collection(spark, path, 64, "COSINE")
    sinks.upsert(rows.select("vec_id", F.lit("first").alias("v")), path, "vec_id")
    sinks.upsert(rows.where("vec_id % 3 = 0").select("vec_id", F.lit("second").alias("v")), path, "vec_id")
    counts = sinks.read_table(spark, path).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(sinks.collection(spark, path))  # one row on the right


@query
def json_lines_round_trip(spark, sf_dir):
    path = f"{scratch.folder(spark)}/lines-{uuid.uuid4().hex}"
    sinks.json_lines(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "lang")
    rows = readers.json_lines(spark, f"{path}/*", "doc_id long, text string")
    return rows.where("NOT malformed").select("row.doc_id", F.md5("row.text").alias("text_md5"))


@query
def json_array_round_trip(spark, sf_dir):
    path = f"{scratch.folder(spark)}/array-{uuid.uuid4().hex}.json"
    sinks.json_array(_t(spark, sf_dir, "pages").select("page_id", "url", "html"), path, "page_id")
    rows = readers.json_array(spark, path, "page_id long, url string, html string")
    return rows.select("page_id", "url", F.md5("html").alias("html_md5"))


@query
def requests_loaded(spark, sf_dir):
    """Two files of requests, objects and bare strings, numbered through."""
    path = f"{scratch.folder(spark)}/requests-{uuid.uuid4().hex}"
    items = _t(spark, sf_dir, "benchmark")
    sinks.json_array(items.select("item_id", F.col("text").alias("query"), F.lit("docs").alias("type")), f"{path}/a.json", "item_id")
    sinks.json_array(items.select("item_id", F.col("text").alias("query"), F.lit("code").alias("query_type"), F.lit("docs").alias("type")), f"{path}/b.json", "item_id")
    return readers.requests(spark, path)


@query
def result_dump(spark, sf_dir):
    rows, asks = _asks(spark, sf_dir)
    docs = rows.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("v"), "vec_id").alias("text"), F.concat(F.lit("https://x/"), "vec_id").alias("link"))
    queries = asks.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("q"), "vec_id").alias("query"))
    out = hybrid.dump(knn.exact(rows, asks), queries, docs)
    total = F.aggregate("distances", F.lit(0.0), lambda s, x: s + x)
    return out.select("query_id", "query", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("doc_ids", "top_docs", "doc_links")], F.round(total, 5).alias("total"))


@query
def eval_report(spark, sf_dir):
    """The report with a latency that follows from the query's number."""
    results, truth = _judged(spark, sf_dir)
    results = results.withColumn("latency", (F.col("query_id") % 7) / F.lit(8.0))
    return sinks.report_lines(evaluate.aggregates(evaluate.per_query(results, truth)))


@query
def eval_latency(spark, sf_dir):
    results, truth = _judged(spark, sf_dir)
    results = results.withColumn("latency", (F.col("query_id") % 7) / F.lit(8.0))
    return evaluate.aggregates(evaluate.per_query(results, truth)).select("query_type", F.round("latency_mean", 6).alias("mean"), F.round("latency_std", 6).alias("std"))


@query
def retrieved_with_latency(spark, sf_dir):
    """What the lifecycle returns; of the measured time only that it is there."""
    docs = corpus.parse(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("source").alias("file"), "text"), None).withColumn("doc_id", F.col("index"))
    queries = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("docs").alias("query_type"))
    results, _ = retrieval.retrieve(docs, queries, k=5)
    return results.select("query_id", F.array_join(F.transform("retrieved_docs", lambda d: d["index"].cast("string")), " ").alias("found"), (F.col("latency") > 0).alias("timed"))
