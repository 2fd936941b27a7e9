"""TF-IDF features and the encoder hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .bm25 import by_id

PART_TEXT = 10_000_000  # characters of text in one part

# English function words, the default stop list.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my "
    "no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def ngrams(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two characters or more without stop words, and their pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\b\w\w+\b)"), 1)
    words = F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def _terms(docs: DataFrame, id_col: str, text_col: str, name: str, stop_words: Sequence[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias(name), F.explode(ngrams(F.coalesce(F.col(text_col), F.lit("")), stop_words)).alias("term"))


def fit_tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int = 768, stop_words: Sequence[str] = STOP_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """(id, term, tf) of the terms that are features, the vocabulary (term,
    term_index, idf), and the number of documents.  The vocabulary are the
    ``features`` most frequent terms of the corpus, ties to the smaller term.  Texts
    are dealt into parts of bounded size, so that no task counts the terms of more;
    in these the terms of the vocabulary are counted by document."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("text")).first()
    dealt = by_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size["text"], PART_TEXT)
    terms = _terms(dealt, "id", "text", "id", stop_words)
    top = stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "term").limit(features).select("term"))
    # At most ``features`` rows: the window and the broadcasts are that small.
    tf = stored(terms.join(F.broadcast(top), "term").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = F.log((F.lit(1) + F.lit(size["n"])) / (F.lit(1) + F.col("df"))) + 1
    rows = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    index = F.row_number().over(Window.orderBy("term")) - 1
    return tf, stored(rows.select("term", index.cast("int").alias("term_index"), idf.alias("idf"))), size["n"]


def weighed(tf: DataFrame, vocabulary: DataFrame, by: str) -> DataFrame:
    """(by, term, term_index, weight) with rows of length 1."""
    rows = tf.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    rows = rows.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.collect_list(F.struct("term", "term_index", "w")).alias("all"))  # a row's features
    return rows.select(by, "length", F.inline("all")).select(by, "term", "term_index", (F.col("w") / F.col("length")).alias("weight"))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int = 768, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(id, term, term_index, weight) of every document."""
    tf, vocabulary, _ = fit_tfidf(docs, id_col, text_col, features, stop_words)
    return weighed(by_id(tf, tf.count()), vocabulary, "id")


def tfidf_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_id: str = "item_id", text_col: str = "text", features: int = 768, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, doc_id, score) by the product of the weights; queries are
    weighed with the corpus' vocabulary and idf.  The pairs of queries and documents
    are made and summed up inside of the documents' parts."""
    tf, vocabulary, n = fit_tfidf(docs, id_col, text_col, features, stop_words)
    terms = _terms(queries, query_id, text_col, "query_id", stop_words).join(F.broadcast(vocabulary.select("term")), "term")
    q = weighed(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf")), vocabulary, "query_id")
    q = stored(q.select("query_id", "term", F.col("weight").alias("qw")))
    pairs = n * q.select("query_id").distinct().count()
    return weighed(by_id(tf, pairs), vocabulary, "id").join(q, "term").groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def unit(vectors: Column) -> Column:
    """Vectors at length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(vectors, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vectors, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def encode(text: Column, model: Callable[[Column], Column], most: int = 512, normalise: bool = True) -> Column:
    """Dense vectors of texts by an ``encoder``: the text's first ``most`` words,
    128 for queries by convention, then the model, then the norm."""
    first = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), 1, most), " ")
    return unit(model(first)) if normalise else model(first)


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Callable[[Column], Column]:
    """A column function text -> array<float> for a model that ``load`` opens
    once in each worker; ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            yield pd.Series([v for lo in range(0, len(texts), batch) for v in model(texts[lo : lo + batch])])

    return run
