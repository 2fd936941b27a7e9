"""Okapi BM25 over a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_words
from ..sources.scratch import shuffle_parts, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
ROWS = 1_000_000  # pairs of a query and a document in one part


def tokenised(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(lower_words(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))


def totals(tokens: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df): one shuffle, on partial counts."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of every document."""
    return tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(df_table: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf_raw, idf): a negative idf becomes a share of the mean.  The
    table of terms is read twice, so it is written out."""
    raw = df_table.crossJoin(F.broadcast(total.select("n_docs")))  # one row on the right
    raw = stored(raw.withColumn("idf_raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("idf_raw").alias("mean_idf"))
    floored = F.when(F.col("idf_raw") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("idf_raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "idf_raw", floored.alias("idf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts as often as it stands."""
    words = queries.select(F.col(id_col).alias("query_id"), F.explode(lower_words(F.col(text_col))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def by_id(df: DataFrame, rows: int, most: int = ROWS) -> DataFrame:
    """``df`` dealt by ``id`` into as many parts as ``rows`` rows, made from it later,
    take at ``most`` a part.  What is grouped by id, or by id and more, stays in its
    part, so those rows need no shuffle."""
    return df.repartition(max(1, -(-rows // most), shuffle_parts(df.sparkSession)), "id")


def scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a word with the
    query.  Texts are cut into words once, and what was cut is written out.  Only
    words that some query has go on to the documents' parts; the pairs with queries,
    which are far more, are made and summed up inside of these."""
    tokens = stored(tokenised(docs, doc_id, doc_text))
    total = stored(totals(tokens))
    terms = stored(query_terms(queries, query_id, query_text))
    wanted = terms.select("term").distinct()
    weights = idf(document_frequencies(tokens), total).join(wanted, "term")
    # A row a query and word: small enough to broadcast, or else joined by word.
    asked = stored(weights.join(terms, "term").select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("weight")))
    pairs = total.first()["n_docs"] * terms.select("query_id").distinct().count()
    tf = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    tf = by_id(tf, pairs).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")
    part = F.col("weight") * (F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length))
    joined = tf.crossJoin(F.broadcast(total.select("avgdl"))).join(asked, "term")
    return joined.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """rank, by the rounded score, ties to the smaller document."""
    scored = scored.withColumn("score", F.round("score", digits))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def normalised(scored: DataFrame) -> DataFrame:
    """Scores divided by the query's largest, where that is over 0.  The largest are
    written out, a row a query; the scores are made again for the division."""
    most = stored(scored.groupBy("query_id").agg(F.max("score").alias("most_")))
    return scored.join(most, "query_id").withColumn("score", F.when(F.col("most_") > 0, F.col("score") / F.col("most_")).otherwise(F.col("score"))).drop("most_")
