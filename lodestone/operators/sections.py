"""Documents to sections at second- and third-level headings.

A text is cut in place, in the JVM and without a shuffle: splitting before each
heading line gives an array whose first element is what stands before the first
heading, and the rest are the sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, url_kept, word_count

_BEFORE = r"\n(?=[ \t\x0B\f\r]*##{1,2}[ \t\x0B\f\r]+[^\n]*\S)"
_HEAD = r"^\s*#{2,3}\s+([^\n]*\S)"


def sections_of(text: Column) -> Column:
    """array<struct<title, text>>."""
    chunks = F.slice(F.split(F.concat(F.lit("\n"), text), _BEFORE), 2, 1 << 30)
    body = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[^\n]*", ""), r"^\n+|\n+$", "")
    return F.transform(chunks, lambda c: F.struct(F.regexp_extract(c, _HEAD, 1).alias("title"), body(c).alias("text")))


def split_sections(docs: DataFrame, text_col: str = "text", index_col: str = "index", min_words: int = 10, min_chars: int = 0) -> DataFrame:
    """A row a section that is long enough: the document's other columns,
    parent_index, position among the document's sections, title and text."""
    others = [c for c in docs.columns if c not in (text_col, "title", index_col)]
    out = docs.select(*others, F.col(index_col).alias("parent_index"), F.posexplode(sections_of(F.col(text_col))).alias("position", "s"))
    out = out.select(*others, "parent_index", "position", F.col("s.title").alias("title"), F.col("s.text").alias("text"))
    return out.where((word_count(F.col("text")) >= min_words) & (F.length(strip(F.col("text"))) >= min_chars))


def clean_outcomes(docs: DataFrame, url_col: str, text_col: str, excluded: list[str], code_blocks: str | None = None, min_words: int = 40) -> DataFrame:
    """``docs`` with ``outcome``: url (filtered by it), short (too few words and
    no code block) or kept."""
    short = word_count(F.coalesce(F.col(text_col), F.lit(""))) < min_words
    if code_blocks:
        short &= F.coalesce(F.size(code_blocks), F.lit(0)) <= 0
    kept = url_kept(F.coalesce(F.col(url_col), F.lit("")), excluded)
    return docs.withColumn("outcome", F.when(~kept, F.lit("url")).when(short, F.lit("short")).otherwise(F.lit("kept")))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many were processed, kept, filtered by URL and by length."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(F.count(F.lit(1)).alias("processed"), of("kept").alias("kept"), of("url").alias("filtered_by_url"), of("short").alias("filtered_by_min_words"))


def kept_docs(docs: DataFrame, text_col: str = "text", code_blocks: str | None = None, min_words: int = 40) -> DataFrame:
    """Documents of enough words, and any with a code block."""
    keep = word_count(F.col(text_col)) >= min_words
    return docs.where(keep | (F.size(code_blocks) > 0) if code_blocks else keep)
