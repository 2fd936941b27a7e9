"""The three kinds of record as one document table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_line, strip

DOCUMENT = ("index", "source_type", "path", "text", "func_name", "docstring_summary", "title")
# The names under which a dataset asks for a parser.
PARSERS = {
    **dict.fromkeys(("sourcecode", "source_code", "src", "code", "structured", "SourceCodeParser", "source"), "sourcecode"),
    **dict.fromkeys(("discussion", "DiscussionParser"), "discussion"),
}


def section(text: Column, names: Sequence[str]) -> Column:
    """What stands below the first of the headers ``--- name ---``, up to the
    next line that begins with three dashes."""
    found = [F.regexp_extract(text, rf"(?s)--- {n} ---\n(.*?)(?=\n---|\z)", 1) for n in names]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))


def field(meta: Column, names: Sequence[str]) -> Column:
    """The value of the first of the fields ``name: value``."""
    found = [strip(F.regexp_extract(meta, rf"(?m)^{n}:\s*(.+)$", 1)) for n in names]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))


def _or(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def parse_source(df: DataFrame, strict_headers: bool = False) -> DataFrame:
    """Entity texts; either spelling of the headers is read unless ``strict``.
    A row without a function name has ``error``."""
    pick = (lambda a, b: [a]) if strict_headers else (lambda a, b: [a, b])
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = section(text, pick("Meta Data", "Metadata"))
    name = field(meta, pick("Function Name", "Name"))
    doc = strip(section(text, pick("Docstring", "Documentation")))
    code = strip(section(text, ["Code"]))
    brief = F.when(doc != "", first_line(doc)).otherwise(F.lit(""))
    body = strip(F.concat(name, F.lit(" "), name, F.lit(" "), brief, F.lit(" "), doc, F.lit(" "), F.substring(code, 1, 500)))
    return df.select(
        F.coalesce(_column(df, "index", "long"), F.lit(0)).alias("index"),
        F.lit("sourcecode").alias("source_type"),
        _or(field(meta, ["Path"]), _column(df, "file"), _column(df, "entry_filename")).alias("path"),
        body.alias("text"),
        name.alias("func_name"),
        brief.alias("docstring_summary"),
        F.lit(None).cast("string").alias("title"),
        F.when(name == "", F.lit("no function name")).alias("error"),
    )


def parse_discussion(df: DataFrame) -> DataFrame:
    """Discussions with columns title, bodyText, answer (struct or null) and
    perhaps answers (array)."""
    fields = {f.name for f in df.schema["answer"].dataType.fields} if "answer" in df.columns else set()
    given = [F.col(f"answer.{n}") for n in ("bodyText", "text") if n in fields]
    if "answers" in df.columns:
        inner = {f.name for f in df.schema["answers"].dataType.elementType.fields}
        given += [F.get("answers", F.lit(0))[n] for n in ("bodyText", "text") if n in inner]
    answer = _or(*given) if given else F.lit("")
    title = F.coalesce(_column(df, "title"), F.lit(""))
    text = F.concat(title, F.lit("\n "), F.coalesce(_column(df, "bodyText"), F.lit("")), F.lit(" \n Answer: "), answer)
    return df.select(
        F.coalesce(_column(df, "index", "long"), _column(df, "id", "long"), F.lit(0)).alias("index"),
        F.lit("discussion").alias("source_type"),
        _or(_column(df, "entry_filename"), _column(df, "url"), _column(df, "file"), title).alias("path"),
        strip(text).alias("text"),
        F.lit(None).cast("string").alias("func_name"),
        F.lit(None).cast("string").alias("docstring_summary"),
        title.alias("title"),
        F.lit(None).cast("string").alias("error"),
    )


def parse_raw(df: DataFrame) -> DataFrame:
    """Documents as they are: path and text."""
    path = _or(_column(df, "file"), _column(df, "entry_filename"))
    text = _or(_column(df, "text"), _column(df, "content"), _column(df, "raw_text"))
    return df.select(
        F.coalesce(_column(df, "index", "long"), F.lit(0)).alias("index"),
        F.lit("docs").alias("source_type"),
        path.alias("path"),
        F.concat(path, F.lit(" "), text).alias("text"),
        *[F.lit(None).cast("string").alias(c) for c in ("func_name", "docstring_summary", "title", "error")],
    )


def parse(df: DataFrame, parser: str | None) -> DataFrame:
    """``df`` by the parser of that name; raw without one."""
    kind = PARSERS.get(parser or "")
    return parse_source(df) if kind == "sourcecode" else parse_discussion(df) if kind == "discussion" else parse_raw(df)


def union_corpora(datasets: Sequence[DataFrame]) -> DataFrame:
    """Parsed datasets in order, without the rows that failed, with the number
    of the dataset in ``dataset``."""
    out = None
    for number, df in enumerate(datasets):
        rows = df.where(F.col("error").isNull()).drop("error").withColumn("dataset", F.lit(number))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


# The parts of a file's name that say which source it is of.
KINDS = {"discussions.json": "discussions", "docs_cleaned.json": "docs", "src_filtered_data.json": "source"}


def enrich_relevant(truth: DataFrame, sources: dict[str, DataFrame], key: str = "query") -> DataFrame:
    """``truth`` with the text of each relevant document filled in from the source
    that its ``file`` names, by ``index``.  ``sources``: by kind, tables of index
    and text.  A document of no such file, or of an index that is not there, keeps
    its text.  One join on (kind, index); the order of the documents stays."""
    kind = lambda f: F.coalesce(*[F.when(F.contains(f, F.lit(part)), F.lit(name)) for part, name in KINDS.items()])
    known = None
    for name, df in sources.items():
        rows = df.select(F.lit(name).alias("kind_"), F.col("index").cast("long").alias("index_"), F.col("text").alias("text_"))
        known = rows if known is None else known.unionByName(rows)
    docs = truth.select(key, F.posexplode("relevant_docs").alias("at_", "d_"))
    docs = docs.withColumns({"kind_": kind(F.col("d_.file")), "index_": F.col("d_.index").cast("long")}).join(known, ["kind_", "index_"], "left")
    full = docs.select(key, F.struct("at_", F.col("d_").withField("text", F.coalesce("text_", "d_.text")).alias("d")).alias("r"))
    full = full.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["d"]).alias("filled_"))  # a query's documents
    return truth.join(full, key, "left").withColumn("relevant_docs", F.coalesce("filled_", "relevant_docs")).drop("filled_")


def answered(threads: DataFrame, comments: str, answer: str, keywords: Sequence[str], first: int = 20) -> DataFrame:
    """Threads with an answer and a keyword, whatever its case, in one of their
    first comments.  Keywords are plain text."""
    named = lambda c: F.greatest(F.lit(False), *[F.contains(F.lower(c), F.lit(k.lower())) for k in keywords])
    hit = F.exists(F.slice(comments, 1, first), lambda c: F.coalesce(named(c), F.lit(False)))
    return threads.where(F.col(answer).isNotNull() & F.coalesce(hit, F.lit(False)))
