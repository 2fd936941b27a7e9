"""Writers: JSON lines and arrays, index tables, evaluations, HTML."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape
from ..operators.ordinals import with_ordinal
from .scratch import folder


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder a value of ``by``."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def json_array(df: DataFrame, path: str, order: str) -> None:
    """One file with the rows as a JSON array.  The rows are written as sorted
    text by the executors; the driver only joins the parts' bytes, a buffer at a
    time, so that neither holds the table."""
    spark = df.sparkSession
    rows = with_ordinal(df, [F.col(order)], "ordinal_")
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    comma = F.when(F.col("ordinal_") == 0, F.lit("")).otherwise(F.lit(","))
    parts = f"{folder(spark)}/arrays/{uuid.uuid4().hex}"
    rows.orderBy("ordinal_").select(F.concat(comma, line).alias("value")).write.text(parts)
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    source = hadoop.fs.Path(parts)
    fs, target = source.getFileSystem(conf), hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(b"[\n"))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")):
            with_in = fs.open(hadoop.fs.Path(name))
            hadoop.io.IOUtils.copyBytes(with_in, out, 1 << 16, False)
            with_in.close()
        out.write(bytearray(b"]\n"))
    finally:
        out.close()
    fs.delete(source, True)


def extraction_summary(entities: DataFrame) -> DataFrame:
    """One row: counts by entity type and the first 100 class names."""
    kinds = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("entity_type_counts"))
    classes = entities.where(F.col("entity_type") == "class").orderBy("path", "start_line").limit(100)
    names = classes.agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "start_line", "func_name"))), lambda r: r["func_name"]).alias("classes"))
    return kinds.crossJoin(names)  # one row each


def summary_row(entities: DataFrame, repository: str, output: str, config: dict, statistics: dict) -> DataFrame:
    """``extraction_summary`` with what the run was asked and counted: repository,
    output_directory, config and statistics (JSON), total_entities and
    classes_discovered."""
    given = {"repository": repository, "output_directory": output, "config": json.dumps(config, sort_keys=True), "statistics": json.dumps(statistics, sort_keys=True)}
    counts = entities.agg(F.count(F.lit(1)).alias("total_entities"), F.count_distinct(F.when(F.col("entity_type") == "class", F.col("func_name"))).alias("classes_discovered"))
    return counts.crossJoin(extraction_summary(entities)).select(*[F.lit(v).alias(k) for k, v in given.items()], "*")  # one row each


def index_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of an index as Parquet, each in a folder of its name; what was
    there is replaced."""
    for name, df in tables.items():
        create_collection(df.sparkSession, f"{path}/{name}")
        _write_version(df, f"{path}/{name}", 1)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_collection(spark: SparkSession, path: str, size: int | None = None, metric: str | None = None) -> None:
    """An empty collection; one that is there is dropped.  Its size and metric
    stand beside its versions."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)
    fs.mkdirs(at)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_collection.json"), True)
    out.write(bytearray(json.dumps({"size": size, "distance": metric}).encode()))
    out.close()


def collection(spark: SparkSession, path: str) -> DataFrame:
    """One row: size and distance of a collection."""
    fs, _ = _fs(spark, path)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_collection.json"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    found = json.loads(text)
    return spark.createDataFrame([(found["size"], found["distance"])], "size int, distance string")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[8:]) for n in names if n.startswith("version-") and done(n))


def _write_version(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version-{number}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of a table."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version-{found[-1]}")


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Rows by id into a table: a row with the id of another takes its place.  A
    new version is written beside the old one; the file that ends a write makes it
    the one that is read, so that at each moment one whole version is there.  The
    version before stays for readers that have begun."""
    spark = df.sparkSession
    there = _versions(spark, path)
    if there:
        kept = read_table(spark, path).join(df.select(key), key, "left_anti")
        df = kept.unionByName(df, allowMissingColumns=True)
    _write_version(df, path, there[-1] + 1 if there else 1)
    fs, _ = _fs(spark, path)
    for old in there[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{old}"), True)


# The names of the metrics in a report.
REPORTED = (("mrr", "MRR"), ("average_precision", "MAP"), ("ndcg_at_10", "NDCG@10"), ("precision_at_5", "Precision@5"), ("recall_at_5", "Recall@5"))


def report_lines(aggregates: DataFrame) -> DataFrame:
    """(query_type, line): the console report of ``evaluate.aggregates``, a line
    for each type and one for all (query_type null)."""
    parts = [x for c, name in REPORTED for x in (F.lit(f", {name} "), F.format_string("%.4f", F.col(c)))]
    head = F.concat(F.upper(F.coalesce("query_type", F.lit("all"))), F.lit(" ("), F.col("n_queries").cast("string"), F.lit(" queries)"))
    late = []
    if "latency_mean" in aggregates.columns:
        late = [F.lit(", latency "), F.format_string("%.2f", F.col("latency_mean") * 1000), F.lit(" +- "), F.format_string("%.2f", F.col("latency_std") * 1000), F.lit(" ms")]
    return aggregates.select("query_type", F.concat(head, *parts, *late).alias("line"))


def evaluation(metrics: DataFrame, aggregates: DataFrame, path: str) -> None:
    """An evaluation as JSON: the rows of each query, the means over all and those
    by type, each in a folder of its own."""
    json_lines(metrics, f"{path}/per_query")
    json_lines(aggregates.where(F.col("query_type").isNull()).drop("query_type"), f"{path}/aggregate")
    json_lines(aggregates.where(F.col("query_type").isNotNull()), f"{path}/by_type")


def metadata(docs: DataFrame, order: str, sample: int = 100) -> DataFrame:
    """The first rows of a collection, with its size."""
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return docs.orderBy(order).limit(sample).crossJoin(total)  # one row on the right


def html_card(index: Column, title: Column, text: Column) -> Column:
    """An entry of the page."""
    number = index.cast("string")
    return F.concat(
        F.lit('<article class="entry" id="entry-'), number, F.lit('"><h2>'), html_escape(title), F.lit("</h2><pre>"), html_escape(text),
        F.lit('</pre><a href="#entry-'), (index + 1).cast("string"), F.lit('">next</a></article>'),
    )


_PAGE = (
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Documents</title></head><body>'
    '<input id="q" placeholder="Search" oninput="filter(this.value)"><nav><ol>{toc}</ol></nav><main>{cards}</main>'
    "<script>function filter(q){q=q.toLowerCase();document.querySelectorAll('.entry').forEach(e=>{"
    "e.style.display=e.textContent.toLowerCase().includes(q)?'':'none'})}</script></body></html>"
)


def html_page(docs: DataFrame, index: str = "index", title: str = "title", text: str = "text", most: int = 20_000) -> str:
    """A page with a table of contents, a card a document and a search field.  It
    is one text for a browser; more than ``most`` documents are an error."""
    rows = docs.orderBy(index).limit(most + 1).select(
        F.concat(F.lit('<li><a href="#entry-'), F.col(index).cast("string"), F.lit('">'), html_escape(F.col(title)), F.lit("</a></li>")).alias("toc"),
        html_card(F.col(index), F.col(title), F.col(text)).alias("card"),
    )
    toc, cards = [], []
    for r in rows.toLocalIterator():
        toc.append(r["toc"])
        cards.append(r["card"])
    if len(cards) > most:
        raise ValueError(f"more than {most} documents for one page")
    return _PAGE.replace("{toc}", "".join(toc)).replace("{cards}", "".join(cards))


def search(docs: DataFrame, term: str, title: str = "title", text: str = "text") -> DataFrame:
    """Documents that hold the term in title or text, whatever the case."""
    return docs.where(F.contains(F.lower(F.concat_ws(" ", title, text)), F.lower(F.lit(term))))
