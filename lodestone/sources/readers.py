"""Readers: JSON arrays, JSON lines, source trees, requests, truths, settings."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.ordinals import with_ordinal
from . import arrays


def json_array(spark: SparkSession, path: str, schema: str, position: str | None = None) -> DataFrame:
    """The objects of files that each hold one JSON array, read by many tasks; a file
    that holds anything else is an error.  An object that doesn't parse is a row of
    nulls.  ``position``: a column for its place, in the order of paths."""
    rows = arrays.objects(spark, path)
    at = [F.struct("path", "number", "at").alias(position)] if position else []
    return rows.select(F.from_json("text", schema).alias("row"), *at).select("row.*", *([position] if position else []))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines as ``row`` (struct) with ``malformed``; blank lines are left out.
    The caller counts the malformed before dropping them."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(read.alias("row")).withColumn("malformed", F.col("row._corrupt").isNotNull() | F.col("row").isNull())


def counted(rows: DataFrame) -> dict[str, int]:
    """total and malformed of ``json_lines``, in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("malformed").alias("malformed")).first().asDict()


def source_tree(spark: SparkSession, root: str, subdirs: Sequence[str] = ("src/lightning", "src"), pattern: str = "*.py") -> DataFrame:
    """(path, content) of the files below the first sub-folder that there is, in
    the order of their paths; path is relative to ``root``."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = next((s for s in subdirs if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{s}"))), "")
    whole = fs.makeQualified(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(f"{root}/{top}".rstrip("/"))
    rel = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(whole.replace("file:///", "file:/")) + 1, 1 << 20)
    return files.select(rel.alias("path"), F.col("content").cast("string").alias("content")).orderBy("path")


def first_pages(pages: DataFrame, most: int = 1000) -> DataFrame:
    """The nodes of cursor pages (page, nodes, has_next) as (ordinal, page, node):
    pages are taken in order until they have ``most`` nodes together, a page says
    that none follows, or one has no nodes at all.  The page that reaches ``most``
    is taken whole.  What is summed up in one place is a row a page."""
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pages.select("page", F.coalesce(F.size("nodes"), F.lit(0)).alias("n"), F.coalesce("has_next", F.lit(False)).alias("on"))
    ends = F.coalesce(F.max(~F.col("on") | (F.col("n") <= 0)).over(before), F.lit(False))
    first = F.coalesce(F.sum(F.greatest("n", F.lit(0))).over(before), F.lit(0))
    taken = sizes.select("page", first.alias("first"), ends.alias("ended")).where(~F.col("ended") & (F.col("first") < most))
    nodes = pages.join(taken.select("page", "first"), "page").select("page", "first", F.posexplode("nodes").alias("at", "node"))
    return nodes.select((F.col("first") + F.col("at")).cast("long").alias("ordinal"), "page", "node")


def discussion_pages(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Landed answers of a paginated discussions query, a file a page, in the
    order of their names, newest first: ordinal and the discussion's columns."""
    node = schemas.DISCUSSION_NODE
    answer = f"data struct<repository: struct<discussions: struct<pageInfo: struct<hasNextPage: boolean, endCursor: string>, nodes: array<struct<{node}>>>>>"
    rows = spark.read.schema(answer).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("page"), F.col("data.repository.discussions").alias("d"))
    return first_pages(rows.select("page", "d.nodes", F.col("d.pageInfo.hasNextPage").alias("has_next")), most).select("ordinal", "node.*")


def requests(spark: SparkSession, paths: str | Sequence[str], type_fallback: bool = True) -> DataFrame:
    """(query_id, query, query_type): the items of the files in order, numbered
    from 1.  Items are objects or bare strings; ``paths`` is a folder (its
    ``*.json`` by name) or a list.  An object's ``type`` stands in for a missing
    ``query_type`` unless ``type_fallback`` is off."""
    if isinstance(paths, str):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(paths).select("path").orderBy("path").collect()
        paths = [r["path"] for r in found]
    out = None
    for number, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
        items = text.select(F.lit(number).alias("file"), F.posexplode("a").alias("at", "item"))
        out = items if out is None else out.unionByName(items)
    if out is None:
        return spark.createDataFrame([], "query_id long, query string, query_type string")
    is_object = F.substring(F.trim("item"), 1, 1) == "{"
    row = F.from_json("item", schemas.REQUEST)
    kind = F.coalesce(row["query_type"], row["type"]) if type_fallback else row["query_type"]
    out = out.select("file", "at", F.when(is_object, row["query"]).otherwise(F.col("item")).alias("query"), F.when(is_object, kind).alias("query_type"))
    return with_ordinal(out, [F.col("file"), F.col("at")], "query_id", 1).select("query_id", "query", F.coalesce("query_type", F.lit("")).alias("query_type"))


def ground_truth(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(ordinal, query, query_type, relevant_docs) of files in order: arrays of
    queries, or objects whose values are queries (in the order of their keys)."""
    out = None
    for number, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        one = T.StructType.fromDDL(schemas.GROUND_TRUTH)
        listed = F.from_json("v", T.ArrayType(one))
        keyed = F.map_values(F.from_json("v", T.MapType(T.StringType(), one)))
        rows = text.select(F.lit(number).alias("file"), F.posexplode(F.when(F.startswith("v", F.lit("[")), listed).otherwise(keyed)).alias("at", "t"))
        out = rows if out is None else out.unionByName(rows)
    fixed = F.transform("t.relevant_docs", lambda d: d.withField("index", F.coalesce(d["index"], d["doc_index"])))
    out = out.select("file", "at", F.col("t.query").alias("query"), F.col("t.query_type").alias("query_type"), F.coalesce(fixed, F.array()).alias("relevant_docs"))
    by = Window.orderBy("file", "at")  # a hand-made file of queries: a row a query
    return out.withColumn("ordinal", F.row_number().over(by)).drop("file", "at")


def results(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.RESULT)


@dataclass(frozen=True)
class Dataset:
    path: str
    parser: str | None = None


@dataclass(frozen=True)
class Settings:
    """Settings of a retrieval run; paths are resolved against the file's folder."""

    dataset_files: tuple[Dataset, ...] = ()
    request_files: tuple[str, ...] = ()
    output: str = "results"
    metric: str = "l2"
    method: str = "flat"
    top_k: int = 5
    use_hybrid: bool = False
    alpha: float = 0.7
    max_docs: int | None = None
    extra: dict = field(default_factory=dict)


def load_settings(path: str | None = None) -> Settings:
    """Settings from a YAML or JSON file, defaults where it says nothing."""
    if path is None:
        return Settings()
    text = Path(path).read_text()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    home = Path(path).resolve().parent
    full = lambda p: p if "://" in p or Path(p).is_absolute() else str(home / p)
    known = {f.name for f in fields(Settings)} - {"extra"}
    kept = {k: v for k, v in given.items() if k in known}
    if "dataset_files" in kept:
        kept["dataset_files"] = tuple(Dataset(full(d["path"]), d.get("parser")) if isinstance(d, dict) else Dataset(full(d)) for d in kept["dataset_files"])
    if "request_files" in kept:
        files = kept["request_files"]
        kept["request_files"] = tuple(full(p) for p in ([files] if isinstance(files, str) else files))
    if "output" in kept:
        kept["output"] = full(kept["output"])
    return Settings(**kept, extra={k: v for k, v in given.items() if k not in known})
