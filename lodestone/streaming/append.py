"""New documents into the index tables as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.bm25 import term_frequencies, tokenised
from ..sources.sinks import upsert


def append_documents(stream: DataFrame, index_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """A query that puts each batch's documents and postings into the tables
    below ``index_path``.  Rows are replaced by id, so that a batch that runs
    again after a failure changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.dropDuplicates([id_col]).persist()
        upsert(rows, f"{index_path}/documents", id_col)
        postings = term_frequencies(tokenised(rows, id_col, text_col)).withColumnRenamed("id", id_col)
        upsert(postings, f"{index_path}/postings", id_col)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
