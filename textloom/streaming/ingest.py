"""Growing an index from a stream of documents. An extension: batches are indexed as they come and counted together when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.index import Index, _finish, count_postings, document_index
from textloom.sources.readers import STOPWORDS


def start(stream: DataFrame, path: str, checkpoint: str, filtered: bool = False, stopwords=STOPWORDS, **trigger):
    """Starts a query that appends each micro-batch of (docid, docno, body) to the tables in ``path``.

    A batch is written to a folder of its own number, so a batch that is run again after a failure replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        counted = count_postings(batch, filtered, stopwords)
        for name, table in (("counted", counted), ("docs", document_index(batch, filtered, stopwords))):
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load(spark: SparkSession, path: str, filtered: bool = False) -> Index:
    """The index of all batches so far."""
    return _finish(spark.read.parquet(f"{path}/counted").drop("batch"), spark.read.parquet(f"{path}/docs").drop("batch"), filtered)
