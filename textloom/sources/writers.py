"""Sinks: the index, run files, and compressed collections."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TAG = "STANDARD"


def write_table(table: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Replaces a Parquet table. With ``sort``, rows are dealt by ranges of it and sorted, so that readers skip row groups by their bounds."""
    out = table.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else table
    out.write.mode("overwrite").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; on a local master a temporary one will do."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def written(table: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a table of the shared folder, which goes when the application ends."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"
    table.write.parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(table.schema).parquet(path)


def run_lines(results: DataFrame) -> DataFrame:
    """(qid, docno, score) -> (value): lines of a run file."""
    return results.select(F.concat_ws("\t", F.col("qid").cast("string"), F.lit("Q0"), F.col("docno").cast("string"), F.lit("1"), F.col("score").cast("string"), F.lit(RUN_TAG)).alias("value"))


def write_run(results: DataFrame, path: str) -> None:
    run_lines(results).write.mode("overwrite").text(path)


def write_tsv(collection: DataFrame, path: str, compression: str = "gzip") -> None:
    """(docno, body) -> delimited text; tabs and line ends in a body become spaces."""
    body = F.regexp_replace("body", "[\\t\\r\\n]", " ")
    collection.select(F.concat_ws("\t", "docno", body).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_zip(collection: DataFrame, path: str, entry: str = "collection.tsv") -> list[str]:
    """(docno, body) -> a zip archive of delimited text for each partition, streamed line by line; returns the archives' names in ``path``, a folder that executors share.

    Names are of one attempt of a task; what a lost attempt has left isn't among them. Partitions without rows give no archive.
    """
    spark = collection.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        name, lines = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.zip", 0
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(entry, "w", force_zip64=True) as member:
            for batch in (b for some in ([first], batches) for b in some):
                for line in batch["value"]:
                    member.write(f"{line}\n".encode())
                lines += len(batch)
        yield pd.DataFrame({"archive": [name], "lines": [lines]})

    body = F.regexp_replace("body", "[\\t\\r\\n]", " ")
    rows = collection.select(F.concat_ws("\t", "docno", body).alias("value")).mapInPandas(pack, "archive string, lines long")
    return sorted(r["archive"] for r in rows.collect())  # one row a partition
