"""Collections from Parquet, delimited text and zip archives; stop words; queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.writers import written

#: The stop words that a token, which holds letters only, can equal. Other lists are files with one word a line,
#: read by ``load_stopwords``; lines with other characters in them never match a token.
STOPWORDS = tuple(
    """a able about above abst accordance according accordingly across act actually added adj affected affecting affects after afterwards again against ah
    all almost alone along already also although always am among amongst an and announce another any anybody anyhow anymore anyone anything anyway anyways
    anywhere apparently approximately are aren arent arise around as aside ask asking at auth available away awfully b back be became because become
    becomes becoming been before beforehand begin beginning beginnings begins behind being believe below beside besides between beyond biol both brief
    briefly but by c ca came can cannot cause causes certain certainly co com come comes contain containing contains could couldnt d date did different do
    does doing done down downwards due during e each ed edu effect eg eight eighty either else elsewhere end ending enough especially et etc even ever
    every everybody everyone everything everywhere ex except f far few ff fifth first five fix followed following follows for former formerly forth found
    four from further furthermore g gave get gets getting give given gives giving go goes gone got gotten h had happens hardly has have having he hed
    hence her here hereafter hereby herein heres hereupon hers herself hes hi hid him himself his hither home how howbeit however hundred i id ie if im
    immediate immediately importance important in inc indeed index information instead into invention inward is it itd its itself j just k kept kg km know
    known knows l largely last lately later latter latterly least less lest let lets like liked likely line little look looking looks ltd m made mainly
    make makes many may maybe me mean means meantime meanwhile merely mg might million miss ml more moreover most mostly mr mrs much mug must my myself n
    na name namely nay nd near nearly necessarily necessary need needs neither never nevertheless new next nine ninety no nobody non none nonetheless
    noone nor normally nos not noted nothing now nowhere o obtain obtained obviously of off often oh ok okay old omitted on once one ones only onto or ord
    other others otherwise ought our ours ourselves out outside over overall owing own p page pages part particular particularly past per perhaps placed
    please plus poorly possible possibly potentially pp predominantly present previously primarily probably promptly proud provides put q que quickly
    quite qv r ran rather rd re readily really recent recently ref refs regarding regardless regards related relatively research respectively resulted
    resulting results right run s said same saw say saying says sec section see seeing seem seemed seeming seems seen self selves sent seven several shall
    she shed shes should show showed shown showns shows significant significantly similar similarly since six slightly so some somebody somehow someone
    somethan something sometime sometimes somewhat somewhere soon sorry specifically specified specify specifying still stop strongly sub substantially
    successfully such sufficiently suggest sup take taken taking tell tends th than thank thanks thanx that thats the their theirs them themselves then
    thence there thereafter thereby thered therefore therein thereof therere theres thereto thereupon these they theyd theyre think this those thou though
    thoughh thousand throug through throughout thru thus til tip to together too took toward towards tried tries truly try trying ts twice two u un under
    unfortunately unless unlike unlikely until unto up upon ups us use used useful usefully usefulness uses using usually v value various very via viz vol
    vols vs w want wants was wasnt way we wed welcome went were werent what whatever whats when whence whenever where whereafter whereas whereby wherein
    wheres whereupon wherever whether which while whim whither who whod whoever whole whom whomever whos whose why widely willing wish with within without
    wont words world would wouldnt www x y yes yet you youd your youre yours yourself yourselves z zero""".split()
)


def load_stopwords(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(word): the default list, which joins send to the executors, or the lines of a file as they are, without empty ones and repeats."""
    if path is None:
        return F.broadcast(spark.createDataFrame([(w,) for w in STOPWORDS], "word string"))
    return spark.read.text(path).select(F.col("value").alias("word")).filter("word <> ''").distinct()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents table as a collection: (docid long from 1, docno, body)."""
    docs = spread(spark.read.parquet(path))
    return docs.select((F.col("doc_id") + 1).cast("long").alias("docid"), F.col("doc_id").cast("string").alias("docno"), F.col("text").alias("body"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt out over all cores where it has fewer splits: a small file has a single row group, which one task would read alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def split_line(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of docno, tab, body -> (docno, body). Further fields are ignored; a line without a tab has an empty body."""
    parts = F.split(F.col(column), "\t")
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.get(parts, F.lit(0)).alias("docno"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))


def number_lines(collection: DataFrame, order: list[str]) -> DataFrame:
    """Adds docid 1 to N in the given order, by offsets of range partitions: no partition holds all rows.

    The partitions are written with their numbers before these are counted, so a part that is computed again can't change them.
    """
    parted = written(collection.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_in", inside).join(offsets, "_part").withColumn("docid", (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_n", "_before", "_in")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text, plain or compressed -> (docno, body)."""
    return split_line(spark.read.text(path))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Zip archives -> (path, line_no, docno, body) of each one's first entry."""
    return unzip(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzip(files: DataFrame, batch_lines: int = 4096) -> DataFrame:
    """(path, content) -> (path, line_no, docno, body) of each archive's first entry, streamed line by line. An archive without entries has no lines."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for entry in archive.namelist()[:1]:
                        with io.TextIOWrapper(archive.open(entry), encoding="utf-8", errors="replace", newline="\n") as text:
                            held: list[str] = []
                            first = 0
                            for line in text:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == batch_lines:
                                    yield pd.DataFrame({"path": name, "line_no": range(first, first + len(held)), "value": held})
                                    first, held = first + len(held), []
                            if held:
                                yield pd.DataFrame({"path": name, "line_no": range(first, first + len(held)), "value": held})

    return split_line(files.mapInPandas(lines, "path string, line_no long, value string"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text of qid, tab, query -> (qid, text)."""
    return read_tsv(spark, path).select(F.col("docno").alias("qid"), F.col("body").alias("text"))
