"""Command line: builds an index, answers queries typed in, and runs a file of evaluation queries.

    python -m textloom index COLLECTION FOLDER [--filtered] [--stopwords FILE]
    python -m textloom search FOLDER
    python -m textloom run FOLDER QUERIES OUTPUT
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import index as ix
from textloom.operators import search as se
from textloom.sources import readers, writers


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(docid, docno, body) of a zip archive, delimited text, or a documents table in Parquet; docids follow the order of the lines, or docno's."""
    if path.endswith(".parquet"):
        return readers.read_documents(spark, path)
    if path.endswith(".zip"):
        return readers.number_lines(readers.read_zip(spark, path), ["path", "line_no"]).select("docid", "docno", "body")
    return readers.number_lines(readers.read_tsv(spark, path).withColumn("_n", F.expr("try_cast(docno as long)")), ["_n", "docno"]).select("docid", "docno", "body")


def build(spark: SparkSession, source: str, folder: str, filtered: bool = False, stopwords: str | None = None) -> ix.Index:
    words = readers.load_stopwords(spark, stopwords) if stopwords else readers.STOPWORDS
    ix.build_index(collection(spark, source), filtered, words).save(folder)
    return ix.Index.load(spark, folder)


def answer(index: ix.Index, lines: Iterable[str], say=print) -> None:
    """One query a line: ``mode, scorer, k, words`` with mode and/or and scorer tfidf/bm25, or words alone (or, bm25, 10). Ends with an empty line or the input."""
    searcher = se.Searcher(index)
    for line in lines:
        if not (line := line.strip()):
            break
        head = [x.strip() for x in line.split(",", 3)]
        mode, scorer, k, query = head if len(head) == 4 else ("or", "bm25", "10", line)
        began = time.time()
        try:
            rows = searcher.search(query, mode, scorer, int(k)).join(index.doc_index.select("docid", "docno"), "docid").orderBy(F.desc("score"), "docid").collect()
        except ValueError as wrong:
            say(f"not a query: {wrong}")
            continue
        for r in rows:
            say(f"{r['docno']}\t{r['score']:.6f}")
        say(f"{len(rows)} documents, {time.time() - began:.3f} s")


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("collection"), one.add_argument("folder"), one.add_argument("--filtered", action="store_true"), one.add_argument("--stopwords")
    commands.add_parser("search").add_argument("folder")
    run = commands.add_parser("run")
    run.add_argument("folder"), run.add_argument("queries"), run.add_argument("output")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if a.command == "index":
        index = build(spark, a.collection, a.folder, a.filtered, a.stopwords)
        print(f"{index.stats.num_docs:.0f} documents, {index.stats.total_len:.0f} tokens")
    elif a.command == "search":
        answer(ix.Index.load(spark, a.folder), sys.stdin)
    else:
        writers.write_run(se.evaluation_run(ix.Index.load(spark, a.folder), readers.read_queries(spark, a.queries)), a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
