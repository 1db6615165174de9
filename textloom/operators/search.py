"""Ranked retrieval over an index: conjunctive and disjunctive queries, single or many at a time."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text, weights
from textloom.operators.index import Index, drop_stopwords, stem_column
from textloom.sources.readers import STOPWORDS

SCORERS = ("tfidf", "bm25")
MODES = ("and", "or")
TIES = ("collapse", "keep")
#: Scores that agree to so many places count as equal.
TIE_PLACES = 9
#: Weights are added as whole numbers of so many parts: a sum below 9 million is exact to them.
UNITS = 1e12
#: Query terms are brought to the driver and sent to the executors up to so many rows, and become a filter of the scans up to so many terms.
MAX_SENT, MAX_FILTER = 100_000, 1_000


def _check(mode: str, scorer: str, k: int, ties: str) -> None:
    for value, allowed, what in ((mode, MODES, "mode"), (scorer, SCORERS, "scorer"), (ties, TIES, "ties")):
        if value not in allowed:
            raise ValueError(f"{what} must be one of {allowed}, not {value!r}")
    if k < 1:
        raise ValueError("k must be at least 1")


def query_terms(queries: DataFrame, filtered: bool = False, stopwords=STOPWORDS) -> DataFrame:
    """(qid, text) -> (qid, term): distinct analysed terms."""
    terms = queries.select("qid", F.explode(text.tokens("text")).alias("term"))
    if filtered:
        terms = stem_column(drop_stopwords(terms, stopwords))
    return terms.distinct()


def known_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Query terms that the lexicon has, with its columns."""
    return terms.join(lexicon, "term")


def weight(scorer: str, avg_len: float, k1: float = weights.K1, b: float = weights.B) -> Column:
    """Weight of a posting (tf, doclen) under its term's idf."""
    if scorer == "tfidf":
        return weights.tfidf(F.col("tf"), F.col("idf"))
    return weights.bm25(F.col("tf"), F.col("idf"), F.col("doclen"), avg_len or 1.0, k1, b)


def score_sum() -> Column:
    """Sum of a document's weights in whole units of 1e-12, so that it is the same in any order, and partial sums are plain numbers."""
    return F.sum(F.round(F.col("w") * UNITS).cast("long")) / UNITS


class Searcher:
    """A stored index made ready for many single queries: the lexicon's rows of terms that were asked for are kept on the driver, up to ``keep`` terms.

    A query of terms that were asked for before reads postings alone.
    """

    def __init__(self, index: Index, keep: int = 100_000) -> None:
        self.index, self.keep = index, keep
        self.seen: dict[str, tuple | None] = {}
        self.schema = index.lexicon.schema

    def _lexicon(self, terms: list[str]) -> DataFrame:
        if new := [t for t in terms if t not in self.seen]:
            if len(self.seen) + len(new) > self.keep:
                self.seen.clear()
                new = terms
            self.seen |= dict.fromkeys(new)
            self.seen |= {r["term"]: tuple(r) for r in self.index.lexicon.filter(F.col("term").isin(*new)).collect()}
        return self.index.postings.sparkSession.createDataFrame([r for t in terms if (r := self.seen[t])], self.schema)

    def search(self, query: str, mode: str = "or", scorer: str = "bm25", k: int = 10, ties: str = "collapse", query_filtered: bool | None = None, stopwords=STOPWORDS) -> DataFrame:
        """The rows of ``search``."""
        _check(mode, scorer, k, ties)
        index, spark = self.index, self.index.postings.sparkSession
        terms = [r["term"] for r in query_terms(_one(spark, query), index.filtered if query_filtered is None else query_filtered, stopwords).collect()]
        known = Index(index.doc_index, index.postings, self._lexicon(terms), index.stats, index.filtered)
        return top_k(score(known, spark.createDataFrame([(0, t) for t in terms], "qid int, term string"), mode, scorer), k, ties)


class Known:
    """The known terms of queries, (qid, term, df, idf and bounds), and the postings of these terms.

    Up to MAX_SENT rows the terms and their rows of the lexicon are on the driver: they filter both scans, so that only their row
    groups are read and counted, and are sent to the executors instead of shuffling postings. Beyond that all of it is joined.
    """

    def __init__(self, index: Index, terms: DataFrame) -> None:
        rows = terms.select("qid", "term").limit(MAX_SENT + 1).collect()
        self.few = len(rows) <= MAX_SENT
        postings, lexicon = index.postings, index.lexicon
        if self.few:
            spark = terms.sparkSession
            names = sorted({r["term"] for r in rows})
            if len(names) <= MAX_FILTER:
                postings, lexicon = index.of_terms(names)
            else:
                lexicon = lexicon.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "term string")), "term", "left_semi")
            lexicon = F.broadcast(spark.createDataFrame([tuple(r) for r in lexicon.collect()], lexicon.schema))
            self.numbers = spark.createDataFrame(list(enumerate(names)), "no int, term string")
            terms = F.broadcast(spark.createDataFrame(rows, terms.select("qid", "term").schema))
        self.terms = known_terms(terms, lexicon)
        self.lexicon, self.postings = lexicon, postings

    def scored(self, weight: Column) -> DataFrame:
        """(qid, docid, score, _n) of all documents with a term; the weight is of a posting (tf, doclen, idf).

        A posting is weighted once and dealt out by document under its term's number; which queries ask for it is looked up there,
        so what is shuffled doesn't grow with the number of queries.
        """
        if not self.few:
            return _scored(self.postings.join(self.terms.select("qid", "term", "idf"), "term").withColumn("w", weight))
        found = self.postings.join(F.broadcast(self.numbers.join(self.lexicon.select("term", "idf"), "term")), "term")
        asked = self.terms.join(F.broadcast(self.numbers), "term").select("no", "qid")
        return _scored(found.select("no", "docid", weight.alias("w")).repartition("docid").join(F.broadcast(asked), "no"))


def score(index: Index, terms: DataFrame, mode: str = "or", scorer: str = "bm25", k1: float = weights.K1, b: float = weights.B) -> DataFrame:
    """(qid, term) -> (qid, docid, score) of all matching documents. In mode ``and`` a document must hold all known terms of its query.

    Unknown terms are dropped; a query without a known term has no rows.
    """
    known = Known(index, terms)
    scored = known.scored(weight(scorer, index.stats.avg_len, k1, b))
    if mode == "and":
        needed = known.terms.groupBy("qid").agg(F.count("*").alias("_all"))
        scored = scored.join(F.broadcast(needed) if known.few else needed, "qid").filter("_n = _all")
    return scored.select("qid", "docid", "score")


def _scored(matched: DataFrame) -> DataFrame:
    return matched.groupBy("qid", "docid").agg(score_sum().alias("score"), F.count("*").alias("_n"))


def top_k(scored: DataFrame, k: int, ties: str = "collapse") -> DataFrame:
    """(docid, score) -> the k best, best first. ``collapse`` keeps one document, that with the least docid, of each score; ``keep`` keeps all, by docid."""
    if ties == "collapse":
        scored = scored.groupBy(F.round("score", TIE_PLACES).alias("score")).agg(F.min("docid").alias("docid"))
    return scored.select("docid", "score").orderBy(F.desc("score"), "docid").limit(k)


def top_k_by_query(scored: DataFrame, k: int, ties: str = "collapse") -> DataFrame:
    """The same for each qid, with rank from 1. The rank limit is applied before the shuffle to each partition too."""
    if ties == "collapse":
        scored = scored.groupBy("qid", F.round("score", TIE_PLACES).alias("score")).agg(F.min("docid").alias("docid"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid")))
    return ranked.filter(F.col("rank") <= k).select("qid", "rank", "docid", "score")


def best_by_query(scored: DataFrame) -> DataFrame:
    """(qid, docid, score): the first row of ``top_k_by_query``, in one aggregation that is partial before the shuffle."""
    best = scored.groupBy("qid").agg(F.max(F.struct(F.round("score", TIE_PLACES).alias("score"), (-F.col("docid")).alias("first"))).alias("_best"))
    return best.select("qid", (-F.col("_best.first")).alias("docid"), F.col("_best.score").alias("score"))


def _one(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "qid int, text string")


def search(
    index: Index, query: str, mode: str = "or", scorer: str = "bm25", k: int = 10, ties: str = "collapse", query_filtered: bool | None = None, k1: float = weights.K1, b: float = weights.B, stopwords=STOPWORDS
) -> DataFrame:
    """(docid, score) of one query's best documents. The query is analysed as the index was, unless ``query_filtered`` says otherwise."""
    _check(mode, scorer, k, ties)
    terms = query_terms(_one(index.postings.sparkSession, query), index.filtered if query_filtered is None else query_filtered, stopwords)
    return top_k(score(index, terms, mode, scorer, k1, b), k, ties)


def search_many(index: Index, queries: DataFrame, mode: str = "or", scorer: str = "bm25", k: int = 10, ties: str = "collapse", stopwords=STOPWORDS) -> DataFrame:
    """(qid, text) -> (qid, rank, docid, score), all queries in one plan."""
    _check(mode, scorer, k, ties)
    return top_k_by_query(score(index, query_terms(queries, index.filtered, stopwords), mode, scorer), k, ties)


def search_pruned(index: Index, query: str, scorer: str = "bm25", k: int = 10, ties: str = "collapse", stopwords=STOPWORDS) -> DataFrame:
    """A disjunctive search that skips documents whose bounds cannot reach the best k; the rows are those of ``search``.

    First the documents of the term with the highest bound are scored in full, and their k-th best score is the threshold. Then
    the fewest highest-bound terms are found whose absence leaves a document below the threshold; only documents with one of these are scored.
    The postings of the query's terms are read once for both.
    """
    _check("or", scorer, k, ties)
    spark = index.postings.sparkSession
    known = Known(index, query_terms(_one(spark, query), index.filtered, stopwords))
    found = known.terms.select("qid", "term", "idf", F.col(f"max_{scorer}").alias("ub")).collect()
    bounds = sorted(((r["ub"], r["term"]) for r in found), reverse=True)
    idf = F.broadcast(spark.createDataFrame([r[:3] for r in found], "qid int, term string, idf double"))
    matched = known.postings.join(idf, "term").select("qid", "term", "docid", weight(scorer, index.stats.avg_len).alias("w"))
    if len(bounds) < 2:
        return top_k(_scored(matched), k, ties)
    matched = matched.persist(StorageLevel.MEMORY_AND_DISK)
    needed = {term: n for n, (_, term) in enumerate(bounds)}
    place = reduce(lambda out, t: out.when(F.col("term") == t, needed[t]), needed, F.when(F.lit(False), 0))
    # The highest of a document's terms, by place among the bounds, says in which round it counts.
    ranked = matched.groupBy("docid").agg(score_sum().alias("score"), F.min(place).alias("first"))
    best = top_k(ranked.filter("first = 0"), k, ties).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    most = len(bounds)
    if best["n"] == k:
        most = next(n for n in range(1, len(bounds) + 1) if sum(u for u, _ in bounds[n:]) < best["least"] - 1e-6 or n == len(bounds))
    if 1 < most < len(bounds):
        # Only documents with an essential term; the lists of the others are read for these alone.
        held = matched.filter(F.col("term").isin(*[t for _, t in bounds[:most]])).select("docid").distinct()
        ranked = _scored(matched.join(held, "docid", "left_semi"))
    elif most == 1:
        ranked = ranked.filter("first = 0")
    rows = top_k(ranked, k, ties).collect()  # k at most
    matched.unpersist()
    return spark.createDataFrame(rows, "docid long, score double").orderBy(F.desc("score"), "docid")


def bounds_by_term(index: Index, terms: DataFrame, scorer: str = "bm25") -> DataFrame:
    """(qid, term, ub, cumulative): bounds in rising order and their running sum, by which documents are pruned."""
    known = known_terms(terms, index.lexicon).select("qid", "term", F.col(f"max_{scorer}").alias("ub"))
    upto = Window.partitionBy("qid").orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("cumulative", F.sum("ub").over(upto))


def next_geq(postings: DataFrame, term: str, value: int) -> DataFrame:
    """One row (docid): the term's first document from ``value`` on, null where there is none."""
    return postings.filter((F.col("term") == term) & (F.col("docid") >= value)).agg(F.min("docid").alias("docid"))


def min_docid(postings: DataFrame, terms: list[str]) -> DataFrame:
    """One row (docid): the first document of any of the terms."""
    return postings.filter(F.col("term").isin(*terms)).agg(F.min("docid").alias("docid"))


def documents_with_any(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.filter(F.col("term").isin(*terms)).select("docid").distinct()


def documents_with_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    wanted = sorted(set(terms))
    return postings.filter(F.col("term").isin(*wanted)).groupBy("docid").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select("docid")


def evaluation_run(index: Index, queries: DataFrame, k: int = 10, scorer: str = "bm25", stopwords=STOPWORDS) -> DataFrame:
    """(qid, docid, docno, score) of every query's best document; a query without a match gets the document after the last, with score 0.

    docno is the docid less one, as text.
    """
    _check("or", scorer, k, "collapse")
    best = best_by_query(score(index, query_terms(queries, index.filtered, stopwords), "or", scorer))
    all_queries = queries.select("qid").distinct().join(best, "qid", "left")
    docid = F.coalesce("docid", F.lit(int(index.stats.num_docs) + 1)).cast("long")
    return all_queries.select("qid", docid.alias("docid"), (docid - 1).cast("string").alias("docno"), F.coalesce("score", F.lit(0.0)).alias("score"))
