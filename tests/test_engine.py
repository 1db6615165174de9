"""Analysis, index and search on small collections whose results are worked out by hand or by brute force."""

import math
import zipfile
from collections import Counter

import pytest

from textloom.functions import codecs, text
from textloom.functions.stem import stem_word, stem_words
from textloom.operators import index as ix
from textloom.operators import search as se
from textloom.sources import readers, writers
from textloom.streaming import ingest
from pyspark.sql import functions as F

BODIES = ["Red fox, red FOX! A big dog.", "The dog sees http://x.org/a,b;c=1 fox", "red red red", "12 + 34", "b2b café is naïve", "red fox"]


def docs(spark, bodies=BODIES):
    return spark.createDataFrame([(i + 1, str(i), b) for i, b in enumerate(bodies)], "docid int, docno string, body string")


@pytest.fixture(scope="module")
def small(spark):
    return ix.build_index(docs(spark)).persist()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tokens(spark):
    cases = {
        "Red fox, red FOX! A big dog.": "red fox red fox big dog",
        "The dog sees http://x.org/a,b;c=1 fox": "the dog sees fox",
        "12 + 34": "",
        "b2b café is naïve": "b caf is na ve",
        "HTTP://x.org ok": "http org ok",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.tokens("t").alias("w")).collect()
    assert {r.t: " ".join(r.w) for r in got} == cases
    assert spark.sql("select cast(null as string) t").select(text.tokens("t").alias("w")).first().w == []


def test_ngrams(spark):
    df = spark.sql("select array('a','b','c') w, 'abcd' t, array('a') one, 'a' short")
    r = df.select(text.word_ngrams("w", 2).alias("a"), text.char_ngrams("t", 3).alias("b"), text.word_ngrams("one", 2).alias("c"), text.char_ngrams("short", 3).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (["a b", "b c"], ["abc", "bcd"], [], [])


def test_stems(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "formative": "form",
        "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "medicine": "medicin", "people": "peopl",
        "abdominal": "abdomin", "american": "american", "yes": "ye", "is": "is", "a": "a",
    }
    got = stem_words(spark.createDataFrame([(w,) for w in known], "term string")).collect()
    assert {r.term: r.stem for r in got} == known


def test_scores(spark, small):
    assert (small.stats.num_docs, small.stats.total_len) == (6.0, 20.0)
    find = lambda *a, **k: [(r.docid, round(r.score, 6)) for r in se.search(small, *a, **k).collect()]
    assert find("red fox", "or", "tfidf") == [(1, 2.960906), (6, 2.0), (3, 1.7615), (2, 1.0)]
    assert find("red fox", "or", "bm25") == [(6, 0.753421), (1, 0.707293), (3, 0.505947), (2, 0.291238)]
    assert [d for d, _ in find("red fox", "and", "tfidf")] == [1, 6]
    assert [d for d, _ in find("red fox", "and", "bm25")] == [6, 1]
    assert find("dog fox zzz", "or", "tfidf") == [(1, 2.480453), (2, 2.0), (6, 1.0)]
    assert [d for d, _ in find("dog fox zzz", "and", "bm25")] == [2, 1]
    assert find("zzz") == [] and find("") == []


def test_ties(spark):
    index = ix.build_index(docs(spark, ["a fox x", "fox", "fox hen", "hen"]))
    assert [r.docid for r in se.search(index, "fox", scorer="tfidf").collect()] == [1]
    assert [r.docid for r in se.search(index, "fox", scorer="tfidf", ties="keep").collect()] == [1, 2, 3]


@pytest.mark.parametrize("bad", [{"mode": "xor"}, {"scorer": "tf"}, {"k": 0}, {"ties": "all"}])
def test_arguments(small, bad):
    with pytest.raises(ValueError):
        se.search(small, "red", **bad)


def brute(bodies, terms, scorer, mode):
    lists = [b.split() for b in bodies]
    n, avg = len(lists), sum(map(len, lists)) / len(lists)
    df = Counter(t for w in lists for t in set(w))
    known = sorted({t for t in terms if df[t]})
    out = {}
    for d, w in enumerate(lists, 1):
        c, s, hit = Counter(w), 0.0, 0
        for t in known:
            if c[t]:
                hit += 1
                idf = math.log(n / df[t])
                s += 1 + math.log(c[t]) * idf if scorer == "tfidf" else c[t] / (1.2 * (0.25 + 0.75 * len(w) / avg) + c[t]) * idf
        if hit and (mode == "or" or hit == len(known)):
            out[d] = s
    return out


@pytest.mark.parametrize("scorer", ["tfidf", "bm25"])
def test_search_against_brute_force(spark, scorer):
    import random

    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    bodies = [" ".join(random.choices(words, weights=[9, 5, 3, 2, 1, 1], k=random.randint(0, 12))) for _ in range(60)]
    index = ix.build_index(docs(spark, bodies)).persist()
    for mode in ("and", "or"):
        want = brute(bodies, ["alpha", "delta", "zeta"], scorer, mode)
        got = {r.docid: r.score for r in se.search(index, "alpha delta zeta alpha", mode, scorer, 100, "keep").collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    for ties in ("collapse", "keep"):
        for k in (1, 3, 8):
            assert rows(se.search_pruned(index, "alpha delta zeta eps", scorer, k, ties)) == rows(se.search(index, "alpha delta zeta eps", "or", scorer, k, ties))
    bounds = index.postings.join(index.lexicon, "term").withColumn("w", se.weight(scorer, index.stats.avg_len))
    assert bounds.filter(F.col("w") > F.col(f"max_{scorer}") + 1e-12).count() == 0


def test_invariants(small):
    assert small.postings.agg(F.sum("tf")).first()[0] == small.doc_index.agg(F.sum("doclen")).first()[0] == small.lexicon.agg(F.sum("cf")).first()[0]
    assert small.lexicon.agg(F.max("df")).first()[0] <= small.stats.num_docs
    assert small.doc_index.filter("doclen = 0").count() == 1


def test_merge_save_load_stream(spark, small, tmp_path):
    all_docs = docs(spark)
    merged = ix.merge_indexes(ix.build_index(all_docs.filter("docid <= 3")), ix.build_index(all_docs.filter("docid > 3")))
    assert merged.stats == small.stats and sorted(rows(merged.lexicon)) == sorted(rows(small.lexicon))
    small.save(str(tmp_path / "index"))
    loaded = ix.Index.load(spark, str(tmp_path / "index"))
    assert rows(se.search(loaded, "red dog")) == rows(se.search(small, "red dog"))
    all_docs.filter("docid <= 4").write.parquet(str(tmp_path / "in" / "a"))
    all_docs.filter("docid > 4").write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(all_docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ingest.start(stream, str(tmp_path / "live"), str(tmp_path / "ckpt")).awaitTermination()
    live = ingest.load(spark, str(tmp_path / "live"))
    assert live.stats == small.stats and sorted(rows(live.lexicon)) == sorted(rows(small.lexicon))


def test_skip_blocks(spark):
    table = spark.range(1, 11).selectExpr("'t' term", "cast(id as int) docid", "1 tf").union(spark.range(1, 4).selectExpr("'u' term", "cast(id as int) docid", "9 tf"))
    got = sorted((r.term, r.block_no, r.end_docid, r.n_postings, r.tf_bytes) for r in ix.skip_blocks(table).collect())
    assert got == [("t", 0, 3, 3, 3), ("t", 1, 6, 3, 3), ("t", 2, 9, 3, 3), ("t", 3, 10, 1, 1), ("u", 0, 1, 1, 2), ("u", 1, 2, 1, 2), ("u", 2, 3, 1, 2)]


def test_codecs(spark):
    n = F.col("n")
    got = spark.range(1, 20001).select(F.col("id").cast("int").alias("n")).select(
        n, F.hex(codecs.varbyte_encode(n)).alias("v"), codecs.varbyte_decode(codecs.varbyte_encode(n)).alias("vd"),
        codecs.varbyte_length(n).alias("vl"),
    ).collect()
    assert all(r.vd == [r.n] and r.vl * 2 == len(r.v) for r in got)
    by = {r.n: r.v for r in got}
    assert [by[k] for k in (5, 127, 128, 824, 16384)] == ["85", "FF", "0180", "06B8", "010080"]
    got = spark.range(1, 300).select(F.col("id").cast("int").alias("n")).select(n, F.hex(codecs.unary_encode(n)).alias("u"), codecs.unary_decode(codecs.unary_encode(n)).alias("ud"), codecs.unary_length(n).alias("ul")).collect()
    assert all(r.ud == r.n and r.ul * 2 == len(r.u) for r in got)
    assert [{r.n: r.u for r in got}[k] for k in (1, 2, 8, 9)] == ["00", "02", "FE", "FE01"]
    assert spark.sql("select unhex('850180') c").select(codecs.varbyte_decode(F.col("c")).alias("x")).first().x == [5, 128]


def test_sources_and_sinks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.tsv", "7\tred fox\tmore\n8\n9\tdog")
        z.writestr("other.tsv", "1\tno")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    got = readers.read_zip(spark, str(tmp_path / "*.zip"))
    assert sorted((r.line_no, r.docno, r.body) for r in got.collect()) == [(0, "7", "red fox"), (1, "8", ""), (2, "9", "dog")]
    numbered = readers.number_lines(got, ["path", "line_no"])
    assert sorted((r.docid, r.docno) for r in numbered.collect()) == [(1, "7"), (2, "8"), (3, "9")]
    writers.write_tsv(docs(spark).select("docno", "body"), str(tmp_path / "out"))
    assert readers.read_tsv(spark, str(tmp_path / "out")).count() == 6
    names = writers.write_zip(docs(spark).select("docno", "body").repartition(3), str(tmp_path / "zips"))
    back = readers.read_zip(spark, str(tmp_path / "zips" / "*.zip"))
    assert names and sorted((r.docno, r.body) for r in back.collect()) == sorted((str(i), b) for i, b in enumerate(BODIES))
    (tmp_path / "stop.txt").write_text("the\n\nof\nthe\n")
    assert sorted(r.word for r in readers.load_stopwords(spark, str(tmp_path / "stop.txt")).collect()) == ["of", "the"]


def test_evaluation_run(spark, small, tmp_path):
    queries = spark.createDataFrame([(1, "red fox"), (2, "zzz"), (3, None)], "qid int, text string")
    run = se.evaluation_run(small, queries)
    assert sorted((r.qid, r.docid, r.docno, round(r.score, 6)) for r in run.collect()) == [(1, 6, "5", 0.753421), (2, 7, "6", 0.0), (3, 7, "6", 0.0)]
    writers.write_run(run, str(tmp_path / "run"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "run")).collect()]
    assert "2\tQ0\t6\t1\t0.0\tSTANDARD" in lines and len(lines) == 3


def test_filtered(spark):
    index = ix.build_index(docs(spark, ["the foxes were running", "a fox runs"]), filtered=True)
    assert sorted(r.term for r in index.lexicon.collect()) == ["fox", "run"]
    assert [r.docid for r in se.search(index, "running of foxes", "and", ties="keep").collect()] == [1, 2]


def test_empty_collection(spark):
    index = ix.build_index(docs(spark, []))
    assert index.stats.num_docs == 0 and se.search(index, "red").count() == 0


def test_default_stopwords_are_the_full_list(spark):
    words = {r.word for r in readers.load_stopwords(spark).collect()}
    assert len(words) == len(readers.STOPWORDS) == 636
    assert {"able", "according", "would", "zero", "j", "whereupon", "the"} <= words and not {"keep", "keeps", "sure", "t", ""} & words


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_search_reads_the_query_terms_only(spark, small, tmp_path):
    small.save(str(tmp_path / "index"))
    stored = ix.Index.load(spark, str(tmp_path / "index"))
    for found in (se.search(stored, "red fox dog"), se.search(stored, "red fox dog", "and", "tfidf"), se.search_many(stored, spark.createDataFrame([(1, "red fox"), (2, "dog")], "qid int, text string"))):
        text_of_plan = found._jdf.queryExecution().toString()
        scans = [line for line in text_of_plan.splitlines() if "FileScan parquet" in line and ",tf#" in line]
        assert scans and all("In(term, [" in line for line in scans)
        assert "SortMergeJoin" not in plan(found) and not [x for x in plan(found).splitlines() if "Exchange hashpartitioning(term" in x]


def test_many_terms_are_joined(spark, small, monkeypatch):
    queries = spark.createDataFrame([(1, "red fox"), (2, "dog zzz"), (3, "")], "qid int, text string")
    want = sorted(rows(se.search_many(small, queries)))
    for name, most in (("MAX_FILTER", 1), ("MAX_SENT", 1)):
        monkeypatch.setattr(se, name, most)
        assert sorted(rows(se.search_many(small, queries))) == want


def test_skip_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(ix, "_BUCKET", 3)
    table = spark.range(1, 200).selectExpr("'t' term", "id * 5 docid", "1 tf")
    got = sorted((r.block_no, r.end_docid, r.n_postings) for r in ix.skip_blocks(table).collect())
    ids = [k * 5 for k in range(1, 200)]
    assert got == [(b, chunk[-1], len(chunk)) for b, chunk in enumerate(ids[i : i + 14] for i in range(0, 199, 14))]


def test_stems_against_the_published_rules(spark):
    import porter

    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(text.tokens("text")).alias("term")).distinct()
    more = "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yellow yes syzygy flying dying agreed feed caresses ponies ties cats falling hissing fizzed failing filing happy sky conflated troubled sized tanned analogies archaeology".split()
    rows_ = stem_words(words.union(spark.createDataFrame([(w,) for w in more], "term string")).distinct()).collect()
    wrong = [(r.term, r.stem, porter.stem(r.term)) for r in rows_ if len(r.term) > 3 and r.stem != porter.stem(r.term)]
    assert len(rows_) > 10_000 and not wrong, wrong[:20]


def test_documents_are_counted_on_their_own(spark):
    bodies = [*BODIES, "yes Yes running runs run the", "", "cat"]
    for filtered in (False, True):
        counted = ix.count_postings(docs(spark, bodies), filtered)
        words = docs(spark, bodies).select("docid", F.explode(text.tokens("body")).alias("term")).collect()
        kept = [(stem_word(r.term) if filtered else r.term, r.docid) for r in words if not filtered or r.term not in readers.STOPWORDS]
        lengths = Counter(d for _, d in kept)
        assert sorted(rows(counted)) == sorted((t, d, n, lengths[d]) for (t, d), n in Counter(kept).items())
        assert "Exchange" not in plan(counted) and "Join" not in plan(counted)


def test_stems_in_workers_are_those_of_the_engine(spark):
    words = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(text.tokens("text")).alias("term")).distinct()
    ends = "ational izer bli iveness icate ful ement ion sion tion sses ies eed ed ing ly y e ll s es ss".split()
    more = [(b + e,) for b in ("", "y", "a", "tr", "hop", "hopp", "fil", "yell", "relat", "conform") for e in ends]
    got = stem_words(words.union(spark.createDataFrame(more, "term string")).distinct()).collect()
    wrong = [(r.term, r.stem, stem_word(r.term)) for r in got if r.stem != stem_word(r.term)]
    assert len(got) > 50_000 and not wrong, wrong[:20]


@pytest.mark.parametrize("mode", ["or", "and"])
def test_a_filtered_search_stems_no_posting_by_expressions(spark, mode):
    """A filter by stems went below the join with the vocabulary, to each token."""
    index = ix.build_index(docs(spark, ["the foxes were running", "a fox runs", "dogs run"]), filtered=True)
    found = se.search(index, "fox running", mode)
    assert [r.docid for r in found.collect()] == [1]
    assert "rlike" not in found._jdf.queryExecution().toString().lower() and "regexp_extract" not in found._jdf.queryExecution().toString().lower()


def test_batch_scores_are_dealt_out_by_document(spark, small):
    """Pairs of query and document were shuffled, as were those of query and score."""
    queries = spark.createDataFrame([(1, "red fox"), (2, "dog fox red"), (3, "zzz"), (4, "is big")], "qid int, text string")
    scored = se.score(small, se.query_terms(queries))
    best = se.best_by_query(scored)
    assert sorted(rows(best)) == sorted((r.qid, r.docid, r.score) for r in se.top_k_by_query(scored, 3).collect() if r.rank == 1)
    exchanges = [x.split(", [plan_id")[0] for x in plan(best).splitlines() if "Exchange hashpartitioning(" in x]
    assert [x for x in exchanges if "hashpartitioning(docid#" in x] and not [x for x in exchanges if "qid#" in x and ("docid#" in x or "score" in x)]


def test_best_by_query_breaks_ties(spark):
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5 + 1e-12), (1, 9, 0.4), (2, 5, -1.0), (2, 4, -2.0)], "qid int, docid long, score double")
    assert sorted(rows(se.best_by_query(scored))) == [(1, 3, 0.5), (2, 5, -1.0)]


def shuffled(df):
    return [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]


def test_skip_blocks_shuffle_postings_once(spark):
    """Postings were shuffled to be counted and again to be numbered."""
    lists = ix.skip_blocks(ix.count_postings(docs(spark)).drop("doclen"))
    assert sorted((r.term, r.block_no, r.end_docid, r.n_postings) for r in lists.collect() if r.term in ("red", "dog")) == [("dog", 0, 1, 1), ("dog", 1, 2, 1), ("red", 0, 1, 1), ("red", 1, 3, 1), ("red", 2, 6, 1)]
    assert not [x for x in shuffled(lists) if "doclen" in x or "hashpartitioning(term#" in x and "docid#" in x]


def test_stop_words_of_the_default_list_are_sent_not_shuffled(spark):
    from textloom.plans import queries

    left = queries.stopword_filter(spark, "/root/testdata/sf0.001")
    assert left.filter("term in ('the', 'of', 'zero')").count() == 0 and left.count() == left.select("docid", "term").distinct().count()
    assert not shuffled(left) and "SortMergeJoin" not in plan(left) and "BroadcastHashJoin" in plan(left)


@pytest.mark.parametrize("filtered", [False, True])
def test_a_search_counts_the_query_terms_only(spark, filtered):
    """The lexicon was made twice, and documents were counted whole."""
    index = ix.build_index(docs(spark, [*BODIES, "dogs and foxes"]), filtered)
    kept = index.only(["fox", "red"])
    assert sorted(rows(kept)) == sorted(rows(index.postings.filter("term in ('fox', 'red')"))) and index.only([]).count() == 0
    for mode in ("and", "or"):
        found = se.search(index, "red fox zzz", mode, ties="keep")
        assert rows(found) == rows(se.search(ix.Index(index.doc_index, index.postings, index.lexicon, index.stats, filtered), "red fox zzz", mode, ties="keep"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert se.search(index, "").count() == 0


def test_a_filtered_lexicon_is_one_exchange(spark):
    """Stems were joined and counts summed by term and document before the lexicon."""
    assert len(shuffled(ix.build_index(docs(spark), filtered=True).lexicon)) == 1
