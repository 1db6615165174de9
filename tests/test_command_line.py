"""The command line's parts: a collection from text and zip, queries from lines, an evaluation run."""

import zipfile

from textloom import __main__ as cli
from textloom.operators import index as ix
from textloom.operators import search as se


def test_index_search_and_run(spark, tmp_path, capsys):
    text = "7\tred fox\n8\tthe dog sees a red fox\n10\tred red red\n"
    (tmp_path / "c.tsv").write_text(text)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.tsv", text)
    for name in ("c.tsv", "c.zip"):
        cli.main(["index", str(tmp_path / name), str(tmp_path / "index")])
        assert "3 documents, 10 tokens" in capsys.readouterr().out
        said = []
        cli.answer(ix.Index.load(spark, str(tmp_path / "index")), ["and, tfidf, 5, red fox\n", "dog\n", "xor, bm25, 3, red\n", "unheard\n", "\n", "red\n"], said.append)
        docnos = [x.split("\t")[0] for x in said if "\t" in x]
        assert sorted(docnos) == ["7", "8"] and sum("documents," in x for x in said) == 3 and any(x.startswith("not a query") for x in said)
    (tmp_path / "q.tsv").write_text("1\tred fox\n2\tnothing\n")
    cli.main(["run", str(tmp_path / "index"), str(tmp_path / "q.tsv"), str(tmp_path / "out")])
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 2


def test_searcher_keeps_the_lexicon(spark):
    docs = spark.createDataFrame([(k + 1, str(k), t) for k, t in enumerate(["red fox", "red dog", "fox fox"])], "docid long, docno string, body string")
    index = ix.build_index(docs).persist()
    for keep in (1, 100):
        searcher = se.Searcher(index, keep)
        for query in ("red fox", "fox", "dog zzz", "red fox", "zzz", ""):
            for mode in ("and", "or"):
                assert [tuple(r) for r in searcher.search(query, mode).collect()] == [tuple(r) for r in se.search(index, query, mode).collect()]
