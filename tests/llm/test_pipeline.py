"""The stages on nasty and planted rows, against what each should keep."""

import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from textloom.llm import decontaminate, quality_classifier, quality_rules, sentence_pieces
from textloom.llm.common import written

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shingle string"


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    clean = [text(rng.randint(80, 200)) for _ in range(300)]
    junk = [t.upper().replace(" ", "!! ") for t in clean[:100]]
    item = text(40)
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, t) for i, t in enumerate(junk)]
    rows += [(2000, clean[7]), (2001, text(60) + " " + item + " " + text(50)), (2002, "too short"), (2003, None), (2004, ""), (None, text(90))]
    spark.createDataFrame([(*r, "en", "s", None, "x") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.collect()})
        assert name == "sentencepiece" or docs.columns == columns
    good = set(range(300))
    assert kept[0] >= good | {2000, 2001} and not kept[0] & set(range(1000, 1100))
    assert kept[1] >= good | {2000, 2001} and not kept[1] & {2002, 2003, 2004}
    assert kept[2] == kept[1] - {2000}
    assert kept[3] == kept[4] == kept[2] - {2001}
    run = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {r.doc_id: list(r.ids) for r in docs.collect()}


def test_stages_of_nothing(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_by_plain_recomputation(spark):
    """Every stage over sf0.001 once more, in plain Python and with the public tokenizer."""
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    texts = {r.doc_id: r.text or "" for r in tables["documents"].collect()}
    model = quality_classifier.train(tables["documents"], tables["labels"])
    scores = model.score(quality_classifier.feature_matrix([t.encode() for t in texts.values()]))
    kept = [d for d, s in zip(texts, scores, strict=True) if s >= quality_classifier.THRESHOLD]

    counts = {d: quality_rules.base_counts(texts[d].encode()) for d in kept}
    worded = [d for d in kept if counts[d][0]]
    assert len(worded) < quality_rules.MIN_GROUP  # so that one sketch serves all
    rates = {"word_length": 1, "symbol_rate": 2, "dup_line_rate": 3, "repeat_rate": 4}
    value = lambda d, k: 1000 * counts[d][rates[k]] // counts[d][0] if k in rates else counts[d][0]
    low_end = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6

    def decile(k, q):
        values = sorted(low_end(value(d, k)) for d in worded)
        return next(v for i, v in enumerate(values) if 10 * (i + 1) >= q * len(values))

    d1, d5, d9 = ({k: decile(k, q) for k in (*rates, "n_words")} for q in (1, 5, 9))
    step = lambda k: 1000 * quality_rules.EVENT[k] // d5["n_words"]
    high = {k: d9[k] + 3 * max(d9[k] - d5[k], step(k)) for k in rates}
    low = d1["word_length"] - 3 * max(d5["word_length"] - d1["word_length"], step("word_length"))
    least = d1["n_words"] * min(d1["n_words"] / d5["n_words"], 31 / 32) ** 3

    def passes(d):
        n = counts[d][0]
        usual = n < quality_rules.MIN_WORDS or low <= value(d, "word_length") <= high["word_length"]
        return n >= least and usual and all(value(d, k) <= high[k] for k in rates if k != "word_length")

    kept = [d for d in worded if passes(d)]

    def grams(t):
        words = t.encode().lower().split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    sets, lead = {d: grams(texts[d]) for d in kept}, {d: d for d in kept}

    def find(d):
        while lead[d] != d:
            d = lead[d]
        return d

    for i, a in enumerate(kept):
        for b in kept[:i]:
            both = (sets[a] & sets[b]).total()
            if 10 * both >= 8 * (sets[a].total() + sets[b].total() - both):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    kept = [d for d in kept if find(d) == d]
    items = next(decontaminate.load_items(tables["benchmark"]))
    kept = [d for d in kept if not decontaminate.leaks(texts[d], items)]
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: tokenizer.encode(texts[d]) for d in kept} and 50 < len(kept) < len(texts)
