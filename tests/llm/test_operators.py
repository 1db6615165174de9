"""Operators of the training-data subpackage against brute force, round trips and the public libraries."""

import base64
import bisect
import hashlib
import html.parser
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from textloom.llm import components, decontaminate, html_text, licences, quality_classifier, quality_rules, registry, sentence_pieces, sharding, simhash, token_counts, warc
from textloom.llm.common import fresh_path, written
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, key2 string"
SF = "/root/testdata/sf0.001"
NASTY = ["", None, " \n\t ", "one", "a b", "é ñ 日本 😀 " * 3, "x" * 5000, "the same text twice " * 40, "the same text twice " * 40, "\x00 nul", "| # * ! " * 50]


def documents(spark, texts, ids=None, lang="en", source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None, 1, "k") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def nasty(spark):
    return documents(spark, [*NASTY, "no id"], [*range(len(NASTY)), None]).unionByName(documents(spark, ["repeated"] * 2, [50, 50])).unionByName(documents(spark, ["no lang"], [51], None, None))


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# 1
def test_pieces_equal_the_library(spark, nasty):
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    random.seed(2)
    parts = ["a", "b", "the", " ", "  ", "\n", "²", ".", "_", "(", "é", "日", "ing", "1", "😀", "▁", "@@@"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(300)] + ["y" * 70 + "ing", "the " * 3000]
    got = sentence_pieces.encode(documents(spark, texts)).collect()
    assert len(got) == len(texts) and all(list(r.ids) == model.encode(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids) for r in got)
    got = sentence_pieces.encode(nasty).collect()
    assert len(got) == nasty.count() and all(r.round_trip for r in got)
    by_id = {r.doc_id: list(r.ids) for r in got}
    assert all(by_id[i] == model.encode(t or "") for i, t in enumerate(NASTY))
    back = sentence_pieces.decode(sentence_pieces.encode(documents(spark, texts))).collect()
    assert all(r.text == texts[r.doc_id].replace("▁", " ") for r in back)


def test_ids_outside_the_model():
    pieces = sentence_pieces.load()
    for bad in ([-1], [5, None], [10**6]):
        with pytest.raises(IndexError):
            sentence_pieces.decode_ids(bad, pieces)
    assert sentence_pieces.decode_ids([], pieces) == ""


def test_pieces_of_nothing(empty):
    assert sentence_pieces.encode(empty).count() == 0


def test_words_hold_the_units_of_the_text():
    pieces, draw = sentence_pieces.load(), random.Random(1)
    find, tokens = re.compile(pieces.unit).findall, sentence_pieces._Tokens([], [], pieces)
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = ["", " ", "  ", " a", "a ", "a   b  c ", "▁x", "a▁b", "word,\nword  ", "x" * 80 + " y"]
    for text in texts + ["".join(draw.choices("ab ▁ ,_²é\n1日", k=draw.randint(1, 30))) for _ in range(2000)]:
        words = sentence_pieces._words(text, pieces.spaced)
        assert [u for w in words for u in find("▁" + w)] == find(sentence_pieces._marked(text))
        assert np.frombuffer(b"".join(map(tokens.__getitem__, words)), np.int32).tolist() == model.encode(text)


def test_pieces_are_ordered():
    pieces = sentence_pieces.load()
    assert pieces.ordered
    for unit in ["▁unbelievable", "aaaaaaa", "▁ththerande"]:
        assert sentence_pieces._merge(unit, pieces.ranks, pieces.longest)[0] == sentence_pieces._merge_by_queue(unit, pieces.ranks)


def test_viterbi_fold(spark):
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.0, "aba": -8.5, "bb": -4.5}
    pieces = sentence_pieces.Pieces({p: i for i, p in enumerate(scores)}, {}, scores, [], 0, 3)
    units = ["a", "ab", "abba", "babab", "bbbbb", "aabbaab"]
    got = sentence_pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).select("unit", sentence_pieces.viterbi_fold().alias("ids")).collect()
    names = list(scores)

    def best(unit):
        if not unit:
            return 0.0
        return max(scores[unit[:k]] + best(unit[k:]) for k in range(1, min(3, len(unit)) + 1) if unit[:k] in scores)

    for r in got:
        assert "".join(names[i] for i in r.ids) == r.unit and sum(scores[names[i]] for i in r.ids) == pytest.approx(best(r.unit))


# 2
def test_leaks(spark, nasty, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 40)))) for k in range(20)] + [(90, "tiny item"), (91, ""), (92, None), (93, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = []
    for k in range(20):
        w = items[k][1].split()
        if k % 3 == 1:
            w[len(w) // 2] = "changed"
        if k % 3 == 2:
            w[0] = "changed"
        texts.append(" ".join([word() for _ in range(rng.randint(0, 60))] + w + [word() for _ in range(rng.randint(0, 60))]).upper())
    texts += ["clean text here", "a Tiny, item!"]
    want = set()
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for i, item in items:
            iw = decontaminate.words_of(item)
            if iw:
                spans = [words[s : s + len(iw)] for s in range(max(1, len(words) - len(iw) + 1))]
                if max(decontaminate.similarity(Counter(decontaminate.shingles(s)), Counter(decontaminate.shingles(iw))) for s in spans) >= 0.8:
                    want.add((d, i))
    got = decontaminate.find_leaks(documents(spark, texts), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (21, 90) in want and (21, 93) in want and len(want) > 10
    kept = decontaminate.keep_clean(documents(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == documents(spark, []).columns
    assert decontaminate.find_leaks(nasty, bench).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.keep_clean(nasty, bench.limit(0)).count() == nasty.count()


def test_the_index_names_all_within_the_radius(spark, monkeypatch):
    assert sum(t + 1 for t in decontaminate.SHARES) > decontaminate.RADIUS
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index, named = decontaminate.MultiIndex(list(range(300)), prints), 0
    for k in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 30)), replace=False))
        asked = int(prints[k]) ^ flips
        assert index.near(asked) == [i for i, p in enumerate(prints.tolist()) if (p ^ asked).bit_count() <= decontaminate.RADIUS]
        named += sum(int(index._list(b, asked >> 16 * b & 0xFFFF).sum()) for b in range(4))
    assert named < 0.6 * 300 * 300


def test_an_index_keeps_nothing_of_the_texts(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passages = [[word() for _ in range(20 + k % 5)] for k in range(30)]
    items = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(passages)])
    texts = []
    for w in passages * 3:
        held = list(w)
        held[rng.choice((0, -1))] = word()
        texts.append(" ".join([word() for _ in range(30)] + held + [word() for _ in range(30)]))
    texts += ["", " ".join(word() for _ in range(3000)) + " " + " ".join(passages[0] * 100)]
    size = len(pickle.dumps(items))
    found = [decontaminate.leaks(t, items) for t in texts]
    assert len(pickle.dumps(items)) == size and all(found[:90]) and not found[90] and found[91]
    monkeypatch.setattr(decontaminate, "WINDOWS", 3)
    monkeypatch.setattr(decontaminate, "LOOKUPS", 8)
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 10)
    decontaminate._WORD_HASHES.clear()
    assert [decontaminate.leaks(t, items) for t in texts] == found and len(decontaminate._WORD_HASHES) <= 10


def test_a_benchmark_in_parts_finds_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_CHARS", bench.agg(F.sum(F.char_length("text"))).first()[0] // 3)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole and whole
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == clean == {r.doc_id for r in docs.collect()} - {w[0] for w in whole}


# 3
def test_archives(spark, tmp_path):
    pages = [(k, f"http://h/{k} ü", t) for k, t in enumerate(["<p>a</p>", None, "", "<p>a</p>", "b" * 100_000, "<p>a</p>", "c\r\n\r\nd"])] + [(None, None, "<p>a</p>"), (7, None, "x")] + [(7, None, "x")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, sha string")
    out = warc.archive_pages(df).toPandas()
    assert len(out) == len(pages)
    largest = {}
    for i, _, h in pages:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    want = sorted(
        (-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", -1) if i is None or largest[h or ""] == i else ("revisit", largest[h or ""])))
        for i, _, h in pages
    )
    assert sorted(out.fillna({"page_id": -1, "refers_to": -1}).astype({"page_id": int, "refers_to": int}).itertuples(index=False, name=None)) == want
    folder = fresh_path(spark, "test")
    archives = warc.write_archives(warc.to_records(df), folder)
    back = warc.read_archives(spark, archives, folder).filter("record_type = 'response'").collect()
    assert {(r.page_id, r.url, bytes(r.payload)) for r in back} >= {(4, "http://h/4%20ü", b"b" * 100_000), (6, "http://h/6%20ü", b"c\r\n\r\nd")}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_damaged_archive():
    records = [warc.encode_record(k, "u", bytes([65 + k]) * 500, None) for k in range(3)]
    with pytest.raises(ValueError):
        warc.decode_record(records[0].replace(b"AAAA", b"AABA"))
    content = warc.build_dictionary(records * 100).as_bytes()
    assert content
    with pytest.raises(ValueError):
        list(warc._frames(b"\0" * 16))


# 4
def test_shards(spark, nasty, empty):
    rng = random.Random(1)
    texts = ["w" * rng.randint(0, 400) for _ in range(2000)] + ["same"] * 900
    out = sharding.shard_documents(documents(spark, texts)).toPandas()
    assert len(out) == len(texts) and (out["size"] == [len(texts[i]) + 16 for i in out.doc_id]).all()
    assert (out.text_crc32 == [zlib.crc32(texts[i].encode()) for i in out.doc_id]).all()
    per = out.groupby("shard")["size"].sum()
    assert len(per) == 40 and (per - per.mean()).abs().max() <= out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    order = out.sort_values(["text_crc32", "doc_id"])
    assert order.shard.is_monotonic_increasing and (order.sort_values(["shard", "slot"]).doc_id.to_numpy() == order.doc_id.to_numpy()).all()
    some = sharding.shard_documents(nasty).toPandas()
    assert len(some) == nasty.count() and some.text_crc32.notna().all()
    assert sharding.shard_documents(empty).count() == 0


# 5
def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    random.seed(3)
    for _ in range(400):
        text = "".join(random.choices(["ab", "é", " ", "\n", "\t", "#", "x y z w v u t s ", "\x0b", " ", "😀"], k=random.randint(0, 80)))
        assert quality_rules.base_counts(text.encode()) == plain_counts(text)
    assert quality_rules.base_counts(None) == (0, 0, 0, 0, 0)


def test_sketch_bins(spark):
    got = spark.range(0, 70_000, 7).selectExpr("id", f"cast({quality_rules.bin_of('id')} as long) b").selectExpr("id", "b", f"{quality_rules.low_end('b')} as low").collect()
    assert all(r.low <= r.id <= r.low * (1 + 1 / 32) + 1e-9 for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_rules(spark, nasty, empty):
    rng = random.Random(6)
    clean = [" ".join("".join(rng.choices("abcdef", k=rng.randint(3, 7))) for _ in range(60)) for _ in range(400)]
    marked = [t.replace(" ", "### ") for t in clean[:20]]
    rows = documents(spark, clean[:300] + marked + ["too short"]).unionByName(documents(spark, clean[300:], [1000 + k for k in range(100)], "fr", "rare"))
    out = quality_rules.judge(rows).toPandas().set_index("doc_id")
    assert out.kept[list(range(300))].all() and out.kept[list(range(1000, 1100))].all()
    assert not out.kept[list(range(300, 321))].any() and out.base_failed[320] and not out.base_failed[300]
    kept = quality_rules.keep_good(rows)
    assert kept.count() == 400 and kept.columns == rows.columns
    judged = quality_rules.judge(nasty).toPandas()
    assert len(judged) == nasty.count() and judged.base_failed.sum() >= 8
    assert quality_rules.judge(empty).count() == 0


def test_fences_follow_their_groups(spark):
    rng = random.Random(5)
    text = lambda share, n=100: " ".join(("#" if rng.random() < share else "") + "".join(rng.choices("abcdef", k=rng.randint(3, 7))) for _ in range(n))
    rows = documents(spark, [text(0.0) for _ in range(300)], list(range(300)), "en", "plain")
    rows = rows.unionByName(documents(spark, [text(0.2) for _ in range(300)], list(range(300, 600)), "en", "marked"))
    rows = rows.unionByName(documents(spark, [text(0.2), text(0.9)], [600, 601], "en", "plain")).unionByName(documents(spark, [text(0.9)], [602], "en", "marked"))
    limits = {r.source: r for r in quality_rules.fences(quality_rules.sketches(quality_rules.base_features(rows))).collect()}
    assert limits["plain"].hi_symbol_rate < 50 < 250 < limits["marked"].hi_symbol_rate < 600
    kept = quality_rules.judge(rows).toPandas().set_index("doc_id").kept
    assert kept[range(600)].all() and not kept[[600, 601, 602]].any()


# 6
def test_licences(spark, nasty, empty):
    texts = [
        "x\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.\n\nmore", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "The driver license fee was renewed and the copyright debate went on.", "nothing here", "word " * 3000 + "licensed under the mozilla public license version 2.0",
    ]
    got = licences.scan(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(0, 1, "apache"), (1, 0, "mit"), (2, 0, "gpl"), (3, 0, "cc-by-nc"), (6, 0, "mpl")]
    assert licences.scan(nasty).count() == 0 and licences.scan(empty).count() == 0
    assert licences.scan(documents(spark, texts[:1] * 3, [1, 1, None])).count() == 3


def test_no_template_is_left_out(spark):
    templates = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    assert licences.paragraphs(documents(spark, [t for _, t in templates])).count() == len(templates)
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = [isc, "a\n \n\n" + isc.replace(" ", "\n"), "Permission is hereby granted, free of charge, to any\r\nperson obtaining a copy of this software and\r\nassociated documentation files", "\n\nx y\n\n" + isc]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(documents(spark, texts)).collect())
    assert got == [(0, 0, "isc"), (1, 3, "isc"), (2, 0, "mit"), (3, 4, "isc")]


def test_unknown_licences():
    """Notices that no model has seen, calibrated: other licences and ordinary text are unknown or unsure, families are found."""
    known = {"mit": "this project is distributed under the terms of the mit license", "apache": "code released under the apache license version 2.0", "gpl": "released under gpl 3.0 by the authors"}
    assert all(licences.classify(licences._tokens(t))[0] == f for f, t in known.items())
    unseen = ["licensed under the sleepycat license", "licensed under the ibm public license version 1.0", "released under the educational community license", "the driver lost the license in the house of books", "permission slip for the school trip"]
    assert all(f == "unknown" or p < 0.9 for f, p in (licences.classify(licences._tokens(t)) for t in unseen))


def test_licences_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wrapped = ["x y\n\n" + t.replace(" ", "\n", 9) for ts in licences.TEMPLATES.values() for t in ts] + [o for row in licences.OTHERS for o in row]
    rows += [(10_000 + k, t) for k, t in enumerate(wrapped)]

    def judged(text):
        words = re.findall("[a-z0-9]+", text.lower())
        family, p = licences.classify(words)
        mine = set(licences._triples(words))
        share = max((len(mine & set(t)) / len(t) for t in map(licences._triples, map(licences._tokens, licences.TEMPLATES.get(family, ())))), default=0)
        return family if family != "unknown" and p >= licences.MIN_PROBABILITY and share >= licences.MIN_TEMPLATE else None

    expected = []
    for doc_id, text in rows:
        lines, start = text.split("\n"), 0
        while start < len(lines):
            end = start
            while end < len(lines) and lines[end].strip(" \t\r\f\v"):
                end += 1
            hits = {}
            for k in range(start, end):
                if f := judged(lines[k]):
                    expected.append((doc_id, k, f))
                    hits[f] = True
            if end - start > 1 and (f := judged("\n".join(lines[start:end]))) and f not in hits:
                expected.append((doc_id, start, f))
            start = end + 1
    got = licences.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == sorted(expected) and len(expected) > 40



def test_licence_scores_match_numpy(spark):
    classes, weights, intercepts, temperature = licences.train()
    line = "This file is released under the MIT License"
    z = np.array(intercepts) + sum(np.array(weights[g]) for g in licences._grams(licences._tokens(line)) if g in weights)
    p = np.exp(z / licences.SCALE / temperature)
    r = licences.scan(documents(spark, [line])).first()
    assert r.family == classes[int(z.argmax())] and r.probability == pytest.approx(p.max() / p.sum(), abs=1e-6)


# 7
def test_classifier(spark, nasty, empty):
    rng = random.Random(8)
    clean = [" ".join("".join(rng.choices("abcdef", k=rng.randint(3, 7))) for _ in range(rng.randint(5, 60))) + "." for _ in range(400)]
    texts = [t if k % 3 else t.upper().replace(" ", "!! ") for k, t in enumerate(clean)]
    rows = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(rows, labels).toPandas().set_index("doc_id").sort_index()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index])
    assert (out.held_out.to_numpy() == held).all() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert (out.predicted == [int(i % 3 > 0) for i in out.index])[held].mean() > 0.95
    assert quality_classifier.keep_good(rows, labels).columns == rows.columns
    odd = quality_classifier.classify(nasty, labels).toPandas()
    assert len(odd) == nasty.count() and odd.score.notna().all()
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(rows.limit(3), labels.limit(0)).toPandas().score.between(0, 1).all()


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.AdditiveModel().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] == 1)).mean() > 0.9


def test_scores_by_plain_recomputation(spark):
    """Bins, tables and scores of the query, added up one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op7_quality_classifier"](spark, SF).collect():
        x = quality_classifier.feature_matrix([(texts[r.doc_id] or "").encode()])[0]
        total = model.start + sum(t[bisect.bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        for (i, j), t in model.pairs.items():
            total += t[bisect.bisect_right(list(model.coarse[i]), x[i]) * (len(model.coarse[j]) + 1) + bisect.bisect_right(list(model.coarse[j]), x[j])]
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_columns_with_the_names_of_helpers(spark):
    """Filters leave any column as it is, whatever its name, and don't trip over it."""
    names = ["_gone", "_Clean", "_score", "__clean", "__score", "id", "fp", "key", "component", "block"]
    texts = ["".join(random.Random(k).choices("abcdefgh ", k=400)) for k in range(30)]
    docs = documents(spark, texts).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names if n != "key"})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, " ".join(texts[3].split()))], "item_id long, text string")
    for kept in (quality_rules.keep_good(docs), simhash.keep_one(docs), decontaminate.keep_clean(docs, items), quality_classifier.keep_good(docs, labels)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r._gone == f"_gone{r.doc_id}" and r._Clean == f"_Clean{r.doc_id}" and r._score == f"_score{r.doc_id}" for r in rows)


def test_repeated_ids_send_one_row_each_to_the_driver(spark):
    docs = documents(spark, ["some text here"] * 50 + ["other text"], [1] * 50 + [2])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    quality_classifier_fit = quality_classifier.AdditiveModel.fit
    try:
        quality_classifier.AdditiveModel.fit = lambda self, x, y: (seen.append(len(x)), quality_classifier_fit(self, x, y))[1]
        quality_classifier.train(docs, labels)
    finally:
        quality_classifier.AdditiveModel.fit = quality_classifier_fit
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2))]


# 8
PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">buy</div><header>Top</header>
<article><h1>Title &amp; more</h1><p>One <b>two</b>&nbsp; three<br>four<p>Five<div id="comments">bad</div><form>x</form></article><footer>&copy; me</footer>"""


def test_html_structure():
    assert html_text.Page(PAGE).text() == "Title & more\nOne two three four\nFive"
    for odd in (None, "", "plain", "<", "<<<>>>", "<a href='x", "<!-- open", "<script>open", "</p></div>", "<p " + "x" * 5000, '<a title="' * 2000):
        html_text.Page(odd).text()
    assert html_text.Page("plain &lt;text&gt;").text() == "plain <text>"
    assert html_text.Page("A &am<b>p;</b> B").text() == "A &amp; B" and html_text.Page("<p>a&lt;b<i>&gt;</i>").text() == "a<b>"
    inside = "<article><p class='form-factor'>size</p><p class='search-results'>found</p><p class='related-work'>prior</p><p id='alert'>x</p><div class='notice-board'>y</div><p>kept</p>{}</article>"
    assert html_text.Page(inside.format("<div class='ad'>a</div><ul class='comments'><li>b</ul><p class='sponsored'>c</p>")).text() == "size\nfound\nprior\nx\ny\nkept"


def test_html_wrappers():
    text = "<p>The text of the page</p>"
    for page in (
        f"<div class='site has-sidebar'><article>{text}</article></div>", f"<article class='post has-comments'>{text}</article>", f"<div class='widget'><main>{text}</main></div>",
        f"<div id='search'><article class='form'>{text}</article></div>", f"<div class='has-sidebar'>{text}</div>", f"<article><div class='share-price'>{text}</div></article>",
        f"<article>{text}</article><div class='comments'><article>bad</article></div>", f"<div class='modal'><div role='main'>{text}</div></div>",
    ):
        assert html_text.Page(page).text() == "The text of the page", page


def test_html_runs(spark):
    chrome = "we use small files to make this site work for all of you"
    body = [f"page {k} has words of its own like {'abcdefgh'[k % 8] * 3} and number {k * 7}" for k in range(6)]
    rows = [(k, "http://Host.example/x", f"<div>{chrome}</div><div>{body[k]}</div>") for k in range(6)]
    rows += [(10, "http://other/", f"<div>{chrome}</div>"), (11, "http://mirror/", PAGE), (12, "http://mirror/", PAGE), (13, None, None), (None, "http://host.example/", f"<p>{chrome}</p>")]
    rows += [(14, "http://twin/", "<p>" + body[0] + "</p>"), (15, "http://twin/", "<p>" + body[0] + "</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    out = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(out) == len(rows) and all(out[k].text == body[k] for k in range(6))
    assert out[10].text == chrome and out[11].text == out[12].text == "Title & more\nOne two three four\nFive" and out[13].text == "" and out[13].n_chars == 0
    assert out[14].text == out[15].text == body[0] and all(r.n_chars == len(r.text) for r in out.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_runs_in_and_beside_articles(spark):
    rng = random.Random(15)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    plea, chrome, text = words(12), words(14), [words(30) for _ in range(14)]
    rows = [(k, f"<div>{chrome}</div><article><p>{text[k]}</p><div class='x1'>{plea}</div></article>") for k in (0, 1, 2, 3, 8, 9, 10, 11, 12)]
    rows += [(4, f"<article><p>{text[0]}</p><p>{words(3)}</p></article>"), (5, f"<article></article><div>{chrome}</div><p>{text[4]}</p>"), (6, f"<main><p>see below</p></main><div>{chrome}</div><p>{text[5]}</p>")]
    rows += [(7, rows[3][1])]
    frame = spark.createDataFrame([(k, "http://h/", p) for k, p in rows], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert [out[k] for k in (0, 1, 2, 3, 8, 12)] == [text[k] for k in (0, 1, 2, 3, 8, 12)] and out[7] == text[3]
    assert out[4].startswith(text[0]) and out[5] == text[4] and out[6] == "see below\n" + text[5]
    # With fewer pages, or on fewer than half of them, a repeated block inside an article stays.
    out = {r.page_id: r.text for r in html_text.extract(frame.filter("page_id < 4")).collect()}
    assert out[1] == f"{text[1]}\n{plea}"


def test_html_repeats_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    run, pages = 4, []
    shared = [" ".join(rng.choices("abcdef", k=rng.randint(2, 14))) for _ in range(6)]
    for k in range(60):
        blocks = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        pages.append((k, f"http://host{k % 3}/{k}", "".join(f"<div>{b}</div>" for b in blocks), blocks))
    streams = {k: " ".join(blocks).split() for k, _, _, blocks in pages}
    grams = {k: [tuple(t[i : i + run]) for i in range(len(t) - run + 1)] for k, t in streams.items()}
    expected = {}
    for k, _, _, blocks in pages:
        twice = {g for o in streams if o % 3 == k % 3 and streams[o] != streams[k] for g in grams[o]}
        covered = {i + j for i, g in enumerate(grams[k]) if g in twice for j in range(run)}
        lines, at = [], 0
        for b in blocks:
            words, kept = b.split(), []
            spans: list[list[int]] = []  # stretches of the block with and without cover
            for i in range(len(words)):
                if spans and (at + i in covered) == (spans[-1][-1] in covered):
                    spans[-1].append(at + i)
                else:
                    spans.append([at + i])
            for span in spans:
                if span[0] not in covered or (len(span) < run and len(spans) > 1):
                    kept += [streams[k][i] for i in span]
            lines += [" ".join(kept)] if kept else []
            at += len(words)
        expected[k] = "\n".join(lines or blocks)
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(frame, run).collect()} == expected
    monkeypatch.setattr(html_text, "MAX_SENT", -1)
    monkeypatch.setattr(html_text, "PART", 200)
    assert {r.page_id: r.text for r in html_text.extract(frame, run).collect()} == expected


class _Articles(html.parser.HTMLParser):
    """The text inside article, block by block, by the standard library's parser."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "article", "br") and tag != "br" else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_extraction_against_another_parser(spark):
    out = registry.QUERIES["op8_html_extraction"](spark, SF).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for page_id, row in pages.iterrows():
        expected = "\n".join(t for b in _Articles(row.html).blocks if (t := " ".join(b.split())))
        assert out.loc[page_id].text == expected and out.loc[page_id].url == row.url


# 9
def test_edits(spark, nasty, empty):
    encode = token_counts.encoder().encode_ordinary
    random.seed(9)
    for leaf in (3, 16):
        for _ in range(400):
            text = "".join(random.choices(["a", " ", "  ", "\n", "'s", "1", ".", "é", " b", "日"], k=random.randint(0, 60)))
            c = token_counts.Counter(text, leaf=leaf)
            for _ in range(3):
                a = random.randint(0, len(text))
                b, new = a + random.randint(0, 9), random.choice(["", " ", "  x", " a b c", "'s", "long words here "])
                text = text[:a] + new + text[b:]
                c.edit(a, b, new)
                assert c.text == text and c.total == len(encode(text)) == sum(c.counts())
    long = "many words in a long text " * 2000
    c = token_counts.Counter(long)
    assert c.edit(20_000, 20_010, "other") < 4 * token_counts.LEAF and c.total == len(encode(c.text))
    out = token_counts.count_revisions(nasty).collect()
    assert len(out) == nasty.count()
    by_id = {r.doc_id: r for r in out}
    for i, t in enumerate(NASTY):
        t = t or ""
        half = len(t) // 2
        new = t[:half] + " [revised] " + t[half + 7 :]
        line = t.find("\n") + 1
        new = new[line if line < half else 0 :]
        assert (by_id[i].n_before, by_id[i].n_tokens, by_id[i].n_chars) == (len(encode(t)), len(encode(new)), len(new)), i
    assert token_counts.count_revisions(empty).count() == 0


def test_trees_keep_their_form_over_many_edits(spark):
    encode = token_counts.encoder().encode_ordinary
    rng, text = random.Random(3), "some words in a text of usual length " * 60
    c, again = token_counts.Counter(text), 0
    for _ in range(300):
        a = rng.randint(0, len(text))
        b, new = min(len(text), a + rng.randint(0, 80)), " ".join(rng.choices(["word", "a", "longer-word", "\n"], k=rng.randint(0, 12)))
        text = text[:a] + new + text[b:]
        again += c.edit(a, b, new)
        assert c.text == text and c.total == len(encode(text))
    assert c.rebuilt < 30 and again < 300 * 12 * token_counts.LEAST_LEAF


def test_edits_of_a_stored_state(spark):
    texts = ["one two three " * 30, "", "four five"]
    state = written(token_counts.build(documents(spark, texts)), "state")
    edit = lambda a, b, t: F.array(F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end"), F.lit(t).alias("text")))
    once = written(token_counts.apply_edits(state.withColumn("edits", edit(0, 3, "1"))), "state")
    twice = token_counts.apply_edits(once.withColumn("edits", edit(2, 2, " and "))).collect()
    encode = token_counts.encoder().encode_ordinary
    for r in twice:
        t = "1" + texts[r.doc_id][3:]
        assert r.text == t[:2] + " and " + t[2:] and r.n_tokens == len(encode(r.text)) and r.n_before == len(encode(t))


# 10
def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    import xxhash

    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    random.seed(1)
    for _ in range(200):
        text = " ".join(random.choices(["Ab", "cd", "É", "ef\n", " x"], k=random.randint(0, 12)))
        assert simhash.fingerprint(text.encode()) == slow_print(text)


@pytest.mark.parametrize("split", [simhash.SPLIT, 300])
def test_links_are_those_of_all_pairs(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {0}
    for b in base:
        for _ in range(150):  # a crowd about one centre: hot keys
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
        for n in range(1, 8):
            prints.add(int(b) ^ ((1 << n) - 1) << int(rng.integers(0, 56)))
    prints |= {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)}
    x = np.array(sorted(prints), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    signed = x.astype(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    found = simhash.links(df).toPandas()
    assert (np.bitwise_count((found.u.to_numpy() ^ found.v.to_numpy()).view(np.uint64)) <= 4).all()
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    groups = components.connected_components(simhash.links(df)).toPandas()
    got = {int(f): int(f) for f in signed} | dict(zip(groups.node, groups.component, strict=True))
    by_true, by_got = {}, {}
    for f, a in zip(signed, label, strict=True):
        by_true.setdefault(int(a), set()).add(int(f))
        by_got.setdefault(got[int(f)], set()).add(int(f))
    assert sorted(map(sorted, by_true.values())) == sorted(map(sorted, by_got.values()))


def test_very_long_texts(spark):
    """Whole texts: what counts stands at the end of 120,000 words."""
    rng = random.Random(21)
    draw = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)]
    item, words = draw(40), draw(120_000)
    long = " ".join([*words, *item])
    docs = documents(spark, [long, " ".join(draw(60)), long + " end"])
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.start, r.similarity) for r in found) == [(0, 120_000, 1.0), (2, 120_000, 1.0)]
    counts = quality_rules.judge(docs).toPandas().set_index("doc_id")
    assert counts.n_words[0] == 120_040 and counts.word_chars[0] == sum(map(len, words + item))
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert near[0][1] == near[2][1] == 0 and int(near[0][0], 16) == slow_print(long)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(3)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels).collect())
    page = f"<nav>home</nav><article>{''.join(f'<p>{x}</p>' for x in (long[k : k + 500].strip() for k in range(0, len(long), 500)))}</article>"
    got = html_text.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).first()
    assert got.text.replace("\n", "") == "".join(long[k : k + 500].strip() for k in range(0, len(long), 500)) and got.n_chars == len(got.text)


def test_near_duplicates(spark, nasty, empty):
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:399], "other"]), " ".join(reversed(words)), "", None, "  "]
    out = simhash.near_duplicates(documents(spark, texts)).toPandas().set_index("doc_id")
    assert out.component_id[[0, 1, 2]].tolist() == [0, 0, 0] and out.component_id[3] == 3 and out.component_id[[4, 5, 6]].tolist() == [4, 4, 4]
    assert all(int(f, 16) == slow_print(texts[i]) and len(f) == 16 for i, f in out.fingerprint.items())
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()) == [0, 3, 4]
    odd = simhash.near_duplicates(nasty).toPandas()
    assert len(odd) == nasty.count() and odd[odd.doc_id.isna()].component_id.isna().all()
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_down_to_the_similarity(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    boiler = " ".join(word() for _ in range(12))
    texts = []
    for n in (24, 60, 200, 900):
        for _ in range(12):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(2):
                copy = list(base)
                for _ in range(rng.randint(1, max(1, n // 45))):
                    copy[rng.randrange(n)] = word()
                texts.append(" ".join(copy) + rng.choice(["", " " + boiler]))
    texts += ["again and again " * 30, "again and again " * 33, "again and again " * 60, boiler, "one two", "one two", "One  Two", "one"]
    counts = [Counter(decontaminate.shingles(t.lower().split())) for t in texts]
    label, bands = list(range(len(texts))), Counter()
    for i in range(len(texts)):
        for j in range(i):
            s = decontaminate.similarity(counts[i], counts[j])
            if s >= 0.8:
                bands[int(s * 20)] += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert min(bands[k] for k in (16, 17, 18)) >= 3 and len(set(label)) < len(texts) - 20
    got = {r.doc_id: r.component_id for r in simhash.similar(documents(spark, texts)).collect()}
    assert got == dict(enumerate(label))
    assert {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()} == set(label)


def test_components(spark):
    random.seed(7)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
