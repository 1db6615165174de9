"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch is a table of counts over value bins that are exact below 64 and relative above (32 bins to each
power of two, so a quantile is right to 1/32). Two sketches merge by adding counts, in any order, so one
aggregation builds them all and coarser groups are sums of finer ones. A document is rejected when a rate lies beyond
a fence of its group: the ninth decile plus FENCE times the group's own spread, which is the distance of that decile from the median.
Rates that are zero in most documents have no spread between quantiles; there it is one event (a symbol, a repeated line, two equal
windows) in a document of the group's median length, the least step in which such a rate can differ. Lengths in words have a low fence
only, by ratios instead of differences, for which the least step is that of the sketch. Nothing else sets a width.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, text_bytes, without, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A group with fewer documents than this takes the sketch of its language, or of all documents.
MIN_GROUP = 200
FENCE = 3
#: Rates that are judged, in parts per thousand words, with the count of one event. Word length has fences on both sides.
EVENT = {"symbol_rate": 1, "dup_line_rate": 1, "repeat_rate": 2 * WINDOW, "word_length": 1}
SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the list, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    with np.errstate(over="ignore"):
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        rolled = np.zeros(n - window + 1, np.uint64)
        for j in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - window + 1 + j]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    found = Counter(tuple(words[i : i + window]) for i in maybe)  # equal hashes are confirmed by the words themselves
    edge = np.zeros(n + 1, np.int64)
    for i in maybe:
        if found[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text counts as empty."""
    text = text or b""
    words = text.split()
    octets = np.frombuffer(text, np.uint8)
    chars = len(octets) - int(_SPACE[octets].sum()) - int(((octets & 0xC0) == 0x80).sum())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, int(_SYMBOL[octets].sum()), dup, repeated_words(words)


def base_features(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, lang, source, base counts, base_failed), one row for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in BASE.split(", ")]
        for batch in batches:
            counts = np.array([base_counts(t) for t in batch["text"]], np.int64).reshape(-1, 5)
            yield pd.concat([batch[["doc_id", "lang", "source"]].reset_index(drop=True), pd.DataFrame(counts, columns=names)], axis=1)

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text_bytes().alias("text"))
    counted = rows.mapInPandas(run, f"doc_id long, lang string, source string, {BASE}")
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _rate(count: str) -> Column:
    return F.expr(f"case when n_words > 0 then 1000 * {count} div n_words else 0 end")


def _rates() -> dict[str, Column]:
    return {"symbol_rate": _rate("n_symbols"), "dup_line_rate": _rate("n_dup_lines"), "repeat_rate": _rate("n_repeat_words"), "word_length": _rate("word_chars")}


def bin_of(value: str) -> str:
    """SQL for the bin of a value of at least 0."""
    return f"case when {value} < 64 then {value} else 32 * (length(bin({value})) - 6) + shiftright({value}, length(bin({value})) - 6) end"


def low_end(bin_: str) -> str:
    """SQL for the least value of a bin."""
    return f"case when {bin_} < 64 then {bin_} else shiftleft({bin_} - 32 * (cast(floor({bin_} / 32) as int) - 1), cast(floor({bin_} / 32) as int) - 1) end"


def sketches(features: DataFrame, base: bool = True) -> DataFrame:
    """(lang, source, feature, bin, n) over the rows that pass the base rules (or all that have words); null languages and sources count as ''."""
    values = _rates() | {"n_words": F.col("n_words")}
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("long").alias("value")) for k, v in values.items()]))
    rows = features.filter("not base_failed" if base else "n_words > 0").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), stacked.alias("f"))
    return rows.select("lang", "source", "f.feature", F.expr(bin_of("f.value")).cast("long").alias("bin")).groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))


def fences(cells: DataFrame) -> DataFrame:
    """Sketch cells -> (lang, source, one high fence a rate, low ones for the word length and the words). Small groups take merged sketches."""
    size = cells.filter("feature = 'n_words'").groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    by_lang = size.groupBy("lang").agg(F.sum("docs").alias("lang_docs"))
    groups = size.join(by_lang, "lang").select(
        "lang", "source",
        F.expr(f"case when docs >= {MIN_GROUP} then 2 when lang_docs >= {MIN_GROUP} then 1 else 0 end").alias("level"),
    )
    merged = (
        cells.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("g_lang", F.expr("case when level >= 1 then lang else '' end"))
        .withColumn("g_source", F.expr("case when level >= 2 then source else '' end"))
        .groupBy("level", "g_lang", "g_source", "feature", "bin").agg(F.sum("n").alias("n"))
    )
    key = ["level", "g_lang", "g_source", "feature"]
    ranked = merged.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    decile = lambda q: F.min(F.when(10 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    bins = ranked.groupBy(*key).agg(*[decile(q).alias(f"b{q}") for q in (1, 5, 9)])
    bounds = bins.select(*key, *[F.expr(low_end(f"b{q}")).alias(f"d{q}") for q in (1, 5, 9)])
    pick = lambda k, c: F.max(F.when(F.col("feature") == k, F.col(c)))
    wide = bounds.groupBy("level", "g_lang", "g_source").agg(pick("n_words", "d1").alias("d1_n_words"), pick("n_words", "d5").alias("d5_n_words"), *[pick(k, d).alias(f"{d}_{k}") for k in EVENT for d in ("d1", "d5", "d9")])
    high = [F.expr(f"d9_{k} + {FENCE} * greatest(d9_{k} - d5_{k}, 1000 * {n} div d5_n_words)").alias(f"hi_{k}") for k, n in EVENT.items()]
    low = F.expr(f"d1_word_length - {FENCE} * greatest(d5_word_length - d1_word_length, 1000 * {EVENT['word_length']} div d5_n_words)").alias("lo_word_length")
    ratio = "least(d1_n_words / d5_n_words, 31 / 32D)"
    low_words = F.expr(f"d1_n_words * {' * '.join([ratio] * FENCE)}").alias("lo_n_words")
    keyed = groups.withColumn("g_lang", F.expr("case when level >= 1 then lang else '' end")).withColumn("g_source", F.expr("case when level >= 2 then source else '' end"))
    return keyed.join(wide.select("level", "g_lang", "g_source", *high, low, low_words), ["level", "g_lang", "g_source"]).drop("level", "g_lang", "g_source")


def judge(docs: DataFrame, base: bool = True) -> DataFrame:
    """documents -> (doc_id, base counts, base_failed, kept), one row for each row.

    kept is false for documents that fail the base rules, else the verdict of the learned fences. Null and empty
    texts have no words and fail. A group without a passing document has no fence; none of its rows needs one.
    Without ``base`` the fences are learned from all documents with words and decide alone. The word length is judged
    from MIN_WORDS words on, as fewer say little about it.
    """
    features = written(base_features(docs), "features")
    limits = written(fences(sketches(features, base)), "fences").withColumnRenamed("lang", "l_lang").withColumnRenamed("source", "l_source")
    # One row for each language and source of the corpus; Spark sends it to the executors only below its own size limit.
    joined = features.join(limits, (F.coalesce("lang", F.lit("")) == F.col("l_lang")) & (F.coalesce("source", F.lit("")) == F.col("l_source")), "left")
    length = _rates()["word_length"]
    inside = F.coalesce(F.col("n_words") >= F.col("lo_n_words"), F.lit(True))
    inside &= (F.col("n_words") < MIN_WORDS) | (F.coalesce(length >= F.col("lo_word_length"), F.lit(True)) & F.coalesce(length <= F.col("hi_word_length"), F.lit(True)))
    for name, rate in _rates().items():
        if name != "word_length":
            inside &= F.coalesce(rate <= F.col(f"hi_{name}"), F.lit(True))
    kept = inside & (~F.col("base_failed") if base else F.col("n_words") > 0)
    return joined.select("doc_id", *[x.split()[0] for x in BASE.split(", ")], "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id the learned fences keep, with all columns; rows without doc_id stay.

    The fixed base rules belong to ``judge``'s report; here the fences alone decide, so that clean short texts stay; a text without words goes. A doc_id that
    repeats goes with all its rows if one of them is rejected. No documents give none.
    """
    gone = judge(docs, base=False).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return without(docs, gone)
