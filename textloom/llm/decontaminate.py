"""Benchmark decontamination by fingerprints of item-sized windows.

Windows are as long as an item, and each is given a 64-bit SimHash of its shingles. The fingerprints of all items of a length are held in a
multi-index: of four blocks, two fingerprints at most RADIUS bits apart have one block within its own share of the radius (the
shares, each plus one, add up to more than the radius), so the items that a window's blocks are near are all that can lie within it.
Items within the radius are candidates, and verified by the exact weighted shingle similarity, the sum of the smaller over that of the larger counts.

A window as similar as asked for to some item holds enough shingles of items, so only such windows are fingerprinted; which items they are
compared with is the index's answer alone.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import in_small_batches, unused

SHINGLE, SIMILARITY = 5, 0.8
#: Between shingle sets of similarity 0.8 the expected distance is 10 bits; this is over three deviations more.
RADIUS = 22
#: Bits that may differ in each of the blocks of 16 bits; each plus one, they add up to RADIUS + 1.
SHARES = (5, 5, 5, 4)
#: The table of at most so many characters of items is sent to every executor; a larger benchmark is worked in parts, one after another.
MAX_BENCHMARK_CHARS = 64 << 20
#: So many windows of a text are fingerprinted, and so many comparisons with items made, at once.
WINDOWS, LOOKUPS = 1024, 1 << 16
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int = SHINGLE) -> list[str]:
    """Word shingles in order, repeats included; the whole sequence where there are fewer words."""
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, a byte each."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` hashes each, from how often each bit is set."""
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over that of the larger."""
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / (a.total() + b.total() - both) if a and b else 0.0


class MultiIndex:
    """Fingerprints of the items of one length by their blocks; ``near`` and ``pairs`` name those within RADIUS. It keeps nothing of what it is asked."""

    def __init__(self, items: list[int], prints: np.ndarray) -> None:
        self.items, self.prints = np.array(items), prints
        #: For each block its distinct values, and which of them each item has.
        self.blocks = [np.unique(block, return_inverse=True) for block in _blocks(prints)]

    def _list(self, block: int, keys) -> np.ndarray:
        """Which items have a block near the key; a row for each where there are several."""
        values, of_item = self.blocks[block]
        return (np.bitwise_count(np.asarray(keys, np.uint16)[..., None] ^ values) <= SHARES[block])[..., of_item]

    def near(self, fingerprint: int) -> list[int]:
        return [k for _, k in self.pairs(np.array([fingerprint], np.uint64))]

    def pairs(self, fingerprints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) for each of the fingerprints and each item within RADIUS of it, in order."""
        step = max(1, LOOKUPS // len(self.items))
        for at in range(0, len(fingerprints), step):
            asked = fingerprints[at : at + step]
            first, *others = [self._list(b, keys) for b, keys in enumerate(_blocks(asked))]
            places, some = np.nonzero(first | others[0] | others[1] | others[2])
            close = np.bitwise_count(asked[places] ^ self.prints[some]) <= RADIUS
            yield from zip((at + places[close]).tolist(), self.items[some[close]].tolist(), strict=True)


def _blocks(prints: np.ndarray) -> np.ndarray:
    """Four rows: the blocks of the fingerprints."""
    return prints.astype("<u8").view("<u2").reshape(-1, 4).T


class Items:
    """Benchmark items: distinct texts, their shingles, and a multi-index of fingerprints for each length."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        by_words: dict[tuple, list[int]] = {}
        for item_id, text in rows:
            if words := words_of(text):
                by_words.setdefault(tuple(words), []).append(item_id)
        self.ids = [sorted(v) for v in by_words.values()]
        self.sizes = [len(w) for w in by_words]
        self.counts = [Counter(shingles(list(w))) for w in by_words]
        #: The few items shorter than a shingle by length and words, all others by length; the rolled hashes of these items' shingles.
        self.short: dict[tuple, list[int]] = {}
        by_size: dict[int, list[int]] = {}
        hashes: set[int] = set()
        prints = np.zeros(len(by_words), np.uint64)
        for k, w in enumerate(by_words):
            if len(w) < SHINGLE:
                self.short.setdefault(w, []).append(k)
            else:
                by_size.setdefault(len(w), []).append(k)
                hashes.update(rolled(list(w)).tolist())
                bits = _bits(np.array([_hash(x) for x in shingles(list(w))], np.uint64))
                prints[k] = _pack(bits.sum(0, dtype=np.int32)[None, :], len(bits))[0]
        self.short_sizes = sorted({len(w) for w in self.short})
        self.index = {size: MultiIndex(items, prints[items]) for size, items in sorted(by_size.items())}
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64((1 << 20) - 1)] = True

    def held(self, rolls: np.ndarray) -> np.ndarray:
        """Which of a text's shingles some item has."""
        out = self.maybe[rolls & np.uint64((1 << 20) - 1)]
        if out.any():
            some = rolls[out]
            out[out] = self.hashes[np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)] == some
        return out


#: Words whose hashes a worker keeps.
MAX_WORDS = 50_000


class _WordHashes(dict):
    """Hashes of the words met so far, forgotten when they are many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = _hash(word)
        return h


_WORD_HASHES = _WordHashes()


def rolled(words: list[str]) -> np.ndarray:
    """A hash of each shingle, from its words' hashes."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    return out


def leaks(text: str | None, items: Items, least: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """(item_id, first word, words, similarity) of the best window for each item that the text holds; the first of equals."""
    words = words_of(text)
    found: dict[int, tuple[float, int]] = {}
    rolls = rolled(words)
    here = items.held(rolls) if len(rolls) and len(items.hashes) else np.zeros(0, bool)
    if here.any():
        upto = np.concatenate([[0], np.cumsum(here)])
        total = int(upto[-1])
        ones = None
        for size, index in items.index.items():
            n = size - SHINGLE + 1
            inside = min(n, len(rolls))  # of a text shorter than the item
            need = least * (n + inside) / (1 + least)  # so many shingles the two have in common
            if total < need - 1e-9:
                continue
            starts = np.flatnonzero(upto[inside:] - upto[: len(upto) - inside] >= need - 1e-9)
            if not len(starts):
                continue
            if ones is None:
                hashes = np.fromiter(map(_hash, shingles(words)), np.uint64, len(rolls))
                ones = np.zeros((len(rolls) + 1, 64), np.int32)
                np.cumsum(_bits(hashes), axis=0, out=ones[1:])
            for at in range(0, len(starts), WINDOWS):
                some = starts[at : at + WINDOWS]
                last, counts = -1, None
                for place, k in index.pairs(_pack(ones[some + inside] - ones[some], inside)):
                    s = int(some[place])
                    if s != last:
                        last, counts = s, Counter(shingles(words[s : s + size]))
                    score = similarity(counts, items.counts[k])
                    if score >= least and score > found.get(k, (0.0, 0))[0]:
                        found[k] = (score, s)
    for size in items.short_sizes:
        for s in range(len(words) - size + 1):
            for k in items.short.get(tuple(words[s : s + size]), ()):
                found.setdefault(k, (1.0, s))
    return [(i, s, items.sizes[k], score) for k, (score, s) in sorted(found.items()) for i in items.ids[k]]


def load_items(benchmark: DataFrame) -> Iterator[Items]:
    """Reads the benchmark to the driver in parts of about MAX_BENCHMARK_CHARS, each no more than what one executor is sent at once."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-(rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // MAX_BENCHMARK_CHARS))
    for part in range(parts):
        of_part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Items([tuple(r) for r in of_part.orderBy("item_id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): one row for each document and item where a window of the document is as similar as ``least``.

    Words are runs of letters, digits and underscores, in lower case. Items shorter than a shingle must occur whole. Equal items each get a row. Null and empty texts have no
    windows, items without words none to match; repeated documents give repeated rows. A window reaches beyond no end of its text.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [rows.mapInPandas(_finder(docs.sparkSession.sparkContext.broadcast(items), least), LEAK) for items in load_items(benchmark)]
    return functools.reduce(DataFrame.unionByName, parts)


LEAK = "doc_id long, item_id long, start long, n_words long, similarity double"


def _finder(items, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = items.value
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in leaks(t, known, least)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "n_words", "similarity"])
            yield out.astype({"doc_id": "Int64", "item_id": "int64", "start": "int64", "n_words": "int64", "similarity": "float64"})

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without a leak, with all columns as they were; judged row by row. Null and empty texts have none and stay."""
    docs, name = in_small_batches(docs), unused(docs, "_clean")
    for items in load_items(benchmark):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(items), least)
        docs = docs.withColumn(name, clean(F.col("text").cast("string"))).filter(F.col(name)).drop(name)
    return docs


def _clean(items, least: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not leaks(t, items.value, least) for t in texts], dtype=bool)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, BooleanType()).asNondeterministic()
