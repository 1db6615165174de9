"""Edit-aware token counts.

A document is kept as leaves, runs of whole pre-tokens of a few dozen characters up to LEAF in long texts, under a segment tree of their token
counts. A leaf begins only where the pre-token pattern must break, right before a single space between two
characters that aren't white space, so the tokens of a text are those of its leaves. An edit replaces the leaves that it touches,
with a neighbour on either side as context, by freshly cut and encoded ones; the counts of all other leaves are kept, and only
the sums above changed leaves are computed anew. Where a region has other leaves than before, neighbours are joined or places stay
empty, so that the tree keeps its form; it is built again only when a leaf has outgrown GROWN times its size.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAST_LEAF, LEAF = 48, 512
GROWN = 8
_CUT = re.compile(r"(?<=\S)(?= \S)")
EDITS = "array<struct<begin:long,end:long,text:string>>"
STATE = "doc_id long, text string, starts array<long>, tree array<long>"


@functools.cache
def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("textloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaf_size(text: str) -> int:
    """Characters of a leaf: a document of n has about the root of n leaves, so that an edit costs about as much."""
    return min(LEAF, max(LEAST_LEAF, math.isqrt(len(text))))


def cut(text: str, leaf: int = LEAF) -> list[int]:
    """Where the leaves of a text begin; a stretch without a place to cut stays one leaf, whatever its length."""
    starts, at = [0], 0
    while (at := at + leaf) < len(text) and (m := _CUT.search(text, at)):
        at = m.start()
        starts.append(at)
    return starts


def count(texts: list[str], path: str = VOCABULARY) -> list[int]:
    encode = encoder(path).encode_ordinary
    return [len(encode(t)) for t in texts]


class Counter:
    """A document's leaves and the segment tree over their counts."""

    def __init__(self, text: str, path: str = VOCABULARY, leaf: int | None = None, state: tuple | None = None) -> None:
        self.text, self.path, self.leaf = text, path, leaf or leaf_size(text)
        self.rebuilt = 0
        if state:
            self.starts, self.tree = list(state[0]), np.array(state[1], np.int64)
        else:
            self.starts = cut(text, self.leaf)
            self._build(count([text[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(text)], strict=True)], path))

    def _build(self, counts: list[int]) -> None:
        """tree[1] is the sum of all; the leaves' counts begin in the middle."""
        width = 1 << max(0, (len(counts) - 1).bit_length())
        self.tree = np.zeros(2 * width, np.int64)
        self.tree[width : width + len(counts)] = counts
        low = width
        while low > 1:
            self.tree[low // 2 : low] = self.tree[low : 2 * low : 2] + self.tree[low + 1 : 2 * low : 2]
            low //= 2

    @property
    def total(self) -> int:
        return int(self.tree[1])

    def counts(self) -> list[int]:
        width = len(self.tree) // 2
        return self.tree[width : width + len(self.starts)].tolist()

    def edit(self, begin: int, end: int, new: str) -> int:
        """Replaces text[begin:end]; returns how many characters were encoded again. Bounds are moved into the text."""
        begin = max(0, min(begin, len(self.text)))
        end = max(begin, min(end, len(self.text)))
        # The leaf of the edit's begin and the one before, the leaf of its end and the one after; leaves may be empty.
        find = lambda at, side: int(np.searchsorted(self.starts, at, side=side))
        first = max(0, find(self.starts[max(0, find(begin, "right") - 1)], "left") - 1)
        last = find(end, "right")
        last = find(self.starts[last], "right") if last < len(self.starts) else last
        low, high = self.starts[first], self.starts[last] if last < len(self.starts) else len(self.text)
        part = self.text[low:begin] + new + self.text[end:high]
        grown = len(new) - (end - begin)
        fresh = cut(part, self.leaf)
        kept = self.counts()
        found = count([part[a:b] for a, b in zip(fresh, [*fresh[1:], len(part)], strict=True)], self.path)
        self.text = self.text[:low] + part + self.text[high:]
        places = last - first
        if len(fresh) > places:  # neighbours share a leaf, if it isn't too long then
            ends = [k * len(fresh) // places for k in range(places + 1)]
            joined = [fresh[a] for a in ends[:-1]]
            if max(b - a for a, b in zip(joined, [*joined[1:], len(part)], strict=True)) <= GROWN * self.leaf:
                fresh, found = joined, [sum(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        elif len(fresh) < places:  # empty leaves at the region's end
            found += [0] * (places - len(fresh))
            fresh += [len(part)] * (places - len(fresh))
        self.starts[first:last] = [low + a for a in fresh]
        if grown:
            self.starts[first + len(fresh) :] = [a + grown for a in self.starts[first + len(fresh) :]]
        if len(fresh) == places:
            width = len(self.tree) // 2
            at = np.arange(width + first, width + last)
            self.tree[at] = found
            while at[0] > 1:
                at = np.unique(at // 2)
                self.tree[at] = self.tree[2 * at] + self.tree[2 * at + 1]
        else:  # sums are built again from kept and new counts; no other text is encoded
            self.rebuilt += 1
            self._build([*kept[:first], *found, *kept[last:]])
        return len(part)


def build(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """documents -> STATE: the text, where its leaves begin, and the tree; one row for each row. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [Counter(t or "", path) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [c.text for c in made], "starts": [c.starts for c in made], "tree": [c.tree for c in made]})

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, STATE)


def apply_edits(state: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """STATE and an edits column -> STATE, n_before, n_tokens, n_chars, reencoded. Edits (begin, end, text; in characters of the text as
    the edits before left it) are applied in order; null edits or fields change nothing, null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, before, again = [], [], []
            for text, starts, tree, edits in zip(batch["text"], batch["starts"], batch["tree"], batch["edits"], strict=True):
                c = Counter(text or "", path, state=(starts.tolist(), tree))
                before.append(c.total)
                again.append(sum(c.edit(int(e["begin"]), int(e["end"]), e["text"] or "") for e in (edits if edits is not None else []) if e is not None and e["begin"] is not None and e["end"] is not None))
                made.append(c)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "text": [c.text for c in made], "starts": [c.starts for c in made], "tree": [c.tree for c in made],
                    "n_before": before, "n_tokens": [c.total for c in made], "n_chars": [len(c.text) for c in made], "reencoded": again,
                }
            )

    rows = state.select("doc_id", "text", "starts", "tree", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInPandas(run, f"{STATE}, n_before long, n_tokens long, n_chars long, reencoded long")


def revision(text: str = "text"):
    """The edits of the query: the middle word's neighbourhood gets a note, and the first line, if any follows, is dropped."""
    half = F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 2).cast("long")
    line = F.coalesce(F.instr(text, "\n"), F.lit(0)).cast("long")
    return F.array(
        F.struct(half.alias("begin"), (half + 7).alias("end"), F.lit(" [revised] ").alias("text")),
        F.struct(F.lit(0).cast("long").alias("begin"), F.when(line < half, line).otherwise(0).alias("end"), F.lit("").alias("text")),
    )


def count_revisions(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """documents -> (doc_id, n_before, n_tokens, n_chars, reencoded): counts of the whole texts, and of the texts after ``revision``."""
    state = build(docs, path).withColumn("edits", revision())
    return apply_edits(state, path).select("doc_id", "n_before", "n_tokens", "n_chars", "reencoded")
