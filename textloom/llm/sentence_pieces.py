"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units that no piece can cross (found from the piece table), and the distinct units of each block of
documents are encoded once: a unit's substrings of at most the longest piece's length are exploded and joined with the
piece table; the matches are the edges of the unit's lattice, grouped by unit and folded with a higher-order aggregate.

For a unigram model the fold is Viterbi: the best score for each end. A byte-pair model has no additive score, and
Viterbi over its ranks gives other tokens than the model's own; there the fold visits the edges by rank and then place
and takes each that spans exactly two present segments, which are the model's merges in their order. This is right
if every piece's parts rank before the piece, which is tested when the model is read. Units of more than 62
characters, whose boundaries fit no long, go the same way in Python.
"""

from __future__ import annotations

import functools
import operator
import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
LONGEST_UNIT = 62
#: Texts of a block, in characters: the distinct units of a block are looked up together.
BLOCK_CHARS = 24_000_000
_NO_MERGE = 2**31 - 1
#: Characters of a prefix, and buckets of their hashes, for the bound on the length of substrings.
PREFIX, _BUCKETS = 4, 1 << 16


@dataclass
class Pieces:
    """A model's normal pieces by string: (id, rank for a merge), and its byte pieces."""

    ids: dict[str, int]
    ranks: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    longest: int
    texts: list[bytes] = field(default_factory=list)
    #: Whether the parts of every piece rank before it.
    ordered: bool = True
    unit: str = ""
    #: Whether a unit holds the space only at its front, so that texts may be cut there first.
    spaced: bool = True


def _unit_pattern(pieces) -> str:
    """A pattern for units: spaces, then word characters or other characters. Word characters that some piece joins with others bind with both."""
    joins = {c for p in pieces for a, b in zip(p, p[1:], strict=False) if SPACE not in (a, b) and _wordy(a) != _wordy(b) for c in (a, b) if _wordy(c)}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return r"(?s).+"
    bind = "".join(re.escape(c) for c in sorted(joins))
    word = rf"[^\W_{bind}]"
    other = rf"(?:_|[^\w{SPACE}])"
    edge = rf"(?=[{SPACE}]|\Z)|(?<={word})(?={other})|(?<=[^\w{SPACE}])(?={word})|(?<=_)(?={word})"
    return rf"(?s){SPACE}*(?:{word}+(?={other}|{SPACE}|\Z)|{other}+(?={word}|{SPACE}|\Z)|[^{SPACE}]+?(?:{edge}))|{SPACE}+"


def _wordy(c: str) -> bool:
    return c != "_" and re.match(r"\w", c) is not None


@functools.cache
def load(path: str = MODEL) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names = {model.id_to_piece(i): i for i in normal}
    scores = {p: model.get_score(i) for p, i in names.items()}
    order = {p: k for k, p in enumerate(sorted((p for p in names if len(p) > 1), key=lambda p: (-scores[p], names[p])))}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    has_bytes = all(model.is_byte(i) for i in byte_ids)
    texts = [b""] * n
    for p, i in names.items():
        texts[i] = p.replace(SPACE, " ").encode()
    if has_bytes:
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
    texts[model.unk_id()] = " ⁇ ".encode()
    out = Pieces(names, order, scores, byte_ids if has_bytes else [], model.unk_id(), max(map(len, names), default=1), texts)
    out.unit = _unit_pattern(names)
    out.spaced = not any(SPACE in p.lstrip(SPACE) for p in names)
    out.ordered = all(_ordered(p, out) for p in order)
    return out


def _merge(unit: str, ranks: dict[str, int], longest: int) -> tuple[list[int], list[int]]:
    """Boundaries of the unit's segments, and the ranks merged; edges by rank and place, each applied where it spans two segments."""
    n = len(unit)
    edges = sorted((r, s, s + k) for s in range(n) for k in range(2, min(longest, n - s) + 1) if (r := ranks.get(unit[s : s + k])) is not None)
    after = list(range(1, n + 2))  # the next boundary; 0 where there is none
    alive, done = [True] * (n + 1), []
    for r, s, e in edges:
        if alive[s] and alive[e] and (m := after[s]) != e and after[m] == e:
            alive[m], after[s] = False, e
            done.append(r)
    return [k for k in range(n + 1) if alive[k]], done


def _merge_by_queue(unit: str, ranks: dict[str, int]) -> list[int]:
    """The model's own rule, however the ranks lie: always the first of the best pairs."""
    cuts = list(range(len(unit) + 1))
    while len(cuts) > 2:
        best = min((r, i) for i in range(len(cuts) - 2) if (r := ranks.get(unit[cuts[i] : cuts[i + 2]], _NO_MERGE)) is not None)
        if best[0] == _NO_MERGE:
            break
        del cuts[best[1] + 1]
    return cuts


def _ordered(piece: str, pieces: Pieces) -> bool:
    """Whether the piece comes out of its own characters with ranks that only rise."""
    cuts, last = list(range(len(piece) + 1)), -1
    while len(cuts) > 2:
        rank, i = min((pieces.ranks.get(piece[cuts[i] : cuts[i + 2]], _NO_MERGE), i) for i in range(len(cuts) - 2))
        if rank == _NO_MERGE or rank < last:
            return False
        last = rank
        del cuts[i + 1]
    return True


def encode_unit(unit: str, pieces: Pieces) -> list[int]:
    """Token ids of one unit, in Python."""
    cuts = _merge(unit, pieces.ranks, pieces.longest)[0] if pieces.ordered else _merge_by_queue(unit, pieces.ranks)
    return expand([pieces.ids.get(x, -1 - ord(x[0])) for x in (unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False))], pieces)


def expand(ids: list[int], pieces: Pieces) -> list[int]:
    """Replaces -1 - code point, which stands for a character that is no piece, by byte pieces or the unknown piece."""
    if not ids or min(ids) >= 0:
        return ids
    out: list[int] = []
    for i in ids:
        if i >= 0:
            out.append(i)
        else:
            out += [pieces.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] if pieces.byte_ids else [pieces.unknown]
    return out


def decode_ids(ids, pieces: Pieces) -> str:
    """The text of token ids: the space that encoding put first is taken off. An id that is null or outside the model is an IndexError."""
    if any(i is None or i < 0 for i in ids):
        raise IndexError("token ids are numbers from 0")
    return decode_bytes(ids, pieces).decode("utf-8", "replace")


def decode_bytes(ids, pieces: Pieces) -> bytes:
    joined = b"".join(map(pieces.texts.__getitem__, ids))
    return joined[1:] if joined[:1] == b" " else joined


def _marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


_find_words = re.compile(f"{SPACE}+[^{SPACE}]*").findall


def _words(text: str | None, spaced: bool) -> list[str]:
    """The text cut before each run of spaces, every word without the first of its spaces: the units of SPACE + word, word by word, are the text's."""
    if not text:
        return []
    if not spaced:
        return [_marked(text)[1:]]
    if text[0] == " " or "  " in text or SPACE in text:
        return [w[1:] for w in _find_words(_marked(text))]
    return text.split(" ")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Numbers the blocks of a partition; the same rows in the same order get the same numbers."""
    part, k, size = TaskContext.get().partitionId(), 0, 0
    for whole in batches:
        for at in range(0, len(whole), 1024):
            batch = whole.slice(at, 1024)
            texts = batch.column("text").to_pylist()
            if size > BLOCK_CHARS:
                k, size = k + 1, 0
            size += sum(len(t) for t in texts if t)
            yield (part << 24) + k, batch.column("doc_id").to_pylist(), texts


def _units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(block, unit): the distinct units of each block, from its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, now, words = re.compile(pieces.unit).findall, 0, set()

        def out() -> pa.RecordBatch:
            units: set[str] = set()
            while words:
                units.update(find(SPACE + words.pop()))
            if pieces.ordered:  # a unit that is a piece comes out whole: the commonest units of all blocks need no lattice
                units.difference_update(pieces.ids)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(units), pa.int64()), pa.array(list(units), pa.string())], ["block", "unit"])

        for block, _, texts in _blocks(batches):
            if block != now and words:
                yield out()
            now = block
            for text in texts:
                words.update(_words(text, pieces.spaced))
        if words:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, unit string")


def _packed(docs: DataFrame) -> DataFrame:
    """(block, blob): the documents of a block, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6)
        for block, doc_ids, texts in _blocks(batches):
            blob = packer.compress(pickle.dumps((doc_ids, texts), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, blob binary")


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit) distinct, of 2 to LONGEST_UNIT characters -> (unit, edges): the pieces of at least two characters inside it, as struct (rank, s, n, id, score), by rank and place."""
    return _edges(units, pieces, "named_struct('rank', rank, 's', s, 'n', n, 'id', id, 'score', score)", 1)


def packed_lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The same with each edge as one long: rank, place (six bits) and length (five bits)."""
    if pieces.longest > 31:
        raise ValueError("pieces of more than 31 characters")
    return _edges(units, pieces, "shiftleft(cast(rank as bigint), 11) + s * 32 + n", 2)


def _bounds(pieces: list[str]) -> list[int]:
    """For each hash bucket of a prefix, the most characters of a piece that begins with it; at least those of a piece too short to have one."""
    out = [min(PREFIX - 1, max(map(len, pieces), default=1))] * _BUCKETS
    for p in pieces:
        if len(p) >= PREFIX:
            k = xxhash.xxh64_intdigest(p[:PREFIX].encode(), 42) % _BUCKETS
            out[k] = max(out[k], len(p))
    return out


def _edges(units: DataFrame, pieces: Pieces, edge: str, least: int) -> DataFrame:
    rows = [(p, i, pieces.ranks.get(p, _NO_MERGE), float(pieces.scores[p])) for p, i in pieces.ids.items() if len(p) >= least]
    # As many rows as the model has pieces, whatever the documents.
    table = F.broadcast(units.sparkSession.createDataFrame(rows, "piece string, id int, rank int, score double"))
    # No piece that begins with a place's first characters is longer than the table of bounds says for their hash.
    bounds = ",".join(map(str, _bounds(list(pieces.ids))))
    reach = f"cast(split('{bounds}', ',') as array<int>)[cast(xxhash64(substring(unit, s, {PREFIX})) & {_BUCKETS - 1} as int)]"
    spans = F.expr(
        f"""flatten(transform(sequence(1, char_length(unit) - {least - 1}), s -> transform(sequence({least}, greatest({least}, least({reach}, char_length(unit) - s + 1))),
        n -> named_struct('s', s - 1, 'n', n, 'piece', substring(unit, s, n)))))"""
    )
    matched = units.filter(F.char_length("unit") >= least).select("unit", F.inline(spans)).join(table, "piece")
    return matched.select("unit", F.expr(edge).alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def merge_fold(unit: str = "unit", edges: str = "edges") -> Column:
    """Boundaries of a byte-pair model's segments as bits of a long. The fold takes each edge (packed) whose ends are boundaries with exactly one between."""
    s, e = "(cast(shiftright(x, 5) as int) & 63)", "((cast(shiftright(x, 5) as int) & 63) + (cast(x as int) & 31))"
    inner = f"(shiftleft(1L, {e}) - shiftleft(2L, {s}))"
    return F.expr(
        f"""aggregate({edges}, shiftleft(2L, char_length({unit})) - 1L, (have, x) ->
        if(bit_count(have & {inner}) = 1 and (shiftright(have, {s}) & shiftright(have, {e}) & 1L) = 1L, have & ~{inner}, have))"""
    )


def viterbi_fold(unit: str = "unit", edges: str = "edges") -> Column:
    """Ids of a unigram model: for each end the best sum of scores and its ids; ties go to the longer last piece. Every character must be a piece."""
    best = "array_max(transform(filter({edges}, x -> x.s + x.n = e), x -> named_struct('score', best[x.s].score + x.score, 'n', x.n, 'ids', concat(best[x.s].ids, array(x.id)))))"
    return F.expr(
        f"""aggregate(sequence(1, char_length({unit})), array(named_struct('score', 0D, 'n', 0, 'ids', cast(array() as array<int>))),
        (best, e) -> concat(best, array({best.format(edges=edges)})), best -> best[char_length({unit})].ids)"""
    )


class _Tokens(dict):
    """Token ids of words, as bytes of 32-bit numbers, from the folded boundaries of their units."""

    def __init__(self, hashes: list[int], cuts: list[int], pieces: Pieces) -> None:
        super().__init__()
        self.cuts, self.pieces = dict(zip(hashes, cuts, strict=True)), pieces
        self.find, self.units, self.slices = re.compile(pieces.unit).findall, {}, {}
        self.packed = {p: array("i", [i]).tobytes() for p, i in pieces.ids.items()}

    def __missing__(self, word: str) -> bytes:
        units, known = self.find(SPACE + word), self.units
        if len(units) == 1:
            out = known.get(units[0]) or self._encoded(units[0])
        else:
            out = b"".join([known.get(u) or known.setdefault(u, self._encoded(u)) for u in units])
        self[word] = out
        return out

    def _encoded(self, unit: str) -> bytes:
        """The unit's ids. Pieces that are the unit's own slices decode to it; all others are decoded to see whether they do."""
        p, n = self.pieces, len(unit)
        if p.ordered and unit in self.packed:
            return self.packed[unit]
        raw = unit.encode("utf-8", "surrogatepass")
        h = xxhash.xxh64_intdigest(raw, 42)
        have = self.cuts.get(h - (1 << 64) if h >> 63 else h)
        if have is None and not any(unit[k : k + 2] in p.ranks for k in range(n - 1)):
            have = (2 << n) - 1  # no two characters merge: such a unit isn't folded, all its boundaries stay
        ids = None
        if n <= LONGEST_UNIT and have is not None and have & 1 and have.bit_length() == n + 1:
            take = self.slices.get(have) or self._slices(have)
            try:
                return b"".join(map(self.packed.__getitem__, take(unit)))
            except KeyError:  # a character that is no piece
                at = [k for k in range(n + 1) if have >> k & 1]
                ids = expand([p.ids.get(x, -1 - ord(x[0])) for x in (unit[a:b] for a, b in zip(at, at[1:], strict=False))], p)
        wanted = raw.replace(_SPACE_BYTES, b" ")
        if ids is None or b"".join([p.texts[i] for i in ids]) != wanted:
            # A long unit, one that another partitioning of the rows put into another block, or equal hashes of two units.
            ids = encode_unit(unit, p)
        return array("i", ids).tobytes()

    def _slices(self, have: int):
        at = [k for k in range(have.bit_length()) if have >> k & 1]
        parts = [slice(a, b) for a, b in zip(at, at[1:], strict=False)]
        self.slices[have] = take = operator.itemgetter(*parts) if len(parts) > 1 else lambda unit: (unit,)
        return take


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """documents -> (doc_id, ids array<int>, n_tokens, round_trip), one row for each row.

    round_trip: decoding the document's ids gives its text again, where the escape character U+2581 counts as the space that it stands for.
    Null and empty texts have no ids. doc_id may be null or repeat. Texts of any length are encoded whole.
    """
    pieces = load(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pairs = _units(rows, pieces).repartition("unit")
    short = pairs.filter(F.char_length("unit").between(2, LONGEST_UNIT) & F.lit(pieces.ordered))
    # The least block only keeps both columns in the shuffle, so that one shuffle serves this and the join.
    units = short.groupBy("unit").agg(F.min("block").alias("block")).filter("block is not null")
    folded = packed_lattice(units, pieces).select("unit", merge_fold().alias("cuts"))
    known = short.join(folded, "unit").select("block", F.xxhash64("unit").alias("hash"), "cuts")

    def run(blobs: pa.Table, found: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        tokens = _Tokens(found.column("hash").to_numpy().tolist(), found.column("cuts").to_numpy().tolist(), pieces)
        doc_ids, values, sizes, same = [], [], [], []
        for blob in blobs.column("blob"):
            for doc_id, text in zip(*pickle.loads(opener.decompress(blob.as_py())), strict=True):
                words = _words(text, pieces.spaced)
                out = b"".join(map(tokens.__getitem__, words))
                doc_ids.append(doc_id)
                values.append(out)
                sizes.append(len(out) // 4)
                same.append(decode_bytes(np.frombuffer(out, np.int32).tolist(), pieces) == (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass"))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32)))
        return pa.Table.from_arrays([pa.array(doc_ids, pa.int64()), ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return _packed(rows).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null ids give a null text, none an empty one; an id that is null or outside the model raises IndexError."""
    pieces = load(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if x is None else decode_ids(x, pieces) for x in batch["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
