"""SimHash near-duplicate detection with a pigeonring candidate filter.

A 64-bit fingerprint is cut into five consecutive segments on a ring. If two fingerprints differ in at
most four bits, then from some segment on every chain of k consecutive segments differs in at most
``floor(4 k / 5)`` bits: none in the first, one in the first two, two in three, three in four. The first two
budgets make an equi-join key (the first segment, and the second with at most one bit changed); the
longer chains prune what the join finds, before the full Hamming distance is tested.

Four bits are far fewer than differ at a similarity of 0.8, and no radius that reaches it leaves segments wide enough for a
join. ``keep_one`` therefore takes the links of the fingerprints as its first candidates, adds every pair that prefixes of their
shingles in one order must share at that similarity, prunes these by pigeonring chains of a radius that lies over five deviations
from the distance expected at 0.8, and confirms what is left by the exact weighted shingle similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, text_bytes, without, written
from .components import connected_components

RADIUS = 4
#: Least similarity of near copies for ``keep_one``, in tenths: the sum of the smaller over that of the larger shingle counts.
TENTHS = 8
#: One in SAMPLE texts shows which shingles are common (RARE of them or more hold it); at most MAX_COMMON are sent to the executors.
#: They only set the order of shingles. Any order gives the same result, and one with common shingles last fewer candidates.
SAMPLE, RARE, MAX_COMMON = 16, 3, 500_000
#: Bits that may differ between candidates of ``similar``; ten do at a similarity of 0.8, 32 between unlike texts.
WIDE = 26
#: Prefix shingles that several texts have, and documents to confirm, are sent to the executors up to so many numbers, else joined.
MAX_SENT = 8_000_000
#: Pairs that a worker confirms at once.
PAIR_ROWS = 128
#: Low bit and width of the five segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A key held by more fingerprints than this is worked in blocks of BLOCK that return only a spanning forest.
HOT_KEY, BLOCK = 32, 256
#: A key held by more than this is split by the third segment first.
SPLIT = 20_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_CHUNK = 1 << 16


def _hashes(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of all word shingles in order, repeats included; of the whole text where it has no more words than one."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Majority of the XXH64 (seed 42) bits of all word shingles, repeats included; no words: 0."""
    return _majority(_hashes(text, shingle))


def _majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        octets = np.array(hashes[k : k + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """documents -> (doc_id, fp long). Null and empty texts have fingerprint 0; other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.astype(np.int64)})

    return in_small_batches(docs).select("doc_id", text_bytes().alias("text")).mapInPandas(run, "doc_id long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp, probe). A fingerprint owns five keys; as a probe it also visits those whose second segment has one more bit set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = batch["fp"].to_numpy(np.int64)
            fp = signed.astype(np.uint64)
            seg = [((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            keys, owners, probes = [], [], []
            for i in range(5):
                j = (i + 1) % 5
                base = (i << 26) | (seg[i] << 13)
                keys.append(base | seg[j]), owners.append(signed), probes.append(np.zeros(len(fp), bool))
                for bit in range(SEGMENTS[j][1]):
                    free = (seg[j] >> bit) & 1 == 0
                    keys.append((base | seg[j] | (1 << bit))[free]), owners.append(signed[free]), probes.append(np.ones(free.sum(), bool))
            yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.concatenate(owners), "probe": np.concatenate(probes)})

    return fps.mapInPandas(run, "key long, fp long, probe boolean")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain_masks(length: int) -> list[int]:
    """For each start, the bits of a chain of that many segments."""
    return [_signed(sum(((1 << SEGMENTS[(i + k) % 5][1]) - 1) << SEGMENTS[(i + k) % 5][0] for k in range(length))) for i in range(5)]


def _ring(a, b, radius: int):
    """Whether from some segment on every chain of k segments differs in at most ``radius * k // 5`` bits, and the whole in ``radius``."""
    diff = a.bitwiseXOR(b)
    start = F.lit(False)
    for i in range(5):
        chain = F.lit(True)
        for length in (1, 2, 3, 4):
            chain &= F.bit_count(diff.bitwiseAND(F.lit(_chain_masks(length)[i]).cast("long"))) <= radius * length // 5
        start |= chain
    return (F.bit_count(diff) <= radius) & start


def _deeper(rows: DataFrame) -> DataFrame:
    """(key, fp, probe) of keys held by very many -> the same with the third segment in the key.

    The chain of three may differ in two bits: a fingerprint that owns the key visits the third segments within two bits of its own, one that
    visits the key with a bit changed those within one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, signed, probe = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64), batch["probe"].to_numpy(bool)
            third = (key >> 26) + 2
            low = np.array([s for s, _ in SEGMENTS])[third % 5]
            width = np.array([w for _, w in SEGMENTS])[third % 5]
            seg = (signed.view(np.uint64) >> low.astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)
            flips = [0, *(1 << a for a in range(13)), *(1 << a | 1 << b for a in range(13) for b in range(a))]
            for flip in flips:
                ok = (flip < (1 << width)) & (~probe | (flip.bit_count() < 2))
                if ok.any():
                    yield pd.DataFrame({"key": (key[ok] << 13) | (seg[ok] ^ flip), "fp": signed[ok], "probe": probe[ok] | (flip > 0)})

    return rows.mapInPandas(run, "key long, fp long, probe boolean")


def _within_budget(key, a, b):
    """The chains of three and four segments, then the whole distance. ``key`` begins with the number of the chain's first segment."""
    diff = a.bitwiseXOR(b)
    start = key.cast("int") + 1
    test = F.lit(True)
    for length in (3, 4):
        masks = F.array(*[F.lit(m).cast("long") for m in _chain_masks(length)])
        test &= F.bit_count(diff.bitwiseAND(F.element_at(masks, start))) <= RADIUS * length // 5
    return test & (F.bit_count(diff) <= RADIUS)


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between (or, for one block, within) the blocks of a hot key."""
    empty = pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    left, right = rows[rows["blk"] == a], rows[rows["blk"] == b]
    if left.empty or right.empty:
        return empty
    x, y = left["fp"].to_numpy(np.int64), right["fp"].to_numpy(np.int64)
    near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= RADIUS
    near &= ~(left["probe"].to_numpy(bool)[:, None] & right["probe"].to_numpy(bool)[None, :])
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    out = []
    for i, j in np.argwhere(near):
        u, v = int(x[i]), int(y[j])
        if (p := find(u)) != (q := find(v)):
            parent[max(p, q)] = min(p, q)
            out.append((u, v))
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["u", "v"]) if out else empty


def links(fps: DataFrame) -> DataFrame:
    """(fp), distinct -> (u, v): links of at most RADIUS bits that join the same fingerprints as all links do.

    Fingerprints that share a key with few others give every link; those of a hot key, split into pairs
    of blocks, give a spanning forest for each pair, so neither one task nor the output grows with the square of a group. The keys of
    very many are split by the third segment of the chain first, so that the number of such pairs doesn't either.
    """
    return _paired(written(_keys(fps), "keys"), 26)


def _paired(rows: DataFrame, shift: int) -> DataFrame:
    """(key, fp, probe) -> (u, v); the number of a key's first segment stands ``shift`` bits up."""
    own = rows.filter("not probe").select("key", "fp")
    # Bits of a probe beyond the block size spread over the blocks of the owners.
    counts = rows.groupBy("key").agg(F.count(F.when(~F.col("probe"), 1)).alias("n_own"), F.count("*").alias("n"))
    hot = written(counts.filter(f"n_own > {HOT_KEY} or (n_own > 0 and n > {8 * HOT_KEY})").select("key", "n"), "hot")
    left = own.join(hot.select("key"), "key", "left_anti").select("key", F.col("fp").alias("u"))
    right = rows.select("key", F.col("fp").alias("v"), "probe")
    cold = left.join(right, "key").filter((F.col("probe") | (F.col("u") < F.col("v"))) & _within_budget(F.shiftright("key", shift), F.col("u"), F.col("v"))).select("u", "v")
    deep = hot.filter(F.col("n") > SPLIT).select("key") if shift == 26 else None
    if deep is not None and not deep.isEmpty():
        cold = cold.unionByName(_paired(written(_deeper(rows.join(deep, "key", "left_semi")), "keys"), 39))
        hot = hot.filter(F.col("n") <= SPLIT)
    blocked = rows.join(hot, "key").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    paired = (
        blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", "fp", "probe", "blk", F.least("blk", "o").alias("a"), F.greatest("blk", "o").alias("b"))
    )
    return cold.unionByName(paired.groupBy("key", "a", "b").applyInPandas(_forest, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id): documents of one component can be reached from one
    another over links of at most four differing bits; component_id is its least doc_id.

    Equal fingerprints are folded before any pair is looked for. Texts without words have fingerprint zero,
    and are linked like others. Rows without doc_id keep a fingerprint and get no component. Repeated
    doc_ids are repeated in the result. An empty table gives an empty table.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = connected_components(links(classes.select("fp")))
    labelled = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _elements(hashes: list[int]) -> np.ndarray:
    """Shingles as a sorted set of signed longs, in which the k-th repeat of a shingle is an element of its own."""
    x = np.sort(np.array(hashes, np.uint64))
    first = np.r_[True, x[1:] != x[:-1]][: len(x)]
    place = np.arange(len(x))
    repeat = place - np.maximum.accumulate(np.where(first, place, 0))
    with np.errstate(over="ignore"):
        return np.sort((x + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))


def _digest(elements: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(elements.tobytes(), 42))


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Elements that RARE or more of the sampled texts hold, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"el": _elements(_hashes(text, shingle))})

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(text_bytes().alias("text")).distinct()
    counts = sample.mapInPandas(run, "el long").groupBy("el").agg(F.count("*").alias("n")).filter(F.col("n") >= RARE)
    top = counts.orderBy(F.desc("n"), "el").limit(MAX_COMMON).select("el").toArrow()
    return np.sort(top.column(0).to_numpy())


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """documents -> (doc_id, id, fp, n): id stands for the shingle counts, n is their sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(text: bytes | None) -> tuple[int, int, int]:
            hashes = _hashes(text, shingle)
            return _digest(_elements(hashes)), _signed(_majority(hashes)), len(hashes)

        for batch in batches:
            ids, fps, sizes = np.array([of(text) for text in batch["text"]], np.int64).reshape(-1, 3).T
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": ids, "fp": fps, "n": sizes})

    return _read(docs).mapInPandas(run, "doc_id long, id long, fp long, n long")


def _read(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_bytes().alias("text"))


def _prefixes(docs: DataFrame, common: np.ndarray, shingle: int, wanted=None) -> DataFrame:
    """documents -> (key, id): the first ``n - ceil(0.8 n) + 1`` elements of each text, rare ones first; with ``wanted``, a broadcast array, only these keys.

    Two texts of similarity 0.8 share such an element. Texts that a task has met before aren't repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = None if wanted is None else wanted.value
        met: set[int] = set()
        for whole in batches:
            for at in range(0, len(whole), 256):
                keys, ids = [], []
                for text in whole["text"].iloc[at : at + 256]:
                    x = _elements(_hashes(text, shingle))
                    if (k := _digest(x)) in met:
                        continue
                    if len(met) > 100_000:
                        met.clear()
                    met.add(k)
                    if len(common):
                        x = x[np.argsort(_among(x, common), kind="stable")]
                    x = x[: len(x) + (-TENTHS * len(x)) // 10 + 1]
                    if keep is not None:
                        x = x[_among(x, keep)]
                    keys.append(x), ids.append(np.full(len(x), k, np.int64))
                if keys:
                    yield pd.DataFrame({"key": np.concatenate(keys), "id": np.concatenate(ids)})

    return _read(docs).select("text").mapInPandas(run, "key long, id long")


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _sent(rows: DataFrame, column: str):
    """The column as a sorted array for all executors, or None where it is too long for that."""
    if rows.count() > MAX_SENT:
        return None
    return rows.sparkSession.sparkContext.broadcast(np.sort(rows.select(column).toArrow().column(0).to_numpy()))


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The (u, v) pairs of ids whose texts have a similarity of at least 0.8."""
    pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    asked = written(classes.join(asked, "id", "left_semi").select("id", F.col("least").alias("doc_id")), "asked")
    sent = _sent(asked, "doc_id")
    rows = _read(docs)
    if sent is None:
        rows = rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if sent is not None:
                batch = batch[_among(batch["doc_id"].to_numpy(np.int64), sent.value)]
            for at in range(0, len(batch), 256):
                found = [_elements(_hashes(t, shingle)) for t in batch["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"id": np.array([_digest(x) for x in found], np.int64), "els": [x.tobytes() for x in found]})

    # Of rows with an asked doc_id those with another text bring an id that no pair has, or one whose elements are the same.
    sets = written(rows.mapInPandas(run, "id long, els binary").groupBy("id").agg(F.first("els").alias("els")), "sets")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(10 * both >= TENTHS * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, bool), ["u", "v"]]

    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("els").alias("a")), "u")
    tested = left.join(sets.select(F.col("id").alias("v"), F.col("els").alias("b")), "v").select("u", "v", "a", "b").mapInPandas(test, "u long, v long")
    # Two whole texts' elements a row: few rows at once, so that pairs of very long texts fit a worker's memory.
    conf, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    conf.set(size, str(PAIR_ROWS))
    try:
        return written(tested, "links")
    finally:
        conf.set(size, before)


def _shared_keys(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(key, id, n, fp): prefix elements that several classes have. All elements are shuffled once, with partial aggregation; only the shared ones go on."""
    common = _common(docs, shingle)
    every = _prefixes(docs, common, shingle)
    shared = written(every.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key"), "shared")
    sent = _sent(shared, "key")
    rows = every.join(shared, "key", "left_semi") if sent is None else _prefixes(docs, common, shingle, sent)
    rows = rows.select("key", "id").distinct()
    return written(rows.join(classes.select("id", "n", "fp"), "id"), "keys")


def _hubs(keyed: DataFrame) -> DataFrame:
    """(u, v): each text and one hub. The hub of a key is its text that, for its length, shares most keys with others; that of a text is the hub of most of its keys."""
    held = keyed.groupBy("key").agg((F.count("*") - 1).alias("others"))
    weight = keyed.join(held, "key").groupBy("id").agg((F.sum("others") / F.max("n")).alias("weight"))
    weighed = keyed.join(weight, "id")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "id", "n", "fp")).alias("hub"))
    ratio = (10 * F.least(F.col("n"), F.col("hub.n")) >= TENTHS * F.greatest(F.col("n"), F.col("hub.n"))) & (F.col("id") != F.col("hub.id"))
    led = weighed.join(hubs, "key").filter(ratio & _ring(F.col("fp"), F.col("hub.fp"), WIDE)).groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("keys"))
    return led.groupBy("id").agg(F.max(F.struct("keys", "hub")).alias("best")).select(F.col("id").alias("u"), F.col("best.hub").alias("v"))


def similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """documents -> (doc_id, component_id): documents of one component can be reached from one another over pairs of similarity 0.8.

    Candidates, each confirmed: every text with the least fingerprint that it is linked to, and with one hub, the text that shares most of the
    prefix shingles of the keys they have in common; no more than two pairs a text. Then all pairs that aren't of one component by now and share
    as many prefix shingles as the similarity needs. The last misses nothing that the chains of WIDE bits let pass, the first two keep it small.
    Texts without words are alike.
    """
    marked = written(_signatures(docs, shingle), "signatures")
    classes = written(marked.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n")), "classes")
    prints = classes.groupBy("fp").agg(F.min("id").alias("head"))
    linked = connected_components(links(prints.select("fp")))
    leads = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    near = leads.join(prints.withColumnRenamed("fp", "component"), "component").select(F.col("id").alias("u"), F.col("head").alias("v"))
    keyed = _shared_keys(docs, classes, shingle)
    found = _confirmed(docs, classes, near.unionByName(_hubs(keyed)), shingle)
    groups = connected_components(found).withColumnRenamed("node", "id")
    rows = keyed.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A key whose texts are all of one component has no pair left.
    open_keys = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    rows = written(rows.join(open_keys, "key", "left_semi"), "open")
    x, y = (rows.select("key", *[F.col(c).alias(side + c) for c in ("id", "n", "component", "fp")]) for side in "xy")
    size = ((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xid") < F.col("yid")))) & (10 * F.col("xn") >= TENTHS * F.col("yn"))
    shared = x.join(y, "key").filter((F.col("xcomponent") != F.col("ycomponent")) & size & _ring(F.col("xfp"), F.col("yfp"), WIDE))
    counts = shared.groupBy("xid", "yid").agg(F.count("*").alias("shared"), F.min("xn").alias("xn"), F.min("yn").alias("yn"))
    # What two texts have in common and not in both prefixes lies beyond the prefix of the one whose prefix ends first, so the prefixes share the rest.
    beyond = F.greatest(*[F.ceil(F.col(n) * TENTHS / 10) - 1 for n in ("xn", "yn")])
    pairs = counts.filter((TENTHS + 10) * (F.col("shared") + beyond) >= TENTHS * (F.col("xn") + F.col("yn")))
    found = found.unionByName(_confirmed(docs, classes, pairs.select(F.col("xid").alias("u"), F.col("yid").alias("v")), shingle))
    labelled = classes.select("id", "least").join(connected_components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "id").join(labelled.join(least, "component").select("id", "component_id"), "id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Keeps the document with the least doc_id of each component of similar texts, with all columns; rows without doc_id stay."""
    return without(docs, similar(docs, shingle).filter("doc_id <> component_id").select("doc_id").distinct())
