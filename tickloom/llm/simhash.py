"""SimHash near-duplicates: fingerprints of shingles, linked through BK-trees over key shards."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    IS_SPACE, LOWER, Rolling, components, discard, local_components, mix, release, saved, slices, span_hashes, spans, with_arrow_columns, with_row_key,
)

#: Fingerprints of one shard that a tree holds; larger shards are cut by further bits.
SHARD = 512
SEED = 42
#: Sets of a key that one tree takes; sets with a hash from which on it comes last;
#: sets of a larger group that one task compares with as many others.
FEW, COMMON, TILE = 32, 32, 1024
#: Hashes that are told to come last, which is a matter of order only; rounds of looking for them.
LATE, ROUNDS = 1_000_000, 6
#: Comparisons for each set up to which new common hashes are few.
PER_SET = 1000
#: Hashes that a task counts at a time.
COUNTED = 1_000_000
#: Bits of a set's SimHash, and the chance of a similar pair to lie beyond the radius of the search.
PRINT_BITS, MISS = 128, 1e-10
#: Bytes of texts whose sets are made at once.
SET_BYTES = 500_000
_set_words, _set_shingles = Rolling(31), Rolling(32)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows of text bytes, and where each row's begin in them."""
    low = LOWER[data]
    inside = ~IS_SPACE[low]
    starts, ends = spans(inside, offsets)
    # words joined by one space: each word's bytes and a space after it
    row_of = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(row_of, minlength=len(offsets) - 1)
    lengths = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=places[1:])
    joined = np.full(int(places[-1]), 32, np.uint8)
    shift = np.repeat(places[:-1] - starts, lengths)
    at = np.flatnonzero(inside)
    joined[at + shift] = low[at]
    raw = joined.tobytes()
    first_word = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(n_words, out=first_word[1:])
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(n_shingles, out=first[1:])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    word = np.arange(total) - np.repeat(first[:-1] - first_word[:-1], n_shingles)
    last = np.minimum(word + shingle, np.repeat(first_word[1:], n_shingles))
    begin, end = places[word].tolist(), (places[last] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, total), first


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = SEED) -> np.ndarray:
    """A 64-bit fingerprint for each row of text bytes."""
    return majority(*shingle_hashes(data, offsets, shingle, seed))


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row of hashes the bits that are set in over half of them; none for a row without any."""
    n_shingles = np.diff(first)
    full = np.flatnonzero(n_shingles)
    out = np.zeros(len(n_shingles), np.uint64)
    if not len(full):
        return out
    ones = np.empty((len(full), 64), np.int32)
    for byte in range(8):  # bits of one byte at a time: an eighth of the memory
        bits = np.unpackbits((hashes >> np.uint64(8 * byte)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    most = 2 * ones > n_shingles[full][:, None]
    out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs and the SimHash of each whole text as a signed long.

    A-Z are lower-cased; words are runs of all but white space; every run of ``shingle`` words,
    repeats included (fewer words: all of them), is hashed by XXH64, and a bit is set if it is
    set in over half the hashes. Null, empty or blank text: fingerprint 0.
    """

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(fingerprints(data, offsets, shingle).view(np.int64))]

    return with_arrow_columns(docs, f"`{name}` long", compute, text)


class BKTree:
    """Children hang on edges labelled with their Hamming distance to the parent."""

    def __init__(self, values: Iterable[int] = ()) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        i, at = len(self.values), 0
        self.values.append(value)
        self.edges.append({})
        while at != i:
            at = self.edges[at].setdefault((self.values[at] ^ value).bit_count(), i)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of values at most radius away; only edges that can lead to one are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            edges = self.edges[at]
            if len(edges) <= 2 * radius + 1:
                todo += [to for label, to in edges.items() if d - radius <= label <= d + radius]
            else:
                todo += [edges[label] for label in range(d - radius, d + radius + 1) if label in edges]


def near_pairs(values: Iterable[int], radius: int) -> tuple[list[int], list[int]]:
    """Indexes, the smaller ones first, of each pair of values at most radius apart, from a tree that each joins after its search."""
    tree = BKTree()
    u: list[int] = []
    v: list[int] = []
    for i, value in enumerate(values):
        near = list(tree.within(value, radius))
        u += near
        v += [i] * len(near)
        tree.add(value)
    return u, v


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values the index of one that stands for all it is linked with here."""
    u, v = near_pairs(values.view(np.uint64).tolist(), radius)
    return local_components(len(values), np.array(u, np.int64), np.array(v, np.int64))


def _masks(path: list[list[int]], depth: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits left, bits fixed) of each table: every level cuts what is left into radius + 1 blocks."""
    out = []
    for left in path:
        cuts = [left[i :: radius + 1] for i in range(radius + 1)]
        out += [([b for b in left if b not in set(c)], c) for c in cuts]
    return out


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = 3, shard: int = SHARD, levels: int = 4) -> DataFrame:
    """(u, v): links of distinct fingerprints (column ``fp``) that connect just those connected by
    pairs at most radius bits apart.

    Two such fingerprints agree on one of radius + 1 blocks of bits. So every block makes a table,
    and equal blocks a shard, whose tree finds its pairs; a shard gives one link a member, not
    every pair. Shards over ``shard`` members are cut again by blocks of the bits they don't share
    (two members at most radius apart also agree on one of those), up to ``levels`` times; members
    of the shards then left differ in 20 of the 64 bits at most, and each has one tree.
    """
    tables = [(list(range(64)), [])]
    todo, out = prints.select("fp", F.lit(0).alias("t")), None
    for level in range(levels):
        cut = [_masks([left], 1, radius) for left, _ in tables]
        n = radius + 1
        fixed = [[*tables[i // n][1], *cut[i // n][i % n][1]] for i in range(len(tables) * n)]
        left = [cut[i // n][i % n][0] for i in range(len(tables) * n)]
        masks = F.array(*[F.lit(_signed(m)).cast("long") for m in fixed])
        shards = todo.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
            "fp", (F.col("t") * n + F.col("b")).alias("t")
        ).withColumn("key", F.col("fp").bitwiseAND(F.get(masks, F.col("t")))).select("t", "key", "fp")
        last = level == levels - 1
        found = saved(_search(shards, radius, None if last else shard))
        own = found.where("t < 0").select("u", "v")
        out = own if out is None else out.union(own)
        todo = found.where("t >= 0").select(F.col("u").alias("fp"), "t")
        if last or todo.isEmpty():
            return out
        tables = list(zip(left, fixed, strict=True))
    return out


def _search(shards: DataFrame, radius: int, most: int | None) -> DataFrame:
    """(t, u, v): links of the shards, with t -1, and in u the members of those of over ``most``, with their table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def rows(t: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(u), pa.array(v)], names=["t", "u", "v"])

        def found() -> pa.RecordBatch:
            values = np.concatenate(held)
            to = linked(values, radius)
            keep = to != np.arange(len(values))
            return rows(-1, values[keep], values[to[keep]])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(t)], strict=True):
                if (t[a], k[a]) != key:
                    if size > 1 and held:
                        yield found()
                    key, held, size = (t[a], k[a]), [], 0
                held.append(fp[a:b])
                size += b - a
                if most and size > most:  # what is held, and all that follows, goes on to be cut
                    for part in held:
                        yield rows(t[a], part, part)
                    held = []
        if size > 1 and held:
            yield found()

    return shards.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(run, "t int, u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD,
) -> DataFrame:
    """docs with fingerprint (signed long) and component_id.

    Documents link where their fingerprints differ in at most radius bits; component_id is the
    smallest doc_id reachable by links, itself included. Equal fingerprints are one node, whatever
    their number, so a large group of copies adds one row to the search.

    Null and blank texts share fingerprint 0 and link like any others. A null doc_id is never the
    smallest unless all are. Repeated rows stay; an empty table gives an empty result; other
    columns are kept, but fingerprint and component_id replace columns of these names.
    """
    return grouped(with_fingerprint(docs, shingle, text), radius, doc_id, shard)


def grouped(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """docs, which have fingerprint, and component_id, as near_duplicates gives it."""
    docs = docs.drop("component_id")
    node, = with_row_key(docs, "node")
    prints = saved(docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(doc_id).alias("least")))
    found = components(links(prints, radius, shard))
    classes = prints.join(found, prints.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "c").select(F.col("fp").alias(node), "component_id")
    return docs.join(named, F.col("fingerprint") == F.col(node)).drop(node)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row's shingles, and where each row's begin in them. Words and
    shingles are those of with_fingerprint, but hashed all at once from the words' hashes."""
    low = LOWER[data]
    starts, ends = spans(~IS_SPACE[low], offsets)
    words = span_hashes(_set_words, low, starts, ends)
    first_word = np.searchsorted(starts, offsets)
    n_words = np.diff(first_word)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(int(first[-1])) + np.repeat(first_word[:-1] - first[:-1], n)
    hashes = _set_shingles.of(_set_shingles.prefix(words), begin, np.minimum(begin + shingle, np.repeat(first_word[1:], n))).view(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[:-1][first[:-1] < len(hashes)]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], upto[first]


def _set_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    raw, digest = hashes.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[8 * a : 8 * b], SEED) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)), np.uint64, len(first) - 1).view(np.int64)


def set_prints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each set of hashes, of PRINT_BITS bits in two longs; every hash counts once, however often its shingle stands in the text."""
    hashes = hashes.view(np.uint64)
    return majority(hashes, first).view(np.int64), majority(mix(hashes), first).view(np.int64)


def _prints(high: np.ndarray, low: np.ndarray) -> list[int]:
    return [a << 64 | b for a, b in zip(high.view(np.uint64).tolist(), low.view(np.uint64).tolist(), strict=True)]


def safe_radius(threshold: float, bits: int = PRINT_BITS, miss: float = MISS) -> int:
    """The least radius beyond which the SimHashes of two sets with a Jaccard similarity of threshold lie with a chance of less than miss.

    The bits of a hash are independent, so the bits that differ are binomial. One differs with the
    chance that the sets' angle gives, and by rounding in sets of a few hashes at most sqrt(pi / 2) times as often."""
    differs = min(0.5, math.sqrt(math.pi / 2) * math.acos(2 * threshold / (1 + threshold)) / math.pi)
    beyond, radius = 0.0, bits
    while radius and (more := beyond + math.comb(bits, radius) * differs**radius * (1 - differs) ** (bits - radius)) < miss:
        beyond, radius = more, radius - 1
    return radius


def with_set(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """docs and ``fp``, a 64-bit hash of the set of each text's shingles; null and blank texts have the empty set."""

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(_set_hashes(*shingle_sets(data, offsets, shingle)))]

    return with_arrow_columns(docs, "fp long", compute, text)


def keys_shared(n: np.ndarray) -> np.ndarray:
    """How many keys a set of n hashes shares with a similar one: few for small sets, whose keys would else be all their hashes."""
    return np.clip(n // 25, 1, 8)


def similar_links(docs: DataFrame, sets: DataFrame, threshold: float = 0.8, shingle: int = 5, few: int = FEW, common: int = COMMON) -> DataFrame:
    """(u, v): links of distinct sets (``fp``) that connect just those connected by pairs with a Jaccard
    similarity of at least threshold, counted over the whole sets.

    docs: row_a, row_b and text; sets: row_a, row_b and fp, of the same rows, from with_set. Sets of
    hashes are made from the texts whenever they are needed and never stored for all documents.

    Pairs are found by SimHash: a BK-tree over each shard of sets with a common key gives those whose
    fingerprints, of 128 bits of their distinct shingles, are within safe_radius(threshold), and only these are counted.
    Keys stand in for op6's blocks of equal bits: at 0.8 about a bit in seven differs, so blocks wide enough to
    tell sets apart would miss similar ones. A pair lies beyond the radius with a chance of less than MISS.

    In any one order of all hashes, two such sets share k (if they share so many at all) of the first
    n - ceil(threshold * n) + k of each, n being its own size, for any k: those are the keys, and sets that
    share k keys, or one large one, meet in a tree, so the keys miss none. k follows the size (keys_shared):
    the smaller of two sets tells it. In the order, hashes found in over ``common`` texts come last. So a
    passage that many texts share gives keys only to those of which it is about three quarters or more.
    Keys with up to ``few`` sets are a shard each. The sets of larger ones, with all that these are joined to by
    further large keys, are one shard, searched in pairs of tiles, each pair of sets once, however many keys it shares.
    """
    spark, radius = docs.sparkSession, safe_radius(threshold)

    def prefixes(share: float, more: int, last: np.ndarray, counted: int = 0) -> DataFrame:
        """The first hashes of every set, in an order in which ``last`` come last: key, fp, the set's size n and its SimHash.

        With ``counted`` key and times instead, of hashes that are in so many of the sets that a task counts
        at a time, and beside the first hashes of sets that have any of ``last`` those others that are
        in two or more: such sets tend to have more common ones."""
        held = spark.sparkContext.broadcast(last)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            late, seen = held.value, set()  # equal sets come once from a task
            sure: list[np.ndarray] = []
            other: list[np.ndarray] = []

            def counts() -> pa.RecordBatch:
                key, times = np.unique(np.concatenate([*sure, np.zeros(0, np.int64)]), return_counts=True)
                key, times = key[times >= counted], times[times >= counted]
                too, often = np.unique(np.concatenate([*other, np.zeros(0, np.int64)]), return_counts=True)
                too, often = too[often > 1], often[often > 1]
                sure.clear()
                other.clear()
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, too])), pa.array(np.concatenate([times, often]))], names=["key", "times"])

            for batch in batches:
                for _, data, offsets in slices(batch, size=SET_BYTES):
                    key, first = shingle_sets(data, offsets, shingle)
                    fp, n = _set_hashes(key, first), np.diff(first)
                    high, low = (None, None) if counted else set_prints(key, first)
                    row, n_late = np.repeat(np.arange(len(n)), n), np.zeros(len(n), np.int64)
                    if len(late):
                        place = np.minimum(np.searchsorted(late, key), len(late) - 1)
                        is_late = late[place] == key
                        moved = np.flatnonzero(is_late)
                        if len(moved):  # within each row those that are not late come first
                            n_late = np.bincount(row[moved], minlength=len(n))
                            key = key[np.argsort(2 * row + is_late, kind="stable")]
                    fresh = np.zeros(len(n), bool)
                    for i, x in enumerate(fp.tolist()):
                        fresh[i] = x not in seen
                        seen.add(x)
                    most = np.where(fresh, np.minimum(n, np.floor(n * share + 1e-9).astype(np.int64) + keys_shared(n) + more), 0)
                    at = np.arange(len(key)) - first[row]
                    take = at < most[row]
                    if counted:
                        sure.append(key[take])
                        other.append(key[~take & (fresh & (n_late > 0))[row] & (at < (n - n_late)[row])])
                        if sum(map(len, sure)) + sum(map(len, other)) > COUNTED:
                            yield counts()
                        continue
                    row = row[take]
                    columns = {"key": key[take], "fp": fp[row], "n": n[row].astype(np.int32), "high": high[row], "low": low[row]}
                    yield pa.RecordBatch.from_pydict({name: pa.array(column) for name, column in columns.items()})
            if sure:
                yield counts()

        return docs.select("text").mapInArrow(run, "key long, times long" if counted else "key long, fp long, n int, high long, low long")

    # hashes that move up when others come last can be common too: keys are counted anew until few are
    last, n_sets = np.zeros(0, np.int64), sets.count()
    for k in range(ROUNDS):
        # a count in the first round is exact; later ones, for hashes further back, look for those that tasks see twice
        first = (1 - threshold, 0) if k else (1.25 * (1 - threshold), 2)
        counts = saved(prefixes(*first, last, counted=2 if k else 1).groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") > common))
        often = counts.orderBy(F.desc("times"), "key").limit(LATE).toArrow()
        discard(counts)
        key, times = (often.column(c).to_numpy() for c in ("key", "times"))
        new = ~np.isin(key, last)
        last = np.union1d(last, key[new])
        # what comparing the sets of each new one in pairs would cost
        if len(last) >= LATE or float((times[new].astype(float) ** 2).sum()) <= PER_SET * n_sets:
            break
    keys = prefixes(1 - threshold, 0, last)
    found = saved(_pairs(keys, threshold, few, radius))
    pairs = saved(found.where("need > 0").groupBy("u", "v", "need").count().where("count >= need").select("u", "v"))
    large = saved(found.where("need = 0").select("u", "v").distinct())
    discard(found)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(large.select("u")).union(large.select("v")).distinct()
    own = _sets_of(docs, sets, nodes, shingle)
    links = _verified(own, pairs, threshold)
    if not large.isEmpty():
        links = links.union(_compared(own, components(large), threshold, radius))
    discard(own, pairs, large)
    return links


def _sets_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles, high, low) of the nodes, from one text for each."""
    # copies, however many, are one row before they meet the nodes
    one = sets.groupBy("fp").agg(F.min(F.struct("row_a", "row_b")).alias("one")).join(nodes, F.col("fp") == F.col("node"), "left_semi")
    one = one.select(F.col("fp").alias("own"), F.col("one.row_a").alias("own_a"), F.col("one.row_b").alias("own_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for fp in batch.column(0).to_pylist():
                fresh.append(fp not in seen)
                seen.add(fp)
            for part, data, offsets in slices(batch.filter(pa.array(fresh, pa.bool_())), size=SET_BYTES):
                hashes, first = shingle_sets(data, offsets, shingle)
                held = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), held, *map(pa.array, set_prints(hashes, first))], names=["fp", "shingles", "high", "low"])

    texts = docs.select("row_a", "row_b", "text").join(one, (F.col("row_a") == F.col("own_a")) & (F.col("row_b") == F.col("own_b")))
    return saved(texts.select("own", "text").mapInArrow(run, "fp long, shingles array<long>, high long, low long"))


def _pairs(keys: DataFrame, threshold: float, few: int, radius: int) -> DataFrame:
    """(u, v, need): pairs of sets of one key that its BK-tree finds within radius and whose sizes allow the
    threshold, and the keys that such a pair shares at least. The sets of a key with over ``few`` are only
    named as one group, by links to the first of them with need 0; what a task holds of a key is bounded by ``few``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple] = []  # two sets, each with its size
        named: list[tuple[int, int]] = []

        def search(held: list[tuple[int, int, int]]) -> None:
            for i, j in zip(*near_pairs((x[2] for x in held), radius), strict=True):
                near.append(held[i][:2] + held[j][:2])

        def rows() -> pa.RecordBatch:
            u, n, v, m = np.array(near, np.int64).reshape(-1, 4).T
            least = np.ceil(threshold * np.maximum(n, m) - 1e-9)
            fits = np.minimum(n, m) >= least
            need = np.minimum(keys_shared(np.minimum(n, m)), least)[fits]
            first, other = np.array(named, np.int64).reshape(-1, 2).T
            near.clear()
            named.clear()
            need = np.concatenate([need, np.zeros(len(first))]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u[fits], first])), pa.array(np.concatenate([v[fits], other])), pa.array(need)], names=["u", "v", "need"])

        last, held, many = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, n, high, low = (batch.column(i).to_numpy() for i in range(5))
            # sorted: sets that several tasks have sent come once
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            new[0] = not (key[0] == last and held and held[-1][0] == fp[0])
            key = key[new]
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            # keys of one set, but for the first and last of a batch, have no pair
            stay = size > 1
            stay[[0, -1]] = True
            of = np.flatnonzero(new)[np.repeat(stay, size)]
            sets = list(zip(fp[of].tolist(), n[of].tolist(), _prints(high[of], low[of]), strict=True))
            end = np.cumsum(size[stay]).tolist()
            for k, a, b in zip(key[begin[stay]].tolist(), [0, *end], end, strict=False):
                if k != last:
                    if len(held) > 1 and not many:
                        search(held)
                    last, held, many = k, sets[a:b], False
                else:
                    held += sets[a:b]
                if len(held) > few or many:
                    named += [(held[0][0], x[0]) for x in held[1:]]
                    held, many = [held[0], held[-1]], True  # the first, and the last to tell repeats
            if len(near) + len(named) > 50_000:
                yield rows()
        if len(held) > 1 and not many:
            search(held)
        if near or named:
            yield rows()

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long, need int")


def _verified(own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least threshold."""
    both = pairs.join(own.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(own.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    alike = shared >= F.lit(threshold) * (F.size("a") + F.size("b") - shared) - F.lit(1e-9)
    return saved(both.where(alike).select("u", "v"))


def _compared(own: DataFrame, clusters: DataFrame, threshold: float, radius: int, tile: int = TILE) -> DataFrame:
    """(u, v): links of the sets within each component of clusters (node, component): of those that the
    BK-tree of a tile finds within radius, the ones whose whole sets have the similarity."""
    clusters = saved(clusters)
    tiles = clusters.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    members = saved(clusters.join(tiles, "component").join(own, F.col("node") == F.col("fp")).select(
        "component", "fp", "shingles", "high", "low", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile")
    ))
    # a member goes to every pair of tiles that has its own
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fp", "shingles", "high", "low"
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        a, b = (table.column(c)[0].as_py() for c in "ab")
        fp, of_tile = table.column("fp").to_numpy(), table.column("tile").to_numpy()
        left, right = np.flatnonzero(of_tile == a), np.flatnonzero(of_tile == b)
        prints = _prints(table.column("high").to_numpy(), table.column("low").to_numpy())
        if a == b:
            i, j = near_pairs(prints, radius)
        else:
            tree = BKTree(prints[x] for x in left.tolist())
            near = [list(tree.within(prints[x], radius)) for x in right.tolist()]
            i, j = [x for found in near for x in found], np.repeat(np.arange(len(right)), [len(found) for found in near])
        if not len(i):
            return pa.table({"u": fp[:0], "v": fp[:0]})
        i, j = np.array(i, np.int64), np.array(j, np.int64)
        lists = table.column("shingles").chunk(0)
        n = lists.value_lengths().to_numpy().astype(np.int64)
        _, col, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(n)), n), times > 1
        row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(shared.sum()), 2048):
            part = slice(*np.searchsorted(col, [lo, lo + 2048]))
            has = np.zeros((len(n), 2048), np.float32)
            has[row[part], col[part] - lo] = 1
            both += has[left] @ has[right].T
        alike = both[i, j] >= threshold * (n[left[i]] + n[right[j]] - both[i, j]) - 1e-9
        i, j = i[alike], j[alike]
        label = local_components(len(n), left[i], right[j])
        keep = label != np.arange(len(n))
        return pa.table({"u": fp[keep], "v": fp[label[keep]]})

    out = saved(paired.groupBy("component", "a", "b").applyInArrow(compare, "u long, v long"))
    discard(clusters, members)
    return out
