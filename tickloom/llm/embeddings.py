"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, local_components, saved, with_row_key

#: Vectors, chosen by hash, that the rotation is learnt from.
SAMPLE = 4096
#: Vectors, repeated ones among them if there are fewer, that get made-up partners.
LEAST = 1024
#: Members of a bucket whose pairs one task compares at once; larger buckets are compared in tiles.
TILE = 1024
#: Hash tables whose keys are shuffled at once.
PASS = 16
#: Further bits of a code, which no key takes; pairs of unrelated vectors that share a key differ in them.
BESIDE = 64
#: Hash tables at most; where more would be needed for the recall asked for, that is an error.
TABLES = 400


class Quantiser:
    """Balanced binary codes: centred vectors, a rotation, and signs. The rotation starts at random within the principal
    axes and alternates between signs and the orthogonal matrix that brings the vectors closest
    to them. Vectors of fewer dimensions than bits get several rotations, from other starts, and so do the ``BESIDE`` bits."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 40) -> None:
        self.bits = bits
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
        v = x @ axes
        parts: list[np.ndarray] = []
        while sum(p.shape[1] for p in parts) < bits + BESIDE:
            rotation, _ = np.linalg.qr(np.random.default_rng(len(parts)).standard_normal((v.shape[1], v.shape[1])))
            for _ in range(rounds):
                a, _, b = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
                rotation = (a @ b).T
            parts.append(axes @ rotation)
        self.project = np.hstack(parts)[:, : bits + BESIDE]
        self.offset = self.mean @ self.project

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """For each vector the bits that keys are made of, and those beside them."""
        p = unit @ self.project - self.offset
        code = np.zeros((2, len(p)), np.uint64)
        for b in range(p.shape[1]):
            code[int(b >= self.bits)] |= (p[:, b] >= 0).astype(np.uint64) << np.uint64(b - self.bits * (b >= self.bits))
        return code


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def partners(unit: np.ndarray, threshold: float, seed: int = 1) -> np.ndarray:
    """For each unit vector one at exactly the threshold, in a random direction."""
    aside = np.random.default_rng(seed).standard_normal(unit.shape)
    aside -= (aside * unit).sum(1, keepdims=True) * unit
    aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-12)
    return _unit(threshold * unit + math.sqrt(1 - threshold**2) * aside)


def learn(vectors: np.ndarray, threshold: float, bits: int) -> tuple[Quantiser, np.ndarray, int]:
    """A quantiser, the bits of keys in which codes of pairs at the threshold differ, and the number of bits, of all,
    in which 999 of 1000 of them differ at most."""
    drawn = _unit(vectors)
    if len(drawn) < LEAST:
        drawn = np.resize(drawn, (LEAST, drawn.shape[1]))
    beside = partners(drawn, threshold)
    quantiser = Quantiser(np.vstack([drawn, beside]), bits)
    changed = quantiser.codes(drawn) ^ quantiser.codes(beside)
    return quantiser, changed[0], int(np.quantile(np.bitwise_count(changed).sum(0), 0.999, method="higher"))


def learnt(nodes: DataFrame, threshold: float, bits: int, sample: int) -> tuple[Quantiser, np.ndarray, int]:
    """learn() from the first ``sample`` vectors by hash, in the task that gathers them: the driver gets what is
    learnt, a row of 128 numbers for each dimension, and no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = np.vstack([_matrix(batch.column(0)) for batch in batches if batch.num_rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(drawn, threshold, bits))])], names=["learnt"])

    return pickle.loads(nodes.orderBy("ha", "hb").limit(sample).select("v").mapInArrow(run, "learnt binary").first()["learnt"])


def table_masks(n: int, bits: int, changed: np.ndarray, missed: float = 0.01, most: int = TABLES, seed: int = 1) -> list[int]:
    """Bits of the code that each table's key takes, for n vectors.

    Keys have about log2(n) - 5 bits, so that buckets of unrelated vectors keep their size as n
    grows. Tables are added until no more than ``missed`` of the pairs whose codes differ in the bits
    ``changed`` agree on no key; as these are whole codes, tables that fail together are counted so.
    Needing more than ``most`` tables is an error: codes of more bits, or a larger ``missed``, need fewer.
    """
    width = min(bits, max(1, math.ceil(math.log2(max(2, n))) - 5))
    rng, out, left = np.random.default_rng(seed), [], changed
    order: list[int] = list(range(bits))
    while not out or len(left) > missed * len(changed):
        if len(out) >= most:
            raise ValueError(f"{most} tables miss {len(left) / len(changed):.3f} of the pairs at the threshold among {n} vectors; {missed} is asked for")
        for i in range(0, bits - width + 1, width):
            out.append(sum(1 << b for b in order[i : i + width]))
            left = left[(left & np.uint64(out[-1])) != 0]
            if len(left) <= missed * len(changed):
                break
        order = rng.permutation(bits).tolist()
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
    bits: int = 64, missed: float = 0.01, sample: int = SAMPLE, tile: int = TILE, tables: int = TABLES, at_once: int = PASS,
) -> DataFrame:
    """vectors with n_links, component_id and kept.

    Two vectors link if their cosine, in double precision, is at least threshold. Candidates agree
    on the key of at least one table (table_masks), and their codes differ in no more bits than 999 of
    1000 pairs at the threshold do, bits that no key takes among them; every candidate pair is reranked by the original vectors, so no
    pair below the threshold links. A pair counts in the first table only in which it meets. Equal
    vectors, told by 96 bits of hash, are one node with a count. The rotation, and the number of tables
    that misses a share ``missed`` of pairs at the threshold, are learnt from ``sample`` vectors and made-up
    partners of theirs, in one task; all vectors are indexed, at any number in the same way. Needing over ``tables`` is an error.
    Keys of ``at_once`` tables are shuffled at a time, so that the disk they take does not grow with the number of tables.

    Buckets of over ``tile`` vectors, by a count of a part of the codes, are cut into tiles, and each pair of tiles is
    one group, so a bucket with many of all rows is spread. A bucket gives one row a member, not its pairs.

    Null, zero and non-finite vectors, or null components: no links, component_id is the own vec_id. Vectors of different
    lengths never link. Repeated rows of one vec_id count as separate vectors. An empty table
    gives an empty result; other columns are kept, but n_links, component_id and kept replace
    columns of these names.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vectors = vectors.drop("n_links", "component_id", "kept")
    ha, hb = with_row_key(vectors, "ha", "hb")
    e = F.col(embedding).cast("array<double>")
    ok = usable(e)
    held = F.col(embedding) if dict(vectors.dtypes).get(embedding) == "array<float>" else e
    keys = {ha: F.when(ok, F.xxhash64(e)), hb: F.when(ok, F.hash(e))}
    nodes = saved(
        vectors.withColumns(keys).where(ok).groupBy(F.col(ha).alias("ha"), F.col(hb).alias("hb"))
        .agg(F.count("*").alias("copies"), F.min(vec_id).alias("least"), F.first(held).alias("v"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    lengths = nodes.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()
    counts, edges = nodes.limit(0).select("node", F.lit(0).cast("long").alias("n")), nodes.limit(0).select(F.col("node").alias("u"), F.col("node").alias("v"))
    for d, n_nodes in lengths:
        own = nodes.where(F.size("v") == d)
        quantiser, changed, radius = learnt(own, threshold, bits, sample)
        c, s = _links(spark, own, quantiser, threshold, table_masks(n_nodes, bits, changed, missed, tables), radius, tile, at_once)
        counts, edges = counts.union(c), edges.union(s)
    found = components(edges)
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    full = nodes.join(counts, "node", "left").join(found, "node", "left").select(
        "ha", "hb", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")
    )
    least = full.groupBy("c").agg(F.min("least").alias("component_id"))
    full = full.join(least, "c").select(F.col("ha").alias(f"{ha}_n"), F.col("hb").alias(f"{hb}_n"), "n_links", "component_id")
    out = vectors.withColumns(keys)
    out = out.join(full, (F.col(ha) == F.col(f"{ha}_n")) & (F.col(hb) == F.col(f"{hb}_n")), "left").drop(ha, hb, f"{ha}_n", f"{hb}_n")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", F.col(vec_id))})
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(vec_id), F.lit(True)))


#: Bits that a tile's number takes in ``place``.
PLACE = 21


class Groups:
    """Rows (t, place, node, code, more, ...) that come sorted by group: of one table t, one key, and one pair of tiles. A place is
    the pair's two tiles and the row's own."""

    def __init__(self, masks: list[int], radius: int) -> None:
        self.masks, self.radius = np.array(masks, np.uint64), radius

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows, but the first, that begin a group."""
        t, place, code = batch.column("t").to_numpy(), batch.column("place").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
        key, tiles = code & self.masks[t], place >> PLACE
        return np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (tiles[1:] != tiles[:-1])) + 1

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows again, in runs of whole groups."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new = self.starts(batch)
            last = int(new[-1]) if len(new) else 0
            if last:
                yield batch.slice(0, last)
            held = batch.slice(last)
        if held is not None:
            yield held

    def pairs(self, run: pa.RecordBatch, at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a group that are within the radius, in different tiles if the group has two, and
        share no key of a table before theirs."""
        borders = np.concatenate([[0], self.starts(run), [run.num_rows]])
        end = np.repeat(borders[1:], np.diff(borders))
        t, place = run.column("t").to_numpy(), run.column("place").to_numpy()
        code, more = (run.column(c).to_numpy().view(np.uint64) for c in ("code", "more"))
        across, tile = (place >> 2 * PLACE) != (place >> PLACE) & (1 << PLACE) - 1, place & (1 << PLACE) - 1
        i, step, found, n = np.arange(run.num_rows), 1, [], 0
        while True:
            i = i[i + step < end[i]]
            if n >= at_once or not len(i) and n:
                yield self.first(t, code, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found, n = [], 0
            if not len(i):
                return
            j = i + step
            near = np.bitwise_count(code[i] ^ code[j]) + np.bitwise_count(more[i] ^ more[j]) <= self.radius
            u, v = i[near], j[near]
            apart = ~across[u] | (tile[u] != tile[v])
            found.append((u[apart], v[apart]))
            n += len(found[-1][0])
            step += 1

    def first(self, t: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k, mask in enumerate(self.masks[: int(t[i].max(initial=0))]):
            new = (t[i] <= k) | ((code[i] ^ code[j]) & mask != 0)
            i, j = i[new], j[new]
        return i, j


def _links(spark, nodes: DataFrame, quantiser: Quantiser, threshold: float, masks: list[int], radius: int, tile: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(node, n): links of each node to others' copies; (u, v): links that connect the same nodes."""
    shared, groups = spark.sparkContext.broadcast(quantiser), Groups(masks, radius)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = shared.value.codes(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.view(np.int64)) for c in code)], names=["node", "code", "more"])

    codes = saved(nodes.select("node", "v").mapInArrow(encode, "node long, code long, more long"))
    key = F.col("code").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)).cast("long") for m in masks]), F.col("t") + 1))
    group = F.xxhash64("t", key, F.shiftright("place", PLACE))

    def indexed(rows: DataFrame, first: int, end: int) -> DataFrame:
        return rows.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))

    part = max(1, tile // 64)
    counted = indexed(codes.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0), 0, len(masks)).groupBy("t", key.alias("key"))
    large = saved(counted.agg(F.ceil(F.count("*") * part / tile).cast("int").alias("tiles")).where("tiles > 1"))
    spread = not large.isEmpty()

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with their places; a member of a large bucket goes to every pair of tiles that has its own."""
        if not spread:
            return rows.select("t", F.lit(0).cast("long").alias("place"), "node", "code", "more")
        rows = rows.withColumn("key", key).join(large, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiles = F.shiftleft(F.least("tile", "other"), 2 * PLACE).bitwiseOR(F.shiftleft(F.greatest("tile", "other"), PLACE))
        return rows.select("t", tiles.bitwiseOR(F.col("tile")).alias("place"), "node", "code", "more")

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a candidate in their group."""
        for run in groups.runs(batches):
            keep = np.zeros(run.num_rows, bool)
            for i, j in groups.pairs(run):
                keep[i] = keep[j] = True
            yield run.filter(pa.array(keep))

    tables = []
    for first in range(0, len(masks), at_once):
        rows = dealt(indexed(codes, first, min(len(masks), first + at_once)))
        tables.append(saved(rows.repartition(group).sortWithinPartitions(group).mapInArrow(retrieve, rows.schema)))
    candidates = tables[0]
    for more in tables[1:]:
        candidates = candidates.union(more)
    candidates = candidates.join(nodes.select("node", "copies", "v"), "node").select("t", "place", "node", "code", "more", "copies", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in groups.runs(batches):
            ids, copies, x = run.column("node").to_numpy(), run.column("copies").to_numpy(), _unit(_matrix(run.column("v")))
            n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i, j in groups.pairs(run):
                size = max(1, 1_000_000 // x.shape[1])
                link = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[i[k : k + size]], x[j[k : k + size]]) >= threshold for k in range(0, len(i), size))])
                i, j = i[link], j[link]
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                label = local_components(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, label]))
            keep = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep]), pa.array(ids[label[keep]])], names=["node", "n", "to"])

    found = saved(candidates.repartition(group).sortWithinPartitions(group).mapInArrow(rerank, "node long, n long, to long"))
    discard(codes, large, *tables)
    return found.select("node", "n"), found.select(F.col("node").alias("u"), F.col("to").alias("v"))
