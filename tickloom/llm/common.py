"""Helpers that the corpus operators share: tables, Arrow text batches, hashing, components.

Python code here runs inside Spark tasks over bounded slices of Arrow batches.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word bytes are all but space and tab to carriage return (pattern ``[^\x20\x09-\x0D]+``).
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one slice of a batch holds at most (a longer single text is a slice of its own).
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch that a task sends its Python worker, or one longer row; else it is 10,000 rows, whatever their texts hold.
BATCH_BYTES = 4_000_000
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set: a temporary one on a local master, as in
    tests; on a cluster, whose executors could not see that, an error."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and sc.getCheckpointDir() is None and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return shared or sc.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's tasks send Python batches of at most BATCH_BYTES, unless the session has a bound of its
    own. Both sides hold a batch whole, and the JVM twice while its buffer grows. Spark reads the setting when a
    query runs, so it stays set."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def saved(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder, so that later jobs do not compute it again,
    also after executors were lost. The shuffle files of the job that writes it are removed after."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of saved() from the shared folder: those that only saved tables were made of."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text) -> F.Column:
    """Number of words; 0 for null. Each word becomes one letter, so no array of words is built."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def with_row_key(df: DataFrame, *names: str) -> list[str]:
    """names, each lengthened until it clashes with no column of df."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        out.append(name)
    return out


_held: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, held in this worker for its later tasks until something else is kept or release() is called."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``size`` bytes of text each, with those bytes and offsets."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a row's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(inside)]
    before[borders] = False
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    borders = offsets[1:][offsets[1:] > 0] - 1
    after[borders] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def union_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs that spans of rows cover; touching spans are one run."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    # ends so far within a row: rows are told apart by a step that no end reaches
    step = np.int64(int(end.max()) + 1)
    reach = np.maximum.accumulate(end + row * step) - row * step
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.concatenate([first[1:] - 1, [len(row) - 1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of stretches of a sequence of bytes or 64-bit symbols."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1 << 63)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        def grown(have: np.ndarray, base: int) -> np.ndarray:
            while len(have) < n:
                step = np.uint64(pow(base, len(have), 2**64))
                have = np.concatenate([have, have * step])
            return have

        if len(self.up) < n:
            self.up, self.down = grown(self.up, self.base), grown(self.down, self.inverse)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Sums that of() needs; bytes are first given random symbols."""
        if symbols.dtype == np.uint8:
            symbols = self.of_byte[symbols]
        self._powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def span_hashes(rolling: Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes. Long ones, for which sums modulo 2**64 can be made to agree, by XXH64."""
    out = rolling.of(rolling.prefix(data), starts, ends)
    for i in np.flatnonzero(ends - starts > 400):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of n nodes over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Rounds of smallest-neighbour labels with pointer jumping; each is written to the shared
    folder. Labels are joined by key, so a hub's links are summed before the shuffle and a skewed
    join is split at run time. No edges: an empty table.
    """
    links = saved(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = saved(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = (
            links.join(labels, links.v == labels.node)
            .groupBy(F.col("u").alias("near_node"))
            .agg(F.min("component").alias("near_min"))
        )
        stepped = labels.join(near, labels.node == near.near_node, "left").select(
            "node", F.col("component").alias("was"), F.least("component", F.coalesce("near_min", "component")).alias("component")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        new = saved(
            stepped.join(parents, stepped.component == parents.parent, "left").select(
                "node", "was", F.least("component", F.coalesce("above", "component")).alias("component")
            )
        )
        discard(labels if hasattr(labels, "saved_path") else last)
        labels, last = new.select("node", "component"), new
        if new.where("was <> component").isEmpty():
            discard(links)
            return labels


def with_arrow_columns(df: DataFrame, ddl: str, compute, text: str) -> DataFrame:
    """df and the columns of ddl, which replace columns of the same names.

    compute: (batch) -> one array for each new column, over a slice of whole rows with about
    SLICE_BYTES of text; it runs in the tasks, over Arrow batches, without a shuffle.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)
    taken = {f.name.lower() for f in new}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    schema = T.StructType([*df.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                arrays = [*part.columns, *compute(part, data, offsets)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)
