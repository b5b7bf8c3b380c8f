"""Ranked lexical search over a document-sharded inverted index.

A shard is a run of documents of one task, of at most ``SHARD_BYTES`` of text (a longer document is
a shard of its own), sorted by id. For each term it holds blocks of ``BLOCK`` postings, sorted by
document, as variable-length bytes of gaps and frequencies. Frequencies over all shards are sums, so
no shard knows them while it is built, and no word of a text is shuffled. A search sends each
shard the queries: cursors over the query's posting lists wait in a heap, and the stretch of
documents that the smallest blocks cover is merged, scored and offered to a heap of the best; the
shards' best then meet. Only the postings of query terms are read and shuffled, to their shard.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

SHARD_BYTES = 16_000_000
BLOCK = 512
#: Rows of a batch of an index.
ROWS = 20_000
#: Query terms, over all queries, that are broadcast at a time; more queries are searched in several passes over the index.
QUERY_TERMS = 200_000
#: Tasks at most that one pass of a search has.
MOST_TASKS = 20_000
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The same for columns; a class of what terms hold, as negated classes are read differently by engines.
TERM_PATTERN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits each, low ones first, the eighth bit telling that
    more follow; and the number of bytes of each."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = (values[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        has = end - start >= k
        out[has] |= (b[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def shard_rows(shard: str, ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each term of a shard, and one without a term that holds its documents' ids and numbers of terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number: dict[bytes, int] = {}
    of_term, of_place, times, n_terms = array("i"), array("i"), array("i"), np.zeros(len(ids), np.int64)
    for place, i in enumerate(order):
        words = TERM.findall(texts[i].translate(LOWER))
        counts = Counter(words)
        n_terms[place] = len(words)
        of_term.extend([number.setdefault(w, len(number)) for w in counts])
        of_place.extend([place] * len(counts))
        times.extend(counts.values())
    known = np.array([ids[i] for i in order if ids[i] is not None], np.int64)
    lengths, _ = pack(n_terms)
    yield pa.RecordBatch.from_pylist(
        [{"shard": shard, "df": int((n_terms > 0).sum()), "n_terms": int(n_terms.sum()), "data": lengths.tobytes(), "ids": known.tobytes()}], schema=INDEX_TYPES
    )
    if not number:
        return
    terms = sorted(number)
    rank = np.empty(len(terms), np.int64)
    rank[[number[t] for t in terms]] = np.arange(len(terms))
    key = rank[np.frombuffer(of_term, np.int32)]
    by_term = np.argsort(key, kind="stable")  # places ascend within a term
    key, place, tf = key[by_term], np.frombuffer(of_place, np.int32)[by_term].astype(np.int64), np.frombuffer(times, np.int32)[by_term].astype(np.int64)
    df = np.bincount(key)
    first = np.cumsum(df) - df
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    data, sizes = pack(np.stack([gaps, tf], 1).ravel())
    block = np.flatnonzero((np.arange(len(key)) - first[key]) % BLOCK == 0)
    block_sizes = np.add.reduceat(sizes[::2] + sizes[1::2], block)
    lasts = place[np.append(block[1:], len(key)) - 1]
    borders = np.append(0, np.cumsum(np.bincount(key[block])))
    ends = np.append(0, np.cumsum(block_sizes))[borders]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, pa.int32()))
    bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(terms), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    n = len(terms)
    rows = pa.RecordBatch.from_arrays(
        [pa.array([shard] * n), pa.array([t.decode() for t in terms]), pa.array(df, pa.int64()), pa.nulls(n, pa.int64()), lists(lasts), lists(block_sizes), bytes_.cast(pa.binary()), pa.nulls(n, pa.binary())],
        schema=INDEX_TYPES,
    )
    for at in range(0, n, ROWS):
        yield rows.slice(at, ROWS)


INDEX = "shard string, term string, df long, n_terms long, lasts array<int>, sizes array<int>, data binary, ids binary"
INDEX_TYPES = pa.schema([
    ("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()), ("lasts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()), ("ids", pa.binary()),
])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of docs, as a table in the shared folder: no shuffle, every task writes its shards.

    Null texts have no terms; null ids come last. Rows of one id are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = body or b""
                if ids and size + len(body) > shard_bytes:
                    yield from shard_rows(uuid4().hex, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(body)
                size += len(body)
        if ids:
            yield from shard_rows(uuid4().hex, ids, texts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"))
    return saved(rows.mapInArrow(run, INDEX))


def query_terms(text: str = "text") -> Column:
    """The terms of a query's text, repeats included."""
    lowered = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))


class Cursor:
    """Where the merge stands in one term's postings: decoded blocks of places and impacts."""

    def __init__(self, number: int, blocks: list, lasts: list[int], decode, weight: int) -> None:
        self.number, self.blocks, self.lasts, self.decode, self.weight, self.at = number, blocks, lasts, decode, weight, 0
        self._open()

    def _open(self) -> None:
        if self.blocks[self.at] is None:
            self.blocks[self.at] = self.decode(self.at)
        self.places, self.impacts = self.blocks[self.at]
        self.from_ = 0

    def take(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Places up to ``upto``, which is not beyond the block, and their scores."""
        end = len(self.places) if self.lasts[self.at] <= upto else int(np.searchsorted(self.places, upto, "right"))
        out = self.places[self.from_ : end], self.impacts[self.from_ : end] * self.weight
        self.from_ = end
        return out

    def advance(self) -> bool:
        """Whether postings are left; opens the next block if need be."""
        if self.from_ < len(self.places):
            return True
        self.at += 1
        if self.at == len(self.lasts):
            return False
        self._open()
        return True


def best_of_shard(cursors: list[Cursor], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents; of equal scores the first places.

    Document at a time, in stretches: the heap gives the cursors that stand first; the stretch up to
    the least end of their blocks is complete once all cursors that start in it are taken."""
    heap = [(int(c.places[0]), i) for i, c in enumerate(cursors)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -place), the worst first
    while heap:
        taken, end = [], None
        while heap and (end is None or heap[0][0] <= end):
            _, i = heapq.heappop(heap)
            taken.append(cursors[i])
            last = cursors[i].lasts[cursors[i].at]
            end = last if end is None else min(end, last)
        parts = [c.take(end) for c in taken]
        places = np.concatenate([p for p, _ in parts])
        order = np.argsort(places, kind="stable")  # merges sorted runs
        places, scores = places[order], np.concatenate([s for _, s in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        places, scores = places[first], np.add.reduceat(scores, first)
        enough = scores > (best[0][0] if len(best) == k else 0)
        places, scores = places[enough], scores[enough]
        if len(scores) > k:
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
        for place, score in sorted(zip(places.tolist(), scores.tolist(), strict=True)):
            if len(best) < k:
                heapq.heappush(best, (score, -place))
            elif score > best[0][0]:
                heapq.heapreplace(best, (score, -place))
        for c in taken:
            if c.advance():
                heapq.heappush(heap, (int(c.places[c.from_]), c.number))
    return [(score, -place) for score, place in best]


@dataclass
class Corpus:
    """Documents with a term, and terms of all documents."""

    n_docs: int
    n_terms: int


def search_shard(rows: list[dict], documents: dict, corpus: Corpus, queries: dict[int, list[tuple[str, int]]], k: int) -> Iterator[tuple[int, int | None, int]]:
    """(query, doc_id, score) of the k best documents of one shard for each query (terms and weights)."""
    n_terms = unpack(documents["lengths"])
    ids = np.frombuffer(documents["doc_ids"], np.int64)
    m = 25 + 75 * n_terms * corpus.n_docs // max(corpus.n_terms, 1)
    lists: dict[str, tuple] = {}
    for row in rows:
        starts = np.concatenate([[0], np.cumsum(row["sizes"])])

        def decode(b: int, data=row["data"], starts=starts, lasts=row["lasts"]) -> tuple[np.ndarray, np.ndarray]:
            pairs = unpack(data[starts[b] : starts[b + 1]]).reshape(-1, 2)
            # gaps go on from the block before
            places = np.cumsum(pairs[:, 0]) + (lasts[b - 1] if b else 0)
            return places, 1_000_000_000 * pairs[:, 1] // (1000 * pairs[:, 1] + 8 * m[places])

        lists[row["term"]] = [None] * len(row["sizes"]), row["lasts"], decode
    for query, terms in queries.items():
        cursors = [Cursor(i, *lists[t], weight) for i, (t, weight) in enumerate((t, w) for t, w in terms if t in lists)]
        for score, place in best_of_shard(cursors, k) if cursors else ():
            yield query, int(ids[place]) if place < len(ids) else None, score


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each query row's k best documents with a score above 0.

    Equal scores stand by ascending doc_id, null last. A query without terms, or none of whose
    terms a document holds, has no rows, and so has every query on an empty index. Queries of one
    item_id are ranked each on its own. At most ``query_terms_at_once`` terms are broadcast, or those of one query.
    """
    spark = index.sparkSession
    shards = index.where("term IS NULL")
    stats = shards.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l"), F.count("*").alias("shards")).first()
    # a task for each shard, as its work depends on the queries and not on the bytes that it reads
    tasks = max(1, min(stats.shards, MOST_TASKS))
    corpus = Corpus(stats.n, stats.l)
    asked = saved(queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item_id}`").alias("item_id"), query_terms(text).alias("terms")))
    times = saved(asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    df = index.where("term IS NOT NULL").join(F.broadcast(times.select("term").distinct()) if times.count() <= query_terms_at_once else times.select("term").distinct(), "term", "left_semi")
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * corpus.n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    weighted = saved(times.join(df, "term").select("query", "term", weight.alias("weight")))
    # passes of whole queries, cut by the running number of their terms
    sizes = weighted.groupBy("query").agg(F.count("*").alias("n_terms")).orderBy("query")
    passes, room = [[]], query_terms_at_once
    for row in sizes.toLocalIterator():
        if passes[-1] and row.n_terms > room:
            passes.append([])
            room = query_terms_at_once
        passes[-1].append(row.query)
        room -= row.n_terms
    found = [_one_pass(index, weighted, p[0], p[-1], corpus, k, tasks) for p in passes if p]
    if not found:
        schema = asked.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long")
        return spark.createDataFrame([], schema)
    best = found[0]
    for other in found[1:]:
        best = best.unionByName(other)
    # a shard's best, then those of groups of shards, then of all
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    group = F.pmod(F.xxhash64("shard"), F.lit(64))
    best = best.withColumn("group", group)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query", "group").orderBy(*by))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by))).where(F.col("rank") <= k)
    out = saved(asked.select("query", "item_id").join(best, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    discard(asked, times, weighted)
    return out


def _one_pass(index: DataFrame, weighted: DataFrame, first: int, last: int, corpus: Corpus, k: int, tasks: int) -> DataFrame:
    """query, shard, doc_id and score of each shard's best documents for the queries from first to last."""
    spark = index.sparkSession
    queries: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for row in weighted.where(F.col("query").between(first, last)).toLocalIterator():
        if row.weight:
            queries[row.query].append((row.term, row.weight))
    sent = spark.sparkContext.broadcast(dict(queries))
    terms = spark.createDataFrame([(t,) for t in sorted({t for q in queries.values() for t, _ in q})], "term string")
    asked = index.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "lasts", "sizes", "data").repartition(tasks, "shard")
    shards = index.where("term IS NULL").select(F.col("shard").alias("of"), F.col("data").alias("lengths"), F.col("ids").alias("doc_ids")).repartition(tasks, "of")

    def run(key: tuple, postings: pa.Table, documents: pa.Table) -> pa.Table:
        found = list(search_shard(postings.to_pylist(), documents.to_pylist()[0], corpus, sent.value, k)) if postings.num_rows else []
        query, doc, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({
            "query": pa.array(query, pa.int64()), "shard": pa.array([key[0].as_py()] * len(found), pa.string()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64()),
        })

    return asked.groupBy("shard").cogroup(shards.groupBy("of")).applyInArrow(run, "query long, shard string, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Indexes docs, searches all queries and deletes the index: for one search only."""
    index = build_index(docs)
    out = search(index, queries, k)
    discard(index)
    return out
