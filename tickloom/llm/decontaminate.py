"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scans import scan

from .common import discard, kept, saved, union_spans, with_arrow_columns, with_row_key

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes of benchmark texts that one pass over the documents broadcasts at most.
BLOCK_BYTES = 4_000_000
#: Bytes of a piece of a longer item.
PIECE_BYTES = 250_000


class Patterns:
    """Tables for all patterns of ``length`` words: how far a block of two words lets the scan
    jump, and by the last block and the first block, the patterns to compare."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set]]] = {}

    def add(self, pattern: tuple, item: str) -> None:
        b = self.block
        same = self.buckets.setdefault(pattern[-b:], {}).setdefault(pattern[:b], {})
        if pattern not in same:
            for end in range(b, self.length + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
        same.setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Marks the words inside any occurrence and adds the items."""
        b, m, jump, shift = self.block, self.length, self.jump, self.shift
        at, n = m, len(words)
        while at <= n:
            block = tuple(words[at - b : at])
            step = shift.get(block, jump)
            if step:
                at += step
                continue
            start = at - m
            if same := self.buckets[block].get(tuple(words[start : start + b])):
                if found := same.get(tuple(words[start:at])):
                    hit[start:at] = True
                    items |= found
            at += 1


def tables_of(block: list[tuple[str, bytes]], window: int) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for item, text in block:
        words = WORDS.findall(text.lower())
        length = min(window, len(words))
        if length:
            own = by_length.setdefault(length, Patterns(length))
            for i in range(len(words) - length + 1):
                own.add(tuple(words[i : i + length]), item)
    return list(by_length.values())


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, item_ids (strings, sorted as such) and hit_spans (word offsets of maximal hit runs).

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Every run of
    ``window`` words of an item is searched in every whole text; an item of fewer words is searched
    as a whole, and one of none never occurs. Items go to the tasks in blocks, a narrow pass over the documents
    for each, which with several blocks writes the occurrences only, and a last pass that merges
    them. Long items are cut into pieces of ``piece_bytes`` that overlap by window - 1 words, and a
    block ends with the piece that fills it, so what is broadcast at once has at most block_bytes and a
    piece more, whatever one item or id has (a single longer word is a piece of its own).

    Null or empty text: no words. Items with null text or id are left out. Repeated items and rows
    count as they are; empty tables give no hits; other columns are kept, but n_words, n_hit,
    item_ids and hit_spans replace columns of these names.
    """
    pieces = _blocks(benchmark, window, item, item_text, block_bytes, piece_bytes)
    n_blocks = (pieces.agg(F.max("block")).first()[0] or 0) + 1
    block = lambda k: sorted((r.item, bytes(r.text)) for r in pieces.where(F.col("block") == k).select("item", "text").collect())
    docs = docs.drop("n_words", "n_hit", "item_ids", "hit_spans")
    if n_blocks == 1:
        return _search(docs, block(0), window, text)
    # a text's occurrences depend on the text alone: passes find them for each block, a last one merges them
    same = [F.xxhash64(text).alias("text_a"), F.hash(F.reverse(F.col(text))).alias("text_b")]
    found = []
    for k in range(n_blocks):
        hits = _search(docs.select(*same, F.col(text).alias("text")), block(k), window, "text").where("n_hit > 0")
        found.append(saved(hits.select("text_a", "text_b", "item_ids", "hit_spans").dropDuplicates(["text_a", "text_b"])))
    merged = reduce(DataFrame.union, found).groupBy("text_a", "text_b").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"), F.flatten(F.collect_list("hit_spans")).alias("spans")
    )
    a, b, ids, spans = with_row_key(docs, "a", "b", "ids", "spans")
    merged = merged.select(F.col("text_a").alias(f"{a}_"), F.col("text_b").alias(f"{b}_"), F.col("ids").alias(ids), F.col("spans").alias(spans))
    joined = docs.withColumns({a: same[0], b: same[1]}).join(merged, (F.col(a) == F.col(f"{a}_")) & (F.col(b) == F.col(f"{b}_")), "left")
    out = _merge(joined.drop(a, b, f"{a}_", f"{b}_"), text, ids, spans)
    return out.drop(ids, spans)


def _blocks(benchmark: DataFrame, window: int, item: str, text: str, block_bytes: int, piece_bytes: int) -> DataFrame:
    """item, text (bytes) and block of the pieces of all items, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = list(pieces_of(body, window, piece_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.binary())], names=["item", "text"])

    known = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull())
    rows = known.select(F.col(item).cast("string").alias("item"), F.encode(F.col(text).cast("string"), "utf-8").alias("text"))
    cut = saved(rows.mapInArrow(run, "item string, text binary").withColumns({"place": F.monotonically_increasing_id(), "size": F.octet_length("text").cast("long")}))
    placed = scan(cut, "place", {"upto": ("sum", F.col("size"))})
    out = saved(placed.select("item", "text", F.floor((F.col("upto") - F.col("size")) / block_bytes).cast("int").alias("block")))
    discard(cut)
    return out


def pieces_of(text: bytes, window: int, piece_bytes: int) -> Iterator[bytes]:
    """text whole, or if it is longer than a piece its words in pieces, each of which begins with the last
    window - 1 words of the one before; so every run of window words is in one of them."""
    if len(text) <= piece_bytes:
        yield text
        return
    words, begin = WORDS.findall(text), 0
    while begin < len(words):
        end, size = begin, 0
        while end < len(words) and (size + len(words[end]) < piece_bytes or end - begin < 2 * window):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[begin:end])
        if end == len(words):
            return
        begin = end - window + 1


def _columns(n_words: list[int], spans: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array) -> list[pa.Array]:
    row, start, end = spans
    n_hit = np.bincount(row, end - start, minlength=len(n_words)).astype(np.int64)
    upto = np.searchsorted(row, np.arange(len(n_words) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
    return [pa.array(n_words, pa.int64()), pa.array(n_hit), ids, pa.ListArray.from_arrays(pa.array(upto), items)]


COLUMNS = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"


def _search(docs: DataFrame, rows: list[tuple[str, bytes]], window: int, text: str) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(rows)
    cached = hashlib.sha256(repr(rows).encode()).hexdigest(), window

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        tables = kept(cached, lambda: tables_of(block.value, window))
        raw, n_words, ids, hits = data.tobytes().lower(), [], [], []
        for i in range(part.num_rows):
            words = WORDS.findall(raw, offsets[i], offsets[i + 1])
            hit, items = np.zeros(len(words), bool), set()
            for patterns in tables:
                patterns.search(words, hit, items)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
            n_words.append(len(words))
            ids.append(sorted(items))
            hits.append(np.column_stack([np.full(len(edges), i), edges]))
        spans = tuple(np.concatenate(hits).astype(np.int64).T) if hits else (np.zeros(0, np.int64),) * 3
        return _columns(n_words, spans, pa.array(ids, pa.list_(pa.string())))

    return with_arrow_columns(docs, COLUMNS, compute, text)


def _merge(docs: DataFrame, text: str, ids: str, spans: str) -> DataFrame:
    """docs and the four columns, from the occurrences that several passes found."""

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw = data.tobytes().lower()
        n_words = [len(WORDS.findall(raw, a, b)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        lists = part.column(part.schema.get_field_index(spans)).fill_null([])
        row, items = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
        start, end = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        return _columns(n_words, union_spans(row, start, end), part.column(part.schema.get_field_index(ids)).fill_null([]))

    return with_arrow_columns(docs, COLUMNS, compute, text)


def contaminated(n_words, n_hit, per: int = 20):
    """Whether hit words are at least one in ``per`` of the document's."""
    return (n_hit > 0) & (n_hit * per >= n_words)
