"""Suffix-array dedup: long repeats found by a run-compressed Burrows-Wheeler index.

The corpus is cut into small indexes that lose no match: each window of bytes is assigned to its
anchor, the stretch of ``k`` bytes in it with the least hash, so equal windows meet under one key.
A segment is a run of windows with one anchor. Equal segments are folded with a count. The
different segments of a key are indexed together: from the transform's runs, whose ends are
sampled with the common prefix of the suffixes that meet there, the matching statistics of every
byte are read in one pass, and these are compared with one window length or several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, discard, saved, slices, union_spans, with_row_key

#: Lengths of the anchors, as shares of the shortest window: segments of keys with over GROUP_BYTES
#: are cut again by longer anchors, at last by whole windows, of which all under one key are equal.
ANCHORS = (0.4, 0.7, 1.0)
GROUP_BYTES = 2_000_000
#: Bytes that one index takes, if no single key has more.
INDEX_BYTES = 700_000
SLICE = 1_000_000
#: Window starts of one text that are looked at together: longer texts are taken in pieces.
PIECE = 4_000_000
_anchors, _segments, _lce = Rolling(21), Rolling(22), Rolling(23)


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of its least, the leftmost of equal ones."""
    n = len(hashes) - width + 1
    # by doubling: the least of 2**i hashes, then of the two stretches that cover the width
    place, step = np.arange(len(hashes)), 1
    while 2 * step <= width:
        left, right = place[: len(place) - step], place[step:]
        place, step = np.where(hashes[left] <= hashes[right], left, right), 2 * step
    left, right = place[:n], place[width - step : width - step + n]
    return np.where(hashes[left] <= hashes[right], left, right)


def segments(data: np.ndarray, offsets: np.ndarray, window: int, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and numbers of windows of the segments of the rows of data. A window never
    crosses rows; of equal least hashes the leftmost is the anchor. own: windows of a row, the first
    so many, that are looked at."""
    n = len(data)
    if n < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    places = np.arange(n - k + 1)
    hashes = _anchors.of(_anchors.prefix(data), places, places + k)
    at = least_places(hashes, window - k + 1)
    begin, end = offsets[:-1], offsets[1:] - window + 1
    if own is not None:
        end = np.minimum(end, begin + own)
    some = end > begin
    inside = np.zeros(n + 1, np.int64)
    inside[begin[some]] = 1
    np.add.at(inside, end[some], -1)
    inside = np.cumsum(inside)[: n - window + 1] > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    new[begin[begin < len(at)]] = True
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return hashes[at[first]], first, last - first + 1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array, by prefix doubling from 8 bytes; only suffixes that are still tied are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(n, np.int64)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = start
    tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    step = 8
    while len(tied):
        suffix = order[tied]
        after = suffix + step
        both = (rank[suffix] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(both)
        both, suffix = both[by], suffix[by]
        order[tied] = suffix
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        rank[suffix] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        step *= 2
    return order


class RunLengthIndex:
    """The runs of a text's Burrows-Wheeler transform with, sampled at each run's ends, the suffix
    there and the length of the prefix that it shares with its neighbour of the other run."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_order(text)
        self.n = len(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        head = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.runs = before[np.concatenate([[0], head])]
        self.lengths = np.diff(np.concatenate([[0], head, [self.n]]))
        self.first, self.last = order[np.concatenate([[0], head])], order[np.concatenate([head - 1, [self.n - 1]])]
        shared = self._common(text, order[head - 1], order[head])
        self.shared_before, self.shared_after = np.concatenate([[0], shared]), np.concatenate([shared, [0]])

    def _common(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b: a galloping step up, then halving, on hashes."""
        prefix = _lce.prefix(text)
        room = self.n - np.maximum(a, b)
        low = np.zeros(len(a), np.int64)

        def take(ok: np.ndarray, step: int) -> np.ndarray:
            """Those of ok whose next ``step`` bytes are alike; their prefixes grow by it."""
            ok = ok[low[ok] + step <= room[ok]]
            x, y = a[ok] + low[ok], b[ok] + low[ok]
            same = (prefix[x + step] - prefix[x]) * _lce.down[x] == (prefix[y + step] - prefix[y]) * _lce.down[y]
            low[ok[same]] += step
            return ok[same]

        going, step = np.arange(len(a)), 64
        while len(going):  # steps double for pairs that still agree
            going = take(going, step)
            step *= 2
        while step := step // 2:
            take(np.arange(len(a)), step)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match with what starts anywhere else. Within a run, a suffix
        shares one byte less than the one before it in the text, so the samples give all lengths."""
        out = np.zeros(self.n, np.int64)
        for places, shared in ((self.first, self.shared_before), (self.last, self.shared_after)):
            reach, sampled = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            reach[places], sampled[places] = places + shared, places
            out = np.maximum(out, reach[np.maximum.accumulate(sampled)] - np.arange(self.n))
        return out


def long_matches(texts: list[np.ndarray], windows: Sequence[int]) -> list[list[np.ndarray]]:
    """For each window length and text the sorted places whose next bytes, so many, also start elsewhere in texts."""
    joined = np.concatenate([x for t in texts for x in (t, np.array([255], np.uint8))])  # 255 is never in UTF-8
    longest = RunLengthIndex(joined).matching_statistics()
    out: list[list[np.ndarray]] = [[] for _ in windows]
    at = 0
    for t in texts:
        for found, window in zip(out, windows, strict=True):
            found.append(np.flatnonzero(longest[at : at + max(0, len(t) - window + 1)] >= window))
        at += len(t) + 1
    return out


def repeated(texts: DataFrame, windows: Sequence[int], anchors: Sequence[float] = ANCHORS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(r, q, start, n, w): ranges of window starts, in bytes, whose windows also start elsewhere; w is
    the window's number in ``windows``, of which the first is the shortest.

    texts: r, q, base, own and text; r, q and base together are alike only for rows that are; start
    counts from the text's start less base; own is the number of window starts that count.

    Segments are those of the shortest window, and reach as far as the longest: equal windows of any
    of the lengths begin with equal shortest ones, and so meet under one key.
    """
    least, most = windows[0], max(windows)
    k = max(1, round(anchors[0] * least))

    def pieces(data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole slices; a single long text in runs of PIECE window starts."""
        if len(data) <= PIECE + most:
            yield 0, data, offsets, own
            return
        for lo in range(0, len(data), PIECE):
            part = data[lo : lo + PIECE + least - 1]
            yield lo, part, np.array([0, len(part)]), np.maximum(0, own - lo)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE):
                own = part.column("own").to_numpy()
                for lo, near, inner, some in pieces(data, offsets, own):
                    key, first, n = segments(near, inner, least, k, some)
                    first = first + lo
                    at = np.searchsorted(offsets, first, "right") - 1
                    end = np.minimum(first + n + most - 1, offsets[at + 1])
                    low = int(first[0]) if len(first) else 0
                    sums = _segments.prefix(data[low : int(end.max(initial=low))])
                    segment = _segments.of(sums, first - low, end - low)
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(segment.view(np.int64)), *[part.column(c).take(rows) for c in ("r", "q", "base")],
                         *[pa.array(x.astype(np.int32)) for x in (first - offsets[at], n, end - first)]],
                        names=["key", "segment", "r", "q", "base", "start", "n", "size"],
                    )

    found = saved(texts.select("r", "q", "base", "own", "text").mapInArrow(
        occurrences, "key long, segment long, r long, q int, base int, start int, n int, size int"
    ))
    keys = saved(found.groupBy("key").agg(F.count("*").alias("times"), (F.min("segment") == F.max("segment")).alias("alike")).where("times > 1"))
    shared = saved(found.join(keys.select("key", "alike"), "key"))
    discard(found, keys)

    def marked(rows: DataFrame) -> DataFrame:
        """Each window length's range of whole segments, as far as the text goes on."""
        fits = [F.least(F.col("n"), F.greatest(F.lit(0), F.col("size") - (w - 1))) for w in windows]
        each = F.explode(F.array(*[F.struct(x.alias("n"), F.lit(i).alias("w")) for i, x in enumerate(fits)]))
        return rows.select("r", "q", (F.col("base") + F.col("start")).alias("start"), each.alias("x")).select("r", "q", "start", "x.n", "x.w").where("n > 0")

    marks = marked(shared.where("alike"))
    mixed = shared.where("not alike")
    folded = saved(mixed.groupBy("key", "segment").agg(
        F.count("*").alias("times"), F.min(F.struct("r", "q", "base", "start", "n", "size")).alias("one")
    ))
    marks = marks.union(marked(mixed.join(folded.where("times > 1").select("key", "segment"), ["key", "segment"])))
    sizes = folded.groupBy("key").agg(F.sum("one.size").alias("size"))
    large = saved(sizes.where(F.col("size") > group_bytes).select("key", F.lit(True).alias("large")))
    wanted = (
        folded.join(large, "key", "left")
        .select("key", F.col("one.r").alias("wr"), F.col("one.q").alias("wq"), F.col("one.base").alias("wb"), "one.start", "one.n", "one.size",
                (F.col("times") == 1).alias("open"), F.coalesce("large", F.lit(False)).alias("large"))
        .groupBy("wr", "wq", "wb").agg(F.collect_list(F.struct("key", "start", "n", "size", "open", "large")).alias("wanted"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # of equal rows one is cut
        for batch in batches:
            fresh = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("r", "q", "base")], strict=True):
                fresh.append(row not in seen)
                seen.add(row)
            for part, data, offsets in slices(batch.filter(pa.array(fresh, pa.bool_())), "text", SLICE):
                lists = part.column("wanted")
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                items, rows = lists.flatten(), pa.array(at)
                start, size = items.field(1).to_numpy(), items.field(3).to_numpy()
                begin = offsets[at] + start
                yield pa.RecordBatch.from_arrays(
                    [items.field(0), part.column("r").take(rows), part.column("q").take(rows),
                     pa.array((part.column("base").to_numpy()[at] + start).astype(np.int32)), items.field(2), items.field(4), items.field(5),
                     pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)], pa.binary())],
                    names=["key", "r", "q", "base", "own", "open", "large", "text"],
                )

    cuts = texts.select("r", "q", "base", "text").join(wanted, F.expr("r = wr and q = wq and base = wb")).drop("wr", "wq", "wb")
    cuts = cuts.mapInArrow(cut, "key long, r long, q int, base int, own int, open boolean, large boolean, text binary")
    again = len(anchors) > 1 and not large.isEmpty()
    if again:
        cuts = saved(cuts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered up to INDEX_BYTES."""
        held: list[tuple] = []  # r, q, base, is_open, text
        size, last, rows = 0, None, set()

        def joined() -> list[list]:
            """Cuts of one row that overlap are joined, so that every place is in the index once."""
            out: list[list] = []
            for r, q, base, is_open, text in sorted(held, key=lambda h: h[:3]):
                if out and out[-1][:2] == [r, q] and base <= out[-1][2] + len(out[-1][4]):
                    out[-1][3] = out[-1][3] or is_open
                    out[-1][4] += text[out[-1][2] + len(out[-1][4]) - base :]
                else:
                    out.append([r, q, base, is_open, text])
            return out

        def matches() -> pa.RecordBatch:
            out: list[list[int]] = [[], [], [], [], []]
            texts = joined()
            for w, found in enumerate(long_matches([np.frombuffer(h[4], np.uint8) for h in texts], windows)):
                for (r, q, base, is_open, _), places in zip(texts, found, strict=True):
                    if is_open and len(places):
                        new = np.concatenate([[True], np.diff(places) > 1])
                        first = places[new]
                        n = np.diff(np.concatenate([np.flatnonzero(new), [len(places)]]))
                        for values, more in zip(out, ([r] * len(first), [q] * len(first), (base + first).tolist(), n.tolist(), [w] * len(first)), strict=True):
                            values += more
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), *[pa.int32()] * 4), strict=True)], names=["r", "q", "start", "n", "w"]
            )

        for batch in batches:
            for key, r, q, base, is_open, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "r", "q", "base", "open", "text")], strict=True):
                if key != last:
                    if size > INDEX_BYTES:
                        yield matches()
                        held, size = [], 0
                    last, rows = key, set()
                if (r, q, base) not in rows:  # of equal rows one is indexed
                    rows.add((r, q, base))
                    held.append((r, q, base, is_open, text))
                    size += len(text)
        if held:
            yield matches()

    small = cuts.where("not large") if again else cuts
    small = small.select("key", "r", "q", "base", "open", "text").repartition("key").sortWithinPartitions("key")
    marks = marks.union(small.mapInArrow(index, "r long, q int, start int, n int, w int"))
    if again:
        for w, window in enumerate(windows):
            own = cuts.where("large").select("r", "q", "base", "own", "text")
            marks = marks.union(repeated(own, (window,), anchors[1:], group_bytes).withColumn("w", F.lit(w)))
    out = saved(marks)
    discard(shared, folded, large, *([cuts] if again else []))
    return out


def remove_long_repeats(
    docs: DataFrame, window: int = 400, text: str = "text", keep_bytes: bool = True, report: int = 250, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """docs with n_bytes, n_removed, removed_spans, n_repeated, kept_sha256 and (keep_bytes) kept_bytes.

    A text is its UTF-8 bytes. Every byte is removed that a string of ``window`` bytes covers which
    also starts anywhere else, in the same text too, overlaps included; strings never cross texts
    and are judged on the input. kept_bytes joins the rest, and kept_sha256 is its SHA-256.
    n_repeated counts, by the same rule, the bytes that repeated strings of ``report`` bytes cover
    (at most ``window``); nothing is removed for these. It shows passages shorter than a window.

    Null: no bytes. Texts shorter than a window keep all. Repeated rows lose all windows. An empty
    table gives an empty result; other columns are kept, but those named above replace columns of
    these names. Places are 32-bit: a text may have 2**31 - 1 bytes, which is also Spark's limit.
    """
    new = ["n_bytes", "n_removed", "removed_spans", "n_repeated", "kept_sha256", "kept_bytes"]
    windows = (min(report, window), window) if report < window else (window,)
    docs = docs.drop(*new)
    r, q, marks = with_row_key(docs, "r", "q", "marks")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    keyed = docs.withColumns({r: F.xxhash64(*hashed), q: F.hash(F.reverse(F.col(text)))})
    texts = keyed.select(F.col(r).alias("r"), F.col(q).alias("q"), F.lit(0).alias("base"), F.lit(2**31 - 1).alias("own"), F.col(text).alias("text"))
    found = repeated(texts, windows, group_bytes=group_bytes).groupBy(F.col("r").alias(f"{r}_m"), F.col("q").alias(f"{q}_m")).agg(
        F.collect_set(F.struct("start", "n", "w")).alias(marks)
    )
    joined = keyed.join(found, (F.col(r) == F.col(f"{r}_m")) & (F.col(q) == F.col(f"{q}_m")), "left").drop(f"{r}_m", f"{q}_m")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", span),
              T.StructField("n_repeated", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_bytes", T.BinaryType())] if keep_bytes else []
    schema = T.StructType([*docs.schema.fields, *fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                lists = part.column(marks).fill_null([])
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                items = lists.flatten()
                start, n, w = (items.field(k).to_numpy().astype(np.int64) for k in range(3))
                end = start + n + np.array(windows)[w] - 1
                covered, spans_of = np.zeros((len(windows), part.num_rows), np.int64), None
                for i in range(len(windows)):
                    own = w == i
                    spans_of = union_spans(at[own], start[own], end[own])
                    np.add.at(covered[i], spans_of[0], spans_of[2] - spans_of[1])
                row, lo, hi = spans_of
                first = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                kept, digests = [], []
                for i in range(part.num_rows):
                    done, pieces = offsets[i], []
                    for a, b in zip(lo[first[i] : first[i + 1]].tolist(), hi[first[i] : first[i + 1]].tolist(), strict=True):
                        pieces.append(data[done : offsets[i] + a].tobytes())
                        done = offsets[i] + b
                    pieces.append(data[done : offsets[i + 1]].tobytes())
                    rest = b"".join(pieces)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if keep_bytes:
                        kept.append(rest)
                cuts = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["start", "end"])).cast(span_type)
                arrays = [pa.array(np.diff(offsets)), pa.array(covered[-1]), cuts, pa.array(covered[0]), pa.array(digests, pa.string())]
                arrays += [pa.array(kept, pa.binary())] if keep_bytes else []
                own_columns = [part.column(i) for i, f in enumerate(part.schema.names) if f not in (r, q, marks)]
                yield pa.RecordBatch.from_arrays([*own_columns, *arrays], names=schema.names)

    return joined.mapInArrow(removed, schema)
