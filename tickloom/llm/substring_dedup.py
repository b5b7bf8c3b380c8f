"""Substring dedup by recompression: repeated word windows found through consistently named symbols.

Recompression shortens a sequence in rounds: runs of one symbol, then pairs of a left and a right
symbol, become new symbols. A name is a hash of what it stands for and a symbol's side is a bit of
its name, so all tasks name alike, with no dictionary. What a round does with a symbol depends on
it and its neighbours only: every symbol has a stretch of words that settles it (its dependency),
and wherever these words stand, the same symbol comes up. So each window of words has among the
symbols that it settles one of the highest level, its anchor, and equal windows have equal anchors.
Windows with one anchor are then verified by a second hash of all their words: a false repeat would
need both 64-bit hashes to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Rolling, discard, mix, release, saved, slices, span_hashes, spans, union_spans, with_row_key

#: Rounds of naming runs and pairs. A symbol must be settled within a window: further rounds leave
#: fewer symbols that are, and so more anchors.
ROUNDS = 2
#: Windows of one anchor's different ranges that one task compares.
GROUP_WINDOWS = 500_000
_words, _contexts, _spans_of, _windows = Rolling(11), Rolling(12), Rolling(13), Rolling(14)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, their hashes, and each row's offsets in these."""
    starts, ends = spans(~IS_SPACE[data], offsets)
    hashes = span_hashes(_words, data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def levels(name: np.ndarray, border: np.ndarray, window: int, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key and dependency [low, high) of the symbols of each level that fit in a window.

    border: places between texts, the first and the last among them; they keep every round and are
    never in a window, so what depends on a text's end is left out.
    """
    low = np.arange(len(name))
    high = low + 1
    level = 0
    while True:
        fits = (high - low <= window) & ~border
        if not fits.any():
            return
        yield mix(name[fits] + np.uint64(level)), low[fits], high[fits]
        if level >= 2 * rounds:
            return
        n = len(name)
        if level % 2 == 0:  # runs
            joined = (name[1:] == name[:-1]) & ~border[1:] & ~border[:-1]
            first = np.flatnonzero(np.concatenate([[True], ~joined]))
            last = np.concatenate([first[1:], [n]]) - 1
            length = (last - first + 1).astype(np.uint64)
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
            edge = border[first]
            new_low, new_high = np.where(edge, low[first], low[before]), np.where(edge, high[first], high[after])
            name = np.where(length > 1, mix(name[first] ^ (length * np.uint64(0x9E3779B97F4A7C15))), name[first])
            low, high, border = new_low, new_high, edge
        else:  # pairs
            right = (mix(name ^ np.uint64(0xA5A5 + level)) >> np.uint64(63)).astype(bool)
            pair = ~right[:-1] & right[1:] & ~border[:-1] & ~border[1:]
            is_second = np.concatenate([[False], pair])
            first = np.flatnonzero(~is_second)
            paired = np.concatenate([pair, [False]])[first]
            second = np.minimum(first + 1, n - 1)
            edge = border[first]
            alone_right = right[first] & ~paired & ~edge
            new_low = np.where(alone_right, low[np.maximum(first - 1, 0)], low[first])
            new_high = np.where(edge | alone_right, high[first], high[second])
            name = np.where(paired, mix(name[first] * np.uint64(3) + mix(name[second])), name[first])
            low, high, border = new_low, new_high, edge
        level += 1


def first_least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """For each non-empty range [lo, hi), of most places at most, the first place of its least key."""
    best = [np.arange(len(key))]
    while 2 ** len(best) <= most:
        last, step = best[-1], 2 ** (len(best) - 1)
        left, right = last[: max(0, len(last) - step)], last[step:]
        best.append(np.where(key[left] <= key[right], left, right))
    out = np.empty(len(lo), np.int64)
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in range(len(best)):
        own = np.flatnonzero(power == k)
        left, right = best[k][lo[own]], best[k][hi[own] - 2**k]
        out[own] = np.where(key[left] <= key[right], left, right)
    return out


def anchored(hashes: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS):
    """Ranges of windows that share an anchor: its key, the row, the first window's word (within
    the row) and the number of windows. first: each row's offsets in hashes.

    The key also takes half of the window's other words, on the side of the anchor where more of
    them are: equal windows agree on these, while a short anchor alone comes up by chance."""
    n_rows = len(first) - 1
    n_words = np.diff(first)
    total = int(first[-1]) + n_rows + 1
    # a border before each row and after the last
    border = np.zeros(total, bool)
    border[first + np.arange(n_rows + 1)] = True
    name = np.empty(total, np.uint64)
    name[~border] = hashes
    name[border] = mix(np.arange(n_rows + 1, dtype=np.uint64))
    starts = np.maximum(n_words - window + 1, 0)
    upto = np.zeros(n_rows + 1, np.int64)
    np.cumsum(starts, out=upto[1:])
    row = np.repeat(np.arange(n_rows), starts)
    place = np.arange(int(upto[-1])) - upto[row] + first[row] + row + 1  # of each window's first word, borders counted
    keys, anchor, end = np.empty(len(place), np.uint64), np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    todo = np.arange(len(place))
    for key, low, high in reversed(list(levels(name, border, window, rounds))):
        if not len(todo):
            break
        lo, hi = np.searchsorted(low, place[todo]), np.searchsorted(high, place[todo] + window, "right")
        ok = lo < hi
        one, lo, hi = todo[ok], lo[ok], hi[ok]
        least = first_least(key, lo, hi, window)
        keys[one], anchor[one], end[one] = key[least], low[least], high[least]
        todo = todo[~ok]
    if not len(place):
        return keys, row, anchor, anchor
    half = (window - end + anchor) // 2
    right = place + window - end >= anchor - place
    context = np.where(right, end, anchor - half)
    keys = mix(keys ^ mix(_contexts.of(_contexts.prefix(name), context, context + half) + right))
    new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (keys[1:] != keys[:-1])])
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(place)]]))
    return keys[begin], row[begin], begin - upto[row[begin]], n


def repeated(docs: DataFrame, window: int = 35, text: str = "text", row: tuple[str, str] = ("r", "q"), group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """(r, q, start, n): ranges of windows, by first word, whose words also stand elsewhere.

    docs: has a two-part row key, which is alike only for rows that are.

    Each document gives its ranges with a common anchor, with a hash of the range's whole words.
    An anchor that comes up once is dropped. Where all ranges of an anchor are equal, all their
    windows repeat. Else equal ranges are folded into one, and the windows of an anchor's different
    ranges are compared one by one: in one task, or, if the anchor has over group_windows of them,
    as rows that are counted by window.
    """
    r, q = row

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, data, offsets in slices(batch, text, 500_000):
                _, _, hashes, first = word_hashes(data, offsets)
                key, at, start, n = anchored(hashes, first, window)
                begin = first[at] + start
                span = _spans_of.of(_spans_of.prefix(hashes), begin, begin + n + window - 1)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), part.column(r).take(rows), part.column(q).take(rows),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "span", "r", "q", "start", "n"],
                )

    found = saved(docs.select(r, q, text).mapInArrow(occurrences, "key long, span long, r long, q int, start int, n int"))
    anchors = saved(found.groupBy("key").agg(F.count("*").alias("times"), (F.min("span") == F.max("span")).alias("alike")).where("times > 1"))
    shared = saved(found.join(anchors.select("key", "alike"), "key"))
    discard(found, anchors)
    marks = shared.where("alike").select("r", "q", "start", "n")

    mixed = shared.where("not alike").select("key", "span", "r", "q", "start", "n")
    ranges = saved(mixed.groupBy("key", "span").agg(F.count("*").alias("times"), F.min(F.struct("r", "q", "start", "n")).alias("one")))
    marks = marks.union(mixed.join(ranges.where("times > 1").select("key", "span"), ["key", "span"]).select("r", "q", "start", "n"))
    sizes = ranges.groupBy("key").agg(F.sum("one.n").alias("size"))
    large = saved(sizes.where(F.col("size") > group_windows).select("key", F.lit(True).alias("large")))
    wanted = (
        ranges.join(large, "key", "left")
        .select(F.col("one.r").alias("wr"), F.col("one.q").alias("wq"), "key", "one.start", "one.n",
                (F.col("times") == 1).alias("open"), F.coalesce("large", F.lit(False)).alias("large"))
        .groupBy("wr", "wq").agg(F.collect_list(F.struct("key", "start", "n", "open", "large")).alias("wanted"))
    )
    texts = docs.join(wanted, (F.col(r) == F.col("wr")) & (F.col(q) == F.col("wq")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of equal rows one is cut
        for batch in batches:
            fresh = []
            for own in zip(batch.column(r).to_pylist(), batch.column(q).to_pylist(), strict=True):
                fresh.append(own not in seen)
                seen.add(own)
            for part, data, offsets in slices(batch.filter(pa.array(fresh, pa.bool_())), text, 500_000):
                _, _, hashes, first = word_hashes(data, offsets)
                lists = part.column("wanted")
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                items, rows = lists.flatten(), pa.array(at)
                start, n = items.field(1).to_numpy(), items.field(2).to_numpy()
                ends = np.cumsum(n)
                begin = np.repeat(first[at] + start, n) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
                own = _windows.of(_windows.prefix(hashes), begin, begin + window)
                upto = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [items.field(0), part.column(r).take(rows), part.column(q).take(rows), items.field(1), items.field(3), items.field(4),
                     pa.ListArray.from_arrays(upto, pa.array(own.view(np.int64)))],
                    names=["key", "r", "q", "start", "open", "large", "windows"],
                )

    cuts = texts.mapInArrow(windows, "key long, r long, q int, start int, open boolean, large boolean, windows array<long>")
    again = not large.isEmpty()
    if again:
        cuts = saved(cuts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered."""
        names = ["key", "r", "q", "start", "open", "windows"]
        held: list[pa.RecordBatch] = []

        def matches() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            same = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "r", "q", "start")])
            order = np.lexsort(same[::-1])
            once = np.ones(len(order), bool)  # equal rows that several tasks have cut come once
            once[1:] = (same[:, order[1:]] != same[:, order[:-1]]).any(0)
            if not once.all():
                rows = rows.take(pa.array(order[once])).combine_chunks()
            lists = rows.column("windows").combine_chunks()
            n = lists.value_lengths().to_numpy().astype(np.int64)
            one = np.repeat(np.arange(len(n)), n)
            own = mix(lists.flatten().to_numpy().view(np.uint64) ^ mix(rows.column("key").to_numpy().view(np.uint64))[one])
            _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((times[inverse] > 1) & rows.column("open").to_numpy(zero_copy_only=False)[one])
            place = rows.column("start").to_numpy()[one[hit]] + hit - (np.cumsum(n) - n)[one[hit]]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(one[hit]) > 0)])) if len(hit) else hit
            take = pa.array(one[hit[new]])
            return pa.RecordBatch.from_arrays(
                [rows.column("r").combine_chunks().take(take), rows.column("q").combine_chunks().take(take), pa.array(place[new].astype(np.int32)),
                 pa.array(np.diff(np.concatenate([new, [len(hit)]])).astype(np.int32))],
                names=["r", "q", "start", "n"],
            )

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if held and size > group_windows and (last or held[-1].column(0)[-1].as_py() != key[0]):
                held.append(batch.slice(0, last))
                yield matches()
                held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += len(batch.column(names.index("windows")).flatten())
        if held:
            yield matches()

    columns = ["key", "r", "q", "start", "open", "windows"]
    small = (cuts.where("not large") if again else cuts).select(*columns)
    marks = marks.union(small.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "r long, q int, start int, n int"))
    if again:
        one = cuts.where("large").groupBy("key", "r", "q", "start", "open").agg(F.first("windows").alias("windows"))
        single = saved(one.select("key", "r", "q", "start", "open", F.posexplode("windows").alias("place", "own")))
        twice = single.groupBy("key", "own").agg(F.count("*").alias("times")).where("times > 1").select("key", "own")
        marks = marks.union(
            single.where("open").join(twice, ["key", "own"]).select("r", "q", (F.col("start") + F.col("place")).alias("start"), F.lit(1).alias("n"))
        )
    out = saved(marks)
    discard(shared, ranges, large, *([cuts, single] if again else []))
    return out


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", keep_text: bool = True, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """docs with n_words, n_removed, removed_spans, kept_sha256 and (keep_text) kept_text.

    Words are runs of all but white space. Every word is removed that a window of ``window``
    consecutive words covers whose words, in that order, also start anywhere else, in the same
    document too; windows are judged on the input. kept_text joins the kept words by one space;
    kept_sha256 is the SHA-256 of its UTF-8 bytes; removed_spans are the maximal removed runs.

    Null or empty text: no words, kept_text ''. Documents of fewer words than a window keep all.
    Repeated rows lose all windows. An empty table gives an empty result; other columns are kept,
    but those named above replace columns of these names.
    """
    import hashlib

    new = ["n_words", "n_removed", "removed_spans", "kept_sha256", "kept_text"]
    docs = docs.drop(*new)
    r, q, marks = with_row_key(docs, "r", "q", "marks")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    keyed = docs.withColumns({r: F.xxhash64(*hashed), q: F.hash(F.reverse(F.col(text)))})
    found = repeated(keyed, window, text, (r, q), group_windows).groupBy(F.col("r").alias(f"{r}_m"), F.col("q").alias(f"{q}_m")).agg(
        F.collect_set(F.struct("start", "n")).alias(marks)
    )
    joined = keyed.join(found, (F.col(r) == F.col(f"{r}_m")) & (F.col(q) == F.col(f"{q}_m")), "left").drop(f"{r}_m", f"{q}_m")

    from pyspark.sql import types as T

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
              T.StructField("kept_sha256", T.StringType())] + ([T.StructField("kept_text", T.StringType())] if keep_text else [])
    schema = T.StructType([*docs.schema.fields, *fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                starts, ends = spans(~IS_SPACE[data], offsets)
                first = np.searchsorted(starts, offsets)
                lists = part.column(marks).fill_null([])
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                items = lists.flatten()
                start, n = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                row, lo, hi = union_spans(at, start, start + n + window - 1)
                n_removed = np.zeros(part.num_rows, np.int64)
                np.add.at(n_removed, row, hi - lo)
                upto = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                raw, kept, digests = data.tobytes(), [], []
                for i in range(part.num_rows):
                    words, pieces, done = raw[offsets[i] : offsets[i + 1]].split(), [], 0
                    for a, b in zip(lo[upto[i] : upto[i + 1]].tolist(), hi[upto[i] : upto[i + 1]].tolist(), strict=True):
                        pieces += words[done:a]
                        done = b
                    rest = b" ".join(pieces + words[done:])
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if keep_text:
                        kept.append(rest.decode())
                cuts = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["start", "end"])).cast(span)
                arrays = [pa.array(np.diff(first)), pa.array(n_removed), cuts, pa.array(digests, pa.string())]
                if keep_text:
                    arrays.append(pa.array(kept, pa.string()))
                own_columns = [part.column(i) for i, f in enumerate(part.schema.names) if f not in (r, q, marks)]
                yield pa.RecordBatch.from_arrays([*own_columns, *arrays], names=schema.names)

    return joined.mapInArrow(removed, schema)
