"""Language identification by cross-parsing against labelled text of each language."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, with_arrow_columns

#: Labelled documents of a language that are learnt from at most, the bytes up to which they are taken by
#: hash alone, those up to which one is taken at all, and the bytes of normalised text that all have at most.
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST_BYTES, TRAIN_BYTES = 200, 1_000, 1_000_000, 48_000
#: Symbols of a text that are parsed in one lane, side by side with the others.
BLOCK = 512
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z, and Latin-1 capitals in UTF-8) with each run of ASCII non-letters
    as one space; offsets of the rows in them."""
    low = data.copy()
    capital = (low >= 65) & (low <= 90)
    low[capital] += 32
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = data[second]
    low[second[(latin >= 0x80) & (latin <= 0x9E) & (latin != 0x97)]] += 32
    gap = ~LETTERS[low]
    low[gap] = 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    first = offsets[:-1][offsets[:-1] < len(keep)]
    keep[first] |= gap[first]
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return low[keep], kept[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of text; 0 is its start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, at = len(moves), last
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """Phrase counts of texts against one language's text: each phrase is the longest match of
    what follows with any substring of that text, and one symbol where there is none."""

    def __init__(self, text: bytes, classes: np.ndarray, n_classes: int) -> None:
        moves = suffix_automaton(text)
        self.n = n_classes
        self.table = np.zeros((len(moves) + 1) * n_classes, np.int32)  # row 0: no match; row 1: the start
        for state, row in enumerate(moves):
            for c, to in row.items():
                self.table[(state + 1) * n_classes + classes[c]] = (to + 1) * n_classes
        self.weight = float(np.log2(len(text) + 2))

    def phrase_starts(self, lanes: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Where phrases start. lanes: symbols, one block a column; goes_on: blocks that go on with the text of
        the column before.

        Every block is first parsed as if a phrase started with it. Then each goes on with the phrase that
        is open at the end of the one before, up to the first start that both ways have in common,
        from which on they agree. Where a block has none, the next one is parsed again."""
        out = np.empty(lanes.shape, bool)
        state = np.zeros(lanes.shape[1], np.int32)
        for t in range(len(lanes)):
            symbol = lanes[t]
            onward = self.table[state + symbol]
            starts = onward == 0 if t else np.ones(len(symbol), bool)
            out[t] = starts
            state = np.where(starts, self.table[self.n + symbol], onward)
        alone, end, todo = out.copy(), state, np.flatnonzero(goes_on)
        while len(todo):
            lane, state = todo, end[todo - 1]
            out[:, todo] = alone[:, todo]
            for t in range(len(lanes)):
                symbol = lanes[t, lane]
                onward = self.table[state + symbol]
                starts = onward == 0
                apart = ~(starts & alone[t, lane])
                state = np.where(starts, self.table[self.n + symbol], onward)[apart]
                out[t, lane] = starts
                lane = lane[apart]
                if not len(lane):
                    break
            end[lane] = state
            todo = lane + 1
            todo = todo[todo < len(goes_on)]
            todo = todo[goes_on[todo]]
        return out


class Model:
    def __init__(self, samples: list[tuple[str, bytes]]) -> None:
        self.langs = [lang for lang, _ in samples]
        seen = sorted({c for _, text in samples for c in text})
        classes = np.zeros(256, np.int32)  # class 0: bytes that no language has
        classes[seen] = np.arange(1, len(seen) + 1)
        self.classes = classes
        self.parsers = [CrossParser(text, classes, len(seen) + 1) for _, text in samples]

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits to name each row's phrases, by language. Rows are parsed each by itself and whole."""
        size = np.diff(offsets)
        lanes = -(-size // BLOCK)
        first = np.concatenate([[0], np.cumsum(lanes)])
        if not first[-1]:
            return np.zeros((len(size), len(self.langs)))
        begin = first[:-1] * BLOCK
        symbols = np.zeros(int(first[-1]) * BLOCK, np.int32)
        symbols[np.arange(len(data)) + np.repeat(begin - offsets[:-1], size)] = self.classes[data]
        symbols = np.ascontiguousarray(symbols.reshape(-1, BLOCK).T)
        goes_on = np.ones(int(first[-1]), bool)
        goes_on[first[:-1][lanes > 0]] = False
        out = np.empty((len(size), len(self.langs)))
        for k, parser in enumerate(self.parsers):
            starts = np.zeros(symbols.size + 1, np.int64)
            np.cumsum(parser.phrase_starts(symbols, goes_on).T.reshape(-1), out=starts[1:])
            out[:, k] = (starts[begin + size] - starts[begin]) * parser.weight
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """Normalised whole texts of documents of each non-null language: at most SAMPLE_DOCS of them, which together
    have at most TRAIN_BYTES. Those of up to SAMPLE_BYTES come first, by a hash of their text, then
    longer ones by size; the first is taken whatever it has, but for ones of over LONGEST_BYTES. Sorted
    by language; languages without text are left out."""
    size = F.octet_length(F.col(text).cast("string"))
    known = docs.where(F.col(lang).isNotNull() & (size > 0) & (size <= LONGEST_BYTES)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"), size.alias("size"))
    known = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(SAMPLE_BYTES)), "h", "text"))).where(F.col("k") <= SAMPLE_DOCS)
    # texts that can't be among the first TRAIN_BYTES stay where they are
    upto = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") <= 2 * TRAIN_BYTES)
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for row in known.select("lang", "k", "text").collect():
        by_lang.setdefault(row.lang, []).append((row.k, row.text.encode()))
    out = []
    for name, texts in sorted(by_lang.items()):
        kept_, seen = b"", set()
        for _, raw in sorted(texts):
            data, _ = normalised(np.frombuffer(raw + b" ", np.uint8), np.array([0, len(raw) + 1]))
            data = data.tobytes()
            if data in seen or kept_ and len(kept_) + len(data) > TRAIN_BYTES:
                continue
            seen.add(data)
            kept_ += data
        if LETTERS[np.frombuffer(kept_, np.uint8)].any():
            out.append((name, kept_))
    return out


def has_letter(raw: bytes) -> bool:
    return raw.lower().strip(b" ") != b"" and any(c.isalpha() for c in raw.decode(errors="replace"))


def identify_language(docs: DataFrame, samples: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score.

    Every whole text is parsed against every language's text; the language that needs the fewest
    bits (phrases times the bits that name a place in its text) wins, the first in order on ties.
    lang_score is one less the ratio of the best to the second best cost (1.0 with one language).
    The samples are broadcast: TRAIN_BYTES a language, or one longer text.

    Null, empty or letterless text, or no samples: ``und`` with score 0. Repeated rows stay; an
    empty table gives an empty result; other columns are kept, but lang_pred and lang_score
    replace columns of these names.
    """
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        model = kept(key, lambda: Model(shared.value))
        names = np.array([*model.langs, "und"], object)
        n_rows = part.num_rows
        ascii_letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTERS[data | 32] & (data < 128), out=ascii_letters[1:])
        lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~lettered):
            lettered[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
        best, score = np.full(n_rows, len(model.langs)), np.zeros(n_rows)
        if model.langs and n_rows:
            cost = model.costs(*normalised(data, offsets))
            order = np.sort(cost, axis=1)
            ratio = order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(model.langs) > 1 else np.zeros(n_rows)
            best, score = np.where(lettered, cost.argmin(1), best), np.where(lettered, 1 - ratio, 0.0)
        return [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())]

    return with_arrow_columns(docs, "lang_pred string, lang_score double", compute, text)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold
