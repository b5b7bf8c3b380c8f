"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, with_arrow_columns

#: Words whose counts a task remembers at most.
REMEMBERED = 400_000
#: A word's last byte is a symbol of its own, which only pieces that end a word have: so no other
#: piece can take it and leave a word's end without a piece.
LAST = 256


def symbols_of(raw: bytes, ends_word: bool) -> list[int]:
    return [*raw[:-1], raw[-1] + LAST] if ends_word else list(raw)


class LongestMatch:
    """Greedy word-piece lengths in one pass over a word's bytes.

    The trie's nodes have failure links, and with each link goes the number of pieces that
    following it closes; so a word's count is a sum over links, and no piece is ever built.
    pieces: bytes, not empty, and whether the piece ends a word; those that do are taken at a word's
    end only, and there no others. Words at which greedy matching gets stuck count as one (unknown)
    token.
    """

    def __init__(self, pieces: list[tuple[bytes, bool]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        accepts, symbols = [False], [(-1, -1)]
        for piece, whole_word in pieces:
            node = 0
            for symbol in symbols_of(piece, whole_word):
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    accepts.append(False)
                    symbols.append((node, symbol))
                node = self.next[node][symbol]
            accepts[node] = node > 0
        self.link: list[int] = [-1] * len(self.next)
        self.closes = [0] * len(self.next)
        order = [0]
        for node in order:
            order += self.next[node].values()
        for node in order[1:]:
            parent, symbol = symbols[node]
            if accepts[node]:
                self.link[node], self.closes[node] = 0, 1
                continue
            at, closed = self.link[parent], self.closes[parent]
            while at >= 0 and symbol not in self.next[at]:
                closed += self.closes[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.closes[node] = self.next[at][symbol], closed

    def count(self, word: bytes) -> int:
        node, n = 0, 0
        for symbol in symbols_of(word, True):
            while symbol not in self.next[node]:
                if self.link[node] < 0:
                    return 1
                n += self.closes[node]
                node = self.link[node]
            node = self.next[node][symbol]
        while node:
            if self.link[node] < 0:
                return 1
            n += self.closes[node]
            node = self.link[node]
        return n


class Remembered(dict):
    def __init__(self, automaton: LongestMatch) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word)
        if len(word) < 100:
            self[word] = n
        return n


def byte_symbols() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow 255 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str, word_end: str = "</w>") -> list[tuple[bytes, bool]]:
    """Pieces of a tokenizer's JSON file whose pieces are spelt in the byte-level alphabet."""
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = []
    for piece in vocabulary:
        stem = piece.removesuffix(word_end)
        if stem and all(c in symbols for c in stem):
            out.append((bytes(symbols[c] for c in stem), stem != piece))
    return sorted(out)


def count_tokens(docs: DataFrame, pieces: list[tuple[bytes, bool]], text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens, the sum of its words' greedy longest-match piece counts.

    Words are runs of all but white space, with A-Z lower-cased. The vocabulary is broadcast: its
    size does not depend on the data. A word that the pieces can't spell is one token.

    Null or empty text: 0. Repeated rows stay; an empty table gives an empty result; other columns
    are kept, but n_words and n_tokens replace columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        counts, raw = kept(key, lambda: Remembered(LongestMatch(shared.value))), data.tobytes().lower()
        words = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n_tokens = [sum(map(counts.__getitem__, w)) for w in words]
        return [pa.array(map(len, words), pa.int64()), pa.array(n_tokens, pa.int64())]

    return with_arrow_columns(docs, "n_words long, n_tokens long", compute, text)
