"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of words. A word enters as a word vector and as its
characters' n-gram vectors, each with the log-odds of the label where it was seen in training. Two
gated recurrences read a window forwards and backwards, attention pools their states, and the
window with the highest score speaks for the text.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, kept, spans, with_arrow_columns

#: Words of a window, and words between the starts of two windows.
WINDOW, STRIDE = 32, 24
#: States of each direction, numbers of a vector, and rows of the word and n-gram tables (by hash).
HIDDEN, WIDTH, ROWS = 8, 6, 1 << 17
GRAMS = (3, 4, 5)
#: Labelled documents of either label that training looks at, and bytes that they have at most.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1_000, 2_000, 6_000
#: Bytes of whole texts hashed at once, and training documents whose n-grams are counted at once.
PIECE, COUNTED = 500_000, 100
#: Windows that go through the recurrence at once.
CHUNK = 8_192
#: What word and n-gram vectors lose in a step of training.
DECAY = 0.02
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True
_hash = Rolling(31)


@dataclass
class Words:
    """Words of some texts: their places among the distinct words, each row's first word, and each
    distinct word's rows of the word table and of the n-gram table."""

    place: np.ndarray
    first: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        low = LOWER[data]
        starts, ends = spans(IS_WORD[low], offsets)
        hashes = np.empty(len(starts), np.uint64)
        borders = np.unique(np.append(offsets[np.searchsorted(offsets, np.arange(0, len(data), PIECE))], len(data)))
        for a, b in zip(borders[:-1], borders[1:], strict=True):  # hashing takes many times the memory of the text
            i, j = np.searchsorted(starts, (a, b))
            hashes[i:j] = _hash.of(_hash.prefix(low[a:b]), starts[i:j] - a, ends[i:j] - a)
        distinct, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        first_word = np.searchsorted(starts, offsets)
        starts, length = starts[at], ends[at] - starts[at]
        # distinct words side by side, each between two border bytes
        begin = np.concatenate([[0], np.cumsum(length + 2)])
        joined = np.ones(int(begin[-1]), np.uint8)
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(begin[:-1] + 1, length) + step] = low[np.repeat(starts, length) + step]
        prefix = _hash.prefix(joined)
        n_grams = np.stack([np.maximum(length + 3 - n, 1) for n in GRAMS], 1)
        first = np.concatenate([[0], np.cumsum(n_grams.reshape(-1))])
        owner = np.repeat(np.arange(n_grams.size), n_grams.reshape(-1))
        start = begin[owner // len(GRAMS)] + np.arange(int(first[-1])) - first[owner]
        size = np.minimum(np.array(GRAMS)[owner % len(GRAMS)], length[owner // len(GRAMS)] + 2)
        gram = (_hash.of(prefix, start, start + size) % np.uint64(ROWS)).astype(np.int32)
        return cls(place.astype(np.int32), first_word, (distinct % np.uint64(ROWS)).astype(np.int32), gram, first[:: len(GRAMS)])


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of all windows: every STRIDE words one starts, until one reaches the
    row's last word. Rows without words have none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + k * STRIDE
    return row, start, np.minimum(start + WINDOW, first[row + 1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters, in ``p``, and the network's forward and backward passes."""

    def __init__(self, seed: int = 5, rows: int = ROWS, dtype: type = np.float32) -> None:
        rng = np.random.default_rng(seed)
        d, h = 2 * WIDTH + 2, HIDDEN
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(dtype)
        self.p = {
            "word": normal(0.1, rows, WIDTH), "gram": normal(0.1, rows, WIDTH),
            "input": normal(d**-0.5, d, 6 * h), "bias": np.zeros(6 * h, dtype),
            "forth": normal(h**-0.5, h, 3 * h), "back": normal(h**-0.5, h, 3 * h),
            "attend": normal(0.5, 2 * h), "out": normal(0.5, 2 * h), "shift": np.zeros(1, dtype),
        }
        self.word_odds, self.gram_odds = np.zeros(rows, dtype), np.zeros(rows, dtype)
        self.prior = 0.0

    def vectors(self, w: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the distinct words ``some``; the n-gram rows of these and their numbers."""
        n = (w.gram_first[some + 1] - w.gram_first[some]).astype(np.int64)
        upto = np.cumsum(n) - n
        grams = w.gram[np.repeat(w.gram_first[some] - upto, n) + np.arange(int(n.sum()))]
        word = w.word[some]
        if not len(some):
            return np.zeros((0, 2 * WIDTH + 2), self.p["word"].dtype), grams, n
        mean = np.add.reduceat(self.p["gram"][grams], upto) / n[:, None].astype(self.p["gram"].dtype)
        most = np.maximum.reduceat(self.gram_odds[grams], upto)
        return np.hstack([self.p["word"][word], self.word_odds[word][:, None], mean, most[:, None]]), grams, n

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of all gates, and a last row, for places after a window's end, whose update gates keep the state."""
        h = HIDDEN
        end = np.zeros((1, 6 * h), x.dtype)
        end[0, :h] = end[0, 3 * h : 4 * h] = 50
        return np.vstack([x @ self.p["input"] + self.p["bias"], end])

    def scan(self, gates: np.ndarray, places: np.ndarray, u: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
        """States after each of the steps through windows (rows of places)."""
        h = HIDDEN
        states = np.empty((places.shape[1], len(places), h), gates.dtype)
        state = np.zeros((len(places), h), gates.dtype)
        for t in steps:
            g, s = gates[places[:, t]], state @ u
            zr = sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
            z, r, q = zr[:, :h], zr[:, h:], s[:, 2 * h :]
            new = np.tanh(g[:, 2 * h :] + r * q)
            if keep is not None:
                keep.append((t, state, z, r, q, new))
            state = new + z * (state - new)
            states[t] = state
        return states

    def pooled(self, states: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.where(inside, states @ self.p["attend"], -1e9)
        share = np.exp(a - a.max(0))
        share /= share.sum(0)
        return share, np.einsum("tb,tbh->bh", share, states)

    def logits(self, gates: np.ndarray, places: np.ndarray) -> np.ndarray:
        out, h = np.empty(len(places), gates.dtype), HIDDEN
        forth, back = np.ascontiguousarray(gates[:, : 3 * h]), np.ascontiguousarray(gates[:, 3 * h :])
        for lo in range(0, len(places), CHUNK):
            part = places[lo : lo + CHUNK]
            ts = range(part.shape[1])
            states = np.concatenate([self.scan(forth, part, self.p["forth"], ts), self.scan(back, part, self.p["back"], ts[::-1])], 2)
            _, pooled = self.pooled(states, (part < len(gates) - 1).T)
            out[lo : lo + CHUNK] = pooled @ self.p["out"] + self.p["shift"]
        return out

    def gradients(self, w: Words, some: np.ndarray, places: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows (rows of places, which index some) and its gradients."""
        h, p = HIDDEN, self.p
        x, grams, n_grams = self.vectors(w, some)
        gates = self.gates(x)
        kept: tuple[list, list] = ([], [])
        ts = range(places.shape[1])
        states = np.concatenate([
            self.scan(gates[:, : 3 * h], places, p["forth"], ts, kept[0]), self.scan(gates[:, 3 * h :], places, p["back"], ts[::-1], kept[1]),
        ], 2)
        share, pooled = self.pooled(states, (places < len(some)).T)
        guess = sigmoid(pooled @ p["out"] + p["shift"])
        loss = -np.mean(np.log(np.where(label == 1, guess, 1 - guess) + 1e-9))
        d_logit = (guess - label).astype(x.dtype) / len(label)
        grad = {"out": pooled.T @ d_logit, "shift": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_share = np.einsum("tbh,bh->tb", states, d_pooled)
        d_attend = share * (d_share - (share * d_share).sum(0))
        grad["attend"] = np.einsum("tb,tbh->h", d_attend, states)
        d_states = share[:, :, None] * d_pooled + d_attend[:, :, None] * p["attend"]
        d_gates = np.zeros_like(gates)
        for side, name in enumerate(("forth", "back")):
            u, d_u, d_state = p[name], np.zeros_like(p[name]), np.zeros((len(places), h), x.dtype)
            for t, before, z, r, q, new in reversed(kept[side]):
                d_state = d_state + d_states[t, :, side * h : side * h + h]
                d_new = d_state * (1 - z) * (1 - new * new)
                d_z = d_state * (before - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                np.add.at(d_gates[:, side * 3 * h : side * 3 * h + 3 * h], places[:, t], np.hstack([d_z, d_r, d_new]))
                inner = np.hstack([d_z, d_r, d_new * r])
                d_u += before.T @ inner
                d_state = d_state * z + inner @ u.T
            grad[name] = d_u
        d_gates = d_gates[:-1]
        grad["input"], grad["bias"] = x.T @ d_gates, d_gates.sum(0)
        d_x = d_gates @ p["input"].T
        grad["word"], grad["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(grad["word"], w.word[some], d_x[:, :WIDTH])
        np.add.at(grad["gram"], grams, np.repeat(d_x[:, WIDTH + 1 : -1] / n_grams[:, None].astype(x.dtype), n_grams, 0))
        return loss, grad

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score for each row of text bytes; rows without words get the share of label 1 in training."""
        w = Words.read(data, offsets)
        row, start, end = windows_of(w.first)
        out = np.full(len(offsets) - 1, self.prior)
        if len(row):
            gates = self.gates(self.vectors(w, np.arange(len(w.word)))[0])
            guess = sigmoid(self.logits(gates, places_of(w.place, start, end, len(w.word))).astype(np.float64))
            new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[new]] = np.maximum.reduceat(guess, new)
        return out


def places_of(place: np.ndarray, start: np.ndarray, end: np.ndarray, after: int) -> np.ndarray:
    """The windows' words, one window a row; ``after`` stands past a window's end."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], place[np.minimum(at, len(place) - 1)], after).astype(np.int32)


def seen_in(rows: np.ndarray, doc: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """For either label, the number of documents that have each table row."""
    pairs = np.unique(doc.astype(np.int64) * size + rows)
    return np.stack([np.bincount(pairs[label[pairs // size] == k] % size, minlength=size) for k in (0, 1)])


def log_odds(seen: np.ndarray, label: np.ndarray, weight: float = 8.0) -> np.ndarray:
    """Log-odds of label 1 for each table row, by the documents that have it, against all documents';
    ``weight`` documents of the sample's mix are added, so a row that few have says little."""
    share = label.mean()
    return (np.log((seen[1] + weight * share) / (seen[0] + weight * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)


def fit(texts: list[str], labels: list[int], steps: int = 200, batch: int = 100, rate: float = 0.01, seed: int = 5) -> Network:
    """A network trained on whole labelled texts, by so many steps of Adam, in whole epochs.

    A text counts by its window with the highest score, and in the first half of the steps by the one
    with the highest log-odds. Without texts of both labels all scores are the share of label 1."""
    net = Network(seed)
    label = np.array(labels, np.int64)
    net.prior = min(0.49, float((label.sum() + 0.5) / (len(label) + 5)))
    net.p["shift"][:] = np.log(net.prior / (1 - net.prior))
    if not 0 < label.sum() < len(label):
        net.p["out"][:] = 0
        return net
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    w = Words.read(np.frombuffer(b"".join(raw), np.uint8), offsets)
    doc = np.repeat(np.arange(len(label)), np.diff(w.first))
    net.word_odds = log_odds(seen_in(w.word[w.place], doc, label, ROWS), label)
    used, seen = np.unique(doc * np.int64(len(w.word)) + w.place), np.zeros((2, ROWS), np.int64)
    cuts = np.searchsorted(used // len(w.word), np.arange(0, len(label) + COUNTED, COUNTED))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        word = used[lo:hi] % len(w.word)
        n = w.gram_first[word + 1] - w.gram_first[word]
        grams = w.gram[np.repeat(w.gram_first[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        seen += seen_in(grams, np.repeat(used[lo:hi] // len(w.word), n), label, ROWS)
    net.gram_odds = log_odds(seen, label)
    odds = np.maximum(net.word_odds[w.word], np.maximum.reduceat(net.gram_odds[w.gram], w.gram_first[:-1]))
    row, start, end = windows_of(w.first)
    of_row = np.searchsorted(row, np.arange(len(label) + 1))
    full = np.flatnonzero(np.diff(of_row))
    full = np.concatenate([full, *[full[label[full] == 1]] * max(0, round(len(full) / (3 * max(1, label.sum()))) - 1)])  # a third has label 1
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step, epochs = 0, -(-steps // max(1, -(-len(full) // batch)))
    for epoch in range(epochs if len(full) else 0):
        order = rng.permutation(full)
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            count = of_row[docs + 1] - of_row[docs]
            at = np.cumsum(count) - count
            windows = np.repeat(of_row[docs] - at, count) + np.arange(int(count.sum()))
            places = places_of(w.place, start[windows], end[windows], len(w.word))
            some, local = np.unique(places, return_inverse=True)
            local = local.reshape(places.shape).astype(np.int32)
            if some[-1] == len(w.word):
                some = some[:-1]
            if 2 * epoch >= epochs:
                score = net.logits(net.gates(net.vectors(w, some)[0]), local)
            else:
                score = np.append(odds, -np.inf)[places].max(1)
            best = np.array([a + int(np.argmax(score[a : a + c])) for a, c in zip(at, count, strict=True)])
            _, grad = net.gradients(w, some, local[best], label[docs])
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            for k in ("word", "gram"):  # vectors of what few texts have stay near zero
                net.p[k] *= 1 - DECAY
    return net


def labelled_sample(
    docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES,
    text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
) -> tuple[list[str], list[int]]:
    """Texts and labels: of each label the first documents by a hash, of at most most_bytes.

    Only ids that can be needed go to the scan of docs (four times the sample's bound), where they
    are broadcast; rows with a null label or text are left out."""
    ids = None
    for value, n in ((1, n_toxic), (0, n_clean)):
        own = labels.where(F.col(label) == value).select(F.col(doc_id).alias("id"), F.lit(value).alias("y"))
        own = own.dropDuplicates().orderBy(F.xxhash64("id"), "id").limit(4 * n)
        ids = own if ids is None else ids.union(own)
    short = docs.where(F.octet_length(text) <= most_bytes).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = short.join(F.broadcast(ids), "id").withColumn("h", F.xxhash64("text"))
    out: dict[str, int] = {}
    for value, n in ((1, n_toxic), (0, n_clean)):
        rows = found.where(F.col("y") == value).orderBy("h", "text").limit(n).select("text").collect()
        out |= {r.text: value for r in rows if r.text not in out}
    return list(out), list(out.values())


def score_toxicity(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs with toxicity, from 0 to 1: the highest score of any window of the whole text.

    Null, empty or wordless text: the share of label 1 in training, below 0.5. Long texts are
    scored in all windows. Repeated rows stay; an empty table gives an empty result; other columns
    are kept, but toxicity replaces a column of this name. The network is broadcast: its size does
    not depend on the data.
    """
    packed = pickle.dumps(network)
    key, shared = hashlib.sha256(packed).hexdigest(), docs.sparkSession.sparkContext.broadcast(packed)

    def compute(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        network = kept(key, lambda: pickle.loads(shared.value))
        return [pa.array(network.scores(data, offsets), pa.float64())]

    return with_arrow_columns(docs, "toxicity double", compute, text)
