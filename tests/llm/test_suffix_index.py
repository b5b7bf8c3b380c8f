import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm.suffix_index import RunLengthIndex, long_matches, remove_long_repeats, suffix_order


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


def texts(window, seed=2):
    rng = random.Random(seed)
    free = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, near = free(window + 30), free(4 * window)
    out = [None, "", "a" * (window - 1), "a" * window, "a" * (window + 1), "b" * 3 * window, "xyz" * window, "q" + "xyz" * window, free(3 * window)]
    out += [free(rng.randrange(window)) + shared + free(rng.randrange(window)) for _ in range(12)]
    for _ in range(12):
        w = list(near)
        for k in rng.sample(range(len(w)), 3):
            w[k] = rng.choice("xyz")
        out.append("".join(w))
    return [*out, out[-1], out[-1], out[8] + out[8]]


def test_order_and_statistics():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 300), (4, 200), (1, 50), (200, 100)):
        text = rng.integers(97, 97 + alphabet, n).astype(np.uint8)
        raw = text.tobytes()
        assert suffix_order(text).tolist() == sorted(range(n), key=lambda i: raw[i:])
        index = RunLengthIndex(text)
        assert index.lengths.sum() == n

        def common(i, j):
            k = 0
            while max(i, j) + k < n and raw[i + k] == raw[j + k]:
                k += 1
            return k

        assert index.matching_statistics().tolist() == [max(common(i, j) for j in range(n) if j != i) for i in range(n)]
    found = long_matches([np.frombuffer(b"abcde", np.uint8), np.frombuffer(b"xbcd", np.uint8)], (2, 3))
    assert [[x.tolist() for x in f] for f in found] == [[[1, 2], [1, 2]], [[1], [1]]]


def checked(spark, rows, window, report, group_bytes=2_000_000):
    docs = spark.createDataFrame([(i % 20 if i else None, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, marks string")
    got = remove_long_repeats(docs, window, report=report, group_bytes=group_bytes).collect()
    assert all(r.marks == "z" for r in got)
    expected = Counter(
        (t, *e[:3], s[1], hashlib.sha256(e[3]).hexdigest()) for t, e, s in zip(rows, brute(rows, window), brute(rows, min(report, window)), strict=True)
    )
    assert Counter((r.text, r.n_bytes, r.n_removed, len(r.removed_spans), r.n_repeated, r.kept_sha256) for r in got) == expected
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got)
    return got


@pytest.mark.parametrize(
    ("window", "report", "group_bytes"), [(40, 40, 2_000_000), (40, 25, 2_000_000), (40, 25, 300), (40, 40, 300), (400, 250, 2_000_000), (400, 250, 3000)]
)
def test_equals_brute_force(spark, window, report, group_bytes):
    checked(spark, texts(window), window, report, group_bytes)


@pytest.mark.parametrize("window", [8192, 9000])
def test_long_windows(spark, window):
    rng = random.Random(5)
    free = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = free(9799)
    got = checked(spark, [free(300) + "x" + shared + "y" + free(100), free(77) + "z" + shared, free(12000)], window, 250)
    assert sum(r.n_removed for r in got) == 2 * 9799


def test_long_text_in_pieces(spark, monkeypatch):
    from tickloom.llm import suffix_index

    monkeypatch.setattr(suffix_index, "PIECE", 700)
    rng = random.Random(6)
    free = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    long = free(5000)
    long = long + free(333) + long[1000:4000]
    rows = [(1, long), (2, free(50) + long[2000:2600] + free(60))]
    own = np.array([2**31 - 1])
    keys = suffix_index.segments(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), 60, 24, own)
    assert keys[2].sum() == len(long) - 59
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_long_repeats(frame, 60, report=60).collect()}
    for (i, _), e in zip(rows, brute([t for _, t in rows], 60), strict=True):
        assert (got[i].n_removed, got[i].kept_bytes) == (e[1], e[3])


def test_many_equal_rows(spark):
    rng = random.Random(7)
    free = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    a, b = free(300), free(150)
    docs = spark.createDataFrame([(1, a)] * 3000 + [(2, a[:120] + b), (3, b + a[100:])], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed, r.kept_bytes) for r in remove_long_repeats(docs, 60, report=30).collect())
    expected = brute([a, a, a[:120] + b, b + a[100:]], 60)
    assert got == Counter({(1, expected[0][1], expected[0][3]): 3000, (2, expected[2][1], expected[2][3]): 1, (3, expected[3][1], expected[3][3]): 1})


def test_empty_table(spark):
    assert remove_long_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)).count() == 0
