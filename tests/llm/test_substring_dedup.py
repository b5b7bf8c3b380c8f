import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm.substring_dedup import remove_repeats


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept))
    return out


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    free = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, twice = free(50), free(35)
    out = [None, "", " \n\t", "a " * 34, "a " * 35, "a " * 36, "b " * 200, "b " * 80, "x y " * 60, free(3) + " x y" * 25, free(2000)]
    out += [free(rng.randrange(40)) + " " + shared + "\n" + free(rng.randrange(40)) for _ in range(12)]
    out += [free(20) + " " + twice + " " + free(9) + "  " + twice, free(34), out[-1], out[-1]]
    near = free(300).split()
    for _ in range(8):
        w = list(near)
        for k in rng.sample(range(300), 4):
            w[k] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    for window, group_windows in ((35, 500_000), (8, 500_000), (8, 40)):
        rows = texts()
        docs = spark.createDataFrame([(i % 30 if i else None, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, r string")
        got = remove_repeats(docs, window, group_windows=group_windows).collect()
        assert all(r.r == "z" for r in got)
        expected = brute(rows, window)
        assert Counter((r.text, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got) == Counter(
            (t, *e, hashlib.sha256(e[2].encode()).hexdigest()) for t, e in zip(rows, expected, strict=True)
        )
        assert all(sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in got)


def test_many_equal_rows(spark):
    rng = random.Random(4)
    free = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n))
    a, b = free(90), free(40)
    near = " ".join([*a.split()[:30], b])
    docs = spark.createDataFrame([(1, a)] * 3000 + [(2, near), (3, b + " " + " ".join(a.split()[40:]))], "doc_id long, text string")
    for group_windows in (500_000, 20):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, 8, group_windows=group_windows).collect())
        own, _, other, last = brute([a, a, near, b + " " + " ".join(a.split()[40:])], 8)
        assert got == Counter({(1, *own): 3000, (2, *other): 1, (3, *last): 1})


def test_long_words(spark):
    """Words that a sum modulo 2**64 can't tell apart are told apart."""
    word = lambda n, flip: "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))
    rows = [" ".join([word(4096, k)] + [f"x{i}" for i in range(5)]) for k in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(docs, 6).collect()] == [0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert remove_repeats(docs).withColumn("x", F.lit(1)).count() == 0
