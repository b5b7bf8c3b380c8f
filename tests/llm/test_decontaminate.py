import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontaminate
from tickloom.llm.decontaminate import contaminated, find_benchmark
from tickloom.llm.queries import op10_decontaminate

SF = "/root/testdata/sf0.01"
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if own := grams.get(tuple(w[i : i + m])):
                    found |= own
                    hit[i : i + m] = [True] * m
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("window", "block_bytes"), [(13, 4_000_000), (3, 60)])
def test_equals_brute_force(spark, window, block_bytes):
    rng = random.Random(4)
    vocabulary = ["Ünder", "b1", "cc", "Dd", "e", "über"]
    free = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, free(rng.randrange(0, 30))) for i in range(12)] + [(12, None), (None, "e e"), (13, "--"), (3, "cc Dd")]
    texts = [None, "", "...", free(400), free(5), *[f"{free(9)} {items[k][1]} {free(9)}" for k in range(12)], "e " * 30_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[5]])], "doc_id long, text string, n_hit string")
    got = find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"), window, block_bytes=block_bytes).collect()
    known = [(i, t) for i, t in items if i is not None and t is not None]
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 1
    for i, (n, hit, found) in enumerate(brute([*texts, texts[5]], known, window)):
        assert (by[i].n_words, by[i].n_hit, by[i].item_ids) == (n, hit, sorted(map(str, found)))
        assert sum(s.end - s.start for s in by[i].hit_spans) == hit
    none = spark.createDataFrame(items, "item_id long, text string").limit(0)
    assert all(r.n_hit == 0 for r in find_benchmark(docs, none).collect())
    assert find_benchmark(docs.limit(0), none).count() == 0


def test_string_ids_and_several_benchmarks_in_one_session(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    for text, ids in (("two three", ["b-10", "b-9"]), ("four five", []), ("One Two", ["b-10", "b-9"])):
        items = spark.createDataFrame([("b-9", text), ("b-10", text)], "item_id string, text string")
        assert find_benchmark(docs, items).first().item_ids == ids


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op10_decontaminate(spark, SF).collect()}
    for d, (n, hit, found) in zip(docs, brute([r.text for r in docs], items), strict=True):
        r = got[d.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0 and 20 * hit >= n)
    assert contaminated is not None


def test_an_item_above_the_block_size_goes_in_pieces(spark):
    """One long item, and many rows of one id: no block holds more than its size and a piece, and nothing is lost."""
    rng = random.Random(6)
    free = lambda n: " ".join(f"{rng.choice('abc')}{rng.randrange(9)}" for _ in range(n))
    long = free(3000)
    items = [("long", long), ("short", "a1 b2"), *[("same", free(40)) for _ in range(60)], ("wide", "x" * 5000 + " y z")]
    parts = long.split(" ")
    texts = [free(50) + " " + " ".join(parts[k : k + 25]) + " " + free(9) for k in range(0, 2950, 59)] + [items[5][1], "x" * 5000 + " y z", long, free(100)]
    benchmark = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    blocks = decontaminate._blocks(benchmark, 13, "item_id", "text", 4000, 1000)
    sizes = [r.s for r in blocks.groupBy("block").agg(F.sum(F.octet_length("text")).alias("s")).collect()]
    assert len(sizes) > 4 and max(s for s in sizes if s < 5000) <= 5000 and sorted(sizes)[-2] <= 5000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_benchmark(docs, benchmark, block_bytes=4000, piece_bytes=1000).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, sorted(found))


def test_pieces_hold_every_window():
    rng = random.Random(7)
    for n in (1, 12, 13, 14, 100, 500):
        words_ = [("w" * rng.randrange(1, 30) + str(i)).encode() for i in range(n)]
        pieces = [p.split() for p in decontaminate.pieces_of(b" ".join(words_), 13, 200)]
        grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        assert set().union(*map(grams, pieces)) == grams(words_)
        assert all(len(p) >= min(n, 13) for p in pieces)
