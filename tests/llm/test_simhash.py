import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tickloom.llm.queries import op6_simhash
from tickloom.llm.simhash import BKTree, components, links, near_duplicates

SF = "/root/testdata/sf0.001"


def simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op6_simhash(spark, SF).collect()}
    assert len(got) == len(docs)
    prints = [simhash(r.text) for r in docs]
    for r, p, g in zip(docs, prints, groups(prints), strict=True):
        assert got[r.doc_id].fingerprint == f"{p:016x}"
        assert got[r.doc_id].component_id == docs[g].doc_id


def test_null_empty_long_and_repeated_texts(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "One two", "d"), (4, "one TWO", "d"), (5, "w " * 50_000, None), (None, "x y z", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("node", F.lit(1))
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert {by[(i, t)].component_id for i, t in [(1, None), (2, ""), (3, " \n")]} == {1}
    assert by[(4, "One two")].fingerprint == by[(4, "one TWO")].fingerprint != 0
    assert by[(1, None)].fp == "a" and by[(1, None)].node == 1
    assert near_duplicates(docs.limit(0)).count() == 0


def test_tree_finds_all_within_radius():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(10)})
    tree = BKTree(values)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def test_shards_cut_again_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            v = int(b)
            for bit in rng.integers(0, 12, 2):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for shard in (2, 10_000):
        got = {r.node: r.component for r in components(links(prints, 3, shard)).collect()}
        ours = [got.get(v, v) for v in values]
        theirs = groups([v & (2**64 - 1) for v in values])
        assert len(set(zip(ours, theirs, strict=True))) == len(set(ours)) == len(set(theirs))


def test_search_of_sets_loses_no_similar_pair():
    """The exact chance that a bit differs, for all small sets with a Jaccard similarity of 0.8 or more."""
    from math import comb

    from tickloom.llm.simhash import MISS, near_pairs, safe_radius

    def set_in_most(ones, n):
        return 2 * ones > n

    def differs(both, a, b):
        chance = [[comb(n, k) / 2**n for k in range(n + 1)] for n in (both, a, b)]
        return sum(
            x * y * z
            for i, x in enumerate(chance[0]) for j, y in enumerate(chance[1]) for k, z in enumerate(chance[2])
            if set_in_most(i + j, both + a) != set_in_most(i + k, both + b)
        )

    radius = safe_radius(0.8)
    most = max(differs(n - n // 5, a, n // 5 - a) for n in range(5, 60) for a in range(n // 5 + 1))
    assert sum(comb(128, k) * most**k * (1 - most) ** (128 - k) for k in range(radius + 1, 129)) < MISS
    assert radius < 64 - 5 and safe_radius(0.95) < radius < safe_radius(0.6)
    rng = random.Random(8)
    values = [rng.getrandbits(128) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(128)) for v in values] + values[:5]
    pairs = {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 57}
    found = list(zip(*near_pairs(values, 57), strict=True))
    assert set(found) == pairs and len(found) == len(pairs)


def test_prints_of_sets():
    from tickloom.llm.common import mix
    from tickloom.llm.simhash import set_prints, shingle_sets

    texts = ["", "a b c", "a b c d e f g h", "A b c d  e f g h a b c d e f g h", "x y z " * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, first = shingle_sets(data, np.cumsum([0, *map(len, texts)]), 5)
    high, low = (x.view(np.uint64).tolist() for x in set_prints(hashes, first))
    for k in range(len(texts)):
        own = hashes[first[k] : first[k + 1]].view(np.uint64)
        assert len(set(own.tolist())) == len(own)
        for got, values in ((high[k], own.tolist()), (low[k], mix(own).tolist())):
            assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in values) > len(values))
