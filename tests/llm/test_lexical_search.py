import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import lexical_search
from tickloom.llm.lexical_search import build_index, pack, ranked_search, search, unpack


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in own:
            n = sum(counts.values())
            score = 0
            for t in terms(text):
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    assert [t for _, t in frame.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted([tuple(r) for r in frame.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["The", "été", "Ünïcode", "漢字", "x1", " ", "K", "K"]
    text = lambda m: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(words) for _ in range(m))
    docs = [(rng.randrange(-5, 3 * n), text(rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]
    docs += [(1, None), (None, "w1 w2 the"), (None, ""), (-9, "w1 w2 the"), (10**15, "w1 w2 the"), (4, "w3 " * 5000)]
    items = [(i, text(rng.choice([0, 1, 8, 40]))) for i in range(12)] + [(3, "w1 w1 THE"), (50, None), (51, "zzz nowhere"), (None, "w2")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(1, 400)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert got(ranked_search(frame, asked)) == expected
    assert got(ranked_search(frame.coalesce(1), asked)) == expected


def test_small_shards_and_several_passes(spark):
    docs, items = corpus(2, 300)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=2000)
    assert index.where("term IS NULL").count() > 20
    assert got(search(index, asked, query_terms_at_once=10)) == brute(docs, items)
    assert got(search(index, asked, k=3)) == brute(docs, items, 3)


def test_postings_of_many_blocks_merge_in_document_order():
    rng = np.random.default_rng(3)
    cursors, sums = [], Counter()
    for number in range(9):
        places = np.flatnonzero(rng.random(5000) < rng.choice([0.001, 0.05, 0.6]))
        if not len(places):
            continue
        impacts = rng.integers(1, 50, len(places))
        cut = [slice(b, b + 16) for b in range(0, len(places), 16)]
        cursors.append(lexical_search.Cursor(number, [(places[c], impacts[c]) for c in cut], [int(places[c][-1]) for c in cut], None, number + 1))
        for p, i in zip(places.tolist(), impacts.tolist()):
            sums[p] += i * (number + 1)
    expected = sorted(((s, p) for p, s in sums.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert sorted(lexical_search.best_of_shard(cursors, 10), key=lambda x: (-x[0], x[1])) == expected


def test_a_shard_with_short_blocks(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    docs, items = corpus(5, 200)
    documents, *postings = [b.to_pylist() for b in lexical_search.shard_rows("s", [d for d, _ in docs], [(t or "").encode() for _, t in docs])]
    assert max(len(r["lasts"]) for r in postings[0]) > 10
    df = {r["term"]: r["df"] for r in postings[0]}
    whole = lexical_search.Corpus(documents[0]["df"], documents[0]["n_terms"])
    weight = lambda t: math.floor(1000 * math.log((2 * whole.n_docs + 2) / (2 * df[t] + 1)))
    asked = {q: [(t, n * weight(t)) for t, n in Counter(terms(text)).items() if t in df] for q, (_, text) in enumerate(items)}
    found = lexical_search.search_shard(postings[0], {"lengths": documents[0]["data"], "doc_ids": documents[0]["ids"]}, whole, asked, 10)
    expected = Counter((i, score) for i, _, _, score in brute(docs, items))
    assert Counter((items[q][0], score) for q, _, score in found) == expected


def test_bytes_round_trip():
    values = np.array([0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**31, 2**45])
    data, size = pack(values)
    assert unpack(data.tobytes()).tolist() == values.tolist() and size.sum() == len(data)
    assert unpack(pack(np.zeros(0, np.int64))[0].tobytes()).tolist() == []


def test_empty_tables(spark):
    docs, items = corpus(4, 10)
    none, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search(none, asked)) == []
    assert got(ranked_search(spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string"), asked)) == []
    assert got(ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), asked.where(F.lit(False)))) == []
