"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm.common import components, saved
from tickloom.llm.simhash import similar_links, with_set

from .test_curriculum import check
from .test_decontaminate import brute as benchmark_hits
from .test_substring_dedup import brute as without_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, " 12 ", "en", None, 4), (10**6 + 2, "", None, None, 0)], docs.schema)
    first = docs.orderBy("doc_id").limit(1)
    docs = docs.unionByName(extra).unionByName(first).unionByName(first.withColumn("text", F.lit("quite another text of the same id")))
    out.append(saved(docs))
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text))


def test_stages_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "decontaminate", "curriculum_mix"]
    assert all(r.columns == results[0].columns and r.dtypes == results[0].dtypes for r in results[:5])


def test_language_id_rejects_letterless_texts_only(results):
    kept = Counter((r.doc_id, r.text) for r in results[1].collect())
    assert kept == Counter((r.doc_id, r.text) for r in results[0].collect() if re.search(r"[^\W\d_]", r.text or ""))
    both = [(a.lang, b.lang) for a, b in zip(rows(results[0].where("doc_id < 1000000")), rows(results[1]), strict=False) if a.text == b.text]
    assert sum(a == b for a, b in both) > 0.9 * len(both)


def shingle_groups(texts):
    """For each text the first that is reachable by a Jaccard similarity of 0.8 of the sets of five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_one_document_of_each_group_stays(results):
    docs = rows(results[1])
    root = shingle_groups([r.text for r in docs])
    stay = {}
    for r, g in zip(docs, root, strict=True):
        stay[g] = min(stay.get(g, r.doc_id), r.doc_id)
    got = results[2].collect()
    assert sorted(r.doc_id for r in got) == sorted(stay.values())
    assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in docs}


def test_shared_passages_go(results):
    before = rows(results[2])
    expected = without_repeats([r.text for r in before], 35)
    after = results[3].collect()
    assert Counter((r.doc_id, r.text) for r in after) == Counter(
        (r.doc_id, kept if removed else r.text) for r, (_, removed, kept) in zip(before, expected, strict=True)
    )
    assert all(r.n_chars == len(r.text) for r in after)


def test_contaminated_documents_go(spark, results):
    before = rows(results[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = benchmark_hits([r.text for r in before], items)
    clean = {r.doc_id for r, (n, hit, _) in zip(before, hits, strict=True) if not (hit > 0 and 20 * hit >= n)}
    assert {r.doc_id for r in results[4].collect()} == clean


def test_mix(results):
    check(results[4].collect(), results[5].collect())


def test_run_gives_the_stages_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and "taken" in got.columns


def test_empty_and_repeated_rows(spark, results):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, results[k].limit(0), SF).count() == 0
    rng = random.Random(0)
    text = " ".join(rng.choice("abcdef") for _ in range(60))
    same = spark.createDataFrame([(None, text, "en", "s", 1)] * 3, results[0].schema)
    assert corpus_pipeline.STAGES[1][1](spark, same, SF).count() == 1


def test_unlike_texts_without_or_under_one_id_all_stay(spark, results):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(60)) for _ in range(6)]
    rows = [(None, t, "en", "s", 1) for t in texts[:3]] + [(7, t, "en", "s", 1) for t in texts[3:5]]
    rows += [(None, texts[3], "en", "s", 1), (7, texts[0], "en", "s", 1), (8, texts[5], None, "s", 1), (8, texts[5], "s", None, 1)]
    got = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows * 2, results[0].schema), SF).collect()
    expected = [(7, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(expected)


def test_documents_with_a_jaccard_of_four_fifths_are_near_copies(spark, results):
    rng = random.Random(2)
    line = [f"menu{i}" for i in range(9)]
    texts = []
    for n in [3, 5, 9, 40, 100, 200]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changed in [0, 0, 1, 1, 2, 2, 3, 4, 5, 6]:
            words = list(base)
            for k in range(min(changed, n)):
                words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words + line[: 9 * (changed % 2)]))
    root = shingle_groups(texts)
    assert 15 < len(set(root)) < len(texts) - 15
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], results[0].schema)
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()} == set(root)
    keyed = docs.withColumns({"row_a": F.col("doc_id"), "row_b": F.lit(0)})
    sets = with_set(keyed)
    prints = [r.fp for r in sets.orderBy("doc_id").collect()]
    for few, common in ((3, 4), (32, 32)):
        found = components(similar_links(keyed, sets.select("row_a", "row_b", "fp"), 0.8, few=few, common=common))
        got = {r.node: r.component for r in found.collect()}
        ours = [got.get(p, p) for p in prints]
        assert len(set(zip(ours, root, strict=True))) == len(set(ours)) == len(set(root))


def test_a_phrase_in_all_texts_compares_none_of_them(spark, results, monkeypatch):
    """Texts of ten words that share six, and of 84 that share 64: no two are similar, and no group of them is compared."""
    from tickloom.llm import simhash

    groups, pairs = [], []
    compared, verified = simhash._compared, simhash._verified
    monkeypatch.setattr(simhash, "_compared", lambda own, clusters, *a: groups.append(clusters.count()) or compared(own, clusters, *a))
    monkeypatch.setattr(simhash, "_verified", lambda own, found, *a: pairs.append(found.count()) or verified(own, found, *a))
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    line = " ".join(f"b{i}" for i in range(64))
    rows = [(i, " ".join(word() for _ in range(4)) + " all rights reserved by the owner", "en", "s", 1) for i in range(2000)]
    rows += [(5000 + i, " ".join(word() for _ in range(20)) + " " + line, "en", "s", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, results[0].schema).repartition(6)
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).count() == 3000
    assert sum(groups) + sum(pairs) < 30


def test_only_sets_with_near_fingerprints_are_compared(spark, results, monkeypatch):
    """Pairs of texts that share a phrase meet by a common key; those whose SimHashes are far apart go no further."""
    import numpy as np

    from tickloom.llm import simhash

    pairs = []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda own, found, *a: pairs.extend(map(tuple, found.collect())) or verified(own, found, *a))
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    texts = []
    for _ in range(400):
        phrase = words(8)
        texts += [words(16) + " " + phrase + " " + words(16) for _ in range(2)]
    for _ in range(100):
        base = words(40)
        texts += [base, base + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], results[0].schema).repartition(6)
    got = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()}
    assert got == {i for i in range(1000) if i < 800 or i % 2 == 0}
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, first = simhash.shingle_sets(data, np.cumsum([0, *map(len, texts)]), 5)
    ones = [(hashes[a:b].view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(0) * 2 > b - a for a, b in zip(first[:-1], first[1:], strict=True)]
    bits = dict(zip(simhash._set_hashes(hashes, first).tolist(), ones, strict=True))
    apart = [int((bits[u] != bits[v]).sum()) for u, v in pairs]
    # the phrases alone would give some 200 further pairs, half of them more than 30 of 64 bits apart
    assert len([d for d in apart if d < 12]) >= 100 and len([d for d in apart if d > 30]) < 25


@pytest.mark.parametrize("k", range(4))
def test_stages_bound_the_bytes_of_batches(spark, results, k):
    """A task of 20 MB of text does not go to its Python worker at once; a bound that the session has stays."""
    import pyarrow as pa

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ab cd "), 850).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    before = spark.conf.get(bound, None)
    try:
        for own, most in ((None, 4_000_000), (200_000, 200_000)):  # the row that reaches it is the last
            spark.conf.set(bound, str(own)) if own else spark.conf.unset(bound)
            corpus_pipeline.STAGES[k][1](spark, results[k].limit(20), SF)
            sent = long.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in sent) == 4000 and max(r.bytes for r in sent) < most + 6000
    finally:
        spark.conf.set(bound, before) if before else spark.conf.unset(bound)
