import re
import zlib

from pyspark.sql import functions as F

from tickloom.llm.language_id import BLOCK, CrossParser, Model, identify_language, suffix_automaton, train
from tickloom.llm.queries import op8_language_id

SF = "/root/testdata/sf0.01"


def test_automaton_reads_substrings_only():
    text = b"abracadabra"
    moves = suffix_automaton(text)

    def reads(s):
        at = 0
        for c in s:
            if c not in moves[at]:
                return False
            at = moves[at][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(reads, subs))
    assert not any(reads(s + bytes([c])) for s in subs for c in b"abcdrx" if s + bytes([c]) not in subs)


def phrases(text, learnt):
    """Greedy longest matches."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learnt and text[at : at + 1] in learnt:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrase_counts_equal_brute_force():
    import numpy as np

    learnt, text = b"the cat sat on the mat and the dog ran", b"the dog sat and a fox ran on the cat zz the mat" * 30
    model = Model([("x", learnt)])
    cost = model.costs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert round(cost[0, 0] / model.parsers[0].weight) == phrases(text, learnt)
    assert isinstance(model.parsers[0], CrossParser)


def test_phrases_go_on_over_the_borders_of_blocks():
    """One phrase longer than several blocks, phrases that end anywhere, and rows that end at a border."""
    import random

    import numpy as np

    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abc") for _ in range(k)).encode()
    learnt = word(3000)
    rows = [learnt[100:2900], learnt[:BLOCK], learnt[7 : 2 * BLOCK + 7] + b"zz" + learnt[5 : 3 * BLOCK], b"z" * (BLOCK + 1), b"", learnt[BLOCK - 3 :] + learnt[: BLOCK + 3]]
    rows += [b"".join(learnt[i : i + rng.randrange(1, 900)] for i in [rng.randrange(2900) for _ in range(12)]) for _ in range(5)] + [word(5000)]
    model = Model([("x", learnt), ("y", word(2000))])
    cost = model.costs(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    for k, text in enumerate([learnt, None]):
        for i, row in enumerate(rows):
            if text is not None:
                assert round(cost[i, k] / model.parsers[k].weight) == phrases(row, text), i
    assert round(cost[0, 0] / model.parsers[0].weight) == 1


def test_the_sample_is_of_whole_texts(spark):
    rows = [("en", f"text {i} " + "word " * (i % 50)) for i in range(300)] + [("de", "lang " * 2000), ("fr", "mot " * 9000), ("fr", "beau " * 50_000), ("xx", "y" * 1_000_001), ("es", "12 3"), (None, "no"), ("it", "uno"), ("it", "uno")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    samples = dict(train(docs))
    assert sorted(samples) == ["de", "en", "fr", "it"]
    assert samples["de"] == b"lang " * 2000 and samples["fr"] == b"mot " * 9000 and samples["it"] == b"uno "
    assert all(s == s.strip() + b" " for s in samples.values()) and len(samples["en"]) <= 48_000


def test_scores_do_not_depend_on_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    samples = train(docs)
    assert all(40_000 < len(text) <= 48_000 for _, text in samples[:1])
    found = [identify_language(d, samples).select("doc_id", "lang_pred", "lang_score").collect() for d in (docs, docs.repartition(7), docs.repartition(40, "text"))]
    assert sorted(found[0]) == sorted(found[1]) == sorted(found[2])


def test_query_equals_brute_force(spark):
    """Costs from a plain parser over each text alone, on the smallest table."""
    import numpy as np

    from tickloom.llm.language_id import held_out, normalised

    small = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    samples = train(docs.where(~F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))))
    got = {r.doc_id: r for r in op8_language_id(spark, small).collect()}
    for r in docs.where("doc_id % 10 = 0").collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        data, _ = normalised(raw, np.array([0, len(raw)])) if len(raw) else (raw, None)
        cost = [phrases(data.tobytes(), learnt) * np.log2(len(learnt) + 2) for _, learnt in samples]
        best, second = sorted(cost)[:2]
        if re.search(r"[^\W\d_]", r.text or ""):
            assert got[r.doc_id].lang_pred == samples[cost.index(best)][0] and abs(got[r.doc_id].score - (1 - best / second)) < 1e-9


def test_held_out_accuracy(spark):
    got = op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    lettered = [r for r in got if r.held_out and re.search(r"[^\W\d_]", r.text or "")]
    assert len(lettered) > 150
    assert sum(r.lang == r.lang_pred for r in lettered) / len(lettered) > 0.97
    assert all(r.lang_pred == "und" for r in got if not re.search(r"[^\W\d_]", r.text or ""))


def test_bad_rows_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 -- 34", "c"), (4, "the cat", None), (4, "the cat", None), (5, "el gato " * 40_000, "e"), (None, "ß", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = identify_language(docs, [("en", b"the cat sat on the mat"), ("es", b"el gato come en la mesa")])
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "lang_pred", "lang_score"]
    by = {r.doc_id: r for r in got.collect()}
    assert {by[k].lang_pred for k in (1, 2, 3)} == {"und"} and by[1].lang_score == 0
    assert by[4].lang_pred == "en" and by[5].lang_pred == "es"
    assert {r.lang_pred for r in identify_language(docs, []).collect()} == {"und"}
    assert identify_language(docs.limit(0), []).count() == 0
    labelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert train(labelled) == []
