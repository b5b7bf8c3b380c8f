import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import toxicity
from tickloom.llm.queries import op5_toxicity
from tickloom.llm.toxicity import Network, Words, fit, places_of, score_toxicity, windows_of

SF = "/root/testdata/sf0.1"


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])


def test_words_and_windows():
    texts = ["", "One two ONE", "  ", "a" * 30, "ü-x"]
    w = Words.read(*packed(texts))
    assert w.first.tolist() == [0, 0, 3, 3, 4, 6]
    assert w.place[0] == w.place[2] != w.place[1]
    row, start, end = windows_of(np.array([0, 0, 1, 33, 90]))
    assert row.tolist() == [1, 2, 3, 3, 3]
    assert start.tolist() == [0, 1, 33, 57, 81]
    assert end.tolist() == [1, 33, 65, 89, 90]


def test_gradients_match_differences():
    net = Network(rows=64, dtype=np.float64)
    net.word_odds, net.gram_odds = (np.random.default_rng(k).standard_normal(64) for k in (1, 2))
    w = Words.read(*packed(["the cat sat on the mat", "a dog", "the the dog ran " * 12]))
    w.word, w.gram = w.word % 64, w.gram % 64
    row, start, end = windows_of(w.first)
    places = places_of(w.place, start, end, len(w.word))
    some, label = np.arange(len(w.word)), np.array([1, 0, 1, 0])[: len(row)]
    loss, grad = net.gradients(w, some, places, label)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was, e = flat[i], 1e-5
            flat[i] = was + e
            up = net.gradients(w, some, places, label)[0]
            flat[i] = was - e
            down = net.gradients(w, some, places, label)[0]
            flat[i] = was
            assert abs((up - down) / (2 * e) - grad[name].reshape(-1)[i]) < 1e-6, name


def test_held_out_accuracy_and_columns(spark):
    got = op5_toxicity(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    hit = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(clean) < 0.02
    assert np.mean(hit) > 0.7  # some labels there have nothing in the text to show for it
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_window_counts_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    free = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "ate", "rat"], n))
    clean = [free(k) for k in range(5, 105)]
    toxic = [f"{free(k)} zorkwad {free(9)}" for k in range(5, 55)]
    net = fit(clean + toxic, [0] * len(clean) + [1] * len(toxic), steps=80, batch=50)
    late = " " + free(100_000) + " "
    rows = [(1, None, "a"), (2, "", "b"), (3, "...", "c"), (4, late, "d"), (5, late + "zorkwad", "e"), (5, late + "zorkwad", "e"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    got = score_toxicity(docs, net)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == len(rows)
    score = {r.doc_id: r.toxicity for r in got.collect()}
    assert score[1] == score[2] == score[3] == net.prior < 0.5
    assert score[4] < 0.5 < score[5]
    assert score_toxicity(docs.limit(0), net).count() == 0
    none = fit(["a b"], [0])
    assert score_toxicity(docs.where(F.col("doc_id") == 4), none).first().toxicity < 0.5
    assert fit([], []).prior < 0.5 and toxicity.SAMPLE_TOXIC > 0


def plain_score(net, text):
    """The score of one text, word by word and window by window, with nothing shared between them."""
    w = Words.read(*packed([text]))
    p, h = net.p, toxicity.HIDDEN
    n = int(w.first[1])
    if not n:
        return net.prior
    sig = lambda x: 1 / (1 + np.exp(-x))

    def entered(k):
        d = w.place[k]
        grams = w.gram[w.gram_first[d] : w.gram_first[d + 1]]
        return np.concatenate([p["word"][w.word[d]], [net.word_odds[w.word[d]]], p["gram"][grams].mean(0), [net.gram_odds[grams].max()]]) @ p["input"] + p["bias"]

    def run(words, side, u):
        state, out = np.zeros(h), []
        for k in words:
            g, s = entered(k)[side * 3 * h : side * 3 * h + 3 * h], state @ u
            z, r = sig(g[:h] + s[:h]), sig(g[h : 2 * h] + s[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * s[2 * h :]) + z * state
            out.append(state)
        return out

    best, start = 0.0, 0
    while True:
        words = list(range(start, min(n, start + toxicity.WINDOW)))
        states = np.hstack([run(words, 0, p["forth"]), run(words[::-1], 1, p["back"])[::-1]])
        share = np.exp(states @ p["attend"])
        best = max(best, sig((share / share.sum()) @ states @ p["out"] + p["shift"][0]))
        if words[-1] == n - 1:
            return best
        start += toxicity.STRIDE


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "cat", "sat", "zorkwad", "über", "x", "antidisestablishment"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 31, 32, 33, 56, 57, 130)] + ["", "..."]
    net = fit(texts[:8] * 2, [0, 1] * 8, steps=20, batch=8)
    got = net.scores(*packed(texts))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
    assert np.ptp(got[:8]) > 1e-4
