import random

import pytest

from tickloom.llm.token_counts import LongestMatch, count_tokens, read_vocabulary

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def greedy(word, pieces):
    """Longest piece first; the word's end belongs to its last byte. One token where no piece fits."""
    at, n = 0, 0
    while at < len(word):
        sizes = range(min(len(word) - at, 200), 0, -1)
        size = next((k for k in sizes if (word[at : at + k], at + k == len(word)) in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_counts_equal_greedy_matching():
    rng = random.Random(1)
    for trial in range(60):
        pieces = {(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 5))), rng.random() < 0.4) for _ in range(rng.randrange(1, 9))}
        pieces |= {(b"a", False), (b"b", False), (b"a", True), (b"b", True)} if trial % 2 else set()
        automaton = LongestMatch(sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_public_vocabulary_and_bad_rows(spark):
    pieces = read_vocabulary(VOCABULARY)
    known = set(pieces)
    rows = [(1, None), (2, ""), (3, "The quick brown fox, jumps!"), (4, "naïve café über"), (5, "token " * 30_000), (5, "token " * 30_000), (None, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words")
    got = count_tokens(docs, pieces).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_tokens, by[2].n_tokens, by[1].n_words) == (0, 0, 0)
    for k, text in ((3, rows[2][1]), (4, rows[3][1])):
        assert by[k].n_tokens == sum(greedy(w, known) for w in text.encode().lower().split())
    assert by[5].n_words == 30_000 and by[5].n_tokens == 30_000 * greedy(b"token", known)
    assert by[None].n_tokens >= 1
    assert count_tokens(docs.limit(0), pieces).count() == 0


def test_words_that_pieces_spell_are_not_unknown():
    pieces = read_vocabulary(VOCABULARY)
    known, automaton = set(pieces), LongestMatch(pieces)
    for word in ("thre", "f\u00fcr", "\u00e7"):
        raw = word.encode()
        assert (raw, True) not in known and automaton.count(raw) == greedy(raw, known) > 1


def test_vocabularies_of_one_size_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    pieces = [(bytes([c]), e) for c in range(97, 123) for e in (False, True)]
    more = [*pieces, (b"zz", True)], [*pieces, (b"ab", True)]
    assert [count_tokens(docs, sorted(p)).first().n_tokens for p in more] == [2, 1]


@pytest.mark.parametrize("word", [b"a", b"hello", b"!!!", "é".encode()])
def test_each_word_has_a_token(word):
    assert LongestMatch(read_vocabulary(VOCABULARY)).count(word) >= 1
