import random

from pyspark.sql import functions as F

from tickloom.llm.exact_dedup import exact_groups, without_copies

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Expected (id, keep, size, kept count) by content; kept is counted, as repeated rows are alike."""
    groups = {}
    for doc, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in SPACE), []).append((doc, len(text or "")))
    out = []
    for members in groups.values():
        keep, most = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        first = members.index((keep, most))
        out += [(doc, keep, len(members), i == first) for i, (doc, _) in enumerate(members)]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "b c", "b  c", "bc", "été", "", None, " \t", "x" * 5000, "x" * 4999 + " x", "\U0001f600 y", " ", "a\n"]
    return [(rng.choice([i, i, i, -i]), rng.choice(words)) for i in range(n)]


def test_against_brute_force(spark):
    rows = [*rows_of(1, 300), (7, "once"), (2**63 - 1, "big"), (-(2**63), "big"), (5, "null id"), (None, "null id"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(exact_groups(docs)) == brute(rows)


def test_contents_that_one_digest_cannot_tell_apart(spark):
    rows = rows_of(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda text: F.pmod(F.length(text), F.lit(3)).cast("string")
    for share in (1, 1000):  # no salts and salts
        assert got(exact_groups(docs, digest=weak, hot_share=share, salts=3)) == brute(rows)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact_groups(docs)) == brute(rows)
    assert sorted(r.text for r in without_copies(docs).collect()) == ["a b", "c", "d"]


def test_empty_table_other_columns_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).collect() == []
    docs = spark.createDataFrame([(1, "a a", "x", 0, True), (2, "a  a", "y", 1, None), (3, None, "z", 2, None), (4, "", "z", 3, None)], "doc_id int, text string, digest string, own int, kept boolean")
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.digest, r.own) for r in kept.collect()) == [(2, "y", 1), (3, "z", 2)]


def test_no_python_and_no_text_in_the_joins_with_winners(spark):
    docs = spark.createDataFrame(rows_of(3, 50), "doc_id long, text string")
    plan = exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
