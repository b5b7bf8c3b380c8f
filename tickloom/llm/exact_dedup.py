"""Exact duplicates, skew-safe, with DataFrame functions alone.

Texts are equal when identical after white space (space, tab to carriage return) is deleted. Three
stages compare whole contents: each map task merges its own copies (the partial step of a grouping
by digest, salt and content), the shuffle merges groups by digest and salt, and the salts' winners
are merged by digest and content. Only digests with more than one row in ``HOT`` get salts, so all
other texts are shuffled once. Rows then meet their winner by digest; where one digest stands for
several contents, by digest and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, with_row_key

#: A digest is hot if it has more than one of so many rows; so at most so many are hot, and they are broadcast.
HOT = 1000
#: A hot digest's rows are merged in so many groups first, by the map task that read them.
SALTS = 64
SPACE = " \t\n\x0b\x0c\r"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: Column) -> Column:
    """text without white space; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that is higher for more code points, then for a smaller id; null comes last."""
    low = F.coalesce(F.lit(str(2**63)).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n_chars.cast("decimal(12,0)") * F.lit(str(2**65)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _unranked(rank: str) -> tuple[Column, Column]:
    """n_chars and doc_id of a rank."""
    n = F.expr(f"{rank} div {2**65}")
    low = (F.col(rank) - n.cast("decimal(12,0)") * F.lit(str(2**65)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return n, F.when(low > 0, (F.lit(str(2**63)).cast("decimal(20,0)") - low).cast("long"))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, hot_share: int = HOT, salts: int = SALTS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and n_chars for every row of docs.

    Of equal texts stays the row with the most code points in its text as it was, then the smallest
    doc_id, null last; of repeated rows of one doc_id and text one stays. doc_id is an integer.
    A null text is empty, and empty texts are equal. Extra columns are not read, and an empty table
    gives an empty table. ``digest`` may be any function of a text: rows that it can't tell apart are
    told apart by content.
    """
    norm = normalised(F.col(f"`{text}`"))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), norm.alias("norm"), digest(norm).alias("digest"),
        F.char_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("n_chars"),
    )
    keyed = saved(rows.select(F.monotonically_increasing_id().alias("row"), "id", "digest", "n_chars"))
    many = keyed.groupBy("digest").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") * hot_share > keyed.count())
    hot = saved(many.where("n_rows > 1").select("digest"))

    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts)) + 1).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").withColumn("salt", salt)
    best, times = F.max(_rank(F.col("n_chars"), F.col("id"))).alias("best"), F.count("*").alias("times")
    merged = salted.groupBy("digest", "salt", "norm").agg(best, times)
    merged = saved(merged.select("digest", "salt", F.when(F.col("salt") > 0, F.col("norm")).alias("norm"), "best", "times"))
    again = [F.max("best").alias("best"), F.sum("times").alias("times")]
    combined = merged.where("salt > 0").groupBy("digest", "norm").agg(*again).drop("norm")
    contents = merged.where("salt = 0").select("digest", "best", "times").unionByName(combined)
    winners = saved(contents.groupBy("digest").agg(F.count("*").alias("contents"), *again))

    alone, none = winners.where("contents = 1").drop("contents"), F.lit(-1).cast("long").alias("content")
    of_hot = keyed.join(F.broadcast(alone.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    of_rest = keyed.join(F.broadcast(hot), "digest", "left_anti").join(alone, "digest")
    columns = ["row", "id", "n_chars", "digest", "content", "best", "times"]
    found = of_hot.unionByName(of_rest).withColumn("content", none).select(columns)
    unlike = winners.where("contents > 1").select("digest")
    if not unlike.isEmpty():
        found = found.unionByName(_by_content(rows, unlike).select(columns))
    keep_chars, keep_id = _unranked("best")
    found = found.withColumns({"keep_id": keep_id, "first": (F.col("n_chars") == keep_chars) & F.col("id").eqNullSafe(keep_id)})
    found = saved(found)
    discard(keyed, hot, merged, winners)

    # repeated rows of one id and text: the groups' numbers of first rows tell whether there are any
    chosen = found.where("first").groupBy("digest", "content").agg(F.min("row").alias("row"), F.count("*").alias("n_first"))
    if chosen.where("n_first > 1").isEmpty():
        out = found.withColumn("kept", F.col("first"))
    else:
        out = found.join(chosen.select("row", F.lit(True).alias("is_chosen")), "row", "left").withColumn("kept", F.coalesce("is_chosen", F.lit(False)))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("times").alias("group_size"), "kept", "digest", "n_chars")


def _by_content(rows: DataFrame, unlike: DataFrame) -> DataFrame:
    """Rows and winners of digests that stand for several contents: rows meet winners by their content."""
    own = rows.join(unlike, "digest", "left_semi")
    best = [F.max(_rank(F.col("n_chars"), F.col("id"))).alias("best"), F.count("*").alias("times")]
    each = saved(own.groupBy("digest", "norm").agg(*best).withColumn("content", F.monotonically_increasing_id()))
    # numbers below 0, so that they differ from those of the other rows
    return saved(own.join(each, ["digest", "norm"]).withColumn("row", -1 - F.monotonically_increasing_id()).drop("norm"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of every group of equal texts."""
    own, chars, stay_id, stay_digest, stay_chars = with_row_key(docs, "own", "chars", "stay_id", "stay_digest", "stay_chars")
    groups = exact_groups(docs, doc_id, text)
    stay = saved(groups.where("kept").select(F.col("doc_id").alias(stay_id), F.col("digest").alias(stay_digest), F.col("n_chars").alias(stay_chars)))
    keyed = docs.withColumns({
        own: sha256(normalised(F.col(f"`{text}`"))), chars: F.char_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))),
    })
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_digest)) & (F.col(chars) == F.col(stay_chars))
    out = keyed.join(stay, same, "left_semi")
    if groups.count() > groups.select("doc_id", "digest").distinct().count():  # repeated rows
        out = out.dropDuplicates([own])
    return out.drop(own, chars)
