"""A corpus pipeline of five stages, each over all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, and each result is written as a table in the cluster's shared folder before
the next stage reads it. Extra columns of documents are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches, components, discard, saved, table
from tickloom.llm.curriculum import curriculum, in_training_order
from tickloom.llm.decontaminate import contaminated, find_benchmark
from tickloom.llm.language_id import held_out, identify_language, train
from tickloom.llm.simhash import similar_links, with_set
from tickloom.llm.substring_dedup import remove_repeats


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; lang becomes the predicted one. Rejected, as ``und``,
    are null, empty and letterless texts. Nothing but text and the labels of the training folds is learnt from."""
    bounded_batches(spark)
    samples = train(docs.where(~F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))))
    found = identify_language(docs, samples).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def row_hashes(docs: DataFrame) -> list[Column]:
    """96 bits that tell rows apart; a null is not taken for the value beside it."""
    cols = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    cols += [c.isNull() for c in cols]
    return [F.xxhash64(*cols).alias("row_a"), F.hash(*cols).alias("row_b")]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by a Jaccard similarity of 0.8 or more of their sets of
    five-word shingles one row: the one with the smallest doc_id (null last), set hash and row
    hash. Links are found as op6 does, by SimHash fingerprints in BK-trees over key shards, within a radius
    that 0.8 needs, and then counted over the whole sets. Groups are told apart by their sets, not their ids, so unlike texts of one or no doc_id
    all stay."""
    bounded_batches(spark)
    keyed = docs.select("doc_id", "text", *row_hashes(docs))
    sets = saved(with_set(keyed, 5).drop("text"))
    found = components(similar_links(keyed, sets, 0.8))
    # copies, however many, are one row before they meet the groups
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row_a", "row_b")).alias("first")
    least = sets.groupBy("fp").agg(first).join(found, F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "fp"))
    chosen = least.groupBy("c").agg(F.min("first").alias("first")).select("first.row_a", "first.row_b")
    times = sets.groupBy("row_a", "row_b").agg(F.count("*").alias("times")).where("times > 1")
    stay = saved(chosen.join(times, ["row_a", "row_b"], "left").withColumn("times", F.coalesce("times", F.lit(1))))
    out = docs.select("*", *row_hashes(docs)).join(stay, ["row_a", "row_b"])
    single = out.where("times = 1").select(*docs.columns)
    again = out.where("times > 1")
    if again.isEmpty():
        return single
    return single.unionByName(again.dropDuplicates(["row_a", "row_b"]).select(*docs.columns))


def remove_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 35-word windows that also stand elsewhere; texts that
    lose nothing stay as they are, and the others' kept words are joined by one space."""
    bounded_batches(spark)
    found = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in a benchmark window of 13 words."""
    bounded_batches(spark)
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(~contaminated(F.col("n_words"), F.col("n_hit"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the training positions of each pass, range-sorted
    by the first of them."""
    mixed = in_training_order(curriculum(docs.select("doc_id", "source", "lang", "text")))
    return mixed.select(
        "doc_id", "source", "lang", "size", "source_size", "target", "taken", F.transform("passes", lambda x: x["position"]).alias("positions")
    )


STAGES = [
    ("language_id", identify),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", remove_shared_passages),
    ("decontaminate", decontaminate),
    ("curriculum_mix", mix),
]

#: Language identification and components of near copies can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir. Each stage's result is a table in the
    shared folder until the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        if hasattr(before, "saved_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
