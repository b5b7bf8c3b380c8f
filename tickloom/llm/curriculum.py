"""Mixing sources to target weights: a curriculum whose source weights change over training.

Each source has a token target and a weight schedule. The schedule's integral is the source's
cumulative demand; a document is trained on when the demand reaches the tokens queued before it,
so inverting the integral at those sums gives each document's training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, with_row_key, word_count

#: Leading hex digits of the order that name the buckets into which a source's queue is cut for running sums.
BUCKET_DIGITS = 3
#: (time, weight) knots of the shapes that sources take in turn: falling, level, rising.
SHAPES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.4, 1.0), (1.0, 1.5)))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size -> with ordinal and target: share x all sizes split by weight, at most cap x source_size.

    What a full source can't take is reshared by weight until none is above. That settles at one
    level: sorted by cap/weight, the first sources are full and the others get level x weight.
    Works on one row per source.
    """
    by_name, by_fill = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("fills_at", "ordinal")
    ever = Window.partitionBy()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("ordinal"), F.lit(len(weights))))
    out = (
        sources.withColumn("ordinal", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
    )
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(ever) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(ever) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", level)
    settled = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "ordinal", "level"))).over(ever)
    target = F.coalesce(F.least(settled["level"] * F.col("weight"), F.col("most")), F.col("most"))
    return out.withColumn("target", target).select("source", "source_size", "ordinal", "target")


def position_at(share: Column, ordinal: Column, shapes: Sequence[Sequence[tuple[float, float]]] = SHAPES) -> Column:
    """Time in [0, 1] when a source's cumulative demand reaches a share of its target."""

    def inverse(knots: Sequence[tuple[float, float]]) -> Column:
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        total, done, out = sum(area), 0.0, F.lit(1.0)
        pieces = []
        for (a, b), piece in zip(zip(knots, knots[1:], strict=False), area, strict=True):
            slope, need = (b[1] - a[1]) / (b[0] - a[0]), share * total - done
            # the root of slope/2 x**2 + a[1] x = need, in a form that holds for slope 0
            x = 2 * need / (a[1] + F.sqrt(F.greatest(F.lit(0.0), F.lit(a[1] ** 2) + 2 * slope * need)))
            done += piece
            pieces.append((done / total, F.lit(float(a[0])) + x))
        for upto, x in reversed(pieces):
            out = F.when(share <= upto, x).otherwise(out)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))

    out = inverse(shapes[-1])
    for i, knots in enumerate(shapes[:-1]):
        out = F.when(F.pmod(ordinal, F.lit(len(shapes))) == i, inverse(knots)).otherwise(out)
    return out


def curriculum(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    text: str = "text", source: str = "source", order: Column | None = None,
) -> DataFrame:
    """docs, less their text, with size, source_size, target, taken and passes (array of pass, words, position).

    A source's documents queue by ``order``, 16 or more lowercase hex digits (else those of a hash of
    their contents). Its target is a whole number of passes over the queue and a last pass that
    stops at the target, within a document if need be, so its taken words are the rounded target.
    ``passes`` lists when each pass trains on the document and on how many of its words.

    Texts are read once, for sizes and hashes, and are not shuffled; training_order sorts the rows. The
    queue's running sums are taken within buckets of the order and then over bucket totals, so a
    source with most rows is spread over 16 ** BUCKET_DIGITS groups.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, ordered last.
    Repeated rows are separate documents; empty table: empty result; other columns are kept, but
    size, source_size, target, taken and passes replace columns of these names.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "passes")
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    queued, bucket, before, row, total = with_row_key(docs, "queued", "bucket", "before", "row", "total")
    if order is None:
        order = F.lower(F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])), 16, "0"))
    rows = docs.select(*own, word_count(F.col(text)).alias("size"), order.alias(queued))
    rows = saved(rows.withColumn(bucket, F.conv(F.substring(queued, 1, BUCKET_DIGITS), 16, 10).cast("int")))
    queue = Window.partitionBy(source, bucket).orderBy(queued).rowsBetween(Window.unboundedPreceding, -1)

    sums = rows.groupBy(F.col(source).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum("size").alias("size"))
    buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(buckets), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = sums.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(
        F.col("s.source").alias(f"{before}_source"), F.col("bucket").alias(f"{before}_bucket"), F.col("before").alias(before),
        "source_size", "target", F.col("ordinal").alias(f"{before}_ordinal"),
    )
    rows = rows.withColumn(row, F.coalesce(F.sum("size").over(queue), F.lit(0)))
    rows = rows.join(plan, F.col(f"`{source}`").eqNullSafe(F.col(f"{before}_source")) & (F.col(bucket) == F.col(f"{before}_bucket")))
    rows = rows.withColumn(before, F.col(before) + F.col(row)).withColumn(total, F.round("target").cast("long"))

    n_passes = int(-(-cap // 1)) + 1
    start = lambda k: F.col(before) + F.col("source_size") * k
    words = lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col(total) - start(k)))
    passes = F.filter(
        F.array(*[
            F.struct(
                F.lit(k).alias("pass"), words(k).alias("words"),
                position_at(F.try_divide(start(k).cast("double"), F.col(total)), F.col(f"{before}_ordinal")).alias("position"),
            )
            for k in range(n_passes)
        ]),
        lambda x: x["words"] > 0,
    )
    rows = rows.withColumn("taken", sum((words(k) for k in range(n_passes)), F.lit(0).cast("long"))).withColumn("passes", passes)
    return rows.select(*own, "size", "source_size", "target", "taken", "passes")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each document, with first_position, when it is first trained on, and range-sorted
    by it; documents that are not trained on have null and come last, in order of a hash. mixed is written once, as a
    range sort looks at its input twice."""
    mixed = saved(mixed.withColumn("first_position", F.get("passes", F.lit(0))["position"]))
    by = [F.coalesce("first_position", F.lit(float("inf"))), F.xxhash64(*[F.col(f"`{c}`") for c, kind in mixed.dtypes if not kind.startswith("map")])]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each pass over a document (columns pass, words, position), range-sorted by position."""
    one = mixed.withColumn("passes", F.explode("passes")).withColumns({k: F.col(f"passes.{k}") for k in ("pass", "words", "position")})
    one = saved(one.drop("passes"))
    return one.repartitionByRange("position").sortWithinPartitions("position")
