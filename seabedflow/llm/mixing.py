"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed by source, a target is set for each source by sharing a budget in proportion to weights with
a ceiling of ``cap`` times the source's own size, and each document is taken floor(rate) times plus once
more if its hash falls below the fraction of the rate.

Defined results: a null text has size 0; a null source is a source, sorted last; a repeated row draws the
same hash as its twin; a source of size 0 has target 0 and its documents are taken 0 times; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Uniform steps of the hash.
STEPS = 4294967296.0


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def _ranked(per: DataFrame) -> DataFrame:
    """``per`` (source, source_size) with each source's place by code point, null last. Ranks within sorted ranges are moved on by the
    sizes of the ranges before, so no task holds all sources; the window without a key runs over one row for each range."""
    n = partitions(per.sparkSession)
    order = (F.col("source").isNull(), F.col("source"))
    dealt = durable(per.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    # at most one row for each shuffle partition
    return dealt.withColumn("place", place).join(F.broadcast(before), "part").select("source", "source_size", (F.col("place") + F.col("before") - 1).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """``sizes`` (source, size) -> source, source_size, target.

    ``budget`` is a fraction of all sizes. Sources are filled in proportion to their weights; those that reach their ceiling are
    set to it and the rest is shared again, until none is above. Each round is one aggregation over one row per source; at
    least one more source is full after it, and the level only rises, so a handful of rounds ends it. All comparisons are in whole numbers.
    """
    num, den = budget
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    big = "decimal(38,0)"
    ws = F.array(*[F.lit(int(w)) for w in weights])
    t = _ranked(per).withColumn("w", F.element_at(ws, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("ceil_", F.col("source_size") * cap)
    t = durable(t.select("source", "source_size", "w", "ceil_"), "weights")
    total = t.agg(F.coalesce(F.sum(F.col("source_size").cast(big)), F.lit(0).cast(big))).first()[0]
    # the level a source must lie above to stay open, as a fraction up / down; at first none is full
    up, down = -1, 1
    while True:
        full = F.col("ceil_").cast(big) * F.lit(str(down)).cast(big) <= F.col("w").cast(big) * F.lit(str(up)).cast(big)
        used, open_w = t.agg(F.sum(F.when(full, F.col("ceil_").cast(big))), F.sum(F.when(~full, F.col("w").cast(big)))).first()
        new = (num * int(total) - den * int(used or 0), den * int(open_w or 0))
        if not open_w or new[0] * down <= up * new[1]:
            break
        up, down = new
    share = (F.col("w").cast(big) * F.lit(str(new[0])).cast(big)).cast("double") / F.lit(float(new[1]))
    target = F.when(full, F.col("ceil_").cast("double")).otherwise(share if open_w else F.lit(0.0))
    return t.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A whole number from 0 up to 2^32, fixed by the document's id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), cap: int = 2, seed: str = "mix", rows: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken (= size * copies), with ``rows`` also the document's own row as a struct."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    sized = docs.select("doc_id", "source", word_count(text_of()).alias("size"), *own)
    if not rows:
        sized = durable(sized, "sizes")
    targets = durable(source_targets(sized.select("source", "size"), weights, budget, cap), "targets")
    t = sized.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    t = t.select("d.*", "source_size", "target", rate.alias("rate"))
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), seed).cast("double") < (F.col("rate") - whole) * STEPS).cast("long")
    t = t.withColumn("copies", whole + extra).withColumn("taken", F.col("size") * F.col("copies"))
    return t.select("doc_id", "size", "source_size", "target", "taken", "copies", *(["row"] if rows else []))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of ``docs`` under their own names, whatever they are."""
    plan = mix_plan(docs, rows=True, **kw).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
