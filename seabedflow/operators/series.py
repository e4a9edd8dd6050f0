"""Time series: interpolation between bracketing samples, speed over ground, tide, thinning of buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a series that meet in one window partition.
BUCKET = 3600


def _seconds(c: Column) -> Column:
    return F.unix_micros(c) / 1e6


def _bucket(c: str, size: int) -> Column:
    return F.floor(F.unix_micros(F.col(c)) / (size * 1_000_000))


def interpolate(samples: DataFrame, targets: DataFrame, key: str = "k", values: Sequence[str] = ("value",), bucket: int = BUCKET) -> DataFrame:
    """``samples`` (key, ts, values), ``targets`` (key, id, ts) -> key, id, values.

    Samples and targets of a stretch of ``bucket`` seconds are one stream ordered by time; the last sample at or before and the first at or
    after a target bracket it, out of the stretch or else the nearest stretch that has one. So a series of any length is dealt
    by time, and the windows over a whole series see one row for each stretch. No extrapolation: targets outside, and series of a single sample elsewhere, have
    null. Of samples at the same time any one counts; samples with a null value are samples.
    """
    pair = F.struct("ts", *values)
    s = samples.select(key, "ts", *values).withColumn("b", _bucket("ts", bucket))
    edge = s.groupBy(key, "b").agg(F.min_by(pair, "ts").alias("first"), F.max_by(pair, "ts").alias("last"))
    t = targets.select(key, "ts", F.col("id").cast("long").alias("id")).withColumn("b", _bucket("ts", bucket))
    # stretches with samples or targets, and the samples next to them on both sides
    every = edge.unionByName(t.select(key, "b").distinct(), allowMissingColumns=True).groupBy(key, "b").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    w = Window.partitionBy(key).orderBy("b")
    every = every.select(key, "b", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    u = s.select(key, "b", "ts", F.lit(None).cast("long").alias("id"), pair.alias("s"))
    u = u.unionByName(t.select(key, "b", "ts", "id"), allowMissingColumns=True)
    w = Window.partitionBy(key, "b")
    back = w.orderBy("ts", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rev = w.orderBy(F.col("ts").desc(), F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("x", F.last("s", True).over(back)).withColumn("y", F.last("s", True).over(rev)).where("id is not null")
    u = u.join(every, [key, "b"]).withColumns({"x": F.coalesce("x", "before"), "y": F.coalesce("y", "after")})
    frac = (_seconds(F.col("ts")) - _seconds(F.col("x.ts"))) / (_seconds(F.col("y.ts")) - _seconds(F.col("x.ts")))
    same = F.col("x.ts") == F.col("y.ts")
    return u.select(key, "id", *[F.when(same, F.col(f"x.{v}")).otherwise(F.col(f"x.{v}") + frac * (F.col(f"y.{v}") - F.col(f"x.{v}"))).alias(v) for v in values])


def speed_over_ground(t: DataFrame, key: str = "platform", bucket: int = BUCKET) -> DataFrame:
    """``sog``: forward difference of (ts, x, y) within a platform; the last sample repeats the one before. Stretches as in :func:`interpolate`; null where two samples have the same time
    or there is only one."""
    at = F.struct("ts", "x", "y")
    s = t.withColumn("_b", _bucket("ts", bucket))
    edge = s.groupBy(key, "_b").agg(F.min_by(at, "ts").alias("_first"), F.max_by(at, "ts").alias("_last"))
    w = Window.partitionBy(key).orderBy("_b")
    edge = edge.select(F.col(key).alias("_k"), "_b", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    w = Window.partitionBy(key, "_b").orderBy("ts")
    s = s.withColumns({"_to": F.lead(at).over(w), "_from": F.lag(at).over(w)}).join(edge.withColumnRenamed("_b", "_eb"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_eb")))
    s = s.withColumns({"_to": F.coalesce("_to", "_after"), "_from": F.coalesce("_from", "_before")})

    def speed(a: Column, b: Column) -> Column:
        dt = (F.unix_micros(b.ts) - F.unix_micros(a.ts)) / 1e6
        dx, dy = b.x - a.x, b.y - a.y
        return F.sqrt(dx * dx + dy * dy) / F.when(dt > 0, dt)

    sog = F.when(F.col("_to").isNull(), speed(F.col("_from"), at)).otherwise(speed(at, F.col("_to")))
    return s.withColumn("sog", sog).drop("_b", "_eb", "_k", "_to", "_from", "_before", "_after")


def tide_corrected(soundings: DataFrame, tide: DataFrame, key: str = "k", bucket: int = BUCKET) -> DataFrame:
    """``soundings`` (key, id, ts, depth; id once each) with the interpolated tide (key, ts, value) added to negative depths; soundings outside the tide's times are dropped."""
    at = interpolate(tide, soundings.select(key, "id", "ts"), key, bucket=bucket).where("value is not null")
    return soundings.join(at.select("id", F.col("value").alias("_tide")), "id").withColumn("depth", F.col("depth") + F.col("_tide")).drop("_tide")


def tide_offset(tide: DataFrame, offset: float) -> DataFrame:
    """A tide moved to another datum."""
    return tide.withColumn("value", F.col("value") + offset)


def before_epoch(t: DataFrame, epoch: float) -> DataFrame:
    """Samples from ``epoch`` (seconds) on; earlier ones go."""
    return t.where(_seconds(F.col("ts")) >= epoch)


def all_but_n(t: DataFrame, n: int, key: str = "k") -> DataFrame:
    """The last ``n`` samples of each series."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    return t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def all_but_t(t: DataFrame, seconds: float, key: str = "k") -> DataFrame:
    """The samples of the last ``seconds`` of each series. One row for each series is joined."""
    last = t.groupBy(key).agg(F.max("ts").alias("_last"))
    return t.join(last, key).where(_seconds(F.col("_last")) - _seconds(F.col("ts")) <= seconds).drop("_last")
