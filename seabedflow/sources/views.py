"""Deterministic sounding and time-series views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SheetSpec

SHEET = SheetSpec(0.0, 40.0, 1.0, 4.0, 50, 11)
#: Arrival order; the whole row breaks ties.
ARRIVAL = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "platform", "l_linestatus"]

SOUNDINGS_SQL = """
snd AS (SELECT l_partkey % 40 + l_discount * 10 AS east, (l_suppkey % 10) * 4 + l_tax * 10 AS north, -(l_quantity + 10) AS depth,
  0.01 + l_tax AS dz, 0.05 + l_discount AS dr, l_shipdate AS ts, l_returnflag AS platform, * EXCLUDE (l_shipdate, l_returnflag) FROM lineitem),
cel AS (SELECT *, floor((40.0 - north) / 4.0 + 0.5)::INT AS row, floor(east / 1.0 + 0.5)::INT AS col FROM snd)
"""


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        (F.col("l_partkey") % 40 + F.col("l_discount") * 10).alias("east"), ((F.col("l_suppkey") % 10) * 4 + F.col("l_tax") * 10).alias("north"),
        (-(F.col("l_quantity") + 10)).alias("depth"), (F.lit(0.01) + F.col("l_tax")).alias("dz"), (F.lit(0.05) + F.col("l_discount")).alias("dr"),
        F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("platform"),
        *[c for c in t.columns if c.startswith("l_") and c not in ("l_shipdate", "l_returnflag")],
    )


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = soundings(spark, sf_dir)
    row, col = SHEET.cell(F.col("east"), F.col("north"))
    return t.withColumns({"row": row, "col": col})


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples of one time series for each user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
