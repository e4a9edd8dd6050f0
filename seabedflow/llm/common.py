"""What the text operators share: durable intermediate tables, whole groups of sorted streams, texts and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.store import drop_tables as release
from ..plans.store import shared_table as durable

__all__ = ["components", "durable", "join_with_hot_keys", "only", "partitions", "release", "text_of", "whole_groups"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(c: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(c), F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; further columns, whatever they are called, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: A key with more than one in ``HOT`` of all rows is joined by broadcast; there are fewer than ``HOT`` such keys.
HOT = 1000


def join_with_hot_keys(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``named`` (``key`` once each, ``copies``: how many of the ``total`` rows have it, and more). ``rows`` is read twice."""
    hot = named.where(F.col("copies") * HOT > total)
    often = rows.join(F.broadcast(hot), key)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return often.unionByName(other.join(named.where(F.col("copies") * HOT <= total), key, "left"))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """A stream sorted by ``keys`` as frames of whole groups: the frame, and where its groups begin and the last one ends.

    A group that goes on in the next batch waits for it, so the largest group bounds the memory.
    """
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        if held and _starts(pd.concat([held[-1].iloc[-1:], b.iloc[-1:]]), keys) == [0]:
            held.append(b)  # all of it belongs to the group that waits
            continue
        b = pd.concat([*held, b], ignore_index=True)
        at = _starts(b, keys)
        if len(at) > 1:
            yield b.iloc[: at[-1]], at
        held = [b.iloc[at[-1] :]]
    if held:
        b = pd.concat(held, ignore_index=True)
        yield b, [0, len(b)]


def _starts(b: pd.DataFrame, keys: list[str]) -> list[int]:
    new = np.zeros(len(b), bool)
    new[:1] = True
    for k in keys:
        v = b[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()
