"""Raw sonar logs: framing with resynchronisation, and the depth, attitude, position and imagery datagrams as tables.

A log is a sequence of big-endian datagrams: length, start byte, type, model, date and time, body, end byte and checksum. A file is one
task (see :mod:`seabedflow.sources.soundings`). Everything after framing is an expression or a map over batches of datagrams.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import packed_time
from .soundings import read_files

#: The frame, types of datagrams and records within them.
FRAME = struct.Struct(">IBBHII")
START_BYTE, LONGEST, RESYNC = 2, 40_960, 1024
ATTITUDE, DEPTH, POSITION, IMAGERY, TIDE, HEIGHT, CLOCK = 0x41, 0x44, 0x50, 0x53, 0x54, 0x68, 0x43
DEPTH_HEAD = struct.Struct(">HHHHHBBBBH")
BEAM = np.dtype([("depth", ">i2"), ("y", ">i2"), ("x", ">i2"), ("rx_angle", ">i2"), ("tilt", ">u2"), ("twt", ">u2"), ("quality", "u1"), ("window", "u1"), ("backscatter", "i1"), ("beam", "u1")])
MOTION = np.dtype([("latency", ">u2"), ("status", ">u2"), ("roll", ">i2"), ("pitch", ">i2"), ("heave", ">i2"), ("heading", ">u2")])
FIX = struct.Struct(">HHiiHHHH")
IMAGE_HEAD = struct.Struct(">HHHHHHHbbHBB")
IMAGE_BEAM = np.dtype([("beam", "u1"), ("side", "i1"), ("n", ">u2"), ("centre", ">u2")])
#: Models whose depths fill all 16 bits.
DEEP_MODELS = (300, 120)


def frames(name: str, data: bytes, resync: int = RESYNC) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(offset, type, model, date, time, body) of each datagram. What is no frame is skipped byte by byte, ``resync`` bytes in a row at
    most; a datagram that the file cuts off ends the file."""
    at = skipped = 0
    while at + FRAME.size <= len(data):
        size, start, kind, model, date, time = FRAME.unpack_from(data, at)
        if start != START_BYTE or not FRAME.size - 4 <= size <= LONGEST:
            at, skipped = at + 1, skipped + 1
            if skipped > resync:
                raise ValueError(f"{name}: no datagram in {resync} bytes before {at}")
            continue
        if at + 4 + size > len(data):
            return
        # the end byte and the checksum stand last
        yield at, kind, model, date, time, data[at + FRAME.size : at + 4 + size - 3]
        at, skipped = at + 4 + size, 0


def read_datagrams(spark: SparkSession, path: str | list[str], resync: int = RESYNC) -> DataFrame:
    """One row per datagram: file, offset, kind, model, ts (epoch seconds) and body."""

    def parse(name: str, data: bytes) -> pd.DataFrame:
        rows = [(name, *f) for f in frames(name, data, resync)]
        return pd.DataFrame(rows, columns=["file", "offset", "kind", "model", "date", "time", "body"])

    t = read_files(spark, path, parse, "file string, offset long, kind int, model int, date long, time long, body binary")
    return t.select("file", "offset", "kind", "model", packed_time(F.col("date"), F.col("time")).alias("ts"), "body")


def _decoded(t: DataFrame, kind: int, one, columns: str) -> DataFrame:
    """``one(model, ts, body)`` -> dictionary of columns, for each datagram of a kind; the file and offset go along."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for file, offset, model, ts, body in zip(b.file, b.offset, b.model, b.ts, b.body, strict=True):
                got = pd.DataFrame(one(model, ts, body))
                got.insert(0, "file", file)
                got.insert(1, "offset", offset)
                parts.append(got)
            if parts:
                yield pd.concat(parts, ignore_index=True)[["file", "offset", *names]]

    return t.where(F.col("kind") == kind).mapInPandas(run, f"file string, offset long, {columns}")


def _depth(model: int, ts: float, body: bytes) -> dict:
    ping, serial, heading, sspeed, tx_depth, _, n, zres, xyres, rate = DEPTH_HEAD.unpack_from(body)
    b = np.frombuffer(body, BEAM, n, DEPTH_HEAD.size)
    times = struct.unpack_from("b", body, DEPTH_HEAD.size + n * BEAM.itemsize)[0] if len(body) > DEPTH_HEAD.size + n * BEAM.itemsize else 0
    raw = b["depth"].view(">u2") if model in DEEP_MODELS else b["depth"]
    phase = (b["quality"] & 0x80) != 0
    return {
        "ts": ts, "ping": ping, "heading": heading / 100, "surf_sspeed": sspeed / 10, "beam": b["beam"].astype("i4") - 1, "ahead": b["x"] * (xyres / 100), "starboard": b["y"] * (xyres / 100),
        "depth": raw * (zres / 100) + tx_depth / 100 + times * 655.36, "backscatter": b["backscatter"] / 2, "flags": phase.astype("i4") + (b["window"].astype("i4") << 1),
    }


def depth_beams(t: DataFrame) -> DataFrame:
    """Beams of the depth datagrams: metres ahead and to starboard, depth positive down below the water line, half decibels, and flags (bit 0 phase detection,
    bits 1 to 8 the window). The log has no mean sound speed, so that at the transducer stands in for it."""
    cols = "ts double, ping long, heading double, surf_sspeed double, beam int, ahead double, starboard double, depth double, backscatter double, flags int"
    return _decoded(t, DEPTH, _depth, cols).withColumn("mean_speed", F.col("surf_sspeed"))


def _motion(model: int, ts: float, body: bytes) -> dict:
    n = struct.unpack_from(">H", body, 4)[0]
    m = np.frombuffer(body, MOTION, n, 6)
    return {"ts": ts + m["latency"] / 1000, "roll": m["roll"] / 100, "pitch": m["pitch"] / 100, "heave": m["heave"] / 100, "heading": m["heading"] / 100}


def attitudes(t: DataFrame) -> DataFrame:
    """Samples of the attitude datagrams, at their own times; degrees and metres."""
    return _decoded(t, ATTITUDE, _motion, "ts double, roll double, pitch double, heave double, heading double")


def _fix(model: int, ts: float, body: bytes) -> dict:
    _, _, lat, lon, quality, sog, course, heading = FIX.unpack_from(body)
    return {"ts": [ts], "lat": [lat / 2e7], "lon": [lon / 1e7], "sog": [sog / 100], "course": [course / 100], "heading": [heading / 100], "quality": [quality]}


def fixes(t: DataFrame) -> DataFrame:
    """Position datagrams: degrees and metres a second."""
    return _decoded(t, POSITION, _fix, "ts double, lat double, lon double, sog double, course double, heading double, quality int")


def _image(model: int, ts: float, body: bytes) -> dict:
    head = IMAGE_HEAD.unpack_from(body)
    n = head[-1]
    b = np.frombuffer(body, IMAGE_BEAM, n, IMAGE_HEAD.size)
    data = np.frombuffer(body, "i1", -1, IMAGE_HEAD.size + n * IMAGE_BEAM.itemsize)
    ends = np.cumsum(b["n"].astype("i8"))
    return {"ts": ts, "ping": head[0], "beam": b["beam"].astype("i4"), "side": np.where(b["side"] == -1, "port", "starboard"), "centre": b["centre"].astype("i4"), "samples": [data[e - k : e].tolist() for e, k in zip(ends, b["n"], strict=True)]}


def image_beams(t: DataFrame) -> DataFrame:
    """Beams of the imagery datagrams with their samples in half decibels."""
    return _decoded(t, IMAGERY, _image, "ts double, ping long, beam int, side string, centre int, samples array<int>")


def placed_images(images: DataFrame, beams: DataFrame) -> DataFrame:
    """Imagery with the east and north of the bathymetry of the same ping and beam, null where there is none."""
    where = beams.select("file", "ping", "beam", "east", "north").dropDuplicates(["file", "ping", "beam"])
    return images.join(where, ["file", "ping", "beam"], "left")


def trimmed(beams: DataFrame, positions: DataFrame) -> DataFrame:
    """Datagrams after the first fix of their file; earlier ones can never be placed. One row for each file is joined."""
    first = positions.groupBy("file").agg(F.min("ts").alias("_first"))
    return beams.join(first, "file").where("ts > _first").drop("_first")


def fir(rate: float, out_rate: float, length: int) -> tuple[list[float], int]:
    """Coefficients of a low-pass filter for decimation (a windowed sinc of unit gain) and the step; below the output rate samples pass through."""
    if rate < out_rate:
        return [1.0], 1
    corner, centre = math.pi * out_rate / rate, length // 2
    own = lambda n: corner / math.pi if n == 0 else (0.5 + 0.5 * math.cos(2 * math.pi * n / length)) * math.sin(n * corner) / (math.pi * n)
    h = [own(n - centre) for n in range(length)]
    return [x / sum(h) for x in h], int(rate / out_rate)


def input_rate(latency_ms: Sequence[float]) -> float:
    """Samples a second: the mean of the rates between neighbours."""
    gaps = [b - a for a, b in zip(latency_ms, latency_ms[1:], strict=False)]
    return sum(1000 / g for g in gaps) / len(gaps)


def decimated(values: Column, coefficients: Sequence[float], step: int) -> Column:
    """An array filtered and decimated; beyond its ends it is mirrored. ``coefficients`` are odd in number."""
    lim, last = len(coefficients) // 2, F.size(values) - 1

    def at(i: Column) -> Column:
        total = None
        for j, k in enumerate(coefficients):
            pos = F.abs(i + (j - lim))
            term = F.lit(float(k)) * F.get(values, F.when(pos > last, 2 * last - pos).otherwise(pos))
            total = term if total is None else total + term
        return total

    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), at)


def smooth_attitude(att: DataFrame, out_rate: float, length: int, failure_rate: float = 1.0) -> DataFrame:
    """``att`` (file, offset, ts, roll, pitch, heave, heading) filtered and decimated datagram by datagram, each by the rate it came at.

    A datagram of one sample or slower than ``failure_rate`` is dropped: the sensor had failed. A datagram is a hundred samples or so, so
    its samples meet in one small group.
    """
    names = ["roll", "pitch", "heave", "heading"]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        empty = pd.DataFrame({c: pd.Series([], dtype=object if c == "file" else "f8") for c in ("file", "offset", "ts", *names)})
        if len(g) < 2 or (np.diff(g.ts) <= 0).any():
            return empty
        rate = input_rate((g.ts * 1000).tolist())
        if rate < failure_rate:
            return empty
        h, step = fir(rate, out_rate, length)
        lim, n = len(h) // 2, len(g)
        pos = np.abs(np.arange(0, n, step)[:, None] + np.arange(-lim, len(h) - lim))
        pos = np.clip(np.where(pos >= n, 2 * (n - 1) - pos, pos), 0, n - 1)
        return pd.DataFrame({"file": pd.Series([key[0]] * len(pos), dtype=object), "offset": key[1], "ts": g.ts.to_numpy()[::step], **{c: g[c].to_numpy()[pos] @ np.array(h) for c in names}})

    return att.groupBy("file", "offset").applyInPandas(run, "file string, offset long, ts double, " + ", ".join(f"{n} double" for n in names))
