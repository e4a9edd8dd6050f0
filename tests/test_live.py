"""The live program in a trickle against the same points at once, and the R4 raster."""

import math
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from seabedflow.functions.params import Params, SheetSpec
from seabedflow.operators import kernel
from seabedflow.sources import rasters as X
from seabedflow.streaming import live as L

T0 = datetime(2024, 5, 1, 12)
POINT = "frame string, ts timestamp, x double, y double, z double, vertical_uncertainty double, horizontal_uncertainty double"
MOVE = "frame string, ts timestamp, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def test_points_in_the_map(spark):
    h = math.sqrt(0.5)
    moves = [("s", T0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("s", T0 + timedelta(seconds=1.4), 100.0, 200.0, -1.0, 0.0, 0.0, h, h)]
    pts = [("s", T0 + timedelta(seconds=0.5), 3.0, 4.0, -10.0, 0.1, 0.2), ("s", T0 + timedelta(seconds=2.2), 3.0, 4.0, -10.0, 0.1, 0.2), ("s", T0 + timedelta(seconds=9), 3.0, 4.0, -10.0, 0.1, 0.2), ("q", T0, 1.0, 1.0, 1.0, 1.0, 1.0), ("s", T0 + timedelta(seconds=0.6), None, 4.0, -10.0, 0.1, 0.2)]
    got = L.in_map(spark.createDataFrame(pts, POINT), spark.createDataFrame(moves, MOVE)).orderBy("ts").collect()
    assert [(r.east, r.north, r.depth) for r in got] == [pytest.approx((3.0, 4.0, -10.0)), pytest.approx((96.0, 203.0, -11.0))] and got[0].dz == 0.1 and got[0].dr == 0.2


def test_published_and_recorded_grids(spark, tmp_path):
    rng, p, sheet = random.Random(2), Params(), SheetSpec(0, 0, 1, 1, 4, 1)
    rows = [(i, 0, i % 4, -10 + rng.gauss(0, 0.2), 0.1) for i in range(120)]
    schema = "seq long, row int, col int, depth double, var double"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.publish(src, p, sheet, str(tmp_path / "out"), str(tmp_path / "ck"), every=None)
    assert q.awaitTermination(60)
    last = {r.col: r for r in L.latest_grid(spark.read.parquet(str(tmp_path / "out"))).collect()}
    for c in range(4):
        want = kernel.extract(kernel.fold([(r[3], r[4]) for r in rows if r[2] == c], p), p)
        assert last[c].elevation == pytest.approx(want["depth"]) and last[c].uncertainty == pytest.approx(want["unct"])
    pts = spark.createDataFrame([("s", T0 + timedelta(milliseconds=i), i % 4 + 0.01, 0.0, -10.0, 0.1, 0.04) for i in range(80)], POINT)
    moves = spark.createDataFrame([("s", T0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], MOVE)
    t = L.recorded_grid(pts, moves, sheet, p, str(tmp_path / "sheet"))
    assert t.count() == 4 and {round(r.elevation, 6) for r in t.collect()} == {-10.0} and t.where(F.col("uncertainty") > 0).count() == 4


def test_r4_rasters(spark, tmp_path):
    spec, z = SheetSpec(100.0, 250.0, 2.0, 5.0, 3, 2), np.array([[1.5, np.nan, -3.25], [4.0, 5.0, 6.0]])
    data = X.encode_r4(z, spec)
    assert len(data) == 1024 + 24 and data[:4] == b"OMG1" and struct.unpack_from(">II", data, 4) == (3, 2) and struct.unpack_from(">6d", data, 16) == (100, 104, 245, 250, 2, 5)
    assert struct.unpack_from(">2f", data, 96) == (6.0, -3.25)
    back, values = X.decode_r4(data)
    assert back == spec and np.array_equal(values, z, equal_nan=True)
    whole = np.array([[1.0, np.nan, 3.0], [255.0, 5.0, 6.0]])
    for kind in (1, 2):
        assert np.array_equal(X.decode_r4(X.encode_r4(whole, spec, kind))[1], whole, equal_nan=True)
    (tmp_path / "a.r4").write_bytes(data)
    assert sorted((r.row, r.col, r.z) for r in X.read_r4(spark, str(tmp_path / "a.r4")).collect()) == [(0, 0, 1.5), (0, 2, -3.25), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)]
    for bad in (data[:-1], b"OMG2" + data[4:], data[:64] + b"\x09" + data[65:], data[:66] + b"\x04" + data[67:]):
        with pytest.raises(ValueError):
            X.decode_r4(bad)
    with pytest.raises(ValueError):
        X.encode_r4(z, spec, 1)
    with pytest.raises(ValueError):
        X.encode_r4(z[:1], spec)
