"""What the core operators make of nulls, empty tables, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F
from seabedflow.functions.params import Params, SheetSpec
from seabedflow.operators import estimate as E
from seabedflow.operators import gridding as G
from seabedflow.operators import series as T
from seabedflow.operators import surfaces as S

P, SHEET = Params(), SheetSpec(0, 9, 1, 1, 10, 10)
CELLS = "row int, col int, depth double"
SURFACE = "row int, col int, z double"
SND = "east double, north double, depth double, dz double, dr double"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(0, 0, -5.0), (0, 0, -5.0), (0, 0, -7.0), (0, 0, None), (0, 1, None), (0, 2, 3.0), (None, None, -9.0), (0, 3, -4.0)], CELLS)


def by_cell(t, name):
    return {(r.row, r.col): r[name] for r in t.collect()}


def test_cells(cells):
    assert by_cell(G.hits(cells), "hits") == {(0, 0): 4, (0, 1): 1, (0, 2): 1, (None, None): 1, (0, 3): 1}
    assert by_cell(G.mean_surface(cells), "z") == {(0, 0): pytest.approx(-17 / 3), (None, None): -9.0, (0, 3): -4.0}
    assert by_cell(G.median_surface(cells), "z") == {(0, 0): -5.0, (0, 2): 3.0, (None, None): -9.0, (0, 3): -4.0}
    sdev = by_cell(G.sdev_surface(cells), "sdev")
    assert sdev[0, 1] is None and sdev[0, 3] == 0
    for f in (G.hits, G.mean_surface, G.median_surface, G.sdev_surface, lambda c: G.density(c, SHEET), G.trimmed_mean, lambda c: G.coverage_ratio(c, SHEET)):
        assert f(cells.limit(0)).count() == 0


def test_soundings(spark):
    t = spark.createDataFrame([(3.2, 5.1, -20.0, 0.1, 0.05), (3.2, 5.1, -20.0, 0.1, 0.05), (None, 5.1, -20.0, 0.1, 0.05), (3.2, 5.1, None, 0.1, 0.05), (3.2, 5.1, -20.0, None, None), (99.0, 99.0, -20.0, 0.1, 0.05)], SND)
    pairs = G.gated(G.node_candidates(t, SHEET, P), P)
    n = pairs.count()
    assert n > 0 and n % 2 == 0 and pairs.where("depth is null or var is null").count() == 0
    assert G.node_candidates(t.limit(0), SHEET, P).count() == 0 == G.nodal_pairs(t.limit(0), SHEET, P).count()
    assert E.hypotheses(G.gated(G.node_candidates(t.limit(0), SHEET, P), P), ["east"], P).count() == 0
    assert G.node_estimate_ivw(pairs.limit(0)).count() == 0
    start = spark.createDataFrame([], "row int, col int, z double, var double")
    assert G.predict(t, start, SHEET).where("pred_depth is not null").count() == 0


def test_surfaces(spark):
    t = spark.createDataFrame([(4, 4, -10.0), (4, 5, None), (4, 6, -12.0), (5, 4, -10.0)], SURFACE)
    empty = t.limit(0)
    assert by_cell(S.spike_angle(t, 1, 1.0), "angle")[4, 4] == 0 and (4, 5) not in by_cell(S.spike_angle(t, 1, 1.0), "angle")
    assert by_cell(S.despike(t, 1, 1.0, 1.0, SHEET), "z") == {(4, 4): -10.0, (4, 6): None, (5, 4): -10.0}
    assert by_cell(S.clip(t, -11.0), "z") == {(4, 4): None, (4, 5): None, (4, 6): -12.0, (5, 4): None}
    assert by_cell(S.threshold(t, -11.0), "v") == {(4, 4): 1, (4, 5): 0, (4, 6): 0, (5, 4): 1}
    flat = S.histogram(t.where("col = 4"), 1.0)
    assert flat.count() == 0 and [(r.slot, r.n) for r in S.histogram(t, 0.5).orderBy("slot").collect()] == [(0, 1), (1, 0), (2, 0), (3, 0)]
    for f in (lambda x: S.around(x, 1), lambda x: S.despike(x, 1, 1.0, 1.0, SHEET), lambda x: S.patch_surface(x, 1), lambda x: S.convolve(x, S.gauss_kernel(1)), lambda x: S.histogram(x, 1.0), lambda x: S.blobs(S.threshold(x, 0.0)), lambda x: S.mask_edges(x, 1.0, 3.0), lambda x: S.bilinear(x, 2)):
        assert f(empty).count() == 0
    assert S.coverage(spark.createDataFrame([], SND), t, SHEET).count() == 0
    diagonal = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (3, 3, 0), (5, 5, None)], "row int, col int, v int")
    assert by_cell(S.blobs(diagonal), "blob") == {(0, 0): 0, (1, 1): (1 << 32) + 1, (1, 2): (1 << 32) + 1}
    line = spark.createDataFrame([(0, c, 1) for c in range(60)] + [(r, 59, 1) for r in range(1, 40)], "row int, col int, v int")
    assert set(by_cell(S.blobs(line), "blob").values()) == {0}
    out, bits, scale, shift = S.remap_unsigned(spark.createDataFrame([(70_000,), (70_254,), (None,)], "v long"))
    assert (bits, scale, shift) == (8, 1.0, 70_000) and sorted(r.v for r in out.collect() if r.v is not None) == [0, 254]
    assert S.remap_unsigned(spark.createDataFrame([(0,), (10**6,)], "v long"))[1:3] == (16, 0.065535) and S.remap_unsigned(out.limit(0))[1:] == (8, 1.0, 0)
    hues = spark.createDataFrame([(0.0, 1.0), (120.0, 1.0), (240.0, 1.0), (360.0, 1.0), (77.0, 0.0)], "h double, s double").select(S.rgb(F.col("h"), F.col("s"), F.lit(1.0)).alias("c")).collect()
    assert [tuple(r.c) for r in hues] == [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 0), (255, 255, 255)]
    assert S.colour_table(-10.0, 0.0, 3) == [(-10.0, 300.0), (-5.0, 150.0), (0.0, 0.0)]
    with pytest.raises(ValueError):
        S.check_geometry(SHEET, SheetSpec(0, 9, 1, 1, 10, 11))


def test_series_across_stretches(spark):
    s = spark.createDataFrame([("a", t, float(t), -2.0 * t) for t in (0, 10, 9000, 20_000)] + [("b", 5, 1.0, 1.0), ("c", 5, None, 1.0), ("c", 7, 3.0, 3.0)], "k string, s long, v double, u double").withColumn("ts", F.timestamp_seconds("s"))
    t = spark.createDataFrame([("a", 1, -1), ("a", 2, 0), ("a", 3, 4000), ("a", 4, 20_000), ("a", 5, 20_001), ("b", 6, 5), ("b", 7, 6), ("c", 8, 6), ("d", 9, 1)], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for bucket in (60, 3600, 10**6):
        got = {r.id: (r.v, r.u) for r in T.interpolate(s, t, values=("v", "u"), bucket=bucket).collect()}
        assert got == {1: (None, None), 2: (0.0, 0.0), 3: (pytest.approx(4000), pytest.approx(-8000)), 4: (20_000, -40_000), 5: (None, None), 6: (1.0, 1.0), 7: (None, None), 8: (None, 2.0), 9: (None, None)}
        way = s.where("k = 'a'").select(F.col("k").alias("platform"), "ts", F.col("v").alias("x"), F.col("u").alias("y"))
        assert [r.sog for r in T.speed_over_ground(way, bucket=bucket).orderBy("ts").collect()] == [pytest.approx(5**0.5)] * 4
    assert T.interpolate(s.limit(0), t, values=("v",)).where("v is not null").count() == 0 and T.interpolate(s, t.limit(0), values=("v",)).count() == 0
    assert T.speed_over_ground(way.limit(1)).first().sog is None
    assert T.before_epoch(s, 10.0).count() == 3 and T.all_but_t(s, 15_000.0).where("k = 'a'").count() == 2 and T.all_but_n(s, 1).count() == 3
    assert T.tide_offset(spark.createDataFrame([(1.0,)], "value double"), 0.5).first().value == 1.5
