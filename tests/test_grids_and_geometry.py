"""Grid text, stored sheets, platform lists and beam geometry against known values and round trips."""

import glob
import math

import pytest
from pyspark.sql import functions as F
from seabedflow.functions import geometry as H
from seabedflow.functions import projections as M
from seabedflow.functions.params import SheetSpec
from seabedflow.sources import grids as R

SPEC = SheetSpec(100.0, 220.0, 5.0, 5.0, 4, 3)


def test_grid_text(spark, tmp_path):
    cells = [(0, 1, -10.5), (0, 3, -12.0), (2, 0, -11.25), (2, 1, None), (9, 9, -1.0)]
    R.write_grid(spark.createDataFrame(cells, "row int, col int, z double"), SPEC, str(tmp_path / "g"))
    (path,) = glob.glob(str(tmp_path / "g" / "part-*"))
    assert open(path).read().splitlines()[1:7] == ["COLS_ROWS 4 3", "CELLSIZE 5.000000", "SHAPE PARTIAL", "LOCAL_ORIGIN 100.000000 210.000000 -13.000000", "0 1", "1.750000"]
    got = sorted((r.row, r.col, round(r.z, 6)) for r in R.read_grid(spark, path).collect())
    assert got == [(0, 1, -10.5), (0, 3, -12.0), (2, 0, -11.25)] and R.grid_spec(spark, path) == SPEC
    R.write_grid(spark.createDataFrame([], "row int, col int, z double"), SPEC, str(tmp_path / "e"))
    assert R.read_grid(spark, str(tmp_path / "e")).count() == 0
    full = tmp_path / "f.txt"
    full.write_text("# made\nBEGIN GUTM 1.0\nCOLS_ROWS 2 2\nCELLSIZE 1\nSHAPE FULL\nUSE_ALTERNATE_DATA\nLOCAL_ORIGIN 0 0 -5\n1 7 0 0\n2 8\n3 9\n")
    assert sorted(tuple(r)[:4] for r in R.read_grid(spark, str(full)).collect()) == [(0, 0, -3.0, 8.0), (0, 1, -2.0, 9.0), (1, 0, -4.0, 7.0)]
    for bad in ("", "BEGIN GUTM 1.0\nCOLS_ROWS 2\n"):
        with pytest.raises(ValueError):
            R._cells(bad)
    with pytest.raises(ValueError):
        R._cells(full.read_text().replace("3 9", "3"))


def test_sheet_store(spark, tmp_path):
    t = spark.range(200).select((F.col("id") % 20).cast("int").alias("row"), F.floor(F.col("id") / 20).cast("int").alias("col"), (-F.col("id")).cast("double").alias("depth"))
    R.save_sheet(t, SPEC, str(tmp_path / "s"), tile=8)
    spec, got = R.load_sheet(spark, str(tmp_path / "s"))
    assert spec == SPEC and {tuple(r) for r in got.select("row", "col", "depth").collect()} == {tuple(r) for r in t.collect()}
    some = R.load_sheet(spark, str(tmp_path / "s"), rows=(7, 9), cols=(0, 3))[1]
    assert some.count() == 12 and "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString()
    assert R.world_file(SPEC).split() == ["5.000000", "0.000000", "0.000000", "-5.000000", "100.000000", "220.000000"]


def test_platforms(spark, tmp_path):
    p = tmp_path / "list"
    p.write_text("_a one 0,50 -60,60 a.cfg\n_b two 5,20.5 -45,45 b.cfg\n")
    got = R.read_platforms(spark, str(p)).collect()
    assert tuple(got[1]) == (2, "_b", "two", 5.0, 20.5, -45.0, 45.0, "b.cfg")
    for bad in ("_a one 0,50 -60,90 c", "_a one -1,50 0,1 c", "_a one 0,50"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            R.read_platforms(spark, str(p))


def test_geodesics(spark):
    lit = F.lit
    quarter = H.arc_end(spark.range(1), lit(10.0), lit(0.0), lit(10001965.729), lit(0.0)).first()
    equator = H.arc_end(spark.range(1), lit(10.0), lit(0.0), lit(6378137 * math.radians(1)), lit(math.pi / 2)).first()
    assert quarter.b_lat == pytest.approx(90, abs=1e-7) and equator.b_lon == pytest.approx(11, abs=1e-9) and equator.b_lat == pytest.approx(0, abs=1e-12)
    # near the place, beams agree with the plane
    utm = M.Utm.at(-69.0, 43.0)
    t = spark.createDataFrame([(30.0, 40.0, 0.0), (-20.0, 0.0, 90.0), (0.0, -50.0, 200.0), (0.0, 0.0, 10.0)], "a double, s double, h double")
    c = F.col
    e0, n0 = (v.alias(k) for v, k in zip(utm.forward(lit(-69.0), lit(43.0)), "xy", strict=True))
    for r in H.locate_beams(t, utm, c("a"), c("s"), c("h"), lit(-69.0), lit(43.0)).select("*", e0, n0).collect():
        h = math.radians(r.h)
        assert r.east - r.x == pytest.approx(0.9996 * (r.a * math.sin(h) + r.s * math.cos(h)), abs=1e-3)
        assert r.north - r.y == pytest.approx(0.9996 * (r.a * math.cos(h) - r.s * math.sin(h)), abs=1e-3)
    assert H.arc_end(spark.range(1), lit(None).cast("double"), lit(1.0), lit(5.0), lit(0.0)).first().b_lon is None


def test_formulas(spark):
    lit = F.lit
    z, v = [lit(x) for x in (-10.0, -12.0, -10.0, -14.0)], [lit(x) for x in (1.0, 2.0, 3.0, 4.0)]
    r = spark.range(1).select(
        H.interpolation_variance(z, v, lit(0.0), lit(1.0), lit(0.0), 1.0, 1.0), H.interpolation_variance(z, v, lit(0.5), lit(0.5), lit(2.0), 2.0, 1.0),
        H.packed_time(lit(19700102), lit(1500)), H.packed_time(lit(19701301), lit(0)), H.stamp_time(lit("2000/01/01:00:00:07")), H.stamp_time(lit("no")),
        H.prior_variance(lit(-100.0), 1.96, True), H.prior_variance(lit(-100.0), 0.5, False), H.time_fields(lit(951782400.25 + 3661)),
    ).first()
    assert r[0] == 1.0 and r[1] == pytest.approx(10 / 16 + 2 * (9 / 4 + 1)) and list(r[2:8]) == [86401.5, None, 946684807.0, None, pytest.approx(1.0), 0.25]
    assert tuple(r[8]) == (2000, 2, 29, 60, 1, 1, 1, 250.0) and H.depth_thresholds(90.0, [2.0]) == [pytest.approx(1.0)]
