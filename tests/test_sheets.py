"""Sheet descriptions, planning, seeding, dispatch and several sheets, on small tables worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F
from seabedflow.functions import projections as M
from seabedflow.functions.bounds import Bounds, bounds_of, tile_of, tiles_in
from seabedflow.functions.params import SheetSpec
from seabedflow.functions.uncertainty import DEVICES, Vessel, attributed, beam_table
from seabedflow.operators import estimate as E
from seabedflow.plans import jobs as J
from seabedflow.plans import registry
from seabedflow.plans import sheets as K
from seabedflow.sources import views as V

SF = "/root/testdata/sf0.001"


def test_bounds(spark):
    b = Bounds.of([(1, 2), (3, -4)])
    assert b == Bounds(1, -4, 3, 2) and b.valid and not Bounds().valid and b.contains(3, 2) and not b.contains(3.1, 2)
    assert b.union(Bounds(0, 0, 9, 1)) == Bounds(0, -4, 9, 2) and b.union(Bounds()) == b
    assert Bounds(-0.5, 0, 1.2, 2.9).cells(1, 1) == Bounds(-1, 0, 1, 2) and list(Bounds(0, 0, 1, 1).indexes()) == [(0, 0), (1, 0), (0, 1), (1, 1)] and list(Bounds().indexes()) == []
    t = spark.createDataFrame([(1.0, 2.0), (-1.0, -7.0), (None, 1.0)], "east double, north double")
    assert bounds_of(t) == Bounds(-1.0, -7.0, 1.0, 2.0) and bounds_of(t.limit(0)) == Bounds()
    assert t.where(Bounds(0, 0, 5, 5).holds(F.col("east"), F.col("north"))).count() == 1 and t.where(Bounds().holds(F.col("east"), F.col("north"))).count() == 0
    got = t.select(tile_of(F.col("east"), F.col("north"), 0.5, 1.0, 3, 4).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got[:2]] == [(0, 0, 2, 2), (-1, -2, 1, 1)]
    assert tiles_in(Bounds(-1, 0, 1, 3), 0.5, 1.0, 3, 4) == [(-1, 0), (0, 0)]


def test_descriptions(spark):
    s = SheetSpec.from_bounds(100, 200, 140, 260, 2, 5)
    text = K.sheet_text(s, -70.5, 43.0)
    back, proj = K.parse_sheet(text)
    assert back == s and isinstance(proj, M.Utm)
    by_centre, merc = K.parse_sheet("sheet { projection { type mercator; origin (-70.5, 43) deg; } center (1 km, 2 km); width 100 m; height 60 m; spacing (2, 2) m; }")
    assert by_centre == SheetSpec.from_center(1000, 2000, 100, 60, 2, 2) and isinstance(merc, M.Mercator)
    direct, _ = K.parse_sheet("sheet { projection { type utm; origin (-70.5, 43) deg; } location (5, 9) m; width 10 m; height 20 m; spacing (5, 5) m; }")
    assert direct == SheetSpec(5, 9, 5, 5, 3, 5)
    for bad in ("sheet { projection { type cone; origin (1, 2) deg; } }", "sheet { projection { origin 7; } }"):
        with pytest.raises(ValueError):
            K.parse_sheet(bad)
    m = M.Mercator(-70.5, 43.0)
    assert K.sheet_by_lonlat_center(spark, m, -70.5, 43.0, 100, 60, 2, 2).cols == 51
    b = K.sheet_by_lonlat_bounds(spark, m, -70.51, 43.0, -70.49, 43.01, 10, 10)
    assert 1600 < (b.cols - 1) * b.dx < 1640 and K.contains(b, 0.0, b.y0 - 10) and not K.contains(b, 1e6, 0.0)
    assert K.sheet_info(s)["area_km2"] == pytest.approx(40 * 60 / 1e6)
    lines = K.outlines([s, SheetSpec(90, 200, 1, 1, 3, 3)], 0.5).splitlines()
    at = lines.index("LOCAL_ORIGIN 90.00 198.00 0.0")
    assert lines.count("NEW 5") == 2 and lines[at : at + 7] == ["LOCAL_ORIGIN 90.00 198.00 0.0", "NEW 5", "10.00 2.00 0.00", "10.00 62.00 0.00", "50.00 62.00 0.00", "50.00 2.00 0.00", "10.00 2.00 0.00"]


def test_planning(spark):
    whole = SheetSpec(0, 99, 1, 1, 100, 100)
    cells = [(r, c, -5.0 if c < 50 else -30.0) for r in range(100) for c in range(100) if r >= 40]
    depth = spark.createDataFrame(cells, "row int, col int, z double")
    plan = K.plan_sheets(depth, whole, [20.0], [1.0, 4.0], 30)
    assert len(plan[1.0]) == 6
    for s in plan[1.0]:
        b = K.sheet_bounds(s)
        assert b.max_x <= 52 and b.max_y <= 62 and max(s.cols, s.rows) <= 36
    covered = {(r, c) for r, c, z in cells if z == -5.0 and any(K.contains(s, c, 99 - r) for s in plan[1.0])}
    assert len(covered) == sum(z == -5.0 for *_, z in cells)
    assert len(plan[4.0]) == 1 and K.plan_sheets(depth.where("z > -10"), whole, [20.0], [1.0, 4.0], 30)[4.0] == []
    mask = depth.select("row", "col", F.lit(0).alias("v"))
    burnt = {(r.row, r.col) for r in K.stencil(mask, whole, SheetSpec(10, 50, 1, 1, 6, 4)).where("v = 255").collect()}
    assert burnt == {(r, c) for r in range(49, 52) for c in (10, 15)} | {(r, c) for c in range(10, 15) for r in (49, 52)}


def test_seeding_and_dispatch(spark):
    surface = spark.createDataFrame([(0, 0, -10.0), (0, 1, -12.0), (1, 0, None)], "row int, col int, z double")
    mask = spark.createDataFrame([(0, 1, 255), (5, 5, 255), (0, 0, 7)], "row int, col int, v int")
    got = {(r.row, r.col): r.z for r in J.start_surface(surface, 0.5, mask=mask).collect()}
    assert got[0, 0] == -10.0 and math.isnan(got[0, 1]) and math.isnan(got[5, 5]) and (1, 0) not in got
    assert J.start_surface(surface, 0.5).first().var == 0.25
    snd, p = V.soundings(spark, SF), registry.P
    start = J.start_surface(registry.mean(spark, SF), 0.5)
    prior = J.estimate(snd, V.SHEET, p, V.ARRIVAL)
    assert {tuple(r) for r in prior.collect()} == {tuple(r) for r in E.prior_surface(registry.folded(spark, SF)).collect()}
    for how in ("mean", "median", "hits", "sdev"):
        assert J.estimate(snd, V.SHEET, p, V.ARRIVAL, how).columns == ["row", "col", "z"]
    for how in ("context", "posterior", "predsurf", "nodal"):
        assert J.estimate(snd, V.SHEET, p, V.ARRIVAL, how, start if how == "predsurf" else None).count() > 300
    with pytest.raises(ValueError):
        J.extract(registry.folded(spark, SF), p, "predsurf")
    frozen = J.start_surface(registry.mean(spark, SF), 0.5, mask=registry.mean(spark, SF).select("row", "col", F.lit(255).alias("v")))
    assert J.node_pairs(snd, V.SHEET, p, frozen).count() < J.node_pairs(snd, V.SHEET, p).count()


def test_several_sheets(spark, tmp_path):
    t = V.soundings(spark, SF).withColumns({"file": F.lit("x_1"), "across": F.lit(0.0)})
    wide = spark.createDataFrame([(1, "x_", 0.0, 1000.0, -80.0, 80.0)], "rank int, recog string, min_depth double, max_depth double, min_angle double, max_angle double")
    east = SheetSpec(20.0, 40.0, 1.0, 4.0, 30, 11)
    mask = spark.createDataFrame([(r, c, 1) for r in range(11) for c in range(10)], "row int, col int, v int")
    got = J.assimilate_sheets(t, wide, {"all": V.SHEET, "east": east}, registry.P, V.ARRIVAL, str(tmp_path), {"east": mask})
    assert sorted(map(tuple, got["all"].collect())) == sorted(map(tuple, J.assimilate(t, wide, V.SHEET, registry.P, V.ARRIVAL, str(tmp_path / "one")).collect()))
    assert got["east"].where("col < 8").count() == 0 < got["east"].where("col >= 10").count()
    J.blank_sheet(spark, east, str(tmp_path / "blank"))
    J.sheet_layer(spark, str(tmp_path / "all"), "depth", str(tmp_path / "grid"), Bounds(5, 5, 20, 30), 1.2, 1, 3.0)
    assert J.hypothesis_dump(registry.folded(spark, SF), V.SHEET, Bounds(10, 10, 12, 30)).first().value.count(" ") == 5


def test_error_budget_across_a_swath(spark):
    """The budget of one swath against a plain evaluation of the whole model, beam by beam."""
    v = Vessel(imu=(-0.242, 0.004, 0.464), gps=(0.219, -0.117, 4.503), gps_latency=0.25, draft=0.7)
    depth, roll, pitch, heave, c, way = 25.0, math.radians(2), math.radians(2), 0.05, 1536.0, 6.68
    got = beam_table("em1002", v, depth, 2.0, 2.0, heave, c, way, 10.0, spark).orderBy("beam").collect()
    d, deg = DEVICES["em1002"], math.radians(1)
    assert len(got) == 111 and got[55].angle_deg == 0 and got[0].angle_deg == -75
    cp, sp, cr, sr = math.cos(pitch), math.sin(pitch), math.cos(roll), math.sin(roll)
    for r in got:
        a = math.radians(r.angle_deg)
        rng = depth / math.cos(a)
        bw = d.across * deg
        av = (bw / 12 if abs(r.angle_deg) <= 10 else 0.2 * bw) ** 2 + 0.005 * deg**2 + (math.tan(a) * 0.52) ** 2 / (4 * c * c)
        beyond = a + 60 * deg if a < -60 * deg else a - 60 * deg if a > 60 * deg else 0
        av += (math.tan(beyond) * 0.5 / c) ** 2
        rv = (0.0626 / 2) ** 2 + (c * 0.2e-3 / 4) ** 2
        x, y, z = v.imu
        hv = max((0.1 * heave) ** 2, 0.0025) + 0.005 * deg**2 * ((x * cp - y * sr * sp - z * cr * sp) ** 2 + (y * cr * cp - z * sr * cp) ** 2) + 5e-5 * (sp**2 + (sr * cp) ** 2 + (1 - cr * cp) ** 2)
        t = roll + a
        dz = 0.0017 + hv + (rv + (rng * 0.52 / c) ** 2) * (cp * math.cos(t)) ** 2 + av * (rng * math.sin(t) * cp) ** 2 + 0.005 * deg**2 * (rng * math.cos(t) * sp) ** 2 + ((1 - math.cos(deg)) * depth) ** 2
        assert r.vert95 == pytest.approx(1.96 * math.sqrt(dz), rel=1e-9)
        assert r.horz95 > 1.96 * 2
    t = spark.createDataFrame([("a", 3, 20.0, 22.0, 1.0, 1.0, 0.0, 1500.0, 1500.0, 5.0, 3), ("z", 3, 20.0, 22.0, 1.0, 1.0, 0.0, 1500.0, 1500.0, 5.0, 3)], "platform string, beam int, depth double, range double, roll double, pitch double, heave double, surf_sspeed double, mean_speed double, vessel_speed double, flags int")
    assert attributed(t.where("platform = 'a'"), {"a": ("em300", v), "b": ("sb8101", v)}).first().dz > 0
    with pytest.raises(Exception, match="no device"):
        attributed(t, {"a": ("em300", v)}).collect()
    assert Vessel.from_config({"vessel.sdev.roll": "0.1 deg", "vessel.sdev.gps_drms": "5", "other": "x"}) == Vessel(roll_sdev=0.1, gps_drms=5.0)
