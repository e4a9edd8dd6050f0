"""Text parsers and map projections against known values and round trips."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from seabedflow.functions import projections as M
from seabedflow.sources import text as X


def test_gga(spark):
    lines = ["$INGGA,014530.25,5130.6,N,00007.5,W,1", "$GPGGA,000000,3000.0,S,01030.0,E,1", "$INGLL,1,2", "$INGGA,x,4304.5,N,07042.5,W", None, ""]
    got = [r.g for r in spark.createDataFrame([(x,) for x in lines], "l string").select(X.parse_gga(F.col("l")).alias("g")).collect()]
    assert got[0].epoch == pytest.approx(3600 + 45 * 60 + 30.25) and got[0].lat == pytest.approx(51 + 30.6 / 60) and got[0].lon == pytest.approx(-7.5 / 60)
    assert (got[1].epoch, got[1].lat, got[1].lon) == (0.0, -30.0, 10.5) and got[2:] == [None] * 4


def test_tides(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("99 12 31 23 59 -1.5\n70 1 1 0 0 2\n# no tide\n2000 13 1 0 0 1\n71 1 1 0 0 .25 more\n\n")
    got = [tuple(r) for r in X.read_tides(spark, str(path), "Y M D h m T").select(F.unix_seconds("ts"), "tide").collect()]
    assert sorted(got) == [(31536000, 0.25), (946684740, -1.5), (3155760000, 2.0)]
    g = spark.createDataFrame([("60 6 30 0.5",), ("1 0 0",)], "l string").select(X.parse_tide(F.col("l"), X.JULIAN_TIDE, 2000).alias("g")).collect()
    assert g[0].g.epoch == datetime(2000, 2, 29, 6, 30, tzinfo=UTC).timestamp() and g[0].g.tide == 0.5 and g[1].g is None
    for bad in ("Y M h m T", "Y Y J h m T", "J h m"):
        with pytest.raises(ValueError):
            X.tide_pattern(bad)
    with pytest.raises(ValueError):
        X.parse_tide(F.lit(""), "J h m T")


@pytest.mark.parametrize("proj,points", [
    (M.Mercator(-70, 43, 5, 6), [(-70.7, 43.1), (179.9, -60.0), (0.0, 0.0)]), (M.Utm.at(-70.7, 43.1), [(-70.7, 43.1), (-67.0, 10.0)]), (M.Utm.at(151.0, -33.0), [(151.2, -33.9)]),
    (M.PolarStereographic(-45, 70), [(-45.0, 75.0), (100.0, 61.0)]), (M.PolarStereographic(0, -90, 1, 2), [(30.0, -80.0), (-170.0, -65.0)]),
])
def test_round_trips(spark, proj, points):
    t = spark.createDataFrame(points, "lon double, lat double")
    x, y = proj.forward(F.col("lon"), F.col("lat"))
    t = t.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = proj.inverse(F.col("x"), F.col("y"))
    for r in t.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-7)


def test_worked_examples(spark):
    """Points whose coordinates follow from the ellipsoid alone."""
    t = spark.range(1)
    east, north = M.Utm(31).forward(F.lit(3.0), F.lit(0.0))
    x, _ = M.Mercator(0.0).forward(F.lit(180.0 - 1e-12), F.lit(0.0))
    ux, uy = M.Utm(31).forward(F.lit(3.0), F.lit(90.0 - 1e-9))
    r = t.select(east, north, F.abs(x), ux, uy).first()
    assert r[0] == pytest.approx(500000) and r[1] == pytest.approx(0, abs=1e-6) and r[2] == pytest.approx(20037508.342789, abs=1e-3)
    assert r[4] == pytest.approx(0.9996 * 10001965.729, abs=0.05)


def test_written_text(spark, tmp_path):
    t = spark.createDataFrame([(1_000_000_000, 0.25), (951_782_400, -1.5), (None, 1.0)], "s long, tide double").withColumn("ts", F.timestamp_seconds("s"))
    for fmt in ("Y M D h:m:s T", "Y J h m T *", "D/M/Y h:m T"):
        lines = [r.value for r in X.tide_lines(t, fmt).collect()]
        back = spark.createDataFrame([(x,) for x in lines], "l string").select(X.parse_tide(F.col("l"), fmt).alias("g")).collect()
        whole = 1 if "s" in fmt else 60
        assert sorted((r.g.epoch, r.g.tide) for r in back) == sorted((s // whole * whole, h) for s, h in ((1_000_000_000, 0.25), (951_782_400, -1.5)))
    series = t.where("s is not null").withColumns({"k": F.lit("a"), "x": F.lit(0.5)})
    assert [r.value for r in X.series_lines(series, ["tide", "x"]).orderBy("value").collect()] == ["0 951782400.000 -1.50000 0.500000", "1 1000000000.000 0.250000 0.500000"]
    points = spark.createDataFrame([(10.0, 20.0, -5.0, 0.25, 6.0, 1, 2, 3), (14.0, 30.0, -9.0, 1.0, 7.0, 4, 5, 6), (0.0, 0.0, -1.0, 1.0, 1.0, 1, 1, 1)], "east double, north double, depth double, dz double, range double, beam int, file_id int, backscatter int")
    head, lines = X.point_file(points, "beam")
    assert "N_RECORDS 2\n" in head and "COLOR ATTRIBUTE 6\n" in head and head.endswith("LOCAL_ORIGIN 12.000000 25.000000 -10.000000\n")
    assert sorted(r.value for r in lines.collect()) == ["-2.000 -5.000 5.000 0.500 6.000 1 2 3", "2.000 5.000 1.000 1.000 7.000 4 5 6"]
    assert "N_RECORDS 0\n" in X.point_file(points.limit(0))[0]
    (tmp_path / "d").mkdir()
    for n in ("a.raw", "d/b.raw", "c.txt"):
        (tmp_path / n).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in X.find_files(spark, str(tmp_path), ".raw").collect()) == ["a.raw", "b.raw"]
    (tmp_path / "list").write_text("one.raw\n\n# no\n/abs/two.raw\n")
    assert X.name_list(spark, str(tmp_path / "list"), "/data/") == ["/data/one.raw", "/abs/two.raw"]
