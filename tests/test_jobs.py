"""The batch job end to end at the smallest scale, and the store of soundings."""

import pytest
from pyspark.sql import functions as F
from seabedflow.functions import projections as M
from seabedflow.operators import gridding as G
from seabedflow.operators import estimate as E
from seabedflow.plans import jobs, registry
from seabedflow.sources import grids as R
from seabedflow.sources import views as V

SF = "/root/testdata/sf0.001"
GATES = "rank int, recog string, min_depth double, max_depth double, min_angle double, max_angle double"


def test_assimilate(spark, tmp_path):
    t = V.soundings(spark, SF).withColumns({"file": F.concat(F.lit("x_"), "platform"), "across": F.lit(0.0)})
    wide = spark.createDataFrame([(1, "x_", 0.0, 1000.0, -80.0, 80.0)], GATES)
    got = jobs.assimilate(t, wide, V.SHEET, registry.P, V.ARRIVAL, str(tmp_path / "sheet"))
    names = ["row", "col", "depth", "unct", "nhyp"]
    want = E.prior_surface(registry.folded(spark, SF))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    jobs.summarise(registry.cells(spark, SF), got.select("row", "col", "depth"), V.SHEET, str(tmp_path / "sum"))
    a = {(r.row, r.col): r.z for r in R.read_grid(spark, str(tmp_path / "sum" / "depth")).collect()}
    assert a == {(r.row, r.col): pytest.approx(r.depth, abs=2e-6) for r in got.collect()}
    with pytest.raises(Exception, match="no platform for"):
        jobs.gated_soundings(t, wide.withColumn("recog", F.lit("nowhere"))).count()


def test_sounding_store(spark, tmp_path):
    utm = M.Utm.at(-70.5, 43.0)
    t = spark.createDataFrame([(500100.0 + i, 4760000.0 - i, -10.0 - i) for i in range(5)], "east double, north double, depth double")
    for _ in range(2):
        jobs.put_soundings(t, utm, str(tmp_path / "s"))
    got = sorted(tuple(r) for r in jobs.get_soundings(spark, utm, str(tmp_path / "s")).select("depth", "east", "north").collect())
    assert len(got) == 10 and got[0] == (-14.0, pytest.approx(500104.0, abs=1e-3), pytest.approx(4759996.0, abs=1e-3))


def test_predict_outside(spark):
    s = spark.createDataFrame([(-5.0, 3.0, 0.1), (None, 3.0, 0.1)], "east double, north double, dr double")
    got = G.predict(s, spark.createDataFrame([], "row int, col int, z double, var double"), V.SHEET).collect()
    assert len(got) == 2 and all(r.pred_depth is None and r.pred_var is None for r in got)
