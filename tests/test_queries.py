"""Registered queries against DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest
from seabedflow.plans import registry

SF = "/root/testdata/sf0.001"


def plain(d):
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        d[c] = d[c].astype(str) if d[c].dtype == object else d[c].astype("float64").round(4)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    pd.testing.assert_frame_equal(plain(got), plain(con.execute(registry.oracle_sql()[name]).df()), check_dtype=False, atol=2e-4)


@pytest.mark.parametrize("name", ["blob_stats", "trimmed_mean_surface"])
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from seabedflow.functions.params import Params
    from seabedflow.operators import kernel
    from seabedflow.streaming.nodes import stream_surface

    p = Params()
    rows = [(i, i % 3, 0, -10.0 - (i * 7 % 5) / 10, 0.1) for i in range(90)]
    schema = "seq long, row int, col int, depth double, var double"
    for k in range(2):
        spark.createDataFrame(rows[k * 45 : k * 45 + 45], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_surface(src, p).writeStream.outputMode("update").format("memory").queryName("surface").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.row: r for r in spark.sql("select * from surface").collect() if r.n == 30}
    for node in range(3):
        want = kernel.extract(kernel.fold([(r[3], r[4]) for r in rows if r[1] == node], p), p)
        assert abs(got[node].depth - want["depth"]) < 1e-9
