"""Streams against the same data in one batch."""

import random

import pytest
from seabedflow.streaming import series as S


def test_release_is_ordered_and_bounded():
    samples = [[float(t), t * 2.0] for t in (3, 1, 2)]
    out, kept, rest = S.release(samples, [[2.5, 7], [0.5, 8], [9.0, 9], [1.0, 6]], 1.5)
    assert out == [(8, 0.5, None), (6, 1.0, [2.0]), (7, 2.5, [5.0])] and kept == [[2.0, 4.0], [3.0, 6.0]] and rest == [[9.0, 9]]
    assert S.release([], [[1.0, 1]], 5) == ([], [], [[1.0, 1]])
    assert S.flush_before(samples, 2) == [[3.0, 6.0], [2.0, 4.0]] and S.keep_last(samples, 1) == [[2.0, 4.0]] and S.keep_last(samples, 0) == []
    assert S.at_time([[1.0, 5.0]], 1.0) == [5.0] and S.at_time([[1.0, 5.0], [1.0, 6.0]], 1.0) == [5.0] and S.at_time([], 1.0) is None


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    rng = random.Random(5)
    rows = [(f"k{i % 3}", i / 10, None, [float(i), rng.random()]) for i in range(120)] + [(f"k{i % 3}", i / 10 + 0.013, i, None) for i in range(0, 118, 5)]
    rows.sort(key=lambda r: r[1])
    schema = "k string, ts double, id long, values array<double>"
    step = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * step : n * step + step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.stream_interpolate(src).writeStream.outputMode("append").format("memory").queryName(f"series{files}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r["values"] for r in spark.sql(f"select * from series{files}").collect()}
    want = {}
    for k, ts, i, _ in rows:
        if i is not None:
            v = S.at_time(sorted([t, *v] for kk, t, j, v in rows if kk == k and j is None), ts)
            if v is not None:
                want[i] = v
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
