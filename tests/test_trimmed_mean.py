"""Clipped means against a plain loop over one cell."""

import math
import random

import pytest
from seabedflow.operators import gridding as G


def spread(xs, mean):
    return math.sqrt(sum(x * x for x in xs) / (len(xs) - 1) - mean * mean)


def plain(xs, rounds=100, eps=0.01):
    """Mean, number of samples kept and rounds."""
    mean = sum(xs) / len(xs)
    if len(xs) < 2:
        return mean, len(xs), 0
    se = spread(xs, mean)
    for k in range(1, rounds + 1):
        kept = [x for x in xs if mean - 2 * se <= x <= mean + 2 * se]
        new = sum(kept) / len(kept)
        dev = spread(kept, new)
        settled = abs(new - mean) < eps * abs(new) and abs(dev - se) < eps * dev
        mean, se = new, dev
        if settled:
            break
    return mean, len(kept), k


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(8)
    skewed = lambda n: [-30 - rng.lognormvariate(0, 1.5) for _ in range(n)]
    cells = {(0, 0): skewed(20000), (0, 1): skewed(300), (1, 0): [-12.5], (1, 1): [-10.0, -11.0], (2, 0): [-40.0] * 5, (2, 1): [-20 + rng.gauss(0, 1) for _ in range(500)] + [-300.0] * 3}
    assert plain(cells[0, 0])[2] > 8
    return cells


def frame(spark, cells):
    return spark.createDataFrame([(r, c, z) for (r, c), zs in cells.items() for z in zs], "row int, col int, depth double").repartition(5)


def test_equals_plain_loop(spark, samples):
    got = {(r.row, r.col): r for r in G.trimmed_mean(frame(spark, samples)).collect()}
    assert set(got) == set(samples)
    for at, zs in samples.items():
        z, n, _ = plain(zs)
        assert got[at].z == pytest.approx(z, abs=1e-6) and got[at].n_kept == n


def test_bound_is_reported(spark, samples):
    with pytest.warns(UserWarning, match="cells still move after 3 rounds"):
        got = {(r.row, r.col): r for r in G.trimmed_mean(frame(spark, samples), rounds=3).collect()}
    assert got[0, 0].z == pytest.approx(plain(samples[0, 0], 3)[0], abs=1e-6)


def test_without_depths(spark):
    t = spark.createDataFrame([(0, 0, None), (0, 1, None), (0, 1, -3.0)], "row int, col int, depth double")
    assert sorted(tuple(r) for r in G.trimmed_mean(t).collect()) == [(0, 0, None, 0), (0, 1, -3.0, 1)]
    assert G.trimmed_mean(t.limit(0)).count() == 0
