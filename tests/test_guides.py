"""The guide search against a plain loop over rings."""

import random
from dataclasses import replace

import pytest
from seabedflow.functions.params import Params
from seabedflow.operators import estimate as E

P = Params()
SCHEMA = f"row int, col int, {E.HYPS}"


def node(row, col, *depths):
    return (row, col, [(i + 1, d, 0.1, 0.2, 3) for i, d in enumerate(depths)])


def plain(nodes, p):
    """The node each node of several hypotheses is guided by; later matches of a ring replace earlier ones."""
    single = {(r, c): h[0][1] for r, c, h in nodes if len(h) == 1}
    want = {}
    for r, c, h in nodes:
        if len(h) < 2:
            continue
        for k in range(int(p.min_context / p.dist_scale), int(p.max_context / p.dist_scale) + 1):
            at = [(r - k, c + d) for d in range(-k, k + 1)] + [(r + k, c + d) for d in range(-k, k + 1)]
            at += [(r + d, c - k) for d in range(-k + 1, k)] + [(r + d, c + k) for d in range(-k + 1, k)]
            met = [x for x in at if x in single]
            if met:
                want[r, c] = single[met[-1]]
                break
    return want


def got(spark, nodes, p):
    return {(g.row, g.col): g.gz for g in E.guides(spark.createDataFrame(nodes, SCHEMA), p).collect()}


@pytest.mark.parametrize("far", range(1, 12))
def test_rings_from_least_to_most_context(spark, far):
    nodes = [node(20, 20, -10.0, -30.0), node(20, 20 + far, -30.5)]
    assert got(spark, nodes, P) == plain(nodes, P) == ({(20, 20): -30.5} if 5 <= far <= 10 else {})


@pytest.mark.parametrize("scale", [1.0, 2.0, 8.0])
def test_rings_of_a_sheet(spark, scale):
    rng, p = random.Random(4), replace(P, dist_scale=scale)
    nodes = [node(r, c, *([-20 - rng.random()] if rng.random() < 0.03 else [-10.0, -30.0])) for r in range(25) for c in range(25)]
    assert got(spark, nodes, p) == plain(nodes, p)


def test_corner_belongs_to_top_and_bottom(spark):
    nodes = [node(20, 20, -10.0, -30.0), node(15, 15, -1.0), node(25, 20, -2.0)]
    assert got(spark, nodes, P) == plain(nodes, P) == {(20, 20): -2.0}


@pytest.mark.parametrize("how", ["closest", "posterior"])
def test_guide_picks_the_hypothesis(spark, how):
    nodes = [node(20, 20, -10.0, -30.0), node(20, 27, -30.5)]
    t = spark.createDataFrame(nodes, SCHEMA)
    r = {(x.row, x.col): x for x in E.guided_surface(t, E.guides(t, P), how).collect()}
    assert (r[20, 20].depth, r[20, 20].nhyp, r[20, 27].depth) == (-30.0, 2, -30.5)
