"""The node filter against closed forms, invariances and edge cases."""

import math
import random

import pytest
from seabedflow.functions.params import Params, SheetSpec, parse_config, parse_unit
from seabedflow.operators import estimate as E
from seabedflow.operators import gridding as G
from seabedflow.operators import kernel as K

P = Params()


def test_empty_and_single():
    assert K.extract(K.new_state(), P) is None
    s = K.fold([(-10.0, 0.1)], P)
    got = K.extract(s, P)
    assert (got["depth"], got["nhyp"], got["unct"], got["ratio"]) == (-10.0, 1, 0.0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 10, 11, 12, 40])
def test_equals_inverse_variance_mean(n):
    rng = random.Random(n)
    p = Params(est_offset=1e3, run_limit=10**9, bayes_threshold=0.0, quotient_limit=1e9)
    pairs = [(-10 + rng.gauss(0, 0.05), 0.05 + rng.random()) for _ in range(n)]
    got = K.extract(K.fold(pairs, p), p)
    want = sum(d / v for d, v in pairs) / sum(1 / v for _, v in pairs)
    assert math.isclose(got["depth"], want, abs_tol=1e-9) and got["n"] == n


def test_two_levels_give_two_hypotheses():
    got = K.extract(K.fold([(d, 0.01) for _ in range(30) for d in (-5.0, -9.0)], P), P)
    assert got["nhyp"] >= 2 and 0 <= got["ratio"] <= 5


def test_reading_does_not_change_state_and_batches_do_not_matter():
    rng = random.Random(3)
    pairs = [(-20 + rng.gauss(0, 0.3), 0.1) for _ in range(50)]
    whole = K.fold(pairs, P)
    part = K.fold(pairs[:17], P)
    assert K.extract(part, P) == K.extract(part, P)
    assert K.fold(pairs[17:], P, part) == whole


def test_constant_queue_and_short_queue_are_not_truncated():
    assert len(K.truncate([[-1.0, 0.1]] * 11, P)) == 11
    assert len(K.truncate([[-1.0, 0.1], [-9.0, 0.1]], P)) == 2


def test_edits():
    s = K.flushed(K.fold([(d, 0.01) for _ in range(30) for d in (-5.0, -9.0)], P), P)
    z = s["hyps"][1]["cur"]
    assert K.nominate(s, z) and K.extract(s, P)["depth"] == z
    assert K.unnominate(s) and not K.unnominate(s)
    n = len(s["hyps"])
    assert not K.remove(s, 99.0) and len(s["hyps"]) == n


def test_orders():
    assert Params().limits() == (0.5, 0.013, 5.0) and Params(order="1").limits() == (0.2, 0.0075, 2.0) and Params(order="order3").limits()[2] == 150.0
    with pytest.raises(ValueError):
        Params(order="9").limits()


def test_units_config_and_sheet():
    assert parse_unit("5 mm", "length") == 0.005 and parse_unit("1 nm", "length") == 1852 and parse_unit("10 kHz", "rate") == 1e4
    with pytest.raises(ValueError):
        parse_unit("3 parsec", "length")
    assert parse_config("a { b { c 5 m; } d x; }") == {"a.b.c": "5 m", "a.d": "x"}
    assert SheetSpec.from_bounds(0, 0, 10, 10, 1, 1).cols % 2 == 1


@pytest.mark.parametrize("n, walk", [(1, [0]), (2, [0, 1]), (3, [1, 0, 2]), (4, [1, 2, 0, 3]), (5, [2, 1, 3, 0, 4]), (10, [4, 5, 3, 6, 2, 7, 1, 8, 0, 9]), (11, [5, 4, 6, 3, 7, 2, 8, 1, 9, 0, 10])])
def test_drain_walks_to_and_fro_from_the_middle(n, walk):
    assert K.drain_order(n) == walk and K.drain_order(0) == []


def test_queue_releases_its_median_and_orders_equal_depths():
    s = K.new_state()
    for i in range(11):
        K.insert(s, -10.0, 1 + i / 100, P)
    assert [v for _, v in s["queue"]] == [1 + i / 100 for i in reversed(range(11))]  # while it fills, the newest of equals stands first
    K.insert(s, -10.0, 2.0, P)
    assert [v for _, v in s["queue"]][5] == 2.0 and s["hyps"][0]["cur_var"] == 1.05
    K.insert(s, -9.0, 3.0, P)
    K.insert(s, -11.0, 4.0, P)
    assert s["queue"][0] == [-9.0, 3.0] and s["queue"][-1] == [-11.0, 4.0]


def test_sample_variance_is_about_the_estimate_before_each_datum():
    depths, p = [-10.0, -10.4, -9.7, -10.1, -10.2, -9.9, -10.3, -9.8], Params(est_offset=1e3, run_limit=10**9, bayes_threshold=0.0)
    s = K.new_state()
    for d in depths:
        K.update(s, d, 0.5, p)
    mean, v = depths[0], 0.0
    for n, d in enumerate(depths[1:], 1):
        v = (n - 1) / n * v + (d - mean) ** 2 / n
        mean += (d - mean) / (n + 1)
    h = s["hyps"][0]
    assert math.isclose(h["samp_var"], v) and math.isclose(h["cur"], mean)
    assert math.isclose(K.extract(s, Params(uncertainty="posterior"))["unct"], 1.96 * math.sqrt(0.5 / 8)) and math.isclose(K.extract(s, Params(uncertainty="max"))["unct"], 1.96 * math.sqrt(max(v, 0.5 / 8)))


def test_numbers_stay_unique_and_data_clears_a_nomination():
    s = K.new_state()
    for d in (-5.0, -50.0, -90.0):
        K.update(s, d, 0.01, P)
    assert K.remove(s, -50.0) and K.nominate(s, -90.0) and K.is_nominated(s)
    K.update(s, -20.0, 0.01, P)
    assert [h["num"] for h in s["hyps"]] == [1, 3, 4]
    K.insert(s, -5.0, 0.01, P)
    assert not K.is_nominated(s)
    empty = K.new_state()
    K.add_hypothesis(empty, -7.0, 0.1, n=0)
    assert K.extract(empty, P) is None
    K.update(empty, -7.1, 0.1, P)
    assert K.extract(empty, P)["n"] == 1 and empty["hyps"][0]["samp_var"] == 0


def test_a_guide_without_variance_falls_back_to_most_samples():
    s = K.new_state()
    for d in (-5.0, -5.0, -5.0, -9.0):
        K.update(s, d, 0.01, P)
    assert K.extract(s, P, (-9.0, 0.0), "closest") == K.extract(s, P) and K.extract(s, P)["ratio"] == 2.0
    assert K.extract(s, P, (-9.0, 1.0), "closest")["depth"] == -9.0 and K.extract(s, P, (-6.5, 1e9), "posterior")["depth"] == -5.0


NODES = "row int, col int, hyps array<struct<num:int,cur:double,cur_var:double,samp_var:double,n:long>>"
EDITS = "row int, col int, op string, depth double, at int"


def test_edits_apply_in_time_order(spark):
    hyps = [(1, -5.0, 0.1, 0.1, 3), (2, -9.0, 0.1, 0.1, 9), (3, -9.005, 0.1, 0.1, 1)]
    nodes = spark.createDataFrame([(0, c, hyps) for c in range(7)], NODES)
    log = [(0, "nominate", -5.0, 1), (0, "remove", -20.0, 2), (0, "nominate", -9.004, 3), (1, "nominate", -9.005, 2), (1, "nominate", -5.0, 1), (2, "nominate", -5.0, 1), (2, "remove", -5.0, 2), (2, "nominate", -5.0, 3)]
    log += [(3, "nominate", -5.0, 1), (3, "unnominate", 0.0, 2), (4, "remove", -9.0, 1), (5, "remove", -5.0, 1), (9, "remove", -5.0, 1)]
    edits = spark.createDataFrame([(0, *e) for e in log], EDITS)
    got = {r.col: ([h.num for h in r.hyps], r.pick) for r in E.apply_edits(nodes, edits).collect()}
    assert got == {0: ([1, 2, 3], 3), 1: ([1, 2, 3], 3), 2: ([2, 3], None), 3: ([1, 2, 3], None), 4: ([1, 2, 3], None), 5: ([2, 3], None), 6: ([1, 2, 3], None)}
    depth = {r.col: (r.depth, r.ratio) for r in E.nominated_surface(E.apply_edits(nodes, edits)).collect()}
    assert depth[0] == (-9.005, 0.0) and depth[6] == (-9.0, 2.0)
    assert [r.num for r in E.match_hypothesis(nodes.where("col = 0"), nodes.where("col = 0").selectExpr("row", "col", "-9.0005D as depth")).collect()] == [2]
    listed = {(r.col, r.num): (r.unct, r.nominated) for r in E.node_hypotheses(E.apply_edits(nodes, edits)).collect()}
    assert len(listed) == 19 and listed[0, 3] == (pytest.approx(1.96 * 0.1**0.5), True) and not listed[0, 1][1] and E.node_hypotheses(nodes).where("nominated").count() == 0
    sheet = SheetSpec(0.0, 0.0, 1.0, 1.0, 7, 1)
    assert E.hypotheses_at(nodes, sheet, 2.4, 0.3).select("col").distinct().collect()[0][0] == 2
    assert E.hypotheses_in(nodes, sheet, 1.5, -1, 3.0, 1).count() == 6 and E.edits_at(spark.createDataFrame([(2.6, 0.1, "remove", -5.0, 1)], "x double, y double, op string, depth double, at int"), sheet).first()[:2] == (0, 3)


def test_gates_of_a_node(spark):
    rows = [(d, z, v, 0.0, s) for d, z, v, s in [(-20.0, None, None, None), (-20.0, float("nan"), 1.0, None), (-40.1, -30.0, 0.01, None), (-39.9, -30.0, 0.01, None), (-39.9, -30.0, 100.0, None), (-20.0, -21.0, 0.1, -20.5)]]
    t = spark.createDataFrame([(0, 0, 0.1, 0.05, *r) for r in rows], "row int, col int, dz double, dr double, depth double, node_depth double, node_var double, dist2 double, pred_depth double")
    assert [r.depth for r in G.gated(t, P).collect()] == [-20.0, -39.9, -39.9, -20.5]
    edge = spark.createDataFrame([(0, 0, 0.1, 0.05, -30.0, -20.0, 0.1, d * d, None) for d in (1.0, 1.01)], t.schema)
    assert [r.dist2 for r in G.gated(edge, P).collect()] == [1.0] and G.gated(edge.drop("node_depth", "node_var"), P).count() == 2


def test_fold_streams_nodes_of_any_size(spark):
    rng = random.Random(8)
    rows = [(0, c, -20 + rng.gauss(0, 1), 0.1, i) for c, n in ((0, 30_000), (1, 1), (2, 12)) for i in range(n)] + [(0, 3, None, 0.1, 0)]
    nodes = {r.col: r.hyps for r in E.hypotheses(spark.createDataFrame(rows, "row int, col int, depth double, var double, seq long"), ["seq"], P).collect()}
    assert nodes.keys() == {0, 1, 2}
    for c in nodes:
        want = K.flushed(K.fold([(r[2], r[3]) for r in rows if r[1] == c], P), P)["hyps"]
        assert [(h.num, h.cur, h.n) for h in nodes[c]] == [(h["num"], h["cur"], h["n"]) for h in want]
