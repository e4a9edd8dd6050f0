"""The node filter over DataFrames: ordered fold by node, extraction, guided extraction, hypothesis lists."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import Params, SheetSpec
from . import kernel

CELL = ["row", "col"]
HYPS = "hyps array<struct<num:int,cur:double,cur_var:double,samp_var:double,n:long>>"
SURFACE = "row int, col int, depth double, unct double, ratio double, nhyp int, n long"


def hypotheses(pairs: DataFrame, order: list[str], p: Params) -> DataFrame:
    """Fold the (depth, var) pairs of each node in ``order``: row, col and its hypotheses.

    The filter depends on the order of a node's soundings and has no partial form. Nodes are dealt by hash and sorted within
    partitions, where Spark spills; a partition streams through one filter state, so a node of any size takes the memory of a queue
    and its hypotheses. All surfaces are read off the result without another fold. Pairs without depth or variance are left out;
    equal rows may come in any order; an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, index, out = None, None, None, []

        def done() -> tuple:
            hyps = kernel.flushed(state, p)["hyps"]
            return (*at, [{k: h[k] for k in ("num", "cur", "cur_var", "samp_var", "n")} for h in hyps])

        for b in batches:
            for r, c, d, v in zip(b["row"].tolist(), b["col"].tolist(), b["depth"].tolist(), b["var"].tolist(), strict=True):
                if (r, c) != at:
                    if at is not None:
                        out.append(done())
                    at, state = (r, c), kernel.new_state()
                    index = kernel.Index(state)
                kernel.insert(state, d, v, p, index)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["row", "col", "hyps"])
                out = []
        if at is not None:
            yield pd.DataFrame([*out, done()], columns=["row", "col", "hyps"])

    cols = list(dict.fromkeys([*CELL, "depth", "var", *order]))
    t = pairs.select(*cols).where("depth is not null and var is not null")
    t = t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CELL).sortWithinPartitions(*CELL, *order)
    return t.select(*CELL, "depth", "var").mapInPandas(run, f"row int, col int, {HYPS}")


def _limit(h: Column, uncertainty: str) -> Column:
    v = {"sample": h.samp_var, "posterior": h.cur_var}
    return 1.96 * F.sqrt(F.greatest(*v.values()) if uncertainty == "max" else v[uncertainty])


def _by_samples() -> tuple[Column, Column]:
    """The hypothesis of most samples, the earliest of equals, and its strength max(0, 5 - n1/n2)."""
    best = F.array_sort("hyps", lambda a, b: F.when(a.n > b.n, -1).when(a.n < b.n, 1).otherwise(a.num - b.num))
    second = F.element_at(best, F.least(F.size("hyps"), F.lit(2))).n
    return best[0], F.when(F.size("hyps") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 5 - best[0].n / second))


def _layers(t: DataFrame, uncertainty: str) -> DataFrame:
    h = F.col("h")
    return t.select(*CELL, h.cur.alias("depth"), _limit(h, uncertainty).alias("unct"), "ratio", F.size("hyps").alias("nhyp"), h.n.alias("n"))


def with_data(nodes: DataFrame) -> DataFrame:
    """Hypotheses that data has joined, of nodes that have any; null hypotheses of an initial surface are never extracted."""
    return nodes.withColumn("hyps", F.filter("hyps", lambda x: x.n > 0)).where(F.size("hyps") > 0)


def prior_surface(nodes: DataFrame, uncertainty: str = "sample") -> DataFrame:
    """Most samples, the earliest of equals; strength max(0, 5 - n1/n2). Arrays only, no Python."""
    h, ratio = _by_samples()
    return _layers(with_data(nodes).select(*CELL, "hyps", h.alias("h"), ratio.alias("ratio")), uncertainty)


def guided_surface(nodes: DataFrame, guides: DataFrame, how: str, uncertainty: str = "sample") -> DataFrame:
    """``guides`` (row, col, gz, gv): the hypothesis closest to the guide, or of the greatest posterior, the newest of equals, with
    strength max(0, 5 - n / (N - n)). Nodes without a guide, or with one without variance, have what :func:`prior_surface` gives."""
    t = with_data(nodes).join(guides.select(*CELL, "gz", "gv"), CELL, "left")
    dist = lambda x: F.abs(x.cur - F.col("gz"))
    score = (lambda x: -dist(x)) if how == "closest" else (lambda x: F.log(x.n) - dist(x) * dist(x) / (2 * F.col("gv")))
    best = F.array_max(F.transform("hyps", lambda x: F.struct(score(x).alias("score"), x.num.alias("tie"), x.alias("h")))).h
    rest = F.aggregate("hyps", F.lit(0).cast("long"), lambda a, x: a + x.n) - best.n
    ratio = F.when(F.size("hyps") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 5 - best.n / rest))
    h0, ratio0 = _by_samples()
    guided = F.col("gv") > 0
    return _layers(t.select(*CELL, "hyps", F.when(guided, best).otherwise(h0).alias("h"), F.when(guided, ratio).otherwise(ratio0).alias("ratio")), uncertainty)


def guides(nodes: DataFrame, p: Params) -> DataFrame:
    """For each node of several hypotheses the nearest single-hypothesis node in growing square rings; within a ring the last in scan order
    (top and bottom with their corners, left, right). Rings run from int(min_context) to int(max_context), in nodes and both included.
    """
    single = nodes.where(F.size("hyps") == 1).select(*CELL, F.col("hyps")[0].cur.alias("gz"), F.col("hyps")[0].samp_var.alias("gv"))
    # ring 0 is the asking node itself
    lo, hi = max(1, int(p.min_context / p.dist_scale)), int(p.max_context / p.dist_scale)
    offs = []
    for ring in range(lo, hi + 1):
        row, side = range(-ring, ring + 1), range(-ring + 1, ring)
        scan = [(-ring, c) for c in row] + [(ring, c) for c in row] + [(r, -ring) for r in side] + [(r, ring) for r in side]
        offs += [(r, c, ring, -i) for i, (r, c) in enumerate(scan)]
    o = F.from_json(F.lit(json.dumps([dict(zip(("dr", "dc", "ring", "scan"), x, strict=True)) for x in offs])), "array<struct<dr:int,dc:int,ring:int,scan:int>>")
    asked = nodes.where(F.size("hyps") > 1).select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.explode(o).alias("o"))
    asked = asked.select("_row", "_col", (F.col("_row") + F.col("o.dr")).alias("row"), (F.col("_col") + F.col("o.dc")).alias("col"), "o.ring", "o.scan")
    found = asked.join(single, CELL).groupBy(F.col("_row").alias("row"), F.col("_col").alias("col"))
    return found.agg(F.min_by(F.struct("gz", "gv"), F.struct("ring", "scan")).alias("g")).select(*CELL, "g.gz", "g.gv")


def hypothesis_list(nodes: DataFrame) -> DataFrame:
    return nodes.select(*CELL, F.explode("hyps").alias("h")).select(*CELL, "h.*")


def apply_edits(nodes: DataFrame, edits: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``edits`` (row, col, op, depth, at), op one of nominate, unnominate and remove, in the order of ``at``, then op and depth -> row, col,
    the hypotheses left and the number of the nominated one (or null) as ``pick``.

    Nominating takes the nearest hypothesis within ``tolerance`` (the earliest of equals), or changes nothing; removing needs exactly one
    within it, and takes a nomination of that one along. Edits of nodes that are not there are dropped. Edits are made by people, so
    those of a node are a short list.
    """
    e = edits.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("at", "op", "depth"))).alias("edits"))
    hyp = nodes.schema["hyps"].dataType.simpleString()
    state = f"struct<hyps:{hyp},pick:int>"

    def step(s: Column, e: Column) -> Column:
        near = F.filter(s.hyps, lambda h: F.abs(h.cur - e.depth) < tolerance)
        nearest = F.array_min(F.transform(near, lambda h: F.struct(F.abs(h.cur - e.depth).alias("far"), h.num.alias("num")))).num
        one = F.size(near) == 1
        hyps = F.when((e.op == "remove") & one, F.filter(s.hyps, lambda h: h.num != nearest)).otherwise(s.hyps)
        pick = F.when(e.op == "nominate", F.coalesce(nearest, s.pick)).when(e.op == "unnominate", None).when((e.op == "remove") & one & (s.pick == nearest), None).otherwise(s.pick)
        return F.struct(hyps.alias("hyps"), pick.alias("pick")).cast(state)

    start = F.struct(F.col("hyps"), F.lit(None).cast("int").alias("pick")).cast(state)
    t = nodes.join(e, CELL, "left").withColumn("s", F.when(F.col("edits").isNull(), start).otherwise(F.aggregate("edits", start, step)))
    return t.select(*CELL, "s.hyps", "s.pick")


def node_hypotheses(edited: DataFrame, uncertainty: str = "sample") -> DataFrame:
    """Every hypothesis with its 95 % limit and whether it is the nominated one; nodes without edits have none."""
    t = edited if "pick" in edited.columns else edited.withColumn("pick", F.lit(None).cast("int"))
    t = t.select(*CELL, "pick", F.explode("hyps").alias("h"))
    own = F.coalesce(F.col("h.num") == F.col("pick"), F.lit(False))
    return t.select(*CELL, "h.num", F.col("h.cur").alias("depth"), _limit(F.col("h"), uncertainty).alias("unct"), "h.n", own.alias("nominated"))


def nominated_surface(edited: DataFrame, uncertainty: str = "sample") -> DataFrame:
    """The prior surface with nominated hypotheses in place, whose strength is 0."""
    h, ratio = _by_samples()
    own = F.get(F.filter("hyps", lambda x: x.num == F.col("pick")), F.lit(0))
    t = with_data(edited).select(*CELL, "hyps", F.coalesce(own, h).alias("h"), F.when(own.isNotNull(), 0.0).otherwise(ratio).alias("ratio"))
    return _layers(t, uncertainty)


def match_hypothesis(nodes: DataFrame, places: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """``places`` (row, col, depth) -> row, col, depth and the number of the hypothesis extracted there: nearest within ``tolerance``, else null."""
    t = places.select(*CELL, "depth").join(nodes.select(*CELL, "hyps"), CELL, "left")
    near = F.filter("hyps", lambda h: F.abs(h.cur - F.col("depth")) < tolerance)
    best = F.array_min(F.transform(near, lambda h: F.struct(F.abs(h.cur - F.col("depth")).alias("far"), h.num.alias("num")))).num
    return t.select(*CELL, "depth", best.alias("num"))


def hypotheses_at(nodes: DataFrame, sheet: SheetSpec, x: float, y: float) -> DataFrame:
    """The hypothesis list of the node nearest to a place."""
    row, col = math.floor((sheet.y0 - y) / sheet.dy + 0.5), math.floor((x - sheet.x0) / sheet.dx + 0.5)
    return hypothesis_list(nodes.where((F.col("row") == row) & (F.col("col") == col)))


def hypotheses_in(nodes: DataFrame, sheet: SheetSpec, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """The hypothesis lists of all nodes in an area, its borders included."""
    inside = sheet.node_x().between(left, right) & sheet.node_y().between(bottom, top)
    return hypothesis_list(nodes.where(inside))


def edits_at(edits: DataFrame, sheet: SheetSpec) -> DataFrame:
    """Edits by location (x, y, op, depth, at) as edits of the nearest nodes."""
    row, col = sheet.cell(F.col("x"), F.col("y"))
    return edits.select(row.alias("row"), col.alias("col"), "op", "depth", "at")
