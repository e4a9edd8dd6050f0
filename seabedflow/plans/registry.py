"""Named queries over the driver tables and the SQL they are compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bounds as B
from ..functions import geometry as H
from ..functions import projections as M
from ..functions import uncertainty as U
from ..functions.params import CI95, CI99_GRID, CI99_NODE, Params, SheetSpec
from ..operators import estimate as E
from ..operators import gridding as G
from ..operators import series as T
from ..operators import surfaces as S
from ..sources import datagrams as D
from ..sources import text as X
from ..sources import views as V
from . import jobs as J
from . import sheets as K
from .store import shared_table

Query = Callable[[SparkSession, str], DataFrame]
P = Params()
HALF, DX = 1, V.SHEET.dx
_all: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _all[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all.items() if s}


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return V.celled(spark, sf)


def mean(spark: SparkSession, sf: str) -> DataFrame:
    return G.mean_surface(cells(spark, sf))


WITH = f"WITH {V.SOUNDINGS_SQL.strip()} "
MEAN = WITH + ", mean AS (SELECT row, col, avg(depth) AS z FROM cel WHERE depth < -0.5 GROUP BY ALL)"
OFF = f"(SELECT unnest(range(-{HALF}, {HALF} + 1)) AS dr) CROSS JOIN (SELECT unnest(range(-{HALF}, {HALF} + 1)) AS dc)"
AROUND = MEAN + f""", nb AS (SELECT row + dr AS row, col + dc AS col, max(CASE WHEN dr = 0 AND dc = 0 THEN z END) AS z,
  avg(CASE WHEN dr <> 0 OR dc <> 0 THEN z END) AS m, count(CASE WHEN dr <> 0 OR dc <> 0 THEN z END) AS n FROM mean, {OFF} GROUP BY ALL)"""
RADIUS = f"""CASE WHEN r0 < 0 THEN {P.dist_scale} ELSE r0 END"""
RAD = WITH + f""", ra AS (SELECT *, {P.dist_scale} * pow(greatest(2.0, (({P.fixed2} + {P.pct2} * depth * depth) / ({CI95} * {CI95})) / dz) - 1, {1 / P.dist_exp})
  - {CI99_GRID} * sqrt(dr) AS r0 FROM snd), rad AS (SELECT * EXCLUDE (r0), greatest(least({RADIUS}, {CI99_GRID} * sqrt(dr)), {P.dist_scale}) AS radius FROM ra)"""
CAND = RAD + f""", node AS (SELECT r.row, c.col, c.col * {V.SHEET.dx} + {V.SHEET.x0} AS nx, {V.SHEET.y0} - r.row * {V.SHEET.dy} AS ny
  FROM (SELECT unnest(range({V.SHEET.rows}))::INT AS row) r, (SELECT unnest(range({V.SHEET.cols}))::INT AS col) c),
cand AS (SELECT row, col, depth, dz, dr, pow(nx - east, 2) + pow(ny - north, 2) AS dist2 FROM rad JOIN node ON nx BETWEEN east - radius - 1 AND east + radius + 1 AND pow(nx - east, 2) + pow(ny - north, 2) < radius * radius)"""
GATED = CAND + f""", gat AS (SELECT *, dz * (1 + {P.var_scale} * pow(sqrt(dist2) + {CI95} * sqrt(dr), {P.dist_exp})) AS var FROM cand WHERE sqrt(dist2) <= greatest({P.capture} * abs(depth), 0.5))"""


@query(WITH + "SELECT row, col, count(*) AS hits FROM cel GROUP BY ALL")
def hits(spark, sf):
    return G.hits(cells(spark, sf))


@query(WITH + "SELECT row, col, count(*) / 4.0 AS density FROM cel GROUP BY ALL")
def density(spark, sf):
    return G.density(cells(spark, sf), V.SHEET)


@query(MEAN + "SELECT row, col, round(z, 4) AS z FROM mean")
def mean_surface(spark, sf):
    return mean(spark, sf).select("row", "col", *r4("z"))


@query(WITH + "SELECT row, col, list_sort(list(depth))[(count(*) // 2 + 1)::INT] AS z FROM cel GROUP BY ALL")
def median_surface(spark, sf):
    return G.median_surface(cells(spark, sf))


@query(WITH + "SELECT row, col, round(sqrt(greatest(avg(depth * depth) - avg(depth) * avg(depth), 0.0)), 4) AS sdev FROM cel GROUP BY ALL")
def sdev_surface(spark, sf):
    return G.sdev_surface(cells(spark, sf)).select("row", "col", *r4("sdev"))


_SPREAD = "CASE WHEN count(depth) > 1 THEN sqrt(var_samp(depth) + avg(depth) * avg(depth) / (count(depth) - 1)) END"


@query(WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", tr(row, col, m, se, n, moving, k) AS (SELECT row, col, avg(depth), {_SPREAD}, count(depth), count(depth) > 1, 0 FROM cel GROUP BY row, col
  UNION ALL SELECT row, col, nm, nse, nn, coalesce(nn > 1 AND ((nm <> m AND abs(nm - m) >= 0.01 * abs(nm)) OR (nse <> se AND abs(nse - se) >= 0.01 * abs(nse))), false), k + 1 FROM (
    SELECT c.row, c.col, tr.m, tr.se, tr.k, avg(depth) AS nm, {_SPREAD} AS nse, count(depth) AS nn FROM tr JOIN cel c ON c.row = tr.row AND c.col = tr.col
    WHERE moving AND k < 100 AND depth BETWEEN tr.m - 2 * tr.se AND tr.m + 2 * tr.se GROUP BY c.row, c.col, tr.m, tr.se, tr.k))
SELECT row, col, round(m, 4) AS z, n AS n_kept FROM tr QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY k DESC) = 1""")
def trimmed_mean_surface(spark, sf):
    return G.trimmed_mean(cells(spark, sf)).select("row", "col", *r4("z"), "n_kept")


@query(WITH + "SELECT row, col, list_sort(list(depth))[(count(*) // 2 + 1)::INT] AS z FROM cel GROUP BY ALL ORDER BY z DESC, row, col LIMIT 10")
def median_topk(spark, sf):
    """The report of the ten shoalest medians."""
    return G.median_surface(cells(spark, sf)).orderBy(F.desc("z"), "row", "col").limit(10)


@query(WITH + "SELECT l_orderkey, l_linenumber, round((0.25 + 0.000169 * depth * depth) / pow(1.96, 2), 6) AS dz, round(pow(5 / 1.96, 2), 6) AS dr, round((0.04 + 0.0075 * 0.0075 * depth * depth) / pow(1.96, 2), 6) AS dz_1, round(pow(150 / 1.96, 2), 6) AS dr_4 FROM snd")
def iho_error(spark, sf):
    (dz, dr), (dz1, _), (_, dr4) = (G.iho_error(Params(order=o)) for o in ("order1", "1", "4"))
    return V.soundings(spark, sf).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in (("dz", dz), ("dr", dr), ("dz_1", dz1), ("dr_4", dr4))])


@query(WITH + "SELECT platform, count(*) AS n, round(avg(depth), 4) AS z FROM snd WHERE depth <= -20 AND depth >= -40 GROUP BY ALL")
def depth_gate(spark, sf):
    return G.depth_gate(V.soundings(spark, sf), 20, 40).groupBy("platform").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 4).alias("z"))


@query(WITH + "SELECT platform, count(*) AS n FROM snd WHERE atan2(east - 20, -depth) BETWEEN -0.5 AND 0.5 GROUP BY ALL")
def angle_gate(spark, sf):
    return G.angle_gate(V.soundings(spark, sf), F.col("east") - 20, -0.5, 0.5).groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, CASE WHEN contains(p_name, '1') THEN '1' WHEN contains(p_name, '2') THEN '2' WHEN contains(p_name, '12') THEN '12' END AS recog FROM part GROUP BY ALL")
def platform_match(spark, sf):
    spec = spark.createDataFrame([(1, "1"), (2, "2"), (3, "12")], "rank int, recog string")
    return G.platform_match(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name")), spec)


@query(RAD + "SELECT l_orderkey, l_linenumber, round(radius, 6) AS radius FROM rad")
def influence_radius(spark, sf):
    return V.soundings(spark, sf).select("l_orderkey", "l_linenumber", F.round(G.influence_radius(P), 6).alias("radius"))


def candidates(spark, sf):
    return G.node_candidates(V.soundings(spark, sf), V.SHEET, P)


@query(CAND + "SELECT row, col, count(*) AS n, round(sum(dist2), 4) AS d2 FROM cand GROUP BY ALL")
def node_candidates(spark, sf):
    return candidates(spark, sf).groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.sum("dist2"), 4).alias("d2"))


@query(GATED + f"SELECT row, col, round(sum(depth / var) / sum(1 / var), 4) AS depth, round({CI95} * sqrt(1 / sum(1 / var)), 4) AS unct, count(*) AS n FROM gat GROUP BY ALL")
def node_estimate_ivw(spark, sf):
    return G.node_estimate_ivw(G.gated(candidates(spark, sf), P)).select("row", "col", *r4("depth", "unct"), "n")


_ARRIVAL = ", ".join(V.ARRIVAL)
_Q, _MID = P.queue_length, P.queue_length // 2
_HYP = "STRUCT(num INT, cur DOUBLE, cv DOUBLE, pred DOUBLE, pv DOUBLE, cum DOUBLE, run INT, n BIGINT, sv DOUBLE)"
#: The node filter as a recursion over all nodes at once: step k takes the k-th sounding of each node, step n + 1 puts the queue into the order of the drain,
#: later steps drain it. ``q`` is the queue, ``hy`` the hypotheses from the oldest on.
FOLD = GATED.replace("WITH ", "WITH RECURSIVE ", 1).replace("cand AS (SELECT row,", f"cand AS (SELECT {_ARRIVAL}, row,", 1) + f""",
sq AS (SELECT row, col, depth, var, row_number() OVER (PARTITION BY row, col ORDER BY {_ARRIVAL}) AS k FROM gat),
st(row, col, n, k, q, hy) AS (
  SELECT row, col, count(*), 0::BIGINT, []::STRUCT(d DOUBLE, v DOUBLE)[], []::{_HYP}[] FROM sq GROUP BY row, col
  UNION ALL
  SELECT row, col, n, k, q, CASE WHEN o IS NULL THEN hy WHEN ok THEN hy[1:bi - 1] || [struct_pack(num := h.num, cur := h.pred + gain * inn, cv := o.v * h.pv / (o.v + h.pv), pred := h.pred + gain * inn,
      pv := o.v * h.pv / (o.v + h.pv) + h.cv * (1 - {P.discount}) / {P.discount}, cum := cum2, run := run2, n := h.n + 1, sv := (h.n - 1) * h.sv / h.n + (o.d - h.cur) * (o.d - h.cur) / h.n)::{_HYP}] || hy[bi + 1:len(hy)]
    ELSE CASE WHEN bi IS NULL THEN hy ELSE hy[1:bi - 1] || [struct_pack(num := h.num, cur := h.cur, cv := h.cv, pred := h.pred, pv := h.pv, cum := 1.0, run := 0, n := h.n, sv := h.sv)::{_HYP}] || hy[bi + 1:len(hy)] END
      || [struct_pack(num := coalesce(hy[len(hy)].num, 0) + 1, cur := o.d, cv := o.v, pred := o.d, pv := o.v, cum := 1.0, run := 0, n := 1, sv := 0.0)::{_HYP}] END
  FROM (
    SELECT *, h.pv / (o.v + h.pv) AS gain, o.d - h.pred AS inn, coalesce(bi IS NOT NULL AND bf >= {P.bayes_threshold} AND cum2 >= {P.bayes_threshold} AND run2 <= {P.run_limit}, false) AS ok FROM (
      SELECT *, CASE WHEN bf < {P.bayes_threshold} THEN h.run WHEN h.cum < 1 THEN h.run + 1 ELSE 1 END AS run2, CASE WHEN bf < {P.bayes_threshold} THEN h.cum ELSE bf * least(1.0, h.cum) END AS cum2 FROM (
        SELECT *, exp(least(0.5 * ({P.est_offset} * {P.est_offset} - 2 * {P.est_offset} * abs((o.d - h.pred) / sqrt(h.pv + o.v))), 700.0)) AS bf FROM (
          SELECT *, hy[bi] AS h FROM (
            SELECT *, CASE WHEN len(er) > 0 THEN len(er) + 1 - list_position(list_reverse(er), list_min(er)) END AS bi FROM (
              SELECT row, col, n, k, hy, o, CASE WHEN k = n + 1 THEN list_transform(range(len(q2)), lambda i:
                  q2[(CASE WHEN len(q2) % 2 = 0 THEN len(q2) // 2 + CASE WHEN i % 2 = 0 THEN -(i // 2) ELSE (i + 1) // 2 END ELSE len(q2) // 2 + 1 + CASE WHEN i % 2 = 0 THEN i // 2 ELSE -((i + 1) // 2) END END)::BIGINT]) ELSE q2 END AS q,
                CASE WHEN o IS NULL THEN [] ELSE list_transform(hy, lambda y: abs((o.d - y.pred) / sqrt(y.pv + o.v))) END AS er FROM (
                SELECT *, CASE WHEN cut AND nn >= 2 THEN list_filter(q1, lambda e: NOT coalesce((e.d - mu) * (e.d - mu) / nullif(kk - (e.d - mu) * (e.d - mu) / (nn - 1), 0) >= {P.quotient_limit}, false)) ELSE q1 END AS q2 FROM (
                  SELECT *, nn * list_sum(list_transform(q1, lambda e: (e.d - mu) * (e.d - mu))) / (nn * nn - 1) AS kk FROM (
                    SELECT *, list_sum(list_transform(q1, lambda e: e.d)) / len(q1) AS mu, len(q1) - 1 AS nn,
                      k = n + 1 OR (o IS NOT NULL AND k <= n AND q1[1].d - {CI99_NODE} * sqrt(q1[1].v) >= q1[len(q1)].d + {CI99_NODE} * sqrt(q1[len(q1)].v)) AS cut FROM (
                      SELECT *, CASE WHEN k > n THEN q0 ELSE q0[1:ps] || [x] || q0[ps + 1:len(q0)] END AS q1 FROM (
                        SELECT *, CASE WHEN full_ AND k <= n THEN q[1:{_MID}] || q[{_MID + 2}:len(q)] ELSE q END AS q0,
                          CASE WHEN NOT full_ THEN len(list_filter(q, lambda e: e.d > x.d)) WHEN x.d > o.d THEN len(list_filter(q[1:{_MID}], lambda e: e.d >= x.d))
                            ELSE {_MID} + len(list_filter(q[{_MID + 2}:len(q)], lambda e: e.d > x.d)) END AS ps FROM (
                          SELECT st.row, st.col, st.n, st.k + 1 AS k, st.q, st.hy, len(st.q) >= {_Q} AS full_, struct_pack(d := sq.depth, v := sq.var) AS x,
                            CASE WHEN st.k + 1 > st.n + 1 THEN st.q[st.k - st.n] WHEN st.k + 1 <= st.n AND len(st.q) >= {_Q} THEN st.q[{_MID + 1}] END AS o
                          FROM st LEFT JOIN sq ON sq.row = st.row AND sq.col = st.col AND sq.k = st.k + 1 WHERE st.k < st.n + 1 + len(st.q)))))))))))))),
hy AS (SELECT row, col, h.* FROM (SELECT row, col, unnest(hy) AS h FROM st WHERE k = n + 1 + len(q))),
best AS (SELECT *, count(*) OVER c AS nhyp, sum(n) OVER c AS total, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, num) AS place, max(num) OVER c AS top FROM hy WINDOW c AS (PARTITION BY row, col)),
prior AS (SELECT a.row, a.col, a.cur AS depth, {CI95} * sqrt(a.sv) AS unct, CASE WHEN a.nhyp = 1 THEN 0 ELSE greatest(0, 5 - a.n / b.n) END AS ratio, a.nhyp, a.n
  FROM best a LEFT JOIN best b ON b.row = a.row AND b.col = a.col AND b.place = 2 WHERE a.place = 1)"""
_LO, _HI = max(1, int(P.min_context / P.dist_scale)), int(P.max_context / P.dist_scale)
GUIDE = FOLD + f""", ask AS (SELECT DISTINCT row, col FROM best WHERE nhyp > 1), one AS (SELECT row, col, cur, sv FROM best WHERE nhyp = 1),
met AS (SELECT a.row, a.col, o.cur AS gz, o.sv AS gv, o.row - a.row AS dr, o.col - a.col AS dc, greatest(abs(o.row - a.row), abs(o.col - a.col)) AS ring FROM ask a, one o),
guide AS (SELECT row, col, gz, gv FROM met WHERE ring BETWEEN {_LO} AND {_HI} QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY ring,
  CASE WHEN dr = -ring THEN dc WHEN dr = ring THEN 1000 + dc WHEN dc = -ring THEN 2000 + dr ELSE 3000 + dr END DESC) = 1)"""


def _guided_sql(score: str) -> str:
    return f""", pick AS (SELECT b.*, gv FROM best b JOIN guide g USING (row, col) WHERE gv > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY {score} DESC, num DESC) = 1)
SELECT p.row, p.col, round(coalesce(k.cur, p.depth), 4) AS depth, round(coalesce({CI95} * sqrt(k.sv), p.unct), 4) AS unct,
  round(CASE WHEN k.cur IS NULL THEN p.ratio WHEN k.nhyp = 1 THEN 0 ELSE greatest(0, 5 - k.n / (k.total - k.n)) END, 4) AS ratio, p.nhyp, coalesce(k.n, p.n) AS n
FROM prior p LEFT JOIN pick k USING (row, col)"""


_CLOSEST, _POSTERIOR = "-abs(cur - gz)", "ln(n) - (cur - gz) * (cur - gz) / (2 * gv)"


def folded(spark, sf):
    return E.hypotheses(G.gated(candidates(spark, sf), P), V.ARRIVAL, P)


def stored(t: DataFrame) -> DataFrame:
    """Hypotheses that are read twice, written in the shared folder so that the fold runs once and nothing stays pinned in memory."""
    return shared_table(t, "nodes")


def layers(t: DataFrame) -> DataFrame:
    return t.select("row", "col", *r4("depth", "unct", "ratio"), "nhyp", "n")


@query(FOLD + " SELECT row, col, round(depth, 4) AS depth, round(unct, 4) AS unct, nhyp FROM prior")
def node_fold_prior(spark, sf):
    return E.prior_surface(folded(spark, sf)).select("row", "col", *r4("depth", "unct"), "nhyp")


@query(FOLD + " SELECT row, col, round(ratio, 4) AS ratio FROM prior")
def node_fold_ratio(spark, sf):
    return E.prior_surface(folded(spark, sf)).select("row", "col", *r4("ratio"))


def _guided(spark, sf, how):
    nodes = stored(folded(spark, sf))
    return layers(E.guided_surface(nodes, E.guides(nodes, P), how))


@query(GUIDE + _guided_sql(_CLOSEST))
def context_surface(spark, sf):
    return _guided(spark, sf, "closest")


@query(GUIDE + _guided_sql(_POSTERIOR))
def posterior_surface(spark, sf):
    return _guided(spark, sf, "posterior")


@query(FOLD + ", mean AS (SELECT row, col, avg(depth) AS z FROM cel WHERE depth < -0.5 GROUP BY ALL), guide AS (SELECT row, col, z AS gz, 1.0 AS gv FROM mean)" + _guided_sql(_CLOSEST))
def predsurf_surface(spark, sf):
    guide = mean(spark, sf).select("row", "col", F.col("z").alias("gz"), F.lit(1.0).alias("gv"))
    return layers(E.guided_surface(folded(spark, sf), guide, "closest"))


@query(FOLD + " SELECT row, col, num, round(cur, 4) AS cur, round(cv, 6) AS cur_var, round(sv, 4) AS samp_var, n FROM hy")
def hypothesis_list(spark, sf):
    return E.hypothesis_list(folded(spark, sf)).select("row", "col", "num", *r4("cur"), F.round("cur_var", 6).alias("cur_var"), *r4("samp_var"), "n")


@query(FOLD + " SELECT row, col, round(depth, 4) AS depth, nhyp, n FROM prior WHERE nhyp > 1")
def top_hypothesis(spark, sf):
    return E.prior_surface(folded(spark, sf)).where("nhyp > 1").select("row", "col", *r4("depth"), "nhyp", "n")


# of each node the second hypothesis is nominated, then the first one removed if no other is within the tolerance
@query(FOLD + """, a AS (SELECT h.*, f.cur AS z1, s.cur AS z2 FROM hy h LEFT JOIN hy f ON f.row = h.row AND f.col = h.col AND f.num = 1 LEFT JOIN hy s ON s.row = h.row AND s.col = h.col AND s.num = 2),
p AS (SELECT *, CASE WHEN z2 IS NULL THEN NULL ELSE first(num) OVER (PARTITION BY row, col ORDER BY coalesce(abs(cur - z2), 0), num) END AS pick, count(CASE WHEN abs(cur - z1) < 0.01 THEN 1 END) OVER (PARTITION BY row, col) AS close FROM a)
SELECT row, col, num, round(cur, 4) AS cur, num = pick AS nominated FROM p WHERE NOT (close = 1 AND abs(cur - z1) < 0.01)""")
def hypothesis_edits(spark, sf):
    nodes = stored(folded(spark, sf))
    h = E.hypothesis_list(nodes)
    edit = lambda num, op, at: h.where(F.col("num") == num).select("row", "col", F.lit(op).alias("op"), F.col("cur").alias("depth"), F.lit(at).alias("at"))
    t = E.apply_edits(nodes, edit(2, "nominate", 1).unionByName(edit(1, "remove", 2)))
    return t.select("row", "col", "pick", F.explode("hyps").alias("h")).select("row", "col", "h.num", F.round("h.cur", 4).alias("cur"), (F.col("h.num") == F.col("pick")).alias("nominated"))


_GATE = f"""least(z - {P.blunder_min}, z - {P.blunder_pct} * abs(z), z - {P.blunder_scalar} * sqrt(0.25))"""


@query(CAND + f""", mean AS (SELECT row, col, avg(depth) AS z FROM cel WHERE depth < -0.5 GROUP BY ALL), m AS (SELECT row, col, CASE WHEN (row + col) % 7 = 0 THEN NULL ELSE z + 8 END AS z, (row + col) % 11 = 0 AS frozen FROM mean),
g AS (SELECT row, col, depth, z, dist2 FROM cand LEFT JOIN m USING (row, col) WHERE NOT coalesce(frozen AND z IS NOT NULL, false) AND (z IS NULL OR depth >= {_GATE})
  AND sqrt(dist2) <= greatest({P.capture} * abs(coalesce(z, depth)), 0.5))
SELECT row, col, count(*) AS n, round(avg(depth), 4) AS z FROM g GROUP BY ALL""")
def node_gates(spark, sf):
    place = F.col("row") + F.col("col")
    z = F.when(place % 7 == 0, None).when(place % 11 == 0, F.lit(float("nan"))).otherwise(F.col("z") + 8)
    start = mean(spark, sf).select("row", "col", z.alias("z"), F.lit(0.25).alias("var"))
    t = G.gated(G.at_nodes(candidates(spark, sf), start), P)
    return t.groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 4).alias("z"))


@query(MEAN + ", med AS (SELECT row, col, list_sort(list(depth))[(count(*) // 2 + 1)::INT] AS z FROM cel GROUP BY ALL) SELECT row, col, round(mean.z - med.z, 4) AS z FROM mean JOIN med USING (row, col)")
def surface_diff(spark, sf):
    return S.arithmetic(mean(spark, sf), G.median_surface(cells(spark, sf)), True).select("row", "col", *r4("z"))


@query(MEAN + ", med AS (SELECT row, col, list_sort(list(depth))[(count(*) // 2 + 1)::INT] AS z FROM cel GROUP BY ALL) SELECT row, col, round(100 * (mean.z - med.z) / -mean.z, 4) AS pct FROM mean JOIN med USING (row, col)")
def surface_pct(spark, sf):
    m = shared_table(mean(spark, sf), "mean")
    return S.percent_of_depth(S.arithmetic(m, G.median_surface(cells(spark, sf)), True), m).select("row", "col", *r4("pct"))


@query(MEAN + ", m AS (SELECT min(z) AS lo, max(z) AS hi, floor((max(z) - min(z)) / 2.0)::BIGINT AS slots FROM mean), c AS (SELECT floor(slots / (hi - lo) * (z - lo))::BIGINT AS slot, count(*) AS n FROM mean, m WHERE floor(slots / (hi - lo) * (z - lo)) < slots GROUP BY ALL), e AS (SELECT unnest(range(slots)) AS slot, lo, slots / (hi - lo) AS scale FROM m) SELECT slot, round((slot + 0.5) / scale + lo, 4) AS ordinate, coalesce(n, 0) AS n, round(coalesce(n, 0) * scale / (SELECT sum(n) FROM c), 6) AS pmf FROM e LEFT JOIN c USING (slot)")
def surface_hist(spark, sf):
    return S.histogram(mean(spark, sf), 2.0).select("slot", *r4("ordinate"), "n", F.round("pmf", 6).alias("pmf"))


@query(AROUND + f"SELECT row, col, round(CASE WHEN n = 0 THEN {math.pi / 2} ELSE atan(abs(z - m) / {DX}) END, 4) AS angle FROM nb WHERE z IS NOT NULL")
def spike_angle(spark, sf):
    return S.spike_angle(mean(spark, sf), HALF, DX).select("row", "col", *r4("angle"))


@query(AROUND + f"SELECT row, col, round(CASE WHEN n = 0 OR row < {HALF} OR row > {V.SHEET.rows - 1 - HALF} OR col < {HALF} OR col > {V.SHEET.cols - 1 - HALF} OR abs(z - m) / {DX} > {math.tan(1.2)} THEN NULL ELSE z END, 4) AS z FROM nb WHERE z IS NOT NULL")
def despike(spark, sf):
    return S.despike(mean(spark, sf), HALF, DX, 1.2, V.SHEET).select("row", "col", *r4("z"))


@query(MEAN + "SELECT row, col, round(CASE WHEN z > -35 THEN NULL ELSE z END, 4) AS shallow_off, round(CASE WHEN z < -35 THEN NULL ELSE z END, 4) AS deep_off, round(abs(z), 4) AS size FROM mean")
def clip(spark, sf):
    m = mean(spark, sf)
    cut = [S.clip(m, -35.0).withColumnRenamed("z", "shallow_off"), S.clip(m, -35.0, flip=True).withColumnRenamed("z", "deep_off"), S.magnitude(m).withColumnRenamed("z", "size")]
    return cut[0].join(cut[1], ["row", "col"]).join(cut[2], ["row", "col"]).select("row", "col", *r4("shallow_off", "deep_off", "size"))


@query(MEAN + ", o(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)), k AS (SELECT row, col FROM mean WHERE z <= 0 AND row % 5 <> 4), e AS (SELECT row + dr AS row, col + dc AS col, count(*) AS n FROM k, o GROUP BY ALL HAVING count(*) = 5), d AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM e, o) SELECT m.row, m.col, round(CASE WHEN d.row IS NULL THEN NULL ELSE z END, 4) AS z FROM mean m LEFT JOIN d USING (row, col) WHERE m.row % 5 <> 4")
def mask_edges(spark, sf):
    return S.mask_edges(mean(spark, sf).where("row % 5 <> 4"), 1.0, 3.0).select("row", "col", *r4("z"))


@query(AROUND + "SELECT row, col, round(coalesce(z, m), 4) AS z FROM nb WHERE z IS NOT NULL OR n > 7")
def patch_surface(spark, sf):
    return S.patch_surface(mean(spark, sf), HALF).select("row", "col", *r4("z"))


_KERNEL = ", ".join(f"({r}, {c}, {k!r})" for r, c, k in S.gauss_kernel(HALF))


@query(MEAN + f", k(dr, dc, w) AS (VALUES {_KERNEL}), g AS (SELECT row - dr AS row, col - dc AS col, sum(z * w) AS z, count(*) AS n FROM mean, k GROUP BY ALL) SELECT row, col, round(z, 4) AS z FROM g WHERE n = 9")
def gauss_filter(spark, sf):
    return S.convolve(mean(spark, sf), S.gauss_kernel(HALF)).select("row", "col", *r4("z"))


def _mask(spark, sf):
    return S.threshold(cells(spark, sf).groupBy("row", "col").agg(F.avg("depth").alias("z")), -36.0)


MASK = WITH + ", mask AS (SELECT row, col, (avg(depth) > -36.0)::INT AS v FROM cel GROUP BY ALL), o(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))"


@query(MASK + "SELECT row, col, v FROM mask")
def threshold(spark, sf):
    return _mask(spark, sf)


@query(MASK + ", s AS (SELECT row + dr AS row, col + dc AS col, sum(v) AS s, max((dr = 0 AND dc = 0)::INT) AS here FROM mask, o GROUP BY ALL) SELECT row, col, (s = 5)::INT AS v FROM s WHERE here = 1")
def erode(spark, sf):
    return S.erode(_mask(spark, sf), 3)


@query(MASK + ", s AS (SELECT row + dr AS row, col + dc AS col, max(v) AS v, max((dr = 0 AND dc = 0)::INT) AS here FROM mask, o GROUP BY ALL) SELECT row, col, v FROM s WHERE here = 1")
def dilate(spark, sf):
    return S.dilate(_mask(spark, sf), 3)


@query(MASK.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2 FROM mask a JOIN mask b ON a.v = 1 AND b.v = 1 AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
far AS (SELECT row, col, row AS r0, col AS c0 FROM mask WHERE v = 1 UNION SELECT n.r2, n.c2, far.r0, far.c0 FROM far JOIN n USING (row, col)),
lab AS (SELECT row, col, min(r0::BIGINT * 4294967296 + c0) AS blob FROM far GROUP BY ALL), m AS (SELECT row, col, avg(depth) AS z FROM cel WHERE depth < -0.5 GROUP BY ALL)
SELECT blob, count(*) AS pixels, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, round(avg(z), 4) AS mean_z, round(max(z), 4) AS shoalest FROM lab JOIN m USING (row, col) GROUP BY blob""")
def blob_stats(spark, sf):
    t = S.blob_stats(S.blobs(_mask(spark, sf)), mean(spark, sf))
    return t.select("blob", "pixels", "row_min", "row_max", "col_min", "col_max", *r4("mean_z", "shoalest"))


_EVERY = f"(SELECT unnest(range({V.SHEET.rows}))::INT AS row) r, (SELECT unnest(range({V.SHEET.cols}))::INT AS col) c"


@query(MEAN + f""", few AS (SELECT * FROM mean WHERE (row + col) % 3 <> 0), every AS (SELECT r.row, c.col, few.z FROM {_EVERY} LEFT JOIN few ON few.row = r.row AND few.col = c.col),
ring AS (SELECT e.row, e.col, greatest(abs(e.row - f.row), abs(e.col - f.col)) AS ring, max(f.z) AS z FROM every e JOIN few f ON abs(e.row - f.row) <= 9 AND abs(e.col - f.col) <= 9 WHERE e.z IS NULL GROUP BY ALL),
est AS (SELECT row, col, z FROM every WHERE z IS NOT NULL UNION ALL SELECT row, col, z FROM ring QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY ring) = 1)
SELECT e.row, e.col, round(max(s.depth), 4) AS z FROM est e JOIN snd s ON pow(s.east - e.col * {V.SHEET.dx}, 2) + pow(s.north - ({V.SHEET.y0} - e.row * {V.SHEET.dy}), 2) < pow(2.5 - 0.025 * e.z, 2)
  AND abs(s.east - e.col * {V.SHEET.dx}) < 30 AND s.east >= -0.5 * {V.SHEET.dx} AND e.z < 0 GROUP BY ALL""")
def coverage(spark, sf):
    few = mean(spark, sf).where("(row + col) % 3 <> 0")
    return S.coverage(V.soundings(spark, sf), few, V.SHEET).select("row", "col", *r4("z"))


@query(MEAN + ", hole AS (SELECT row, col FROM mean WHERE (row + col) % 3 = 0), src AS (SELECT * FROM mean WHERE (row + col) % 3 <> 0), c AS (SELECT h.row, h.col, greatest(abs(h.row - s.row), abs(h.col - s.col)) AS ring, s.z FROM hole h JOIN src s ON abs(h.row - s.row) <= 2 AND abs(h.col - s.col) <= 2) SELECT row, col, round(max(z), 4) AS z FROM c JOIN (SELECT row, col, min(ring) AS ring FROM c GROUP BY ALL) USING (row, col, ring) GROUP BY ALL")
def nearest_shoal(spark, sf):
    m = mean(spark, sf)
    hole = (F.col("row") + F.col("col")) % 3 == 0
    return S.nearest_shoal(m.where(~hole), m.where(hole), 2).select("row", "col", *r4("z"))


@query(MEAN + ", f AS (SELECT 2 * a.row + i AS row, 2 * a.col + j AS col, (a.z * (1 - j / 2.0) + b.z * (j / 2.0)) * (1 - i / 2.0) + (c.z * (1 - j / 2.0) + d.z * (j / 2.0)) * (i / 2.0) AS z FROM mean a JOIN mean b ON b.row = a.row AND b.col = a.col + 1 JOIN mean c ON c.row = a.row + 1 AND c.col = a.col JOIN mean d ON d.row = a.row + 1 AND d.col = a.col + 1, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)) SELECT row, col, round(z, 4) AS z FROM f")
def bilinear_resample(spark, sf):
    return S.bilinear(mean(spark, sf), 2).select("row", "col", *r4("z"))


@query(MEAN + ", a AS (SELECT * FROM mean WHERE row % 2 = 0) SELECT row, col, round(coalesce(a.z, m.z / 2), 4) AS z FROM a FULL JOIN mean m USING (row, col)")
def combine_surfaces(spark, sf):
    m = mean(spark, sf)
    return S.combine(m.where("row % 2 = 0"), m.select("row", "col", (F.col("z") / 2).alias("z"))).select("row", "col", *r4("z"))


@query(WITH + "SELECT platform, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max FROM cel GROUP BY ALL")
def sheet_extent(spark, sf):
    return G.extent(cells(spark, sf), "platform")


_SAMPLE = "s AS (SELECT user_id AS k, ts, value FROM events WHERE event_id % 2 = 0), t AS (SELECT user_id AS k, event_id AS id, ts FROM events WHERE event_id % 2 = 1)"


@query(f"WITH {_SAMPLE} SELECT t.k, t.id, round(CASE WHEN a.ts = b.ts THEN a.value ELSE a.value + (epoch_us(t.ts) / 1e6 - epoch_us(a.ts) / 1e6) / (epoch_us(b.ts) / 1e6 - epoch_us(a.ts) / 1e6) * (b.value - a.value) END, 4) AS value FROM t ASOF LEFT JOIN s a ON t.k = a.k AND t.ts >= a.ts ASOF LEFT JOIN s b ON t.k = b.k AND t.ts <= b.ts")
def time_interp(spark, sf):
    e = V.series(spark, sf)
    s = e.where("event_id % 2 = 0").select(F.col("user_id").alias("k"), "ts", "value")
    t = e.where("event_id % 2 = 1").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "ts")
    return T.interpolate(s, t).select("k", "id", *r4("value"))


@query("WITH v AS (SELECT user_id, event_id, ts, value, sqrt(pow(lead(value) OVER w - value, 2) + pow(2 * (lead(value) OVER w - value), 2)) / ((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6) AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(coalesce(v, lag(v) OVER (PARTITION BY user_id ORDER BY ts)), 6) AS sog FROM v")
def nav_sog(spark, sf):
    e = V.series(spark, sf).select(F.col("user_id").alias("platform"), "event_id", "ts", F.col("value").alias("x"), (2 * F.col("value")).alias("y"))
    return T.speed_over_ground(e).select("event_id", F.round("sog", 6).alias("sog"))


@query(f"WITH {_SAMPLE}, i AS (SELECT t.k, t.id, CASE WHEN a.ts = b.ts THEN a.value ELSE a.value + (epoch_us(t.ts) / 1e6 - epoch_us(a.ts) / 1e6) / (epoch_us(b.ts) / 1e6 - epoch_us(a.ts) / 1e6) * (b.value - a.value) END AS tide FROM t ASOF LEFT JOIN s a ON t.k = a.k AND t.ts >= a.ts ASOF LEFT JOIN s b ON t.k = b.k AND t.ts <= b.ts) SELECT i.id, round(-e.value + i.tide, 4) AS depth FROM i JOIN events e ON e.event_id = i.id WHERE tide IS NOT NULL")
def tide_correct(spark, sf):
    e = V.series(spark, sf)
    s = e.where("event_id % 2 = 0").select(F.col("user_id").alias("k"), "ts", "value")
    t = e.where("event_id % 2 = 1").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "ts", (-F.col("value")).alias("depth"))
    return T.tide_corrected(t, s).select("id", *r4("depth"))


@query("SELECT c_custkey, (c_custkey % 24 * 60 + c_custkey % 60) * 60 + 16.5 AS epoch, round(-(70 + 42.25 / 60), 8) AS lon, round(43 + (c_custkey % 60 + 0.5) / 60, 8) AS lat FROM customer")
def gga_parse(spark, sf):
    two = lambda n: F.lpad((F.col("c_custkey") % n).cast("string"), 2, "0")
    line = F.concat(F.lit("$INGGA,"), two(24), two(60), F.lit("16.5,43"), two(60), F.lit(".5,N,07042.25,W,1"))
    t = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", X.parse_gga(line).alias("g"))
    return t.select("c_custkey", "g.epoch", F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS epoch, round(value, 4) AS tide FROM events WHERE value IS NOT NULL")
def tide_parse(spark, sf):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss "), F.col("value").cast("string"))
    t = V.series(spark, sf).select("event_id", X.parse_tide(line, "Y-M-D h:m:s T").alias("g")).where("g is not null")
    return t.select("event_id", "g.epoch", F.round("g.tide", 4).alias("tide"))


def positions(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 100 / 100 - 71).alias("lon"), (F.col("c_custkey") % 37 / 10 + 41).alias("lat"))


_MERC = M.Mercator(-70.5, 43.0)


@query(f"WITH p AS (SELECT c_custkey, c_custkey % 100 / 100 - 71 AS lon, radians(c_custkey % 37 / 10 + 41) AS lat FROM customer) SELECT c_custkey, round(radians(lon + 70.5) * s, 3) AS east, round(s * (atanh(sin(lat)) - {M.E} * atanh({M.E} * sin(lat))), 3) AS north FROM p, (SELECT {M.A} * cos(radians(43)) / sqrt(1 - {M.E2} * pow(sin(radians(43)), 2)) AS s)")
def mercator_forward(spark, sf):
    x, y = _MERC.forward(F.col("lon"), F.col("lat"))
    return positions(spark, sf).select("c_custkey", F.round(x, 3).alias("east"), F.round(y, 3).alias("north"))


@query("SELECT c_custkey, round(c_custkey % 100 / 100 - 71, 6) AS lon, round(c_custkey % 37 / 10 + 41, 6) AS lat FROM customer")
def utm_round_trip(spark, sf):
    utm = M.Utm.at(-70.5, 43.0)
    x, y = utm.forward(F.col("lon"), F.col("lat"))
    lon, lat = utm.inverse(F.col("x"), F.col("y"))
    return positions(spark, sf).select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_VAR = 1.3 / (100 * CI95)
_PRED = MEAN + f""", s AS (SELECT *, east / 1.0 - floor(east / 1.0) AS u, 1 - ((40 - north) / 4 - floor((40 - north) / 4)) AS w, floor((40 - north) / 4)::INT AS r, floor(east)::INT AS c FROM snd),
p AS (SELECT r, c, s.u, s.w, s.dr, a.z AS z0, b.z AS z1, d.z AS z2, e.z AS z3 FROM s JOIN mean a ON a.row = r AND a.col = c JOIN mean b ON b.row = r AND b.col = c + 1 JOIN mean d ON d.row = r + 1 AND d.col = c JOIN mean e ON e.row = r + 1 AND e.col = c + 1),
q AS (SELECT r, c, (z0 * (1 - u) + z1 * u) * w + (z2 * (1 - u) + z3 * u) * (1 - w) AS z,
  pow({_VAR!r}, 2) * (pow(z0 * (1 - u) * w, 2) + pow(z1 * u * w, 2) + pow(z2 * (1 - u) * (1 - w), 2) + pow(z3 * u * (1 - w), 2))
  + dr * (pow((z1 - z0) * w + (z3 - z2) * (1 - w), 2) + pow((z1 - z3) * u + (z0 - z2) * (1 - u), 2) / 16) AS v FROM p)"""


@query(_PRED + " SELECT r AS row, c AS col, count(*) AS n, round(avg(z), 4) AS pred_depth, round(avg(v), 4) AS pred_var FROM q GROUP BY ALL")
def predicted_depth(spark, sf):
    guide = mean(spark, sf).withColumn("var", H.prior_variance(F.col("z"), 1.3, True))
    t = G.predict(V.soundings(spark, sf), guide, V.SHEET).where("pred_depth is not null")
    place = (F.floor((V.SHEET.y0 - F.col("north")) / V.SHEET.dy).cast("int").alias("row"), F.floor((F.col("east") - V.SHEET.x0) / V.SHEET.dx).cast("int").alias("col"))
    return t.groupBy(*place).agg(F.count("*").alias("n"), F.round(F.avg("pred_depth"), 4).alias("pred_depth"), F.round(F.avg("pred_var"), 4).alias("pred_var"))


@query(WITH + "SELECT row, col, round(count(*) / 4.0 * pow(5 - 0.05 * avg(depth), 2), 4) AS ratio FROM cel GROUP BY ALL")
def coverage_ratio(spark, sf):
    return G.coverage_ratio(cells(spark, sf), V.SHEET).select("row", "col", *r4("ratio"))


@query("SELECT event_id, year(ts)::INT AS year, dayofyear(ts)::INT AS yday, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events")
def time_fields(spark, sf):
    whole = F.col("ts").cast("long")
    f = H.time_fields(whole)
    stamp = H.stamp_time(F.date_format("ts", "yyyy/MM/dd:HH:mm:ss")).cast("long")
    t = V.series(spark, sf).select("event_id", f.alias("f"), stamp.alias("epoch"))
    return t.select("event_id", "f.year", "f.yday", "f.hour", "f.minute", "f.second", "epoch")


@query(WITH + "SELECT platform, count(*) AS n FROM snd WHERE CASE platform WHEN 'A' THEN -depth BETWEEN 15 AND 45 AND degrees(atan2(east - 20, -depth)) BETWEEN -30 AND 30 WHEN 'N' THEN -depth BETWEEN 0 AND 50 AND degrees(atan2(east - 20, -depth)) BETWEEN -20 AND 60 ELSE degrees(atan2(east - 20, -depth)) BETWEEN -45 AND 45 AND -depth BETWEEN 0 AND 1000 END GROUP BY ALL")
def platform_gates(spark, sf):
    spec = spark.createDataFrame([(1, "_A", 15.0, 45.0, -30.0, 30.0), (2, "_N", 0.0, 50.0, -20.0, 60.0), (3, "line", 0.0, 1000.0, -45.0, 45.0)], "rank int, recog string, min_depth double, max_depth double, min_angle double, max_angle double")
    t = V.soundings(spark, sf).withColumns({"file": F.concat(F.lit("line_"), F.col("platform")), "across": F.col("east") - 20})
    return J.gated_soundings(t, spec).groupBy("platform").agg(F.count("*").alias("n"))


_PING = "p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 41)::INT AS beam, 10 + l_quantity AS depth, (10 + l_quantity) * 1.2 AS range, (l_suppkey % 2 + 2 * l_linenumber)::INT AS flags, l_discount * 50 - 2 AS roll, l_tax * 40 - 1 AS pitch, l_discount - 0.05 AS heave, 1500 + l_linenumber AS surf, 1490 + l_linenumber AS speed, l_tax * 100 AS way FROM lineitem)"


def pings(spark, sf):
    c = F.col
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", (c("l_partkey") % 41).cast("int").alias("beam"), (10 + c("l_quantity")).alias("depth"), ((10 + c("l_quantity")) * 1.2).alias("range"),
        (c("l_suppkey") % 2 + 2 * c("l_linenumber")).cast("int").alias("flags"), (c("l_discount") * 50 - 2).alias("roll"), (c("l_tax") * 40 - 1).alias("pitch"), (c("l_discount") - 0.05).alias("heave"),
        (1500 + c("l_linenumber")).cast("double").alias("surf_sspeed"), (1490 + c("l_linenumber")).cast("double").alias("mean_speed"), (c("l_tax") * 100).alias("vessel_speed"),
    )


_SHIP = U.Vessel(imu=(-0.242, 0.004, 0.464), gps=(0.219, -0.117, 4.503), gps_latency=0.25, draft=0.7, static_roll=1.5)
_EVEN, _AXIS = "(beam - 50) * 1.5", "(radians((beam - 50) * 1.5 - 1.5))"
_RAD2 = "pow(radians(1.0), 2)"
_TRIG = f"{_PING}, t AS (SELECT *, cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr, {_AXIS} AS a, flags % 2 = 0 AS amp, greatest(flags // 2, 1) AS win FROM p)"
# a SeaBat 8101: 101 beams over 150 degrees, steered beyond 60 degrees, 1.5 degree beams
_ANG = f"""{_TRIG}, g AS (SELECT *, pow(CASE WHEN amp THEN radians(1.5) / 12 ELSE 0.2 * radians(1.5) / sqrt(win) END, 2) + pow(tan(a) * 0.52, 2) / (4 * speed * speed) + 0.005 * {_RAD2}
  + pow(tan(CASE WHEN a < -radians(61.5) THEN a + radians(61.5) WHEN a > radians(58.5) THEN a - radians(58.5) ELSE 0 END) * 0.5 / surf, 2) AS av, pow(0.025, 2) + pow(speed * 0.000004 / 4, 2) AS rv FROM t)"""


@query(f"WITH {_PING} SELECT l_orderkey, l_linenumber, round((beam - 67) * 150.0 / 134, 6) AS em300, round(degrees(asin(3.0637 * (beam - 64) * surf / 300000.0)), 6) AS em3000, round(-55 + 0.9524 * beam, 6) AS em3000d, round(37.25 + 1.25 * (beam - 62), 6) AS en1180, round((beam - 20) * 120.0 / 39, 6) AS sb9003 FROM p")
def beam_angles(spark, sf):
    return pings(spark, sf).select("l_orderkey", "l_linenumber", *[F.round(U.beam_angle(U.DEVICES[d], F.col("beam"), F.col("surf_sspeed")), 6).alias(d) for d in ("em300", "em3000", "em3000d", "en1180", "sb9003")])


@query(f"""WITH {_TRIG} SELECT l_orderkey, l_linenumber, round(1e9 * pow(CASE WHEN amp THEN 0.5 * tan(radians(1.0)) ELSE tan(0.5 * radians(1.0) / sqrt(win)) END, 2), 4) AS em300,
  round(1e9 * pow(CASE WHEN amp THEN radians(2.0) / cos(a) / 12 ELSE 0.2 * radians(2.0) / cos(a) / sqrt(win) END, 2), 4) AS em120, round(1e9 * pow(CASE WHEN amp THEN radians(3.3) / 12 ELSE 0.2 * radians(3.3) / sqrt(win) END, 2), 4) AS em1000, round(1e9 * pow(radians(2.3) / 12, 2), 4) AS hsweepds FROM t""")
def angle_variances(spark, sf):
    a = F.radians((F.col("beam") - 50) * 1.5 - 1.5)
    return pings(spark, sf).select("l_orderkey", "l_linenumber", *[F.round(1e9 * U.angle_variance(U.DEVICES[d], a, *U.detection(F.col("flags"))), 4).alias(d) for d in ("em300", "em120", "em1000", "hsweepds")])


@query(f"WITH {_PING} SELECT l_orderkey, l_linenumber, round(pow(greatest(0.003 * depth, 0.15), 2), 8) AS em300, round(pow(greatest(0.005 * depth, 0.15), 2), 8) AS sb2112, round(pow(0.025, 2) + pow(speed * 0.000033333 / 4, 2), 8) AS em3000, round(pow(0.03, 2) + pow(speed * 0.00015 / 4, 2), 8) AS en1180 FROM p")
def range_variances(spark, sf):
    return pings(spark, sf).select("l_orderkey", "l_linenumber", *[F.round(U.range_variance(U.DEVICES[d], F.col("depth"), F.col("mean_speed")), 8).alias(d) for d in ("em300", "sb2112", "em3000", "en1180")])


@query(f"""WITH {_ANG}, h AS (SELECT *, greatest(pow(0.1 * heave, 2), 0.0025) + 0.005 * {_RAD2} * pow(-0.242 * cp - 0.004 * sr * sp - 0.464 * cr * sp, 2) + 0.005 * {_RAD2} * pow(0.004 * cr * cp - 0.464 * sr * cp, 2)
  + 2 * 0.000025 * (sp * sp + pow(sr * cp, 2) + pow(1 - cr * cp, 2)) AS hv, (rv + pow(range * 0.52 / speed, 2)) * pow(cp * cos(radians(roll) + a), 2) + av * pow(range * sin(radians(roll) + a) * cp, 2)
  + 0.005 * {_RAD2} * pow(range * cos(radians(roll) + a) * sp, 2) + pow((1 - cos(radians(0.75))) * depth, 2) AS dv FROM g)
SELECT l_orderkey, l_linenumber, round(1e6 * av, 6) AS angle_var, round(hv, 8) AS heave_var, round(dv, 6) AS depth_var, round(0.0017 + hv + dv, 6) AS dz FROM h""")
def swath_vertical(spark, sf):
    s = U.Swath("sb8101", _SHIP)
    return pings(spark, sf).select("l_orderkey", "l_linenumber", F.round(1e6 * s.angle_var(), 6).alias("angle_var"), F.round(s.heave_var(), 8).alias("heave_var"), F.round(s.depth_var(), 6).alias("depth_var"), F.round(s.vertical_var(), 6).alias("dz"))


@query(f"""WITH {_ANG}, h AS (SELECT *, 0.00005 * (cp * cp + cr * cr + pow(sr * sp, 2) + sr * sr + pow(cr * sp, 2)) + 0.25 * {_RAD2} * (pow(0.219 * cp, 2) + pow(0.117 * cr, 2) + pow(0.117 * sr * sp, 2) + pow(4.503 * sp * cr, 2) + pow(4.503 * sr, 2)
  + 0.219 * 0.117 * cp * sp * sr - 0.219 * 4.503 * cp * sp * cr + 0.117 * 4.503 * cp * cp * sr * cr) + 0.0025 * {_RAD2} * (pow(0.117, 2) * (sr * sr + pow(cr * sp, 2)) + pow(4.503, 2) * (cr * cr + pow(sr * sp, 2)) - 0.117 * 4.503 * cr * sr * cp * cp)
  + 0.0025 * {_RAD2} * pow(0.219 * sp - 0.117 * sr * cp + 4.503 * cr * cp, 2) AS tv,
  pow(0.25 * 0.2 * cp, 2) + pow(way * cp, 2) * (0.0009 + 0.000025 + 0.000025) + pow(way * 0.25 * cp, 2) * 0.25 * {_RAD2} + pow(way * 0.25 * sp, 2) * 0.005 * {_RAD2} AS lv,
  (pow(0.52 * depth / (speed * cos(a)), 2) + rv) * (1 - pow(cp * cos(a), 2)) + 0.26 * {_RAD2} * depth * depth * (sp * sp + pow(tan(a), 2)) + av * range * range * (1 - pow(cp * sin(a), 2)) + pow(depth * cp, 2) * 0.005 * {_RAD2} AS bv FROM g)
SELECT l_orderkey, l_linenumber, round(tv, 8) AS relative_var, round(lv, 8) AS latency_var, round(bv, 6) AS beam_var, round(4 + tv + lv + bv, 6) AS dr FROM h""")
def swath_horizontal(spark, sf):
    s = U.Swath("sb8101", _SHIP)
    return pings(spark, sf).select("l_orderkey", "l_linenumber", F.round(s.relative_var(), 8).alias("relative_var"), F.round(s.latency_var(), 8).alias("latency_var"), F.round(s.beam_var(), 6).alias("beam_var"), F.round(s.horizontal_var(), 6).alias("dr"))


_FIR, _STEP = D.fir(100.0, 20.0, 7)
_TAPS = ", ".join(f"({j - len(_FIR) // 2}, {h!r})" for j, h in enumerate(_FIR))


@query(f"""WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id HAVING count(*) > 6), k(j, h) AS (VALUES {_TAPS}),
i AS (SELECT user_id, x, unnest(range(0, len(x), {_STEP})) AS i FROM v), p AS (SELECT user_id, i, h, x, abs(i + j) AS p FROM i, k)
SELECT user_id, i // {_STEP} AS place, round(sum(h * x[(CASE WHEN p > len(x) - 1 THEN 2 * (len(x) - 1) - p ELSE p END + 1)::BIGINT]), 4) AS value FROM p GROUP BY ALL""")
def fir_decimate(spark, sf):
    t = V.series(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x")).where("size(x) > 6")
    t = t.select("user_id", F.posexplode(D.decimated(F.col("x.value"), _FIR, _STEP)).alias("place", "value"))
    return t.select("user_id", "place", *r4("value"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3 AND epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts) <= 86400000000::BIGINT")
def kept_samples(spark, sf):
    e = V.series(spark, sf)
    return T.all_but_n(T.all_but_t(e, 86400.0, "user_id"), 3, "user_id").select("user_id", "event_id")


@query(WITH + f"""SELECT floor(floor(east / 1.5)::BIGINT / 8.0)::INT AS tile_x, floor(floor((north - 20) / 2.5)::BIGINT / 5.0)::INT AS tile_y, count(*) AS n, min(((floor(east / 1.5)::BIGINT % 8) + 8) % 8)::INT AS x, max(((floor((north - 20) / 2.5)::BIGINT % 5) + 5) % 5)::INT AS y FROM snd GROUP BY ALL""")
def tile_index(spark, sf):
    t = V.soundings(spark, sf).select(B.tile_of(F.col("east"), F.col("north") - 20, 1.5, 2.5, 8, 5).alias("t"))
    return t.groupBy("t.tile_x", "t.tile_y").agg(F.count("*").alias("n"), F.min("t.x").alias("x"), F.max("t.y").alias("y"))


@query(WITH + "SELECT platform, count(*) AS n, epoch(min(ts))::BIGINT AS first, epoch(max(ts))::BIGINT AS last, round(min(east), 4) AS west, round(min(north), 4) AS south, round(max(east), 4) AS east, round(max(north), 4) AS north FROM snd GROUP BY ALL")
def line_bounds(spark, sf):
    t = J.line_bounds(V.soundings(spark, sf), "platform")
    return t.select("platform", "n", *[F.col(c).cast("timestamp").cast("long").alias(c) for c in ("first", "last")], *r4("west", "south", "east", "north"))


_NODAL = f"{P.dist_scale} * pow(greatest(2.0, (({P.fixed2} + {P.pct2} * depth * depth) / ({CI95} * {CI95})) / dz) - 1, {1 / P.dist_exp})"


@query(WITH + f""", r AS (SELECT *, {_NODAL} AS r FROM snd), s AS (SELECT *, greatest(trunc((40 - north - r) / 4), 0)::INT AS r0, least(trunc((40 - north + r) / 4), 10)::INT AS r1, greatest(trunc(east - r), 0)::INT AS c0, least(trunc(east + r), 49)::INT AS c1 FROM r),
p AS (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM s WHERE r0 <= r1 AND c0 <= c1 AND r0 < 10 AND c0 < 49), q AS (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM p)
SELECT row::INT AS row, col::INT AS col, count(*) AS n, round(sum(dz * (1 + pow(sqrt(pow(col - east, 2) + pow(40 - 4 * row - north, 2)) + {CI95} * sqrt(dr), 2))), 3) AS var FROM q GROUP BY ALL""")
def nodal_pairs(spark, sf):
    return G.nodal_pairs(V.soundings(spark, sf), V.SHEET, P).groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.sum("var"), 3).alias("var"))


_FINE = SheetSpec(1.25, 37.0, 0.5, 3.0, 70, 9)


@query(MEAN + f""", n AS (SELECT r.row, c.col, (c.col * 0.5 + 1.25) AS x, 40 - (37 - 3 * r.row) AS y FROM (SELECT unnest(range(9))::INT AS row) r, (SELECT unnest(range(70))::INT AS col) c), k AS (SELECT *, floor(x)::INT AS c0, floor(y / 4.0)::INT AS r0, x - floor(x) AS u, 1 - (y / 4.0 - floor(y / 4.0)) AS w FROM n),
z AS (SELECT k.row, k.col, u, w, a.z AS nw, b.z AS ne, d.z AS sw, e.z AS se FROM k JOIN mean a ON a.row = r0 AND a.col = c0 JOIN mean b ON b.row = r0 AND b.col = c0 + 1 JOIN mean d ON d.row = r0 + 1 AND d.col = c0 JOIN mean e ON e.row = r0 + 1 AND e.col = c0 + 1)
SELECT row, col, round((nw * (1 - u) + ne * u) * w + (sw * (1 - u) + se * u) * (1 - w), 4) AS z, round(0.04 * (pow((1 - u) * w, 2) + pow(u * w, 2) + pow((1 - u) * (1 - w), 2) + pow(u * (1 - w), 2)), 6) AS var FROM z""")
def resampled_surface(spark, sf):
    start = J.start_surface(mean(spark, sf), 0.2)
    return J.resampled(start, V.SHEET, _FINE).select("row", "col", *r4("z"), F.round("var", 6).alias("var"))


@query(MASK + f", n AS (SELECT r.row, c.col, (c.col * 0.5 + 1.25) AS x, 40 - (37 - 3 * r.row) AS y FROM (SELECT unnest(range(9))::INT AS row) r, (SELECT unnest(range(70))::INT AS col) c) SELECT n.row, n.col, coalesce(v, 0)::INT AS v FROM n LEFT JOIN mask m ON m.row = floor(y / 4.0) AND m.col = floor(x) AND x BETWEEN 0 AND 49 AND y / 4.0 BETWEEN 0 AND 10")
def scaled_mask(spark, sf):
    return K.scaled_mask(_mask(spark, sf), V.SHEET, _FINE)


@query(FOLD + """, o(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)), s AS (SELECT row, col FROM prior WHERE nhyp > 40), d AS (SELECT DISTINCT s.row + dr AS row, s.col + dc AS col FROM s, o), m AS (SELECT p.* FROM prior p JOIN d USING (row, col)),
n AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2 FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
far(row, col, r0, c0) AS (SELECT row, col, row, col FROM m UNION SELECT n.r2, n.c2, far.r0, far.c0 FROM far JOIN n USING (row, col)), lab AS (SELECT row, col, min(r0::BIGINT * 4294967296 + c0) AS blob FROM far GROUP BY ALL)
SELECT blob, count(*) AS nodes, (min(col) + max(col)) / 2.0 AS x, 40 - 4 * (min(row) + max(row)) / 2.0 AS y, (max(col) - min(col))::DOUBLE AS width, 4.0 * (max(row) - min(row)) AS height, round(max(depth), 4) AS shoalest, round(avg(unct), 4) AS mean_unct, round(max(ratio), 4) AS focus_ratio FROM lab JOIN prior USING (row, col) GROUP BY blob""")
def areas_of_interest(spark, sf):
    t = E.prior_surface(folded(spark, sf)).withColumn("nhyp", F.when(F.col("nhyp") > 40, 2).otherwise(1))
    return J.areas_of_interest(stored(t), V.SHEET, 2.5).select("blob", "nodes", "x", "y", "width", "height", *r4("shoalest", "mean_unct", "focus_ratio"))
