"""Queries on edge statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import edges
from platen.plans.register import query

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def samples(v):
    """Each supplier's scan with four sides of lines at 25 offsets, 5 slopes and 10 places, an edge along some of them."""
    return v("edge_samples")


_S = "s AS (SELECT scan_id, side, off, slope, t, gr, gg, gb, ok FROM edge_samples)"
_SCORES = "scores AS (SELECT scan_id, side, off, slope, sqrt(avg(gr) * avg(gr) + avg(gg) * avg(gg) + avg(gb) * avg(gb)) AS score, count(*) AS n FROM s WHERE ok GROUP BY ALL)"


@query("ft2_line_scores", f"WITH {_S}, {_SCORES} SELECT scan_id, side, off, slope, {T6.format('score')} AS score, n FROM scores")
def _(v):
    return edges.line_scores(samples(v)).withColumn("score", tidy("score"))


_NOISE = "noise AS (SELECT scan_id, side, CASE WHEN count(*) < 50 THEN 1e9 ELSE sqrt(var_pop(gr) + var_pop(gg) + var_pop(gb)) / sqrt(count(DISTINCT t)) END AS noise FROM s WHERE ok GROUP BY ALL)"


@query("ft3_edge_noise", f"WITH {_S}, {_NOISE} SELECT scan_id, side, {T6.format('noise')} AS noise FROM noise")
def _(v):
    return edges.edge_noise(samples(v)).withColumn("noise", tidy("noise"))


_MED = ", ".join(f"quantile_cont({c}, 0.5) FILTER (WHERE ok AND {s}off >= 1 AND {s}off <= 6) AS {c}{k}" for k, s in (("o", ""), ("i", "-")) for c in ("gr", "gg", "gb"))


@query("ft4_step_size", f"""WITH {_S}, m AS (SELECT scan_id, side, t, {_MED} FROM s GROUP BY ALL), d AS (SELECT *, sqrt((gro - gri) ** 2 + (ggo - ggi) ** 2 + (gbo - gbi) ** 2) AS d FROM m)
 SELECT scan_id, side, {T6.format('CASE WHEN count(d) > 0.3 * count(*) THEN quantile_cont(d, 0.5) END')} AS step FROM d GROUP BY ALL""")
def _(v):
    return edges.step_size(samples(v)).withColumn("step", tidy("step"))


_CANDS = """r AS (SELECT *, dense_rank() OVER (PARTITION BY scan_id, side ORDER BY slope) AS isl, max(score) OVER (PARTITION BY scan_id, side) AS best FROM
  (SELECT scan_id, side, off, slope, CASE WHEN n < 0.4::double * places THEN 0 ELSE score END AS score FROM scores JOIN (SELECT scan_id, side, count(DISTINCT t) AS places FROM s GROUP BY ALL) USING (scan_id, side))),
 typical AS (SELECT scan_id, side, greatest(quantile_cont(m, 0.5), 1e-6) AS typical FROM (SELECT scan_id, side, off, max(score) AS m FROM r GROUP BY ALL) GROUP BY ALL),
 cands AS (SELECT p.scan_id, p.side, p.off, p.slope, p.score FROM r p JOIN noise n ON n.scan_id = p.scan_id AND n.side = p.side JOIN typical t ON t.scan_id = p.scan_id AND t.side = p.side
 WHERE p.score > 0 AND p.score >= 0.5 * p.best AND p.score >= 1 AND p.score >= 6 * least(n.noise, t.typical / 3)
 AND p.score >= (SELECT max(q.score) FROM r q WHERE q.scan_id = p.scan_id AND q.side = p.side AND abs(q.off - p.off) <= 1.5 AND abs(q.isl - p.isl) <= 2))"""


@query("ft5_edge_candidates", f"WITH {_S}, {_SCORES}, {_NOISE}, {_CANDS} SELECT scan_id, side, off, slope, {T6.format('score')} AS score FROM cands")
def _(v):
    s = samples(v)
    places = s.groupBy("scan_id", "side").agg(F.count_distinct("t").alias("places"))
    return edges.edge_candidates(edges.line_scores(s), edges.edge_noise(s), places).withColumn("score", tidy("score"))


def _trim(k: int) -> str:
    """Round k of the trimmed fit over lists of points."""
    sums = "list_reduce(list_prepend({'n': 0.0::double, 'x': 0.0::double, 'y': 0.0::double, 'xx': 0.0::double, 'xy': 0.0::double}, list_transform(kept, lambda q: {'n': 1.0::double, 'x': q.t, 'y': q.v, 'xx': q.t * q.t, 'xy': q.t * q.v})), lambda s, q: {'n': s.n + q.n, 'x': s.x + q.x, 'y': s.y + q.y, 'xx': s.xx + q.xx, 'xy': s.xy + q.xy})"
    return f"""m{k} AS (SELECT scan_id, side, every, kept, {sums} AS m FROM k{k}), b{k} AS (SELECT *, CASE WHEN abs(m.n * m.xx - m.x * m.x) > 1e-12 THEN (m.n * m.xy - m.x * m.y) / (m.n * m.xx - m.x * m.x) ELSE 0 END AS b FROM m{k} WHERE m.n >= 2),
 a{k} AS (SELECT *, (m.y - b * m.x) / m.n AS a FROM b{k}), d{k} AS (SELECT *, greatest(1.4826::double * list_median(list_transform(kept, lambda q: abs(q.v - (a + b * q.t)))), 0.3) AS sd FROM a{k}),
 k{k + 1} AS (SELECT scan_id, side, every, list_filter(every, lambda q: abs(q.v - (a + b * q.t)) < 2.5 * sd) AS kept, a, b, sd FROM d{k})"""


_POINTS = """tw AS (SELECT scan_id, side, sum(CASE WHEN ok THEN gr ELSE 0 END) AS r, sum(CASE WHEN ok THEN gg ELSE 0 END) AS g, sum(CASE WHEN ok THEN gb ELSE 0 END) AS b, count(DISTINCT t) AS places FROM line_samples GROUP BY ALL),
 td AS (SELECT scan_id, side, places, r / greatest(sqrt(r * r + g * g + b * b), 1e-9) AS r, g / greatest(sqrt(r * r + g * g + b * b), 1e-9) AS g, b / greatest(sqrt(r * r + g * g + b * b), 1e-9) AS b FROM tw),
 al AS (SELECT l.scan_id, l.side, t, d, base, places, CASE WHEN ok THEN greatest(gr * r + gg * g + gb * b, 0) ELSE 0 END AS y1 FROM line_samples l JOIN td ON td.scan_id = l.scan_id AND td.side = l.side),
 nb AS (SELECT *, lag(y1) OVER w AS y0, lead(y1) OVER w AS y2, row_number() OVER (PARTITION BY scan_id, side, t ORDER BY y1 DESC, d) AS k FROM al WINDOW w AS (PARTITION BY scan_id, side, t ORDER BY d)),
 pts AS (SELECT scan_id, side, t, places, base + d + CASE WHEN y0 - 2 * y1 + y2 < 0 THEN 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE 0 END * 0.25 AS v FROM nb WHERE k = 1 AND y1 > 0 AND y0 IS NOT NULL AND y2 IS NOT NULL)"""


@query("ft6_edge_points", f"WITH {_POINTS} SELECT scan_id, side, t, places, {T6.format('v')} AS v FROM pts")
def _(v):
    return edges.edge_points(v("line_samples")).withColumn("v", tidy("v"))


@query("ft6_refine_line", f"""WITH {_POINTS}, k0 AS (SELECT scan_id, side, list({{'t': t, 'v': v}} ORDER BY t, v) AS every, list({{'t': t, 'v': v}} ORDER BY t, v) AS kept FROM pts GROUP BY ALL HAVING count(*) >= 0.4::double * max(places) AND count(*) >= 20),
 {', '.join(_trim(k) for k in range(4))} SELECT scan_id, side, {T6.format('a')} AS a, {T6.format('b')} AS b, {T6.format('sd')} AS sd FROM k4""")
def _(v):
    return edges.refine_line(v("line_samples")).select("scan_id", "side", *(tidy(c).alias(c) for c in ("a", "b", "sd")))


# Samples of whole suppliers' lines: each side is seen at up to 50 places, so that the share of places counts.
_READINGS = """s AS (SELECT sk AS scan_id, cast(cand_id % 4 AS int) AS side, q AS t, cast((pk * 3) % 61 - 30 AS double) AS gr, cast((pk * 5) % 61 - 30 AS double) AS gg, cast((pk * 7) % 61 - 30 AS double) AS gb, pk % 11 <> 0 AS ok FROM lines)"""
_BEST = "best AS (SELECT scan_id, side, t, max(sqrt(gr * gr + gg * gg + gb * gb)) AS g FROM s WHERE ok GROUP BY ALL), p90 AS (SELECT scan_id, side, quantile_cont(g, 0.9) AS p, count(*) AS n FROM best GROUP BY ALL)"


@query("ft7_continuity", f"WITH {_READINGS}, {_BEST} SELECT b.scan_id, b.side, CASE WHEN any_value(n) < 20 THEN 1 ELSE avg((g >= p / 3)::int) END::double AS continuity FROM best b JOIN p90 q ON q.scan_id = b.scan_id AND q.side = b.side GROUP BY ALL")
def _(v):
    pk = F.col("pk")
    colours = ((pk * k % 61 - 30).cast("double").alias(c) for c, k in (("gr", 3), ("gg", 5), ("gb", 7)))
    return edges.continuity(v("lines").select(F.col("sk").alias("scan_id"), (F.col("cand_id") % 4).cast("int").alias("side"), F.col("q").alias("t"), *colours, (pk % 11 != 0).alias("ok")))


@query("ft9_judge_edges", """WITH b AS (SELECT l_orderkey AS scan_id, cand_id, 1000.0::double AS across, (pk % 23)::double AS model_gap, (sk % 31)::double AS to_border, (pk % 17) / 50.0::double AS past, (pk % 40)::double AS distance,
 CASE WHEN pk % 9 = 0 THEN NULL ELSE (sk % 20) / 100.0::double END AS beyond, (pk % 15) / 100.0::double AS inside, (pk % 19) / 100.0::double AS close_in, (sk % 16) / 100.0::double AS close_out, (sk % 45)::double AS plain_distance,
 CASE WHEN pk % 4 = 0 THEN NULL ELSE (sk % 40)::double END AS step, (pk % 10) / 10.0::double AS continuity FROM lines),
 r AS (SELECT *, coalesce(model_gap <= greatest(1.5 * across / 256, 4) AND to_border >= 4 AND past >= 0.1, false) OR (to_border >= 7 AND beyond IS NOT NULL AND
 ((distance < 18 AND least(beyond, inside) >= 0.02 AND abs(beyond - inside) < 0.66 * greatest(beyond, inside)) OR (greatest(close_in, close_out) >= 0.1 AND least(close_in, close_out) < 0.03 AND plain_distance < 25)
 OR (distance < 12 AND greatest(beyond, inside) < 0.02 AND coalesce(step, 99) < 12))) AS rule FROM b) SELECT scan_id, cand_id, rule OR continuity < 0.5 AS internal, NOT rule AND continuity < 0.5 AS broken FROM r""")
def _(v):
    pk, sk = F.col("pk"), F.col("sk")
    real = {"across": F.lit(1000.0), "model_gap": pk % 23, "to_border": sk % 31, "past": pk % 17 / 50.0, "distance": pk % 40, "beyond": F.when(pk % 9 != 0, sk % 20 / 100.0), "inside": pk % 15 / 100.0, "close_in": pk % 19 / 100.0, "close_out": sk % 16 / 100.0, "plain_distance": sk % 45, "step": F.when(pk % 4 != 0, sk % 40), "continuity": pk % 10 / 10.0}
    b = v("lines").select(F.col("l_orderkey").alias("scan_id"), "cand_id", *(c.cast("double").alias(n) for n, c in real.items()))
    return edges.judge_edges(b).select("scan_id", "cand_id", "internal", "broken")


@query("ft10_pick_cluster", f"""WITH {_S}, {_SCORES}, l AS (SELECT *, coalesce((off - lag(off) OVER w > 1.5)::int, 0) AS new FROM scores WINDOW w AS (PARTITION BY scan_id, side ORDER BY off, slope)),
 c AS (SELECT *, sum(new) OVER (PARTITION BY scan_id, side ORDER BY off, slope ROWS UNBOUNDED PRECEDING) AS cluster FROM l),
 e AS (SELECT scan_id, side, cluster, min(abs(off)) AS near, first(off ORDER BY score DESC, off, slope) AS off, max(score) AS score FROM c GROUP BY ALL)
 SELECT scan_id, side, first(off ORDER BY near, cluster) AS off, {T6.format('first(score ORDER BY near, cluster)')} AS score FROM e GROUP BY ALL""")
def _(v):
    return edges.pick_cluster(edges.line_scores(samples(v)), 1.5).withColumn("score", tidy("score"))


@query("ft11_side_decision", """WITH s AS (SELECT l_orderkey AS scan_id, cand_id, pk % 60 AS samples, CASE WHEN pk % 3 = 0 THEN NULL ELSE (pk % 41 - 20) * 0.5::double END AS near_off, sk % 5 = 0 AS near_broken, CASE WHEN sk % 2 = 0 THEN NULL ELSE (sk % 61 - 30)::double END AS far_off FROM lines),
 k AS (SELECT *, CASE WHEN samples < 20 THEN 0 WHEN near_off IS NOT NULL AND NOT near_broken THEN 2 WHEN near_off IS NOT NULL THEN 1 WHEN far_off IS NOT NULL THEN 3 ELSE 0 END AS kind FROM s)
 SELECT scan_id, cand_id, kind, CASE kind WHEN 2 THEN near_off WHEN 3 THEN far_off ELSE 0 END::double AS off FROM k""")
def _(v):
    pk, sk = F.col("pk"), F.col("sk")
    s = v("lines").select(F.col("l_orderkey").alias("scan_id"), "cand_id", (pk % 60).alias("samples"), F.when(pk % 3 != 0, (pk % 41 - 20) * 0.5).alias("near_off"), (sk % 5 == 0).alias("near_broken"), F.when(sk % 2 != 0, (sk % 61 - 30).cast("double")).alias("far_off"))
    return edges.side_decision(s).select("scan_id", "cand_id", "kind", "off")


@query("ft12_meet", f"""WITH l AS (SELECT vec_id AS scan_id, 10 + vec_id % 5::double AS a0, (vec_id % 7 - 3) * 0.01::double AS b0, 90 + vec_id % 4::double AS a1, (vec_id % 5 - 2) * 0.02::double AS b1, 80 + vec_id % 3::double AS a2, (vec_id % 3 - 1) * 0.03::double AS b2, 5 + vec_id % 6::double AS a3, (vec_id % 9 - 4) * 0.01::double AS b3 FROM embeddings)
 SELECT scan_id, {T6.format('a3 + b3 * (a0 + b0 * a3) / (1 - b0 * b3)')} AS x0, {T6.format('(a0 + b0 * a3) / (1 - b0 * b3)')} AS y0, {T6.format('a1 + b1 * (a2 + b2 * a1) / (1 - b2 * b1)')} AS x2, {T6.format('(a2 + b2 * a1) / (1 - b2 * b1)')} AS y2 FROM l""")
def _(v):
    k = F.col("vec_id")
    ab = [(10 + k % 5, (k % 7 - 3) * 0.01), (90 + k % 4, (k % 5 - 2) * 0.02), (80 + k % 3, (k % 3 - 1) * 0.03), (5 + k % 6, (k % 9 - 4) * 0.01)]
    lines = v("embeddings").select(k.alias("scan_id"), F.inline(F.array(*(F.struct(F.lit(i).alias("side"), a.cast("double").alias("a"), b.alias("b")) for i, (a, b) in enumerate(ab)))))
    return edges.meet(lines).select("scan_id", *(tidy(c).alias(c) for c in ("x0", "y0", "x2", "y2")))


_BAND = """p AS (SELECT scan_id, side, off, 100 + gr AS r, 120 + gg AS g, 140 + gb AS b, (t::bigint + side) % 3 AS v FROM s WHERE off BETWEEN 3 AND 9 AND (t::bigint + side) % 3 <> 2)"""


@query("ft8_band_stats", f"""WITH {_S}, {_BAND}, c AS (SELECT scan_id, side, {', '.join(f'quantile_cont({c}, 0.5) AS {c}, quantile_cont({c}, 0.5) FILTER (WHERE v = 0) AS plain_{c}' for c in 'rgb')} FROM p GROUP BY ALL),
 d AS (SELECT scan_id, side, quantile_cont(d, 0.5) AS density FROM (SELECT scan_id, side, off, avg((v = 1)::int) AS d FROM p GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL) SELECT c.*, d.density FROM c JOIN d ON d.scan_id = c.scan_id AND d.side = c.side""")
def _(v):
    """The band from 3 to 9 beyond each side; two points make a row in these sparse samples."""
    p = samples(v).where("off BETWEEN 3 AND 9").select("scan_id", "side", "off", (100 + F.col("gr")).alias("r"), (120 + F.col("gg")).alias("g"), (140 + F.col("gb")).alias("b"), ((F.col("t").cast("long") + F.col("side")) % 3).alias("v"))
    return edges.band_stats(p, 2)


_FOUR = " UNION ALL ".join(f"SELECT scan_id, cand_id, {k} AS side, x{k} AS xa, y{k} AS ya, x{(k + 1) % 4} AS xb, y{(k + 1) % 4} AS yb FROM quads" for k in range(4))


@query("ft1_side_samples", f"""WITH k AS (SELECT scan_id, cand_id, side, (i + 0.5::double) / 300 * 0.76 + 0.12 AS s, xa, ya, xb, yb FROM ({_FOUR}), range(300) r(i)), p AS (SELECT scan_id, cand_id, side, xa + (xb - xa) * s AS x, ya + (yb - ya) * s AS y FROM k)
 SELECT scan_id, cand_id, side::int AS side, count(*) AS n, {T6.format('min(x)')} AS x0, {T6.format('max(x)')} AS x1, {T6.format('min(y)')} AS y0, {T6.format('max(y)')} AS y1, floor(avg(x) * 1e3 + 0.37) / 1e3 AS mx, floor(avg(y) * 1e3 + 0.37) / 1e3 AS my FROM p GROUP BY ALL""")
def _(v):
    """All 300 points of each of the four sides, told by their number, their extent and their middle."""
    p = edges.side_extents(v("quads").select("scan_id", "cand_id", *(f"{c}{k}" for k in range(4) for c in "xy")))
    middle = lambda c: (F.floor(F.col(c) * 1e3 + 0.37) / 1e3).alias(c)
    return p.select("scan_id", "cand_id", "side", "n", *(tidy(f"{c}{k}").alias(f"{c}{k}") for c in "xy" for k in (0, 1)), middle("mx"), middle("my"))
