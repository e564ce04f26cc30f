"""Queries over outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from orogen.operators import shapes as S
from orogen.plans import fixtures as X
from orogen.plans.registry import query

RINGS = [[(4, 4), (60, 8), (52, 58), (6, 50)], [(20, 20), (40, 20), (40, 40), (20, 40)], [(2, 54), (10, 62), (2, 62)]]
EDGES = "edge(ring, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, r in enumerate(RINGS) for (a, b), (c, d) in zip(r, r[1:] + r[:1])) + ")"


@query("q_polygon_mask", f"WITH {X.GRID}, {EDGES}, c AS (SELECT i, j, j + 0.5::DOUBLE AS x, i % 64 + 0.5::DOUBLE AS y FROM grid) SELECT i, j FROM c WHERE (SELECT count(*) FROM edge WHERE ((y0 <= y AND y < y1) OR (y1 <= y AND y < y0)) AND x0 + (y-y0)*(x1-x0)/(y1-y0) <= x) % 2 = 1")
def q_polygon_mask(spark, sf):
    cells = X.grid(spark, sf).select("i", "j", (F.col("j") + F.lit(0.5)).alias("x"), (F.col("i") % 64 + F.lit(0.5)).alias("y"))
    return S.polygon_mask(cells, S.edges(spark, RINGS))


@query("q_outline_extent", f"WITH {EDGES} SELECT (min(x0)+max(x0))/2 AS cx, (min(y0)+max(y0))/2 AS cy, greatest(max(x0)-min(x0), max(y0)-min(y0))/2 AS radius FROM edge")
def q_outline_extent(spark, sf):
    return S.outline_extent(S.edges(spark, RINGS))


HEX = S.RoundedPolygon(6, 24.0, 5.0, 7.0)


# The rounded polygon is the points within the corner radius of a smaller, sharp one: distance to its sides decides.
@query("q_regular_polygon_mask", f"""WITH {X.GRID}, c AS (SELECT i, j, j - 31.75::DOUBLE AS x, 31.25::DOUBLE - i % 64 AS y FROM grid),
k AS (SELECT pi()/2 - pi()/6 + radians(7.0) + n*pi()/3 AS w, (24*cos(pi()/6) - 5)/cos(pi()/6) AS d FROM range(6) r(n)), e AS (SELECT d*cos(w) AS ax, d*sin(w) AS ay, d*cos(w+pi()/3) AS bx, d*sin(w+pi()/3) AS b_y FROM k),
m AS (SELECT i, j, bool_and((bx-ax)*(y-ay) - (b_y-ay)*(x-ax) >= 0) AS inside, min(sqrt(power(x - ax - (bx-ax)*t, 2) + power(y - ay - (b_y-ay)*t, 2))) AS dist FROM (SELECT *, least(greatest(((x-ax)*(bx-ax) + (y-ay)*(b_y-ay))/((bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay)), 0), 1) AS t FROM c, e) GROUP BY i, j) SELECT i, j FROM m WHERE inside OR dist <= 5 + 24e-9""")
def q_regular_polygon_mask(spark, sf):
    g = X.grid(spark, sf)
    return g.filter(HEX.contains(F.col("j") - F.lit(31.75), F.lit(31.25) - F.col("i") % 64)).select("i", "j")


@query("q_polygon_metrics", "SELECT round(24*cos(pi()/6), 9) AS apothem, round(2*24*sin(pi()/6), 9) AS side, round(6*tan(pi()/6)*power(24*cos(pi()/6), 2) - (6*tan(pi()/6) - pi())*25, 9) AS area, round(6*2*24*sin(pi()/6) - 2*(6*tan(pi()/6) - pi())*5, 9) AS perimeter")
def q_polygon_metrics(spark, sf):
    return spark.range(1).select(*[F.round(F.lit(float(getattr(HEX, k))), 9).alias(k) for k in ("apothem", "side", "area", "perimeter")])


@query("q_outline_points", "SELECT k::INT AS k, s::INT AS s, round(d*cos(w) + 5*cos(t), 6) AS x, round(d*sin(w) + 5*sin(t), 6) AS y FROM (SELECT k, s, w, w + (s/4.0 - 1)*pi()/6 AS t, (24*cos(pi()/6) - 5)/cos(pi()/6) AS d FROM (SELECT k, s, pi()/2 - pi()/6 + radians(7.0) + k*pi()/3 AS w FROM range(6) a(k), range(9) b(s)))")
def q_outline_points(spark, sf):
    return HEX.outline(spark, 8).select("k", "s", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TOUCHING = S.RoundedPolygon(5, 24.0, 6.0, -20.0, reference="rounded")


@query("q_polygon_extent", """WITH h AS (SELECT pi()/5 AS h), p AS (SELECT h, 6 + (24-6)*cos(h) AS a FROM h), d AS (SELECT h, a, (a-6)/cos(h) AS d FROM p), c AS (SELECT a, d, d*cos(w) AS x, d*sin(w) AS y FROM (SELECT a, d, pi()/2 - radians(20) + 2*h*k AS w FROM d, range(5) r(k)))
SELECT round(any_value(a), 9) AS apothem, round(any_value(d) + 6, 9) AS extreme_radius, round(min(x)-6, 9) AS west, round(max(x)+6, 9) AS east, round(min(y)-6, 9) AS south, round(max(y)+6, 9) AS north FROM c""")
def q_polygon_extent(spark, sf):
    values = dict(zip(("west", "east", "south", "north"), TOUCHING.bbox, strict=True)) | {k: getattr(TOUCHING, k) for k in ("apothem", "extreme_radius")}
    return spark.range(1).select(*[F.round(F.lit(float(v)), 9).alias(k) for k, v in values.items()])


# On a side's straight part the ray ends on the side, elsewhere on the circle of the nearest corner.
RAY = """k AS (SELECT pi()/2 - pi()/6 + radians(7.0) + n*pi()/3 AS w, 24*cos(pi()/6) AS a, (24*cos(pi()/6) - 5)/cos(pi()/6) AS d FROM range(6) r(n)),
p AS (SELECT i, j, j - 31.75::DOUBLE AS x, 31.25::DOUBLE - i % 64 AS y FROM grid),
q AS (SELECT i, j, x, y, atan2(y, x) AS t, a, d, w, cos(atan2(y, x) - w - pi()/6) AS cs, cos(atan2(y, x) - w) AS cc, sin(atan2(y, x) - w) AS sc, tan(atan2(y, x) - w - pi()/6) AS tn FROM p, k)"""


@query("q_radial_distance", f"WITH {X.GRID}, {RAY} SELECT i, j, round(coalesce(max(CASE WHEN cs > 0 AND abs(a*tn) <= (a-5)*tan(pi()/6) THEN a/cs END), max(CASE WHEN cc > 0 AND 25 >= d*d*sc*sc THEN d*cc + sqrt(25 - d*d*sc*sc) END)), 6) AS reach FROM q GROUP BY i, j")
def q_radial_distance(spark, sf):
    g = X.grid(spark, sf)
    return g.select("i", "j", F.round(HEX.reach(F.col("j") - F.lit(31.75), F.lit(31.25) - F.col("i") % 64), 6).alias("reach"))


# The nearest of the feet on the straight parts and on the arcs.
FEET = """s AS (SELECT i, j, x, y, w, a, d, least(greatest(-x*sin(w+pi()/6) + y*cos(w+pi()/6), -(a-5)*tan(pi()/6)), (a-5)*tan(pi()/6)) AS t, x - d*cos(w) AS u, y - d*sin(w) AS v FROM p, k),
f AS (SELECT i, j, x, y, a*cos(w+pi()/6) - t*sin(w+pi()/6) AS fx, a*sin(w+pi()/6) + t*cos(w+pi()/6) AS fy FROM s UNION ALL SELECT i, j, x, y, d*cos(w) + 5*u/sqrt(u*u+v*v), d*sin(w) + 5*v/sqrt(u*u+v*v) FROM s WHERE u*cos(w) + v*sin(w) > 0 AND abs(v*cos(w) - u*sin(w)) <= (u*cos(w) + v*sin(w))*tan(pi()/6)),
m AS (SELECT i, j, arg_min(fx, dd) AS fx, arg_min(fy, dd) AS fy FROM (SELECT *, (fx-x)*(fx-x) + (fy-y)*(fy-y) AS dd FROM f) GROUP BY i, j)"""


@query("q_outline_project", f"WITH {X.GRID}, {RAY}, {FEET} SELECT i, j, round(sqrt((fx-x)*(fx-x) + (fy-y)*(fy-y)), 6) AS moved, round(sqrt(fx*fx + fy*fy), 6) AS reach FROM m JOIN p USING (i, j) WHERE x*x + y*y <= 400")
def q_outline_project(spark, sf):
    x, y = F.col("j") - F.lit(31.75), F.lit(31.25) - F.col("i") % 64
    px, py = HEX.project(x, y)
    g = X.grid(spark, sf).filter(x * x + y * y <= 400)
    return g.select("i", "j", F.round(F.hypot(px - x, py - y), 6).alias("moved"), F.round(F.hypot(px, py), 6).alias("reach"))


@query("q_outline_by_tolerance", """WITH n AS (SELECT ceil((pi()/3)/(4*asin(sqrt(0.01/10.0))))::INT AS m) SELECT k::INT AS k, s::INT AS s, round(d*cos(w) + 5*cos(t), 6) AS x, round(d*sin(w) + 5*sin(t), 6) AS y
FROM (SELECT k, s, w, w + (2.0*s/m - 1)*pi()/6 AS t, (24*cos(pi()/6) - 5)/cos(pi()/6) AS d FROM (SELECT k, s, m, pi()/2 - pi()/6 + radians(7.0) + k*pi()/3 AS w FROM n, range(6) a(k), range(50) b(s) WHERE s <= m))""")
def q_outline_by_tolerance(spark, sf):
    return HEX.outline(spark, tolerance=0.01).select("k", "s", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
