"""Queries over generated meshes and small solids."""

from __future__ import annotations

from pyspark.sql import functions as F

from orogen.operators import mesh as T
from orogen.plans import fixtures as X
from orogen.plans.registry import query
from orogen.plans.terrain import KEPT, SIDES, kept
from orogen.shared import materialise

BASE = 8.0
K = f"WITH {KEPT}"
H = """, g AS MATERIALIZED (SELECT i*64+j AS id, z FROM grid), ki AS MATERIALIZED (SELECT i, j, i*64+j AS id FROM kept), h AS MATERIALIZED (SELECT k.i, k.j, a.z AS z00, b.z AS z01, c.z AS z10, d.z AS z11 FROM ki k JOIN g a ON a.id=k.id JOIN g b ON b.id=k.id+1 JOIN g c ON c.id=k.id+64 JOIN g d ON d.id=k.id+65)"""
NAMES = 'ax, ay, az, bx, "by", bz, cx, cy, cz'


def _corner(code: str) -> str:
    """'01t' -> coordinates of the corner in row 0, column 1 at the top; 'b' at the base."""
    a, b, level = code
    return f"(j+{b})::DOUBLE, (-(i+{a}))::DOUBLE, " + (f"z{a}{b}" if level == "t" else f"-{BASE}::DOUBLE")


def _tri(part: str, k: int, codes: str, source: str, where: str = "true") -> str:
    xs = ", ".join(f"{v} AS {n}" for v, n in zip(", ".join(map(_corner, codes.split())).split(", "), NAMES.split(", "), strict=True))
    return f"SELECT '{part}' AS part, i, j, {k} AS k, {xs} FROM {source} WHERE {where}"


FLATTER = "abs(z00-z11) <= abs(z10-z01)"
TOP = " UNION ALL ".join([_tri("top", 0, "00t 10t 01t", "h"), _tri("top", 1, "10t 11t 01t", "h")])
ADAPTIVE = " UNION ALL ".join([
    _tri("top", 0, "00t 10t 11t", "h", FLATTER), _tri("top", 1, "00t 11t 01t", "h", FLATTER), _tri("top", 0, "00t 10t 01t", "h", f"NOT {FLATTER}"), _tri("top", 1, "10t 11t 01t", "h", f"NOT {FLATTER}"),
])
BOTTOM = " UNION ALL ".join([_tri("bottom", 0, "00b 01b 10b", "h"), _tri("bottom", 1, "10b 01b 11b", "h")])
WALL = " UNION ALL ".join(
    _tri("wall", k, codes, "h JOIN side USING (i, j)", f"side = '{s}'")
    for n, (s, p, q) in enumerate((("n", "00", "01"), ("w", "10", "00"), ("s", "11", "10"), ("e", "01", "11")))
    for k, codes in ((2 * n, f"{p}t {q}b {p}b"), (2 * n + 1, f"{p}t {q}t {q}b"))
)
MESH = f"{K}{H}, {SIDES}, tri AS MATERIALIZED ({TOP} UNION ALL {BOTTOM} UNION ALL {WALL})"


def _heights(spark, sf):
    return T.corner_heights(kept(spark, sf), X.grid(spark, sf))


def mesh(spark, sf):
    return T.build(kept(spark, sf), X.grid(spark, sf), BASE)


@query("q_top_fixed", f"{K}{H} {TOP}")
def q_top_fixed(spark, sf):
    return T.top(_heights(spark, sf))


@query("q_top_adaptive_diagonal", f"{K}{H} {ADAPTIVE}")
def q_top_adaptive_diagonal(spark, sf):
    return T.top(_heights(spark, sf), adaptive=True)


@query("q_bottom_grid", f"{K}{H} {BOTTOM}")
def q_bottom_grid(spark, sf):
    return T.bottom(kept(spark, sf), BASE)


@query("q_walls", f"{K}{H}, {SIDES} {WALL}")
def q_walls(spark, sf):
    cells = kept(spark, sf)
    return T.walls(cells, T.corner_heights(cells, X.grid(spark, sf)), BASE)


@query("q_mesh_counts", f"{MESH} SELECT part, count(*) AS n FROM tri GROUP BY part")
def q_mesh_counts(spark, sf):
    return mesh(spark, sf).groupBy("part").agg(F.count("*").alias("n"))


FLAT = "z // 64"


def _collapsed(spark, sf):
    """Triangles of which many are degenerate: columns of four are drawn together."""
    t = mesh(spark, sf)
    fold = lambda c: (F.floor(F.col(c) / 2) * 2).cast("double").alias(c)
    return t.select("part", "i", "j", "k", *[fold(c) if c[1] == "x" else F.col(c) for c in T.COORDS])


FOLDED = f"{MESH}, f AS (SELECT part, i, j, k, floor(ax/2)*2 AS ax, ay, az, floor(bx/2)*2 AS bx, \"by\", bz, floor(cx/2)*2 AS cx, cy, cz FROM tri)"
SAME = "((ax::FLOAT = bx::FLOAT AND ay::FLOAT = \"by\"::FLOAT AND az::FLOAT = bz::FLOAT) OR (bx::FLOAT = cx::FLOAT AND \"by\"::FLOAT = cy::FLOAT AND bz::FLOAT = cz::FLOAT) OR (cx::FLOAT = ax::FLOAT AND cy::FLOAT = ay::FLOAT AND cz::FLOAT = az::FLOAT))"
FLATAREA = "((\"by\"-ay)*(cz-az) - (bz-az)*(cy-ay) = 0 AND (bz-az)*(cx-ax) - (bx-ax)*(cz-az) = 0 AND (bx-ax)*(cy-ay) - (\"by\"-ay)*(cx-ax) = 0)"


@query("q_drop_degenerate", f"{FOLDED} SELECT * FROM f WHERE NOT {SAME}")
def q_drop_degenerate(spark, sf):
    return T.drop_degenerate(_collapsed(spark, sf))


@query("q_degenerate", f"{FOLDED} SELECT count(*) FILTER ({SAME} OR {FLATAREA}) AS n_degenerate FROM f")
def q_degenerate(spark, sf):
    return T.degenerate_count(_collapsed(spark, sf))


VERT = "v AS (SELECT ax::FLOAT AS x, ay::FLOAT AS y, az::FLOAT AS z FROM tri UNION SELECT bx::FLOAT, \"by\"::FLOAT, bz::FLOAT FROM tri UNION SELECT cx::FLOAT, cy::FLOAT, cz::FLOAT FROM tri)"


@query("q_weld", f"{MESH}, {VERT} SELECT x, y, z FROM v")
def q_weld(spark, sf):
    return T.weld(mesh(spark, sf))


@query("q_index_mesh", f"{MESH}, {VERT} SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS id, x, y, z FROM v")
def q_index_mesh(spark, sf):
    from orogen.sources.mesh_files import indexed_vertices

    return indexed_vertices(mesh(spark, sf))


EDGES = "e0 AS (SELECT row(ax, ay, az) AS p, row(bx, \"by\", bz) AS q FROM tri UNION ALL SELECT row(bx, \"by\", bz), row(cx, cy, cz) FROM tri UNION ALL SELECT row(cx, cy, cz), row(ax, ay, az) FROM tri)"


@query("q_edge_report", f"{MESH}, {VERT}, {EDGES}, u AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM e0 GROUP BY ALL), d AS (SELECT count(*) AS n FROM (SELECT p, q FROM e0 GROUP BY p, q HAVING count(*) > 1)) SELECT count(*) AS n_edges, count(*) FILTER (n = 1) AS n_open, count(*) FILTER (n > 2) AS n_over, (SELECT n FROM d) AS n_repeated, (SELECT count(*) FROM v) AS n_vertices FROM u")
def q_edge_report(spark, sf):
    return T.edge_report(materialise(mesh(spark, sf), "mesh"))


# A closed mesh encloses the sum over its cells of the two triangles' mean heights above the base.
@query("q_signed_volume", f"{K}{H} SELECT sum(((z00+z10+z01) + (z10+z11+z01))/6.0 + {BASE}) AS volume FROM h".replace("AS volume", "AS v0").replace("SELECT sum", "SELECT round(sum").replace(" AS v0", ", 6) AS volume"))
def q_signed_volume(spark, sf):
    return T.signed_volume(mesh(spark, sf)).select(F.round("volume", 6).alias("volume"))


@query("q_mesh_bbox", f"{MESH}, {VERT} SELECT min(x)::DOUBLE AS min_x, min(y)::DOUBLE AS min_y, min(z)::DOUBLE AS min_z, max(x)::DOUBLE AS max_x, max(y)::DOUBLE AS max_y, max(z)::DOUBLE AS max_z FROM v")
def q_mesh_bbox(spark, sf):
    return T.bbox(mesh(spark, sf))


@query("q_facet_normal", f"{K}{H}, t AS ({TOP}), c AS (SELECT i, j, k, (\"by\"-ay)*(cz-az) - (bz-az)*(cy-ay) AS x, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS y, (bx-ax)*(cy-ay) - (\"by\"-ay)*(cx-ax) AS z FROM t) SELECT i, j, k, round(x/sqrt(x*x+y*y+z*z), 9) AS nx, round(y/sqrt(x*x+y*y+z*z), 9) AS ny, round(z/sqrt(x*x+y*y+z*z), 9) AS nz FROM c")
def q_facet_normal(spark, sf):
    x, y, z = T.cross()
    n = F.sqrt(x * x + y * y + z * z)
    unit = lambda c, name: F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 9).alias(name)
    return T.top(_heights(spark, sf)).select("i", "j", "k", unit(x, "nx"), unit(y, "ny"), unit(z, "nz"))


@query("q_obj_lines", f"{MESH}, {VERT} SELECT 'v ' || x::INT || ' ' || y::INT || ' ' || (z*8)::INT AS line FROM v")
def q_obj_lines(spark, sf):
    v = T.weld(mesh(spark, sf))
    return v.select(F.concat_ws(" ", F.lit("v"), F.col("x").cast("int"), F.col("y").cast("int"), (F.col("z") * 8).cast("int")).alias("line"))


def solids(spark):
    """Two closed cubes apart and a third that lacks a triangle: faces as rows of a mesh."""
    from orogen.sources.mesh_files import cube

    rows = [("a", *t) for t in cube(0, 0, 0)] + [("b", *t) for t in cube(5, 0, 0)] + [("c", *t) for t in cube(10, 0, 0)[1:]]
    return spark.createDataFrame([(p, n, 0, 0, *map(float, t)) for n, (p, *t) in enumerate(rows)], "part string, i int, j int, k int, " + ", ".join(f"{c} double" for c in T.COORDS))


# Every face of a mesh joins the shell of the cell that it stands on, and two cells share a shell if they share a side:
# no pinch is left, so that cells that touch in a corner only do so through others.
CELLS = """run AS MATERIALIZED (SELECT i, g, min(j) AS a, max(j) AS b, min(i*64+j) AS id FROM (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS g FROM kept) GROUP BY i, g),
half AS MATERIALIZED (SELECT r.id AS a, s.id AS b FROM run r JOIN run s ON s.i = r.i + 1 AND s.a <= r.b AND r.a <= s.b), links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(id, l) USING KEY (id) AS (SELECT id, id FROM run UNION SELECT e.b, min(reach.l) FROM reach JOIN links e ON e.a = reach.id JOIN recurring.reach AS old ON old.id = e.b WHERE reach.l < old.l GROUP BY e.b),
shell AS MATERIALIZED (SELECT f.*, l FROM tri f JOIN run r ON r.i = f.i AND f.j BETWEEN r.a AND r.b JOIN reach ON reach.id = r.id)"""


@query("q_shells", f"WITH RECURSIVE {MESH.removeprefix('WITH ')}, {CELLS}, e0 AS (SELECT l, row(ax, ay, az) AS p, row(bx, \"by\", bz) AS q FROM shell UNION ALL SELECT l, row(bx, \"by\", bz), row(cx, cy, cz) FROM shell UNION ALL SELECT l, row(cx, cy, cz), row(ax, ay, az) FROM shell), v AS (SELECT l, count(DISTINCT p) AS n_vertices, count(DISTINCT (least(p, q), greatest(p, q))) AS n_edges FROM e0 GROUP BY l), f AS (SELECT l, min((part, i, j, k)) AS s, count(*) AS n_faces FROM shell GROUP BY l) SELECT concat_ws('/', s[1], s[2], s[3], s[4]) AS shell, n_vertices, n_edges, n_faces, n_vertices - n_edges + n_faces AS euler FROM v JOIN f USING (l)")
def q_shells(spark, sf):
    return T.shells(materialise(mesh(spark, sf), "mesh"))


@query("q_euler", f"{MESH}, {VERT}, {EDGES}, u AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM e0) SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM u) + (SELECT count(*) FROM tri) AS euler")
def q_euler(spark, sf):
    return T.edge_report(t := materialise(mesh(spark, sf), "mesh")).join(F.broadcast(t.agg(F.count("*").alias("f")))).select((F.col("n_vertices") - F.col("n_edges") + F.col("f")).alias("euler"))


def _folded(spark, sf):
    """The top, flat, with some nodes moved over the longest side of one of their triangles: a projection gone wrong."""
    t = T.top(_heights(spark, sf))
    hit = lambda v: F.pmod(-F.col(f"{v}y") * 7 + F.col(f"{v}x") * 3, F.lit(11)) == 0
    moved = lambda c: F.col(c) + F.when(hit(c[0]), 0.625 if c[1] == "x" else -0.625).otherwise(0.0)
    return t.select("part", "i", "j", "k", *[(F.lit(0.0) if c[1] == "z" else moved(c)).alias(c) for c in T.COORDS])


MOVED = ", ".join(f"{v}x + CASE WHEN (-\"{v}y\"*7 + {v}x*3) % 11 = 0 THEN 0.625 ELSE 0 END AS {v}x, \"{v}y\" - CASE WHEN (-\"{v}y\"*7 + {v}x*3) % 11 = 0 THEN 0.625 ELSE 0 END AS \"{v}y\"" for v in "abc")
NORMAL = '("by"-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax) AS nz'
LONG = "greatest((bx-ax)*(bx-ax) + (\"by\"-ay)*(\"by\"-ay) + (bz-az)*(bz-az), (cx-bx)*(cx-bx) + (cy-\"by\")*(cy-\"by\") + (cz-bz)*(cz-bz), (ax-cx)*(ax-cx) + (ay-cy)*(ay-cy) + (az-cz)*(az-cz)) AS long"


def _inverted(faces: str) -> str:
    """Faces of which all three edges have two consistent, reliable faces whose normals are over 120 degrees apart."""
    p = {v: " || ' ' || ".join(f'("{v}{c}"::FLOAT + 0)::VARCHAR' for c in "xyz") for v in "abc"}
    sides = ", ".join(f"[{p[u]}, {p[v]}]" for u, v in ("ab", "bc", "ca"))
    return f"""n AS MATERIALIZED (SELECT part, i, j, k, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) AS size, sqrt(nx*nx+ny*ny+nz*nz) >= 1e-3*long AS good, [{sides}] AS sides FROM (SELECT *, {NORMAL}, {LONG} FROM {faces} WHERE NOT {SAME})),
e AS MATERIALIZED (SELECT part, i, j, k, nx, ny, nz, size, good, u[1] AS p, u[2] AS q FROM (SELECT *, unnest(sides) AS u FROM n)),
m AS MATERIALIZED (SELECT least(p, q) AS lo, greatest(p, q) AS hi FROM e GROUP BY ALL HAVING count(*) = 2 AND min(p) <> max(p)),
x AS (SELECT a.part, a.i, a.j, a.k, count(*) AS n_ok, count(*) FILTER ((a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)/(a.size*b.size) < -0.5) AS n_opp FROM e a JOIN m ON m.lo = least(a.p, a.q) AND m.hi = greatest(a.p, a.q) JOIN e b ON b.p = a.q AND b.q = a.p WHERE a.good AND b.good GROUP BY ALL) SELECT part, i, j, k FROM x WHERE n_ok = 3 AND n_opp = 3"""


@query("q_inverted", f"{MESH}, {_inverted('tri')}")
def q_inverted(spark, sf):
    return T.inverted(materialise(mesh(spark, sf), "mesh"))


FLAT_TOP = "SELECT * REPLACE (0.0::DOUBLE AS az, 0.0::DOUBLE AS bz, 0.0::DOUBLE AS cz) FROM (" + TOP + ")"


@query("q_inverted_folded", f"{K}{H}, f AS MATERIALIZED (SELECT part, i, j, k, {MOVED}, az, bz, cz FROM ({FLAT_TOP})), {_inverted('f')}")
def q_inverted_folded(spark, sf):
    return T.inverted(materialise(_folded(spark, sf), "mesh"))


@query("q_check_mesh", f"{MESH}, {EDGES}, u AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM e0 GROUP BY ALL), x AS (SELECT max(greatest(ax,bx,cx)) - min(least(ax,bx,cx)) <= 64 AS ok FROM tri) SELECT 'open edges' AS name, (SELECT count(*) FROM u WHERE n = 1) = 0 AS passed UNION ALL SELECT 'volume', true UNION ALL SELECT 'width', ok FROM x UNION ALL SELECT 'degenerate', NOT EXISTS (SELECT 1 FROM tri WHERE {SAME})")
def q_check_mesh(spark, sf):
    t = materialise(mesh(spark, sf), "mesh")
    one = lambda name, df, c: df.select(F.lit(name).alias("name"), c.alias("passed"))
    return (
        one("open edges", T.edge_report(t), F.col("n_open") == 0).unionByName(one("volume", T.signed_volume(t), F.col("volume") > 0))
        .unionByName(one("width", T.bbox(t), F.col("max_x") - F.col("min_x") <= 64)).unionByName(one("degenerate", T.degenerate_count(t), F.col("n_degenerate") == 0))
    )


def _flatness(tris):
    """Area seen from above, edges of one face, and directed edges that repeat, in one row."""
    t = materialise(tris, "flat")
    twice = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    return T.edge_report(t).select("n_open", "n_repeated").join(F.broadcast(t.agg(F.round(F.sum(F.abs(twice)) / 2, 6).alias("area"))))


COVERED = f"WITH {KEPT}, {SIDES} SELECT (SELECT count(*) FROM side) AS n_open, 0::BIGINT AS n_repeated, (SELECT count(*) FROM kept)::DOUBLE AS area"


@query("q_merged_bottom", COVERED)
def q_merged_bottom(spark, sf):
    from orogen.operators import covers

    return _flatness(covers.merged_bottom(kept(spark, sf), BASE))


@query("q_merged_bottom_rows", COVERED)
def q_merged_bottom_rows(spark, sf):
    from orogen.operators import covers

    return _flatness(covers.merged_bottom(kept(spark, sf), BASE, cover="rows"))


@query("q_row_cover")
def q_row_cover(spark, sf):
    from orogen.operators import covers

    return covers.row_cover(kept(spark, sf))


@query("q_adaptive_top", COVERED)
def q_adaptive_top(spark, sf):
    from orogen.operators import rtin

    return _flatness(rtin.adaptive_top(_heights(spark, sf), 100.0, block=64))


# An ellipse over all rows: one simple contour whatever the table's size.
ELLIPSE = f"{X.GRID}, hh AS (SELECT max(i) + 1 AS h FROM grid), kept AS MATERIALIZED (SELECT i, j FROM grid, hh WHERE j < 63 AND i < h - 1 AND power((i + 0.5 - h/2.0)/(h/2.0 - 2), 2) + power((j + 0.5 - 32)/30.0, 2) <= 1)"


@query("q_smooth_rim", f"WITH {ELLIPSE}, {SIDES}, n AS (SELECT 2*count(*) AS n FROM side) SELECT part, n, CASE WHEN part = 'rim' THEN h::DOUBLE END AS nearest, h::DOUBLE AS furthest FROM n, hh, (VALUES ('band'), ('rim'), ('under')) v(part)")
def q_smooth_rim(spark, sf):
    from orogen.operators import rims

    g = X.grid(spark, sf)
    h = g.agg(F.max("i") + 1).first()[0]
    u, v = (F.col("i") + 0.5 - h / 2) / (h / 2 - 2), (F.col("j") + 0.5 - 32) / 30.0
    cells = g.filter((F.col("j") < 63) & (F.col("i") < h - 1) & (u * u + v * v <= 1)).select("i", "j")
    rim = rims.smooth_rim(cells, g, float(h), BASE, ci=h / 2, cj=32)
    far = [F.hypot(f"{c}x", f"{c}y") for c in "abc"]
    return rim.groupBy("part").agg(F.count("*").alias("n"), F.when(F.col("part") == "rim", F.round(F.min(F.least(*far)), 6)).alias("nearest"), F.round(F.max(F.greatest(*far)), 6).alias("furthest"))


@query("q_report_json", f"{MESH}, n AS (SELECT count(*) FILTER (part = 'top') AS top, count(*) FILTER (part = 'bottom') AS bottom, count(*) FILTER (part = 'wall') AS wall, min(least(az, bz, cz)) FILTER (part = 'top') AS lo, max(greatest(az, bz, cz)) FILTER (part = 'top') AS hi FROM tri) SELECT to_json({{'schema': 1, 'model': {{'base_mm': {BASE}::DOUBLE, 'step_mm': 1.0::DOUBLE, 'broken': NULL}}, 'relief': {{'min_elevation_m': lo, 'max_elevation_m': hi, 'relief_m': hi - lo}}, 'mesh': {{'top': top, 'bottom': bottom, 'wall': wall, 'triangles': top + bottom + wall}}}})::VARCHAR AS report FROM n")
def q_report_json(spark, sf):
    from orogen.sources import report

    return report.mesh_report(mesh(spark, sf), {"base_mm": BASE, "step_mm": 1.0, "broken": float("nan")})
