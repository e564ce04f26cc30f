"""Boundary loops in order, and rims that lead a stepped boundary out to a circle or another convex outline.

Loops are put in order by pointer doubling: after k rounds a node knows the smallest node among the next 2**k and how far it
is, so that a loop of n nodes takes log2(n) rounds whatever its shape, and no task holds a loop.  A rim belongs to a mask
with one simple loop, whose length is the mask's perimeter; only the outline rim, whose heights follow the angle around
the whole loop, puts that loop into one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.operators.mesh import COORDS, drop_degenerate
from orogen.operators.morphology import directed_boundary
from orogen.operators.shapes import RoundedPolygon
from orogen.shared import materialise

SAME_PLACE = 1e-9


def _id(i: str, j: str) -> Column:
    return F.shiftleft(F.col(i).cast("long"), 32) + F.col(j).cast("long")


def boundary_loops(cells: DataFrame) -> DataFrame:
    """(loop, n, pos, i, j): the nodes of every boundary loop, clockwise about the cells, from its smallest node on.

    A loop is named by its smallest node (i * 2**32 + j).  A node with more than two boundary edges is an error.
    """
    e = directed_boundary(cells).select(_id("ai", "aj").alias("node"), _id("bi", "bj").alias("jump"))
    e = materialise(e, "boundary")
    single = F.assert_true(F.col("count") == 1, "a boundary node has more than two boundary edges: the contour isn't simple")
    if e.groupBy("node").count().filter(single.isNull()).isEmpty():
        return e.select(*[F.col("node").alias(c) for c in ("loop", "n", "pos", "i", "j")]).limit(0)
    state = e.select("node", "jump", F.col("node").alias("best"), F.lit(0).cast("long").alias("dist"))
    size = 1
    while True:
        other = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("best").alias("best2"), F.col("dist").alias("dist2"))
        closer = F.col("best2") < F.col("best")
        step = state.join(other, "jump").select("node", F.col("jump2").alias("jump"), F.least("best", "best2").alias("best"), F.when(closer, F.col("dist2") + size).otherwise(F.col("dist")).alias("dist"), closer.alias("new"))
        state = materialise(step, "loops")
        if state.filter("new").isEmpty():  # if no window gained by its double, every window holds its whole loop
            break
        state, size = state.drop("new"), 2 * size
    n = state.groupBy("best").agg(F.count("*").alias("n"))
    return state.join(n, "best").select(F.col("best").alias("loop"), "n", F.pmod(F.col("n") - F.col("dist"), F.col("n")).alias("pos"), F.shiftright("node", 32).alias("i"), F.col("node").bitwiseAND(F.lit((1 << 32) - 1)).alias("j"))


def _only_loop(cells: DataFrame) -> DataFrame:
    loops = materialise(boundary_loops(cells), "loop")
    n = loops.select("loop").distinct().count()
    if n != 1:
        raise ValueError(f"a rim needs one simple contour, not {n}")
    return loops


def _placed(loop: DataFrame, grid: DataFrame, step: float, ci: float, cj: float) -> DataFrame:
    """The loop's nodes as (pos, x, y, z), the centre in the origin."""
    z = grid.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "z")
    return loop.join(z, ["i", "j"]).select("pos", ((F.col("j") - F.lit(float(cj))) * step).alias("x"), ((F.lit(float(ci)) - F.col("i")) * step).alias("y"), "z")


def _around(order: Window, c: str) -> Column:
    """The next node's value; the last node's next is the first."""
    return F.coalesce(F.lead(c).over(order), F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _triangle(k: Column, *points: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), *[p[c].cast("double").alias(n) for n, (p, c) in zip(COORDS, [(p, c) for p in points for c in "xyz"], strict=True)])


def _down(p: Column, base: float) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(-float(base)).alias("z"))


def _fans(links: DataFrame, base: float) -> DataFrame:
    """Rim triangles of rows (pos, a, b, chain): boundary nodes in clockwise order and the outline's points between theirs."""
    a, b, chain = F.col("a"), F.col("b"), F.col("chain")
    ab, bb = _down(a, base), _down(b, base)
    first = F.get(chain, F.lit(0))
    pairs = F.sequence(F.lit(0), F.size(chain) - 2)
    q, r = (lambda k: F.get(chain, k)), (lambda k: F.get(chain, k + 1))
    down = lambda p: _down(p, base)
    band = F.concat(F.array(_triangle(F.lit(0), a, b, first)), F.transform(pairs, lambda k: _triangle(k + 1, b, r(k), q(k))))
    wall = F.concat(F.transform(pairs, lambda k: _triangle(2 * k, q(k), r(k), down(q(k)))), F.transform(pairs, lambda k: _triangle(2 * k + 1, r(k), down(r(k)), down(q(k)))))
    under = F.concat(F.array(_triangle(F.lit(0), bb, ab, down(first))), F.transform(pairs, lambda k: _triangle(k + 1, down(r(k)), bb, down(q(k)))))
    parts = [links.select(F.lit(name).alias("part"), F.col("pos").alias("i"), F.lit(0).cast("long").alias("j"), F.explode(t).alias("t")).select("part", "i", "j", "t.*") for name, t in (("band", band), ("rim", wall), ("under", under))]
    return drop_degenerate(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def smooth_rim(cells: DataFrame, grid: DataFrame, radius: float, base: float, step: float = 1.0, ci: float = 0.0, cj: float = 0.0) -> DataFrame:
    """Triangles (part, i, j, k, ax .. cz) between the stepped boundary and a circle: a band at the nodes' heights, a wall
    down from the circle, and a flat band at -base.  They take the place of the walls; i is the place in the loop."""
    p = _placed(_only_loop(cells), grid, step, ci, cj)
    r = F.hypot("x", "y")
    out = F.when(r < SAME_PLACE, 0.0).otherwise(F.lit(float(radius)) / r)
    p = p.withColumn("p", _point(F.col("x"), F.col("y"), F.col("z"))).withColumn("q", _point(F.col("x") * out, F.col("y") * out, F.col("z")))
    order = Window.orderBy("pos")
    return _fans(p.select("pos", F.col("p").alias("a"), _around(order, "p").alias("b"), F.array("q", _around(order, "q")).alias("chain")), base)


def outline_rim(cells: DataFrame, grid: DataFrame, shape: RoundedPolygon, base: float, step: float = 1.0, ci: float = 0.0, cj: float = 0.0, tolerance: float = 0.01, merge: float = 1e-4) -> DataFrame:
    """As ``smooth_rim`` for a regular polygon: nodes go to the nearest point of its outline, and its own vertices are put in.

    Neighbours that go to the same point share their mean height.  A vertex of the outline takes its height from the two
    nodes between whose angles it lies; one within ``merge`` of the line between them is left out.
    """
    order, whole = Window.orderBy("pos"), Window.partitionBy()
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = _placed(_only_loop(cells), grid, step, ci, cj)
    px, py = shape.project(F.col("x"), F.col("y"))
    p = p.withColumn("px", px).withColumn("py", py)
    still = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= SAME_PLACE
    p = p.withColumn("px", F.when(still, F.col("x")).otherwise(F.col("px"))).withColumn("py", F.when(still, F.col("y")).otherwise(F.col("py")))
    p = p.withColumn("same", F.hypot(F.col("px") - _around(order, "px"), F.col("py") - _around(order, "py")) <= SAME_PLACE)
    p = p.withColumn("joined", F.coalesce(F.lag("same").over(order), F.last("same").over(full)))
    p = p.withColumn("g", F.sum((~F.col("joined")).cast("int")).over(order)).withColumn("g", F.when(F.col("g") == 0, F.max("g").over(full)).otherwise(F.col("g")) + 0)
    start = F.min_by(F.struct("px", "py"), F.struct("joined", "pos")).over(Window.partitionBy("g"))
    p = p.withColumn("at", start).withColumn("pz", F.avg("z").over(Window.partitionBy("g"))).select("pos", "x", "y", "z", F.col("at.px").alias("px"), F.col("at.py").alias("py"), "pz")
    turn = F.atan2(F.col("py"), F.col("px"))
    p = p.withColumn("psi", turn)
    ahead = -(F.pmod(_around(order, "psi") - F.col("psi") + math.pi, F.lit(2 * math.pi)) - math.pi)
    p = materialise(p.withColumn("ahead", F.greatest(ahead, F.lit(0.0))), "rim")
    sums = p.agg(F.sum("ahead").alias("total"), F.min_by("psi", "pos").alias("psi0")).first()
    if not sums["total"] or sums["total"] < 1e-9:
        raise ValueError("the contour doesn't go around the outline's centre")
    before = F.coalesce(F.sum("ahead").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.withColumn("s", before * (2 * math.pi / sums["total"])).withColumn("p", _point(F.col("x"), F.col("y"), F.col("z"))).withColumn("q", _point(F.col("px"), F.col("py"), F.col("pz")))
    p = p.withColumn("to", F.coalesce(F.lead("s").over(order), F.lit(2 * math.pi)))
    links = materialise(p.select("pos", "s", "to", F.col("p").alias("a"), _around(order, "p").alias("b"), "q", _around(order, "q").alias("r")), "rim")
    own = shape.outline(cells.sparkSession, tolerance=tolerance).select("x", "y", F.pmod(F.lit(sums["psi0"]) - F.atan2("y", "x"), F.lit(2 * math.pi)).alias("t"))
    both = links.select("pos", F.col("s").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).unionByName(own.select(F.lit(None).cast("long").alias("pos"), "t", F.lit(1).alias("kind"), "x", "y"))
    asof = F.last("pos", ignorenulls=True).over(Window.orderBy("t", "kind", "pos"))
    between = both.withColumn("pos", F.when(F.col("kind") == 0, F.col("pos")).otherwise(asof)).filter("kind = 1").select("pos", "t", F.col("x").alias("ex"), F.col("y").alias("ey")).join(links, "pos")
    dx, dy = F.col("r.x") - F.col("q.x"), F.col("r.y") - F.col("q.y")
    along = F.least(F.greatest(F.coalesce(F.try_divide((F.col("ex") - F.col("q.x")) * dx + (F.col("ey") - F.col("q.y")) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    off = F.hypot(F.col("ex") - F.col("q.x") - along * dx, F.col("ey") - F.col("q.y") - along * dy)
    share = F.coalesce(F.try_divide(F.col("t") - F.col("s"), F.col("to") - F.col("s")), F.lit(0.0))
    vertex = _point(F.col("ex"), F.col("ey"), F.col("q.z") + (F.col("r.z") - F.col("q.z")) * share)
    extra = between.filter(off > merge).groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("t", vertex.alias("v")))).alias("extra"))
    none = F.expr("cast(array() as array<struct<x:double,y:double,z:double>>)")
    links = links.join(extra, "pos", "left").withColumn("chain", F.concat(F.array("q"), F.coalesce(F.transform("extra", lambda v: v["v"]), none), F.array("r")))
    return split_slivers(_fans(links.select("pos", "a", "b", "chain"), base))


def split_slivers(tris: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Triangles without area but with three distinct corners in a line are taken out without opening the mesh.

    The neighbour across the longest side is cut at the corner in between.  A sliver whose neighbour is missing, flat itself
    or cut for another sliver stays.  Neighbours are sought within a part.
    """
    t = materialise(tris.withColumn("id", F.monotonically_increasing_id()), "slivers")
    corner = {v: F.struct(*[(F.col(f"{v}{c}") + 0.0).alias(c) for c in "xyz"]) for v in "abc"}
    span = lambda u, v: sum(((F.col(f"{v}{c}") - F.col(f"{u}{c}")) * (F.col(f"{v}{c}") - F.col(f"{u}{c}")) for c in "xyz"), F.lit(0.0))
    sides = [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    lengths = [span(u, v) for u, v, _ in sides]
    ux, uy, uz = (F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    vx, vy, vz = (F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz")
    area = F.sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2)
    longest = F.greatest(*lengths)
    flat = (area <= tolerance * longest) & (F.least(*lengths) > 0)
    t = t.withColumn("flat", flat)
    edge = F.explode(F.array(*[F.struct(corner[u].alias("u"), corner[v].alias("v"), corner[w].alias("w"), n.alias("n")) for (u, v, w), n in zip(sides, lengths, strict=True)])).alias("e")
    edges = t.select("part", "id", "flat", longest.alias("longest"), edge).select("part", "id", "flat", "longest", "e.*")
    slivers = edges.filter(F.col("flat") & (F.col("n") == F.col("longest"))).groupBy("part", "id").agg(F.min(F.struct("u", "v", "w")).alias("s")).select("part", F.col("id").alias("sliver"), F.col("s.v").alias("u"), F.col("s.u").alias("v"), F.col("s.w").alias("m"))
    found = edges.filter(~F.col("flat")).join(slivers, ["part", "u", "v"])
    taken = materialise(found.groupBy("id").agg(F.min(F.struct("sliver", "u", "v", "w", "m")).alias("f")), "slivers")
    f = lambda c: F.col(f"f.{c}")
    names = [c for c in tris.columns if c not in COORDS]
    row = lambda k, p, q, r: F.struct(F.lit(k).alias("half"), *[x[c].alias(n) for n, (x, c) in zip(COORDS, [(x, c) for x in (p, q, r) for c in "xyz"], strict=True)])
    halves = F.explode(F.array(row(0, f("u"), f("m"), f("w")), row(1, f("m"), f("v"), f("w")))).alias("h")
    last = t.agg(F.max("k")).first()[0] or 0
    new = t.join(taken, "id").select(*[n for n in names if n != "k"], F.col("k"), halves).select(*[n for n in names if n != "k"], (F.col("k") + F.col("h.half") * (last + 1)).cast("int").alias("k"), *[f"h.{c}" for c in COORDS])
    gone = taken.select("id").unionByName(taken.select(f("sliver").alias("id")))
    return t.join(gone, "id", "left_anti").select(tris.columns).unionByName(new.select(tris.columns))
