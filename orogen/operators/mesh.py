"""Triangles from kept cells: top, bottom, walls, and the checks of a mesh.

A triangle is a row (part, i, j, k, ax .. cz); k orders the triangles of a cell.  x runs east and y north in millimetres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.operators.graph import connected_components
from orogen.operators.morphology import CORNERS, boundary_edges, spread

COORDS = [f"{v}{c}" for v in "abc" for c in "xyz"]


def corner_heights(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells with the heights of their corners z00, z01, z10, z11 (row, then column)."""
    nodes = spread(cells.select("i", "j", F.col("i").alias("ci"), F.col("j").alias("cj")), CORNERS, "ci", "cj").join(grid.select("i", "j", "z"), ["i", "j"])
    pick = lambda a, b: F.max(F.when((F.col("di") == a) & (F.col("dj") == b), F.col("z"))).alias(f"z{a}{b}")
    return nodes.groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(*[pick(a, b) for a, b in CORNERS])


def _node(a: int, b: int, step: float, z: Column) -> tuple[Column, Column, Column]:
    return (F.col("j") + b) * F.lit(float(step)), -(F.col("i") + a) * F.lit(float(step)), z


def _triangles(cells: DataFrame, part: str, choices: list[tuple[Column, list[list[tuple[Column, Column, Column]]]]], apart: bool = False) -> DataFrame:
    """A row per triangle; choices: condition and the triangles it gives, first match; apart: no two choices share a k."""
    row = lambda k, t: F.struct(F.lit(k).alias("k"), *[v.cast("double").alias(n) for n, v in zip(COORDS, [x for p in t for x in p], strict=True)])
    made = F.coalesce(*[F.when(c, F.array(*[row(k + n * len(ts) * apart, t) for k, t in enumerate(ts)])) for n, (c, ts) in enumerate(choices)])
    return cells.select(F.lit(part).alias("part"), "i", "j", F.explode(made).alias("t")).select("part", "i", "j", "t.*")


def top(cells: DataFrame, adaptive: bool = False, step: float = 1.0) -> DataFrame:
    """Two triangles per cell, facing up; adaptive: cut along the diagonal whose ends differ less in height."""
    n = {(a, b): _node(a, b, step, F.col(f"z{a}{b}")) for a, b in CORNERS}
    anti = [[n[0, 0], n[1, 0], n[0, 1]], [n[1, 0], n[1, 1], n[0, 1]]]
    main = [[n[0, 0], n[1, 0], n[1, 1]], [n[0, 0], n[1, 1], n[0, 1]]]
    if not adaptive:
        return _triangles(cells, "top", [(F.lit(True), anti)])
    return _triangles(cells, "top", [(F.abs(F.col("z00") - F.col("z11")) <= F.abs(F.col("z10") - F.col("z01")), main), (F.lit(True), anti)])


def bottom(cells: DataFrame, base: float, step: float = 1.0) -> DataFrame:
    """Two triangles per cell at -base, facing down."""
    n = {(a, b): _node(a, b, step, F.lit(-float(base))) for a, b in CORNERS}
    return _triangles(cells, "bottom", [(F.lit(True), [[n[0, 0], n[0, 1], n[1, 0]], [n[1, 0], n[0, 1], n[1, 1]]])])


def walls(cells: DataFrame, heights: DataFrame, base: float, step: float = 1.0) -> DataFrame:
    """Two triangles per boundary side from the top down to -base, facing out; k tells the sides of a cell apart."""
    sides = boundary_edges(cells).join(heights, ["i", "j"])
    ends = {"n": ((0, 1), (0, 0)), "w": ((0, 0), (1, 0)), "s": ((1, 0), (1, 1)), "e": ((1, 1), (0, 1))}

    def side(p, q):
        (a, b), (c, d) = p, q
        tp, tq = _node(a, b, step, F.col(f"z{a}{b}")), _node(c, d, step, F.col(f"z{c}{d}"))
        bp, bq = _node(a, b, step, F.lit(-float(base))), _node(c, d, step, F.lit(-float(base)))
        return [[tp, bq, bp], [tp, tq, bq]]

    # Seen from outside, the top edge of the cell's own triangles runs from q to p; the wall takes it the other way.
    return _triangles(sides, "wall", [(F.col("side") == s, side(q, p)) for s, (p, q) in ends.items()], apart=True)


def build(cells: DataFrame, grid: DataFrame, base: float, step: float = 1.0, adaptive: bool = False) -> DataFrame:
    """The closed mesh.  Cells with a corner without data are refused: an error when the mesh is made."""
    h = corner_heights(cells, grid)
    known = F.assert_true(F.col("z00").isNotNull() & F.col("z01").isNotNull() & F.col("z10").isNotNull() & F.col("z11").isNotNull(), "a kept cell touches a node without data").isNull()
    h = h.filter(known)
    return top(h, adaptive, step).unionByName(bottom(cells, base, step)).unionByName(walls(cells, h, base, step))


def _point(v: str) -> Column:
    return F.struct(*[F.col(f"{v}{c}").cast("float").alias(c) for c in "xyz"])


def degenerate() -> Column:
    """Two corners equal in single precision."""
    a, b, c = map(_point, "abc")
    return (a == b) | (b == c) | (c == a)


def drop_degenerate(tris: DataFrame) -> DataFrame:
    return tris.filter(~degenerate())


def cross() -> tuple[Column, Column, Column]:
    u = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    v = {c: F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"}
    return u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]


def signed_volume(tris: DataFrame) -> DataFrame:
    a, b, c = ({k: F.col(f"{v}{k}") for k in "xyz"} for v in "abc")
    det = a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) + a["y"] * (b["z"] * c["x"] - b["x"] * c["z"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])
    return tris.agg((F.sum(det) / 6.0).alias("volume"))


def degenerate_count(tris: DataFrame) -> DataFrame:
    x, y, z = cross()
    return tris.agg(F.count_if(degenerate() | ((x == 0) & (y == 0) & (z == 0))).alias("n_degenerate"))


def bbox(tris: DataFrame) -> DataFrame:
    low = lambda c: F.min(F.least(*[F.col(f"{v}{c}") for v in "abc"])).alias(f"min_{c}")
    high = lambda c: F.max(F.greatest(*[F.col(f"{v}{c}") for v in "abc"])).alias(f"max_{c}")
    return tris.agg(*[f(c) for f in (low, high) for c in "xyz"])


def weld(tris: DataFrame) -> DataFrame:
    """(x, y, z): the distinct single-precision vertices; -0 is 0."""
    p = F.explode(F.array(*map(_point, "abc")))
    return tris.select(p.alias("p")).select(*[(F.col(f"p.{c}") + F.lit(0.0).cast("float")).alias(c) for c in "xyz"]).distinct()


def directed_edges(tris: DataFrame) -> DataFrame:
    """(face, p, q) of non-degenerate faces; vertices as structs in single precision."""
    t = drop_degenerate(tris)
    e = F.explode(F.array(*[F.struct(_point(a).alias("p"), _point(b).alias("q")) for a, b in ("ab", "bc", "ca")]))
    return t.select(F.struct("part", "i", "j", "k").alias("face"), e.alias("e")).select("face", "e.p", "e.q")


def edge_report(tris: DataFrame) -> DataFrame:
    """Vertices, edges, edges of one face, edges of more than two, directed edges that repeat: the last three are 0 for a closed mesh."""
    e = directed_edges(tris)
    both = e.groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.count("*").alias("n"), F.count_if(F.col("p") < F.col("q")).alias("up"))
    found = both.agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("n") == 1).alias("n_open"), F.count_if(F.col("n") > 2).alias("n_over"),
        F.coalesce(F.sum((F.col("up") > 1).cast("int") + (F.col("n") - F.col("up") > 1).cast("int")), F.lit(0)).cast("long").alias("n_repeated"),
    )
    return found.join(F.broadcast(weld(tris).agg(F.count("*").alias("n_vertices"))))


def shells(tris: DataFrame) -> DataFrame:
    """(shell, n_vertices, n_edges, n_faces, euler): components of faces joined by an edge; a shell is named by its first face."""
    e = directed_edges(tris).withColumn("f", F.xxhash64("face"))
    keyed = e.withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q"))
    hub = keyed.groupBy("lo", "hi").agg(F.min("f").alias("a"))
    links = keyed.join(hub, ["lo", "hi"]).select("a", F.col("f").alias("b")).distinct()
    of = connected_components(links)
    rows = keyed.join(of, keyed["f"] == of["node"]).select("component", "face", "f", "p", "lo", "hi")
    counts = rows.groupBy("component").agg(F.min("face").alias("shell"), F.countDistinct("p").alias("n_vertices"), F.countDistinct("lo", "hi").alias("n_edges"), F.countDistinct("f").alias("n_faces"))
    return counts.select(F.concat_ws("/", "shell.part", F.col("shell.i"), F.col("shell.j"), F.col("shell.k")).alias("shell"), "n_vertices", "n_edges", "n_faces", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"))


def inverted(tris: DataFrame, quality: float = 1e-3, oppose: float = -0.5) -> DataFrame:
    """Faces whose normal opposes those of all three neighbours.

    All three edges must have two faces that run along them in opposite ways, and neither the face nor its neighbours
    may be slivers, whose normals mean little.
    """
    x, y, z = cross()
    area2 = F.sqrt(x * x + y * y + z * z)
    side = lambda a, b: sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))
    good = area2 >= quality * F.greatest(side("a", "b"), side("b", "c"), side("c", "a"))
    t = drop_degenerate(tris).withColumn("n", F.array(x / area2, y / area2, z / area2)).withColumn("good", good)
    e = F.explode(F.array(*[F.struct(_point(a).alias("p"), _point(b).alias("q")) for a, b in ("ab", "bc", "ca")]))
    e = t.select(F.struct("part", "i", "j", "k").alias("face"), "n", "good", e.alias("e")).select("face", "n", "good", "e.p", "e.q")
    single = e.groupBy("p", "q").agg(F.count("*").alias("m"), F.first("face").alias("face2"), F.first("n").alias("n2"), F.first("good").alias("good2")).filter("m = 1")
    other = single.select(F.col("q").alias("p"), F.col("p").alias("q"), "face2", "n2", "good2")
    pairs = e.join(single.select("p", "q"), ["p", "q"]).join(other, ["p", "q"])
    dot = sum((F.get("n", F.lit(k)) * F.get("n2", F.lit(k)) for k in range(3)), F.lit(0.0))
    hit = pairs.filter("good and good2").groupBy("face").agg(F.count_if(dot < oppose).alias("m")).filter("m = 3")
    return hit.select("face.part", "face.i", "face.j", "face.k")
