"""Masks as sets of nodes or cells (i, j): neighbourhood joins, boundaries, components and quadtrees.

A neighbourhood is an explode of fixed offsets and a group-by on the cell, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.operators.graph import connected_components
from orogen.shared import materialise

NINE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
EIGHT = [o for o in NINE if o != (0, 0)]
CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def spread(cells: DataFrame, offsets: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Every cell moved by every offset; di and dj tell by which."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in offsets]))
    return cells.select("i", "j", *keep, o.alias("o")).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), *keep, "o.di", "o.dj")


def erode(mask: DataFrame) -> DataFrame:
    """Nodes whose whole 3x3 neighbourhood is set; outside counts as unset."""
    return spread(mask, NINE).groupBy("i", "j").count().filter("count = 9").select("i", "j")


def dilate(mask: DataFrame, height: Column | int, width: int) -> DataFrame:
    """Nodes with a set node in their 3x3 neighbourhood, within the grid."""
    inside = (F.col("i") >= 0) & (F.col("i") < height) & (F.col("j") >= 0) & (F.col("j") < width)
    return spread(mask, NINE).filter(inside).select("i", "j").distinct()


def opened(mask: DataFrame, height: int, width: int) -> DataFrame:
    return dilate(erode(mask), height, width)


def quads(nodes: DataFrame) -> DataFrame:
    """Cells whose four corner nodes are set."""
    return spread(nodes, [(-a, -b) for a, b in CORNERS]).groupBy("i", "j").count().filter("count = 4").select("i", "j")


def touched_nodes(cells: DataFrame) -> DataFrame:
    return spread(cells, CORNERS).select("i", "j").distinct()


def boundary_edges(cells: DataFrame) -> DataFrame:
    """(i, j, side) of cell sides that no other cell shares: n, s, w or e."""
    sides = {"n": (0, 0, "h"), "s": (1, 0, "h"), "w": (0, 0, "v"), "e": (0, 1, "v")}
    e = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(k).alias("kind")) for s, (a, b, k) in sides.items()]))
    edges = cells.select("i", "j", e.alias("e")).select("i", "j", "e.side", (F.col("i") + F.col("e.di")).alias("ei"), (F.col("j") + F.col("e.dj")).alias("ej"), "e.kind")
    one = edges.groupBy("ei", "ej", "kind").agg(F.count("*").alias("n"), F.min(F.struct("i", "j", "side")).alias("c"))
    return one.filter("n = 1").select("c.i", "c.j", "c.side")


def directed_boundary(cells: DataFrame) -> DataFrame:
    """(ai, aj, bi, bj): boundary edges as node pairs with the cell on the right of the way, seen with j east and i south."""
    i, j = F.col("i"), F.col("j")
    ends = {"n": (0, 0, 0, 1), "e": (0, 1, 1, 1), "s": (1, 1, 1, 0), "w": (1, 0, 0, 0)}
    pick = lambda k: F.coalesce(*[F.when(F.col("side") == s, F.lit(o[k])) for s, o in ends.items()])
    return boundary_edges(cells).select((i + pick(0)).alias("ai"), (j + pick(1)).alias("aj"), (i + pick(2)).alias("bi"), (j + pick(3)).alias("bj"))


def boundary_degree(cells: DataFrame) -> DataFrame:
    """How many boundary nodes have which number of boundary edges; only 2 lets a single loop be traced."""
    e = directed_boundary(cells)
    nodes = e.select(F.col("ai").alias("i"), F.col("aj").alias("j")).unionByName(e.select(F.col("bi").alias("i"), F.col("bj").alias("j")))
    return nodes.groupBy("i", "j").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def pinch_cells(cells: DataFrame) -> DataFrame:
    """Cells missing from a 2x2 block of which exactly the two on a diagonal are set."""
    block = spread(cells, [(-a, -b) for a, b in CORNERS]).groupBy("i", "j").agg(F.sum(F.when(F.col("di") == F.col("dj"), F.when(F.col("di") == 0, 1).otherwise(8)).otherwise(F.when(F.col("di") == 0, 2).otherwise(4))).alias("m"))
    fill = F.when(F.col("m") == 9, F.array(F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")))).when(
        F.col("m") == 6, F.array(F.struct(F.lit(0).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(1).alias("dj")))
    )
    return block.select("i", "j", F.explode(fill).alias("f")).select((F.col("i") + F.col("f.di")).alias("i"), (F.col("j") + F.col("f.dj")).alias("j")).distinct()


def fix_pinches(cells: DataFrame) -> DataFrame:
    """Both missing cells of every diagonal pinch are filled, in simultaneous passes until there is none."""
    cells = materialise(cells, "pinch")
    while not (new := materialise(pinch_cells(cells), "pinch")).isEmpty():
        cells = materialise(cells.unionByName(new).distinct(), "pinch")
    return cells


def clean_mask(nodes: DataFrame, height: int, width: int) -> DataFrame:
    """Nodes -> kept cells: opening, cells with four nodes, pinches filled."""
    return fix_pinches(quads(opened(nodes, height, width)))


def components(nodes: DataFrame, width: int) -> DataFrame:
    """(i, j, component) of the 8-connected components; a component is named by its smallest i * width + j.

    Rows become runs first: the graph is over runs that touch, far smaller than over nodes, and long runs cost nothing.
    """
    w = Window.partitionBy("i").orderBy("j")
    runs = nodes.withColumn("g", F.col("j") - F.row_number().over(w))
    of = materialise(runs.withColumn("run", F.col("i") * width + F.min("j").over(Window.partitionBy("i", "g"))).select("i", "j", "run"), "runs")
    ends = of.groupBy("i", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    # Runs of neighbouring rows touch if a node of one lies within one step of the other: an equi-join on reachable nodes.
    below = spread(of.select("i", "j", "run"), [(1, -1), (1, 0), (1, 1)], "run").select("i", "j", F.col("run").alias("up")).distinct()
    links = below.join(of, ["i", "j"]).select(F.col("up").alias("a"), F.col("run").alias("b")).distinct()
    names = connected_components(links.unionByName(ends.select(F.col("run").alias("a"), F.col("run").alias("b"))))
    return of.join(names, of["run"] == names["node"]).select("i", "j", "component")


def largest_component(labelled: DataFrame) -> DataFrame:
    """The nodes of the component with the most nodes; of equal ones the first named."""
    best = labelled.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return labelled.join(F.broadcast(best.select("component")), "component", "left_semi").select("i", "j")


def required_nodes(cells: DataFrame) -> DataFrame:
    """Nodes of kept cells that miss one of their four cells."""
    return spread(cells, CORNERS).groupBy("i", "j").count().filter("count < 4").select("i", "j")


def quadtree(cells: DataFrame, levels: int = 6) -> DataFrame:
    """(level, i, j): the largest aligned full squares that cover the cells, side 2**level."""
    found = cells.select(F.lit(0).alias("level"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    full = found
    out = None
    for k in range(1, levels + 1):
        up = full.groupBy(F.shiftright("i", 1).alias("pi"), F.shiftright("j", 1).alias("pj")).count().filter("count = 4").select("pi", "pj")
        alone = full.join(up, (F.shiftright(full["i"], 1) == up["pi"]) & (F.shiftright(full["j"], 1) == up["pj"]), "left_anti")
        out = alone if out is None else out.unionByName(alone)
        full = up.select(F.lit(k).alias("level"), F.col("pi").alias("i"), F.col("pj").alias("j"))
    return out.unionByName(full)


def balanced(leaves: DataFrame, levels: int = 6) -> DataFrame:
    """Leaves split until side-by-side leaves differ by one level at most."""
    leaves = materialise(leaves, "quadtree")
    while True:
        # A leaf must be split if a leaf two or more levels smaller lies across one of its sides.
        small = leaves.filter(F.col("level") < levels - 1)
        steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
        near = small.select("level", steps.alias("s"), "i", "j").select("level", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
        up = near.select(F.explode(F.sequence(F.col("level") + 2, F.lit(levels))).alias("to"), "level", "i", "j")
        cell = lambda c: F.call_function("shiftright", F.col(c), F.col("to") - F.col("level"))
        hit = up.select(F.col("to").alias("level"), cell("i").alias("i"), cell("j").alias("j")).distinct()
        split = materialise(leaves.join(hit, ["level", "i", "j"], "left_semi"), "quadtree")
        if split.isEmpty():
            return leaves
        kids = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CORNERS]))
        parts = split.select("level", "i", "j", kids.alias("k")).select((F.col("level") - 1).alias("level"), (F.col("i") * 2 + F.col("k.a")).alias("i"), (F.col("j") * 2 + F.col("k.b")).alias("j"))
        leaves = materialise(leaves.join(split, ["level", "i", "j"], "left_anti").unionByName(parts), "quadtree")
