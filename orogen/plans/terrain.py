"""Queries over points, rasters and masks, each with an independently written SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from orogen.operators import grid as G
from orogen.operators import morphology as M
from orogen.operators import points as P
from orogen.operators import resample as RS
from orogen.plans import fixtures as X
from orogen.plans.registry import query

ALL = P.Window(0.0, 64.0, 1.0, 64, 64)
SOUTH_EAST = P.Window(20.0, 40.0, 2.0, 12, 10)
PIX = "floor(x)::BIGINT AS ix, (floor(64.0-y))::BIGINT AS iy"
OK = "NOT withheld AND cls NOT IN (7,18)"
W = f"WITH {X.POINTS} "
INSIDE = "x >= 0 AND x <= 64 AND y >= 0 AND y <= 64 AND floor(x) BETWEEN 0 AND 63 AND floor(64.0-y) BETWEEN 0 AND 63"


@query("q_cell_key", W + f"SELECT x, y, {PIX} FROM points")
def q_cell_key(spark, sf):
    return X.points(spark, sf).select("x", "y", ALL.ix.alias("ix"), ALL.iy.alias("iy"))


@query("q_point_filter", W + f"SELECT x, y, z, cls FROM points WHERE {OK} AND cls = 2")
def q_point_filter(spark, sf):
    return X.points(spark, sf).filter(P.usable("ground")).select("x", "y", "z", "cls")


@query("q_dedup_points", W + "SELECT DISTINCT x, y, z FROM points")
def q_dedup_points(spark, sf):
    p = X.points(spark, sf)
    return P.distinct_points(p.unionByName(p.filter("line = 1")).select("x", "y", "z"))


def _cells(agg: str, more: str) -> str:
    return W + f"SELECT iy, ix, {agg} AS z, count(*) AS n FROM (SELECT DISTINCT x, y, z, {PIX} FROM points WHERE {INSIDE} AND {OK} {more}) GROUP BY iy, ix"


@query("q_grid_mean", _cells("avg(z)", "AND cls = 2"))
def q_grid_mean(spark, sf):
    return P.grid_points(X.points(spark, sf), ALL, "ground")


@query("q_grid_min", _cells("min(z)", ""))
def q_grid_min(spark, sf):
    return P.grid_points(X.points(spark, sf), ALL, "lowest")


@query("q_grid_max", _cells("max(z)", ""))
def q_grid_max(spark, sf):
    return P.grid_points(X.points(spark, sf), ALL, "highest")


@query("q_top_classes", W + "SELECT cls, count(*) AS n FROM points GROUP BY cls ORDER BY n DESC, cls LIMIT 3")
def q_top_classes(spark, sf):
    return P.top_classes(X.points(spark, sf), 3)


SE = "x BETWEEN 20 AND 44 AND y BETWEEN 20 AND 40 AND floor((x-20)/2) BETWEEN 0 AND 11 AND floor((40-y)/2) BETWEEN 0 AND 9"


@query("q_scan_stats", W + f""", p AS (SELECT *, {SE} AS w, {OK} AS ok FROM points), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT x, y, z FROM p WHERE w AND ok))
SELECT count(*) AS n_read, count(*) FILTER (w) AS n_in_window, count(*) FILTER (w AND NOT ok) AS n_dropped, (SELECT n FROM d) AS n_used, count(*) FILTER (w AND ok) - (SELECT n FROM d) AS n_duplicates FROM p""")
def q_scan_stats(spark, sf):
    return P.scan_stats(X.points(spark, sf), SOUTH_EAST, "all")


@query("q_density", W + f", c AS (SELECT iy, ix, count(*) AS n FROM (SELECT DISTINCT x, y, z, {PIX} FROM points WHERE {INSIDE} AND {OK} AND cls = 2) GROUP BY iy, ix) SELECT count(*) AS occupied, count(*)/4096.0::DOUBLE AS share, sum(n)::DOUBLE/4096.0::DOUBLE AS density, count(*)*2 < 4096 AS sparse FROM c")
def q_density(spark, sf):
    return P.density(P.grid_points(X.points(spark, sf), ALL, "ground"), ALL)


@query("q_file_pruning", W + ", q AS (SELECT * FROM points WHERE x < 8 * file + 12), b AS (SELECT file, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM q GROUP BY file) SELECT * FROM b WHERE NOT (x0 > 44 OR x1 < 20 OR y0 > 40 OR y1 < 20)")
def q_file_pruning(spark, sf):
    return P.prune_files(X.points(spark, sf).filter(F.col("x") < 8 * F.col("file") + 12), SOUTH_EAST)


R = f"WITH {X.RASTER} "
DISC = "(i%64-30.5)*(i%64-30.5) + (j-31.5)*(j-31.5) <= 400.0"


def zone(radius: float = 20.0):
    """A disc in every 64 rows, so that the zone grows with the grid."""
    return G.disc(30.5, 31.5, radius, rows=64)


@query("q_disc_mask", R + f"SELECT i, j FROM raster WHERE {DISC}")
def q_disc_mask(spark, sf):
    return X.raster(spark, sf).filter(zone()).select("i", "j")


@query("q_plausible", R + "SELECT i, j, z FROM raster WHERE z > 480.5")
def q_plausible(spark, sf):
    return X.raster(spark, sf).filter(G.plausible(480.5))


@query("q_sentinel_null", R + "SELECT i, j, CASE WHEN r < -9000 OR r > 100000 THEN NULL ELSE r END AS z FROM (SELECT i, j, CASE WHEN j % 9 = 0 THEN -9999.0 WHEN j % 10 = 0 THEN 1e6 ELSE z END::DOUBLE AS r FROM raster)")
def q_sentinel_null(spark, sf):
    from orogen.functions.elevation import sentinel_to_null

    raw = F.when(F.col("j") % 9 == 0, -9999.0).when(F.col("j") % 10 == 0, 1e6).otherwise(F.col("z"))
    return X.raster(spark, sf).select("i", "j", sentinel_to_null(raw).alias("z"))


@query("q_valid_stats", R + "SELECT coalesce(bool_or(z IS NOT NULL), false) AS any_valid, coalesce(bool_and(z = 0), false) AS all_zero FROM raster")
def q_valid_stats(spark, sf):
    return G.valid_stats(X.raster(spark, sf))


@query("q_disc_coverage", R + f"SELECT avg(CASE WHEN z IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE) AS coverage FROM raster WHERE {DISC}")
def q_disc_coverage(spark, sf):
    return G.disc_coverage(X.raster(spark, sf), zone())


@query("q_zone_counts", R + f"SELECT count(*) AS n_zone, count(*) FILTER (z IS NULL) AS n_missing, count(*) FILTER (z <= 480.5) AS n_low, count(*) FILTER (z > 480.5) AS n_kept FROM raster WHERE {DISC}")
def q_zone_counts(spark, sf):
    return G.zone_counts(X.raster(spark, sf), zone(), 480.5)


SPIKED = R + ", spiked AS (SELECT i, j, CASE (i*7+j*3) % 97 WHEN 0 THEN z + 900 WHEN 50 THEN z - 900 ELSE z END AS z FROM raster)"
NEAR = f"near AS (SELECT a.i, a.j, count(*) AS n, min(b.z) AS lo, max(b.z) AS hi FROM spiked a, {X.NINE} o, spiked b WHERE (di <> 0 OR dj <> 0) AND b.i = a.i+di AND b.j = a.j+dj AND b.z IS NOT NULL GROUP BY a.i, a.j)"


@query("q_despike", f"{SPIKED}, {NEAR} SELECT r.i, r.j, CASE WHEN n >= 5 AND (z > hi + (hi-lo) + 5.0 OR z < lo - (hi-lo) - 5.0) THEN NULL ELSE z END AS z FROM spiked r LEFT JOIN near USING (i, j)")
def q_despike(spark, sf):
    k = (F.col("i") * 7 + F.col("j") * 3) % 97
    return G.despike(X.raster(spark, sf).withColumn("z", F.when(k == 0, F.col("z") + 900).when(k == 50, F.col("z") - 900).otherwise(F.col("z"))), tolerance=5.0)


@query("q_despike_off", R + "SELECT i, j, z FROM raster")
def q_despike_off(spark, sf):
    return G.despike(X.raster(spark, sf), tolerance=0.0)


def _near(radius: int) -> str:
    return f"h AS (SELECT i, j FROM raster WHERE z IS NULL), o AS (SELECT a AS di, b AS dj, a*a+b*b AS d2 FROM range({-radius},{radius + 1}) x(a), range({-radius},{radius + 1}) y(b) WHERE a*a+b*b BETWEEN 1 AND {radius * radius}), n AS (SELECT h.i, h.j, r.i AS si, r.j AS sj, r.z, d2 FROM h, o, raster r WHERE r.i = h.i+di AND r.j = h.j+dj AND r.z IS NOT NULL)"


# A hole of many cells in every 64 rows, so that long ways are needed.
HOLED = f"WITH {X.RASTER.replace('raster AS (', 'raster0 AS (')}, raster AS MATERIALIZED (SELECT i, j, CASE WHEN i%64 BETWEEN 10 AND 45 AND j BETWEEN 12 AND 50 THEN NULL ELSE z END AS z FROM raster0)"
RADIUS = 12


def _holed(spark, sf):
    hole = (F.col("i") % 64).between(10, 45) & F.col("j").between(12, 50)
    return X.raster(spark, sf).withColumn("z", F.when(~hole, F.col("z")))


@query("q_fill_nearest", f"{HOLED}, {_near(RADIUS)}, f AS (SELECT i, j, z FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY d2, si, sj) AS k FROM n) WHERE k = 1) SELECT r.i, r.j, coalesce(r.z, f.z) AS z FROM raster r LEFT JOIN f USING (i, j)")
def q_fill_nearest(spark, sf):
    return G.fill_nearest(_holed(spark, sf), RADIUS)


@query("q_fill_idw", f"{HOLED}, {_near(RADIUS)}, q AS (SELECT *, CASE WHEN sj < j AND si <= i THEN 'nw' WHEN si < i AND sj >= j THEN 'ne' WHEN sj > j AND si >= i THEN 'se' ELSE 'sw' END AS q FROM n), b AS (SELECT i, j, q, arg_min(z, (d2, si, sj)) AS z, min(d2) AS d2 FROM q GROUP BY ALL), f AS (SELECT i, j, sum(z/sqrt(d2::DOUBLE))/sum(1.0/sqrt(d2::DOUBLE)) AS z FROM b GROUP BY i, j) SELECT r.i, r.j, round(coalesce(r.z, f.z), 6) AS z FROM raster r LEFT JOIN f USING (i, j)")
def q_fill_idw(spark, sf):
    return G.fill_idw(_holed(spark, sf), RADIUS).withColumn("z", F.round("z", 6))


@query("q_distance", f"{HOLED}, {_near(RADIUS)} SELECT i, j, min(d2)::BIGINT AS d2 FROM n GROUP BY i, j")
def q_distance(spark, sf):
    return G.distance(_holed(spark, sf), RADIUS)


@query("q_fill_far")
def q_fill_far(spark, sf):
    """At a search radius of 50 cells."""
    return G.fill_idw(_holed(spark, sf), 50)


# Target cells from their own side: the source cells that they cover, or whose centres lie around theirs.
AXIS = "SELECT t, s, w FROM (SELECT t, s, {w} AS w FROM (SELECT t, unnest(range({low}, {high} + 1)) AS s FROM range({n}) r(t)))"


def _taps(ratio: float, method: str, n: str) -> str:
    c = f"((t + 0.5)*{ratio} - 0.5)"
    if method == "average":
        return AXIS.format(n=n, low=f"floor(t*{ratio})::BIGINT", high=f"ceil((t+1)*{ratio})::BIGINT - 1", w=f"least((t+1)*{ratio}, s+1) - greatest(t*{ratio}, s)")
    if method == "bilinear":
        return AXIS.format(n=n, low=f"floor({c})::BIGINT", high=f"floor({c})::BIGINT + 1", w=f"1 - abs({c} - s)")
    d = f"abs({c} - s)"
    return AXIS.format(n=n, low=f"floor({c})::BIGINT - 1", high=f"floor({c})::BIGINT + 2", w=f"CASE WHEN {d} < 1 THEN 1.5*{d}*{d}*{d} - 2.5*{d}*{d} + 1 ELSE -0.5*{d}*{d}*{d} + 2.5*{d}*{d} - 4*{d} + 2 END")


def _resampled(ratio: float, method: str) -> str:
    size = f"(SELECT (count(*)/64/{ratio})::BIGINT FROM raster)", f"(64/{ratio})::BIGINT"
    out = f"{R}, " + ", ".join(f"{m}_{k} AS MATERIALIZED ({_taps(ratio, m, 'CAST(' + n + ' AS BIGINT)')})" for m in {method, "bilinear" if method == "cubic" else method} for k, n in zip("ij", size, strict=True))
    for m in dict.fromkeys(("bilinear" if method == "cubic" else method, method)):
        out += f", {m}_z AS (SELECT a.t AS i, b.t AS j, sum(a.w*b.w*z)/sum(CASE WHEN z IS NOT NULL THEN a.w*b.w END) AS z, count(z) AS n, count(*) FILTER (z IS NULL AND a.w*b.w <> 0) AS missing, sum(a.w*b.w) AS whole FROM {m}_i a JOIN raster r ON r.i = a.s JOIN {m}_j b ON r.j = b.s GROUP BY a.t, b.t HAVING sum(CASE WHEN z IS NOT NULL THEN a.w*b.w END) > 1e-9)"
    if method != "cubic":
        return f"{out} SELECT i, j, round(z + 3e-9, 6) AS z FROM {method}_z"
    return f"{out} SELECT l.i, l.j, round(CASE WHEN c.missing = 0 AND abs(c.whole - 1) < 1e-9 THEN c.z ELSE l.z END + 3e-9, 6) AS z FROM bilinear_z l LEFT JOIN cubic_z c USING (i, j)"


def _resample(spark, sf, ratio, method):
    height = X.grid(spark, sf).agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]
    return RS.resample(X.raster(spark, sf), ratio, method, round(height / ratio), round(X.WIDTH / ratio)).withColumn("z", F.round(F.col("z") + 3e-9, 6))  # no value then lies halfway


@query("q_resample_average_any", _resampled(2.5, "average"))
def q_resample_average_any(spark, sf):
    return _resample(spark, sf, 2.5, "average")


@query("q_resample_bilinear_any", _resampled(0.4, "bilinear"))
def q_resample_bilinear_any(spark, sf):
    return _resample(spark, sf, 0.4, "bilinear")


@query("q_resample_cubic", _resampled(0.4, "cubic"))
def q_resample_cubic(spark, sf):
    return _resample(spark, sf, 0.4, "cubic")


@query("q_resample_average", R + "SELECT (i//2)::BIGINT AS i, (j//2)::BIGINT AS j, avg(z) AS z, count(z) AS n_valid FROM raster GROUP BY ALL")
def q_resample_average(spark, sf):
    return G.block_mean(X.raster(spark, sf), 2)


@query("q_block_mean", R + "SELECT (i//4)::BIGINT AS i, (j//4)::BIGINT AS j, round_even(avg(z), 0)::BIGINT AS grey, count(z) AS n_valid FROM raster GROUP BY ALL")
def q_block_mean(spark, sf):
    return G.block_mean(X.raster(spark, sf), 4).select("i", "j", F.rint("z").cast("long").alias("grey"), "n_valid")


@query("q_resample_bilinear", R + """, f AS (SELECT a/2.0 AS u, b/2.0 AS v, a, b FROM range(2) x(a), range(2) y(b))
SELECT c.i*2+a AS i, (c.j*2+b)::BIGINT AS j, c.z*(1-u)*(1-v)+e.z*(1-u)*v+s.z*u*(1-v)+d.z*u*v AS z FROM f, raster c JOIN raster e ON e.i=c.i AND e.j=c.j+1 JOIN raster s ON s.i=c.i+1 AND s.j=c.j JOIN raster d ON d.i=c.i+1 AND d.j=c.j+1
WHERE c.z IS NOT NULL AND e.z IS NOT NULL AND s.z IS NOT NULL AND d.z IS NOT NULL""")
def q_resample_bilinear(spark, sf):
    return G.bilinear(X.raster(spark, sf), 2).select("i", F.col("j").cast("long").alias("j"), "z")


RR = f"WITH {X.RASTERS} "


@query("q_overlay_last_wins", RR + "SELECT a.i, a.j, coalesce(CASE WHEN b.j < 40 THEN b.z END, a.z) AS z FROM raster a JOIN raster2 b USING (i, j)")
def q_overlay_last_wins(spark, sf):
    return G.overlay(X.raster(spark, sf), X.raster2(spark, sf).filter("j < 40"))


@query("q_last_wins", "SELECT o_custkey AS tile, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY ALL")
def q_last_wins(spark, sf):
    from orogen.tables import table

    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tile")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))


@query("q_mosaic_shared_edge", R + ", t AS (SELECT i // 16 AS t, i, j, z FROM raster UNION ALL SELECT i // 16 - 1, i, j, z FROM raster WHERE i % 16 = 0 AND i > 0) SELECT i, j, max(z) AS z FROM t GROUP BY i, j")
def q_mosaic_shared_edge(spark, sf):
    from orogen.sources.tiles import mosaic_tiles

    r = X.raster(spark, sf).withColumn("tile", F.floor(F.col("i") / 16))
    shared = r.filter("i % 16 = 0 and i > 0").withColumn("tile", F.col("tile") - 1)
    return mosaic_tiles(r.unionByName(shared))


@query("q_compare_grids", RR + """, c AS (SELECT a.z AS za, b.z AS zb, b.z - a.z AS d, abs(b.z - a.z) AS ad FROM raster a JOIN raster2 b USING (i, j) WHERE (i%64-30.5)*(i%64-30.5) + (j-31.5)*(j-31.5) <= 900.0)
SELECT count(*) AS n_zone, count(za) AS n_a, count(zb) AS n_b, count(d) AS n_both, count(*) FILTER (za IS NOT NULL AND zb IS NULL) AS only_a, count(*) FILTER (za IS NULL AND zb IS NOT NULL) AS only_b, max(za)-min(za) AS relief_a, avg(d) AS mean,
round(stddev_pop(d), 9) AS sd, round(sqrt(avg(d*d)), 9) AS rms, avg(ad) AS mean_abs, quantile_cont(ad, 0.95) AS p95, max(ad) AS max_abs, avg((ad > 1)::INT::DOUBLE) AS over_1m, avg((ad > 5)::INT::DOUBLE) AS over_5m FROM c""")
def q_compare_grids(spark, sf):
    return G.compare(X.raster(spark, sf), X.raster2(spark, sf), zone(30.0))


@query("q_secondary_fill", RR + f", c AS (SELECT i, j, a.z AS za, b.z AS zb, {DISC} AS inside FROM raster a JOIN raster2 b USING (i, j)), m AS (SELECT median(za - zb) AS o FROM c WHERE inside) SELECT i, j, CASE WHEN inside THEN coalesce(za, zb + o) ELSE za END AS z FROM c, m")
def q_secondary_fill(spark, sf):
    return G.secondary_fill(X.raster(spark, sf), X.raster2(spark, sf), zone())


@query("q_secondary_fill_few_common", RR + ", c AS (SELECT i, j, CASE WHEN j < 2 AND i % 20 = 0 THEN a.z END AS za, b.z AS zb FROM raster a JOIN raster2 b USING (i, j)), m AS (SELECT CASE WHEN count(za - zb) >= 100 THEN median(za - zb) ELSE 0 END AS o FROM c) SELECT i, j, coalesce(za, zb + o) AS z FROM c, m")
def q_secondary_fill_few_common(spark, sf):
    few = F.when((F.col("j") < 2) & (F.col("i") % 20 == 0), F.col("z")).alias("z")
    return G.secondary_fill(X.raster(spark, sf).select("i", "j", few), X.raster2(spark, sf))


@query("q_hillshade", R + """, s AS (SELECT i, j, z, lag(z) OVER wj AS w, lead(z) OVER wj AS e, lag(z) OVER wi AS n, lead(z) OVER wi AS s, (SELECT max(i) FROM raster) AS mi FROM raster WINDOW wj AS (PARTITION BY i ORDER BY j), wi AS (PARTITION BY j ORDER BY i)),
g AS (SELECT i, j, CASE WHEN j = 0 THEN e - z WHEN j = 63 THEN z - w ELSE (e - w)/2 END AS gx, -(CASE WHEN i = 0 THEN s - z WHEN i = mi THEN z - n ELSE (s - n)/2 END) AS gy FROM s)
SELECT i, j, round(least(greatest((sin(radians(45.0)) - gx*sin(radians(315.0))*cos(radians(45.0)) - gy*cos(radians(315.0))*cos(radians(45.0)))/sqrt(1+gx*gx+gy*gy), 0), 1), 9) AS light FROM g""".replace("round(least(greatest(", "CASE WHEN gx IS NULL OR gy IS NULL THEN {none} ELSE round(least(greatest(").replace("0), 1), 9) AS light", "0), 1), 9) END AS light").replace("{none}", "0.0"))
def q_hillshade(spark, sf):
    shaded = G.hillshade(X.raster(spark, sf))
    return shaded.withColumn("light", F.coalesce("light", F.lit(0.0)))


@query("q_base_elevation", R + "SELECT i, j, greatest(z, 500.0) AS z, z < 500.0 AS flattened FROM raster WHERE z IS NOT NULL")
def q_base_elevation(spark, sf):
    return X.raster(spark, sf).filter("z is not null").select("i", "j", F.greatest("z", F.lit(500.0)).alias("z"), (F.col("z") < 500.0).alias("flattened"))


@query("q_print_scale", R + ", m AS (SELECT min(z) AS lo FROM raster) SELECT i, j, j * 0.25::DOUBLE AS x_mm, (z - lo) * 0.25 * 1.5 AS z_mm FROM raster, m WHERE z IS NOT NULL")
def q_print_scale(spark, sf):
    from orogen.functions.elevation import print_height

    r = X.raster(spark, sf).filter("z is not null")
    return r.join(F.broadcast(r.agg(F.min("z").alias("lo")))).select("i", "j", (F.col("j") * F.lit(0.25)).alias("x_mm"), print_height(F.col("z"), F.col("lo"), 0.25, 1.5).alias("z_mm"))


@query("q_relief_stats", R + ", m AS (SELECT min(z) AS lo, max(z) AS hi FROM raster) SELECT lo AS min_m, hi AS max_m, greatest(hi-lo, 0) AS relief_m, (hi-lo)*0.25*1.5 AS relief_mm, (hi-lo)*0.25*1.5*100/256.0 AS percent, least(greatest(0.225*256.0/((hi-lo)*0.25), 1.0), 8.0)::DOUBLE AS suggested FROM m")
def q_relief_stats(spark, sf):
    from orogen.functions.elevation import relief_stats

    return relief_stats(X.raster(spark, sf), scale=0.25, exaggeration=1.5, diameter=256.0)


@query("q_unpack", R + "SELECT i, j, (z * 0.5 * 0.25 * -1) + 100.0 * 0.25 * -1 AS z FROM raster")
def q_unpack(spark, sf):
    from orogen.functions.elevation import unpack

    return X.raster(spark, sf).select("i", "j", unpack(F.col("z"), scale=0.5, offset=100.0, factor=0.25, down=True).alias("z"))


# Masks.
MK = f"WITH {X.mask_sql()}"
ER = f"er AS MATERIALIZED (SELECT m.i, m.j FROM mask m WHERE (SELECT count(*) FROM {X.NINE} o JOIN mask n ON n.i = m.i+di AND n.j = m.j+dj) = 9)"
OP = ER + f", op AS MATERIALIZED (SELECT DISTINCT e.i+di AS i, (e.j+dj)::INT AS j FROM er e, {X.NINE})"
QD = OP + ", qd AS MATERIALIZED (SELECT a.i, a.j FROM op a JOIN op b ON b.i=a.i AND b.j=a.j+1 JOIN op c ON c.i=a.i+1 AND c.j=a.j JOIN op d ON d.i=a.i+1 AND d.j=a.j+1)"


def _pinch(k: int) -> str:
    """k simultaneous passes over qd, each from the four corners of a 2x2 block."""
    out, was = "", "qd"
    for n in range(k):
        b = f"SELECT c.i, c.j, a.i IS NOT NULL AS a, b.i IS NOT NULL AS b, d.i IS NOT NULL AS d, e.i IS NOT NULL AS e FROM (SELECT DISTINCT q.i-x AS i, q.j-y AS j FROM {was} q, range(2) r(x), range(2) s(y)) c LEFT JOIN {was} a ON a.i=c.i AND a.j=c.j LEFT JOIN {was} b ON b.i=c.i AND b.j=c.j+1 LEFT JOIN {was} d ON d.i=c.i+1 AND d.j=c.j LEFT JOIN {was} e ON e.i=c.i+1 AND e.j=c.j+1"
        out += f", b{n} AS ({b}), p{n} AS MATERIALIZED (SELECT i, j::INT AS j FROM {was} UNION SELECT i, (j+1)::INT FROM b{n} WHERE a AND e AND NOT b AND NOT d UNION SELECT i+1, j::INT FROM b{n} WHERE a AND e AND NOT b AND NOT d UNION SELECT i, j::INT FROM b{n} WHERE b AND d AND NOT a AND NOT e UNION SELECT i+1, (j+1)::INT FROM b{n} WHERE b AND d AND NOT a AND NOT e)"
        was = f"p{n}"
    return out + f", kept AS MATERIALIZED (SELECT i, j FROM {was})"


KEPT = f"{X.mask_sql()}, {QD}{_pinch(4)}"
SIDES = "side AS MATERIALIZED (SELECT i, j, s AS side FROM kept k, (VALUES ('n',-1,0),('s',1,0),('w',0,-1),('e',0,1)) v(s, di, dj) WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.i = k.i+di AND o.j = k.j+dj))"


def _opened(spark, sf):
    # The grid's rows are the vectors, its width is the vectors' length; rows beyond the last don't occur after an erosion.
    return M.opened(X.mask(spark, sf), 1 << 62, X.WIDTH)


def kept(spark, sf):
    return M.fix_pinches(M.quads(_opened(spark, sf)))


@query("q_erode", f"{MK}, {ER} SELECT * FROM er")
def q_erode(spark, sf):
    return M.erode(X.mask(spark, sf))


@query("q_dilate", f"{MK} SELECT DISTINCT m.i+di AS i, (m.j+dj)::INT AS j FROM mask m, {X.NINE} WHERE m.i+di BETWEEN 0 AND (SELECT max(i) FROM grid) AND m.j+dj BETWEEN 0 AND 63")
def q_dilate(spark, sf):
    height = X.grid(spark, sf).agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]
    return M.dilate(X.mask(spark, sf), height, X.WIDTH)


@query("q_open_mask", f"{MK}, {OP} SELECT * FROM op")
def q_open_mask(spark, sf):
    return _opened(spark, sf)


@query("q_quads", f"{MK}, {QD} SELECT * FROM qd")
def q_quads(spark, sf):
    return M.quads(_opened(spark, sf))


@query("q_pinch_fix", f"WITH {KEPT} SELECT * FROM kept")
def q_pinch_fix(spark, sf):
    return kept(spark, sf)


@query("q_boundary_edges", f"WITH {KEPT}, {SIDES} SELECT * FROM side")
def q_boundary_edges(spark, sf):
    return M.boundary_edges(kept(spark, sf))


@query("q_boundary_degree", f"WITH {KEPT}, {SIDES}, e AS (SELECT i + (side IN ('s'))::INT AS i, j + (side IN ('e'))::INT AS j FROM side UNION ALL SELECT i + (side IN ('s','w','e'))::INT, j + (side IN ('n','s','e'))::INT FROM side), d AS (SELECT i, j, count(*) AS degree FROM e GROUP BY i, j) SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def q_boundary_degree(spark, sf):
    return M.boundary_degree(kept(spark, sf))


@query("q_touched_nodes", f"WITH {KEPT} SELECT DISTINCT i+a AS i, (j+b)::INT AS j FROM kept, range(2) x(a), range(2) y(b)")
def q_touched_nodes(spark, sf):
    return M.touched_nodes(kept(spark, sf))


@query("q_required_nodes", f"WITH {KEPT} SELECT i, j::INT AS j FROM (SELECT i+a AS i, j+b AS j, count(*) AS n FROM kept, range(2) x(a), range(2) y(b) GROUP BY ALL) WHERE n < 4")
def q_required_nodes(spark, sf):
    return M.required_nodes(kept(spark, sf))


def _label(cells: str) -> str:
    """Recursive part: the smallest id that each cell of a table can reach, from run to touching run of neighbouring rows."""
    return f"""cut AS MATERIALIZED (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS g FROM {cells}), run AS MATERIALIZED (SELECT i, g, min(j) AS a, max(j) AS b, i*64+min(j) AS id FROM cut GROUP BY i, g),
half AS MATERIALIZED (SELECT r.id AS a, s.id AS b FROM run r JOIN run s ON s.i = r.i + 1 AND s.a <= r.b + 1 AND r.a <= s.b + 1), edges AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(id, l) USING KEY (id) AS (SELECT id, id FROM run UNION SELECT e.b, min(reach.l) FROM reach JOIN edges e ON e.a = reach.id JOIN recurring.reach AS old ON old.id = e.b WHERE reach.l < old.l GROUP BY e.b),
ids AS MATERIALIZED (SELECT i, j, i*64+j AS id FROM cut), cc AS MATERIALIZED (SELECT c.i*64+c.j AS id, l FROM cut c JOIN run r ON r.i = c.i AND r.g = c.g JOIN reach ON reach.id = r.id)"""


RC = "WITH RECURSIVE "
MK1 = X.mask_sql(-0.1)


@query("q_components", f"{RC}{MK1}, {_label('mask')} SELECT i, j, l AS component FROM ids JOIN cc USING (id)")
def q_components(spark, sf):
    return M.components(X.mask(spark, sf, -0.1), X.WIDTH)


BIG = "big AS (SELECT l FROM cc GROUP BY l ORDER BY count(*) DESC, l LIMIT 1)"


@query("q_largest_component", f"{RC}{MK1}, {_label('mask')}, {BIG} SELECT i, j FROM ids JOIN cc USING (id) WHERE l = (SELECT l FROM big)")
def q_largest_component(spark, sf):
    return M.largest_component(M.components(X.mask(spark, sf, -0.1), X.WIDTH))


@query("q_island_mode", f"{RC}{X.RASTER}, land AS (SELECT i, j FROM raster WHERE z > 430.0 + 1.0), {_label('land')}, {BIG}, isle AS (SELECT i, j FROM ids JOIN cc USING (id) WHERE l = (SELECT l FROM big)) SELECT r.i, r.j, CASE WHEN s.i IS NULL THEN 430.0 ELSE r.z END::DOUBLE AS z FROM raster r LEFT JOIN isle s ON s.i = r.i AND s.j = r.j")
def q_island_mode(spark, sf):
    g = X.raster(spark, sf)
    land = M.largest_component(M.components(g.filter(F.col("z") > 430.0 + 1.0).select("i", "j"), X.WIDTH)).withColumn("land", F.lit(True))
    return g.join(land, ["i", "j"], "left").select("i", "j", F.when(F.col("land"), F.col("z")).otherwise(430.0).alias("z"))


GAPS = X.RASTER + ", n_rows AS (SELECT max(i) AS h FROM raster), gap AS (SELECT i, j FROM raster WHERE z IS NULL OR (i BETWEEN 20 AND 24 AND j BETWEEN 30 AND 36) OR (i BETWEEN 50 AND 52 AND j < 9))"
CLOSED = f"""{GAPS}, {_label('gap')}, rest AS (SELECT i, j FROM raster WHERE (i, j) NOT IN (SELECT (i, j) FROM gap)), far AS (SELECT l, bool_and(EXISTS (SELECT 1 FROM rest r WHERE (r.i-g.i)*(r.i-g.i)+(r.j-g.j)*(r.j-g.j) <= 9 AND r.i BETWEEN g.i-3 AND g.i+3)) AS near FROM ids g JOIN cc USING (id) GROUP BY l),
ring AS (SELECT l, CASE WHEN i = 0 THEN j WHEN j = 63 THEN 63 + i WHEN i = h THEN 63 + h + 63 - j WHEN j = 0 THEN 126 + h + h - i END AS p, 2*(63+h) AS total FROM ids JOIN cc USING (id), n_rows WHERE i = 0 OR j IN (0, 63) OR i = h),
runs AS (SELECT l, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ring q WHERE q.l = r.l AND q.p = (r.p + r.total - 1) % r.total)) AS n FROM ring r GROUP BY l), closed AS (SELECT i, j FROM ids JOIN cc USING (id) JOIN far f USING (l) LEFT JOIN runs u USING (l) WHERE near AND coalesce(n, 2) >= 2)"""


def _gaps(spark, sf):
    hole = F.col("z").isNull() | (F.col("i").between(20, 24) & F.col("j").between(30, 36)) | (F.col("i").between(50, 52) & (F.col("j") < 9))
    g = X.raster(spark, sf).withColumn("z", F.when(~hole, F.col("z")))
    height = g.agg(F.max("i")).first()[0] + 1
    return g, G.closed_gaps(g.filter("z is null").select("i", "j"), height, X.WIDTH, G.distance(g, 3), 3)


@query("q_closed_gaps", f"{RC}{CLOSED} SELECT * FROM closed")
def q_closed_gaps(spark, sf):
    return _gaps(spark, sf)[1]


@query("q_fill_holes_only", f"{RC}{CLOSED} SELECT g.i, g.j, c.i IS NOT NULL AS filled FROM gap g LEFT JOIN closed c ON c.i = g.i AND c.j = g.j")
def q_fill_holes_only(spark, sf):
    g, closed = _gaps(spark, sf)
    return g.filter("z is null").join(closed.withColumn("c", F.lit(True)), ["i", "j"], "left").select("i", "j", F.coalesce("c", F.lit(False)).alias("filled"))


def _tree(levels: int = 6) -> str:
    out = ", l0 AS (SELECT i, j::BIGINT AS j FROM kept)" + "".join(f", l{k} AS (SELECT i>>1 AS i, j>>1 AS j FROM l{k - 1} GROUP BY i>>1, j>>1 HAVING count(*) = 4)" for k in range(1, levels + 1))
    return out + ", leaf AS (" + " UNION ALL ".join(f"SELECT {k} AS level, i, j FROM l{k} a" + (f" WHERE NOT EXISTS (SELECT 1 FROM l{k + 1} b WHERE b.i = a.i>>1 AND b.j = a.j>>1)" if k < levels else "") for k in range(levels + 1)) + ")"


@query("q_quadtree", f"WITH {KEPT}{_tree()} SELECT level, i, j FROM leaf")
def q_quadtree(spark, sf):
    return M.quadtree(kept(spark, sf))


def _balance(rounds: int = 6, levels: int = 6) -> str:
    """Leaves of which a side neighbour is two or more levels smaller are split, in rounds; levels bound their number."""
    out, was = "", "leaf"
    for n in range(rounds):
        near = f"SELECT DISTINCT t::INT AS level, (i+a) >> (t-level)::INT AS i, (j+b) >> (t-level)::INT AS j FROM {was}, (VALUES (-1,0),(1,0),(0,-1),(0,1)) v(a, b), range(2, {levels + 1}) r(t) WHERE t >= level + 2"
        out += f", hit{n} AS MATERIALIZED ({near}), big{n} AS MATERIALIZED (SELECT l.* FROM {was} l SEMI JOIN hit{n} h USING (level, i, j)), leaf{n} AS MATERIALIZED (SELECT l.* FROM {was} l ANTI JOIN big{n} b USING (level, i, j) UNION ALL SELECT level-1, 2*i+a, 2*j+b FROM big{n}, range(2) x(a), range(2) y(b))"
        was = f"leaf{n}"
    return out + f", even AS (SELECT level, i, j FROM {was})"


@query("q_quadtree_balanced", f"WITH {KEPT}{_tree()}{_balance()} SELECT level, i, j FROM even")
def q_quadtree_balanced(spark, sf):
    return M.balanced(M.quadtree(kept(spark, sf)))


def _loops(rounds: int = 16) -> str:
    """Boundary edges with the cell on the right, and every node's smallest node around its loop, by doubling."""
    out = "edge AS MATERIALIZED (SELECT i+a AS ai, j+b AS aj, i+c AS bi, j+d AS bj, (i+a)*4294967296 + j+b AS node, (i+c)*4294967296 + j+d AS nxt FROM side JOIN (VALUES ('n',0,0,0,1),('e',0,1,1,1),('s',1,1,1,0),('w',1,0,0,0)) v(s, a, b, c, d) ON s = side), w0 AS MATERIALIZED (SELECT node, nxt, node AS best FROM edge)"
    for n in range(rounds):
        out += f", w{n + 1} AS MATERIALIZED (SELECT x.node, y.nxt, least(x.best, y.best) AS best FROM w{n} x JOIN w{n} y ON y.node = x.nxt)"
    return out + f", around AS (SELECT node, best FROM w{rounds})"


# Twice the area by the shoelace formula, which needs the edges of a loop but not their order.
@query("q_boundary_loops", f"WITH {KEPT}, {SIDES}, {_loops()} SELECT best::BIGINT AS loop, count(*) AS n, sum(aj*(-bi) - bj*(-ai))::BIGINT AS twice_area FROM edge JOIN around USING (node) GROUP BY best")
def q_boundary_loops(spark, sf):
    from pyspark.sql import Window

    from orogen.operators import rims

    order = Window.partitionBy("loop").orderBy("pos")
    last = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(last))
    loops = rims.boundary_loops(kept(spark, sf)).withColumn("ni", after("i")).withColumn("nj", after("j"))
    return loops.groupBy("loop").agg(F.count("*").alias("n"), F.sum(F.col("j") * -F.col("ni") - F.col("nj") * -F.col("i")).alias("twice_area"))
