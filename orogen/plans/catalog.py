"""Queries over catalogs, tiles, units and other scalar rules; inputs are literals or the driver's business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orogen.functions import catalog as C
from orogen.functions import elevation as E
from orogen.plans.registry import query
from orogen.sources.tiles import missing_tiles
from orogen.tables import table


def rows(spark, schema: str, *values):
    return spark.createDataFrame(list(values), schema)


PLACE = "p AS (SELECT c_custkey AS id, (c_custkey*37 % 3600)/10.0::DOUBLE - 180 AS lon, (c_custkey*53 % 1800)/10.0::DOUBLE - 90 AS lat FROM customer)"


def places(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), ((k * 37 % 3600) / F.lit(10.0) - 180).alias("lon"), ((k * 53 % 1800) / F.lit(10.0) - 90).alias("lat"))


@query("q_detect_kind", "SELECT path, kind FROM (VALUES ('a.LAZ','lidar'),('b.tif','raster'),('/vsicurl/x.las','raster'),('c.bin','lidar'),('d.asc','raster')) t(path, kind)")
def q_detect_kind(spark, sf):
    r = rows(spark, "path string, head binary", ("a.LAZ", b"LASF"), ("b.tif", b"II*\0"), ("/vsicurl/x.las", b""), ("c.bin", b"LASF\1"), ("d.asc", b"ncol"))
    return r.select("path", C.detect_kind(F.col("path"), F.col("head")).alias("kind"))


VARIABLES = [
    ("a.nc", "z", "", ""), ("a.nc", "Band1", "air_temperature", "Near surface"), ("b.nc", "/data/Elevation", None, None), ("b.nc", "tas", " Surface_Altitude ", ""), ("c.nc", "v", "", "Mean HEIGHT above sea"),
    ("d.nc", "crs", "", "Bathymetric chart"), ("d.nc", "q", "", ""), ("e.nc", "pr", "", ""), ("e.nc", "sub/relief2", "height", ""),
]
VARS = "vars(file, name, standard, long) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for v in VARIABLES) + ")"
NAMED = "'elevation','altitude','height','z','dem','dtm','dsm','topo','topography','relief','orography','orog','elev','alt','hgt','terrain','bathymetry','depth','surface_altitude'"
STANDARD = "'altitude','height','surface_altitude','height_above_mean_sea_level','height_above_reference_ellipsoid','height_above_geopotential_datum','geoid_height_above_reference_ellipsoid','land_surface_altitude','sea_floor_depth_below_geoid','sea_floor_depth_below_sea_level','sea_floor_depth_below_sea_surface','sea_floor_depth_below_reference_ellipsoid','bedrock_altitude','surface_altitude_above_geoid'"
LIKELY = f"l AS (SELECT *, coalesce(lower(trim(standard)) IN ({STANDARD}), false) OR lower(split_part(name, '/', -1)) IN ({NAMED}) OR regexp_matches(lower(coalesce(long, '')), 'elevation|altitude|topograph|bathymetr|height above') AS likely FROM vars)"


def variables(spark):
    return spark.createDataFrame(VARIABLES, "file string, name string, standard string, long string")


@query("q_elevation_like", f"WITH {VARS}, {LIKELY} SELECT file, name, likely FROM l")
def q_elevation_like(spark, sf):
    return variables(spark).select("file", "name", C.elevation_like(F.col("name"), F.col("standard"), F.col("long")).alias("likely"))


@query("q_choose_variable", f"WITH {VARS}, {LIKELY}, c AS (SELECT file, count(*) FILTER (likely) AS n, min(name) FILTER (likely) AS name FROM l GROUP BY file) SELECT file, CASE WHEN n = 1 THEN name END AS name, CASE n WHEN 1 THEN 'chosen' WHEN 0 THEN 'none' ELSE 'several' END AS reason FROM c")
def q_choose_variable(spark, sf):
    return C.choose_variable(variables(spark))


@query("q_named_variable", f"WITH {VARS} SELECT file, max(CASE WHEN trim(name, '/') = 'relief2' OR split_part(name, '/', -1) = 'relief2' THEN name END) AS name, CASE WHEN bool_or(split_part(name, '/', -1) = 'relief2') THEN 'chosen' ELSE 'none' END AS reason FROM vars GROUP BY file")
def q_named_variable(spark, sf):
    return C.choose_variable(variables(spark), "relief2")


@query("q_missing_tiles", f"WITH {PLACE}, h AS (SELECT lat, lon FROM (SELECT DISTINCT floor(lat/10)::INT AS lat, floor(lon/10)::INT AS lon FROM p) WHERE (7*lat + 3*lon) % 5 <> 0) SELECT a AS lat, b AS lon FROM (SELECT unnest(range(min(lat), max(lat)+1))::INT AS a FROM h), (SELECT unnest(range(min(lon), max(lon)+1))::INT AS b FROM h) EXCEPT SELECT lat, lon FROM h")
def q_missing_tiles(spark, sf):
    tiles = places(spark, sf).select(F.floor(F.col("lat") / 10).cast("int").alias("lat"), F.floor(F.col("lon") / 10).cast("int").alias("lon")).distinct()
    return missing_tiles(tiles.filter(F.pmod(7 * F.col("lat") + 3 * F.col("lon"), F.lit(5)) != 0))


@query("q_retry_after", "SELECT value, CASE WHEN regexp_full_match(value, '[0-9]+') THEN least(value::DOUBLE, 60) ELSE least(greatest(epoch(try_strptime(value, '%a, %d %b %Y %H:%M:%S GMT')) - epoch(TIMESTAMP '2024-01-01 00:00:00'), 0), 60)::DOUBLE END AS seconds FROM (VALUES ('5'),('600'),('Mon, 01 Jan 2024 00:00:30 GMT'),('Sun, 31 Dec 2023 23:00:00 GMT')) t(value)")
def q_retry_after(spark, sf):
    r = rows(spark, "value string", ("5",), ("600",), ("Mon, 01 Jan 2024 00:00:30 GMT",), ("Sun, 31 Dec 2023 23:00:00 GMT",))
    return r.select("value", C.retry_after(F.col("value"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds"))


BOX = "b AS (SELECT id, lat, lon, (5000+2000)/111320.0::DOUBLE AS dlat, (5000+2000)/(111320.0::DOUBLE*greatest(cos(radians(lat)), 0.01)) AS dlon FROM p)"


@query("q_circle_bbox", f"WITH {PLACE}, {BOX} SELECT id, round(lon-dlon, 9) AS west, round(lat-dlat, 9) AS south, round(lon+dlon, 9) AS east, round(lat+dlat, 9) AS north FROM b")
def q_circle_bbox(spark, sf):
    b = C.circle_bbox(F.col("lat"), F.col("lon"), 5000.0)
    return places(spark, sf).select("id", *[F.round(v, 9).alias(k) for k, v in b.items()])


@query("q_tiles_for_circle", f"WITH {PLACE}, {BOX}, r AS (SELECT unnest(range(floor(lat-dlat)::INT, floor(lat+dlat)::INT+1))::INT AS lat, floor(lon-dlon)::INT AS w, floor(lon+dlon)::INT AS e FROM b WHERE abs(lat) < 80) SELECT DISTINCT lat, unnest(range(w, e+1))::INT AS lon FROM r")
def q_tiles_for_circle(spark, sf):
    return C.tiles_for_circles(places(spark, sf).filter("abs(lat) < 80"), 5000.0)


@query("q_tile_name", f"WITH {PLACE} SELECT id, printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END, abs(floor(lat))::INT, CASE WHEN floor(lon) >= 0 THEN 'E' ELSE 'W' END, abs(floor(lon))::INT) AS name FROM p")
def q_tile_name(spark, sf):
    return places(spark, sf).select("id", C.tile_name(F.col("lat"), F.col("lon")).alias("name"))


@query("q_latest_per_tile", "SELECT tile, key, stamp FROM (SELECT o_custkey % 50 AS tile, o_orderkey AS key, o_orderdate AS stamp, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def q_latest_per_tile(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("tile"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("stamp"))
    return C.latest(o, "tile", "stamp", "key")


@query("q_snap_window", f"WITH {PLACE} SELECT id, floor((lon*1000-333)/50)*50 AS x0, ceil((lon*1000+333)/50)*50 AS x1 FROM p")
def q_snap_window(spark, sf):
    x0, x1 = C.snap(F.col("lon") * 1000 - 333, F.col("lon") * 1000 + 333, 50.0)
    return places(spark, sf).select("id", x0.alias("x0"), x1.alias("x1"))


@query("q_chunks", "SELECT x AS x0, y AS y0, least(x+300, 1000) AS x1, least(y+300, 700) AS y1 FROM (SELECT unnest(range(0,1000,300))::INT AS x), (SELECT unnest(range(0,700,300))::INT AS y)")
def q_chunks(spark, sf):
    return C.chunks(spark, 1000, 700, 300)


PIXELS = "(VALUES (127,255,255),(128,0,0),(128,0,1),(0,0,0),(0,1,44),(255,255,255)) t(r, g, b)"


@query("q_decode_rgb", f"SELECT r, g, b, CASE WHEN v < 8388608 THEN v*0.01::DOUBLE WHEN v > 8388608 THEN (v-16777216)*0.01::DOUBLE END AS z FROM (SELECT *, 65536*r+256*g+b AS v FROM {PIXELS})")
def q_decode_rgb(spark, sf):
    r = rows(spark, "r int, g int, b int", (127, 255, 255), (128, 0, 0), (128, 0, 1), (0, 0, 0), (0, 1, 44), (255, 255, 255))
    return r.withColumn("z", C.decode_rgb(F.col("r"), F.col("g"), F.col("b")))


WEB = f"{PLACE}, t AS (SELECT id, floor((lon+180)/360*4096)::INT AS x, floor((1 - asinh(tan(radians(lat)))/pi())/2*4096)::INT AS y FROM p WHERE abs(lat) < 80)"


@query("q_web_tile", f"WITH {WEB} SELECT id, x, y FROM t")
def q_web_tile(spark, sf):
    x, y = C.web_tile(F.col("lat"), F.col("lon"), 12)
    return places(spark, sf).filter("abs(lat) < 80").select("id", x.alias("x"), y.alias("y"))


@query("q_tile_fallback", f"WITH {WEB}, w AS (SELECT DISTINCT x, y FROM t), have AS (SELECT 12 AS z, x, y FROM w WHERE (x+y) % 2 = 0 UNION SELECT 11, x>>1, y>>1 FROM w WHERE (x+y) % 3 = 0 UNION SELECT 10, x>>2, y>>2 FROM w WHERE x % 2 = 0) SELECT w.x, w.y, max(z) AS zoom FROM w LEFT JOIN have h ON h.x = w.x >> (12-z) AND h.y = w.y >> (12-z) GROUP BY w.x, w.y")
def q_tile_fallback(spark, sf):
    x, y = C.web_tile(F.col("lat"), F.col("lon"), 12)
    want = places(spark, sf).filter("abs(lat) < 80").select(x.alias("x"), y.alias("y")).distinct()
    at = lambda z, c: want.filter(c).select(F.lit(z).alias("zoom"), F.shiftright("x", 12 - z).alias("x"), F.shiftright("y", 12 - z).alias("y"))
    have = at(12, "(x + y) % 2 = 0").unionByName(at(11, "(x + y) % 3 = 0")).unionByName(at(10, "x % 2 = 0")).distinct()
    return C.tile_fallback(want, have, (12, 11, 10))


TITLES = "t AS (SELECT o_orderkey AS key, CASE WHEN o_custkey % 7 = 0 THEN 'ALS DSM CRS3035RES50000mN2600000E4' ELSE 'ALS  DTM CRS3035RES50000mN' || (2600000 + o_custkey % 8 * 50000) || 'E' || (4200000 + o_custkey % 5 * 50000) || ' of the country, Stichtag ' || strftime(o_orderdate, '%d.%m.%Y') END AS title, o_custkey % 7 = 0 AS other, o_custkey, o_orderdate FROM orders)"


def titles(spark, sf):
    c = F.col("o_custkey")
    text = F.concat(F.lit("ALS  DTM CRS3035RES50000mN"), (c % 8 * 50000 + 2600000).cast("string"), F.lit("E"), (c % 5 * 50000 + 4200000).cast("string"), F.lit(" of the country, Stichtag "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.when(c % 7 == 0, "ALS DSM CRS3035RES50000mN2600000E4").otherwise(text).alias("title"))


@query("q_title_regex", f"WITH {TITLES} SELECT key, CASE WHEN NOT other THEN 'RES50000mN' || (2600000 + o_custkey % 8 * 50000) || 'E' || (4200000 + o_custkey % 5 * 50000) END AS tile, CASE WHEN NOT other THEN 4200000.0::DOUBLE + o_custkey % 5 * 50000 END AS x0, CASE WHEN NOT other THEN 2600000.0::DOUBLE + o_custkey % 8 * 50000 END AS y0, CASE WHEN NOT other THEN 50000.0::DOUBLE END AS size, CASE WHEN NOT other THEN strftime(o_orderdate, '%Y%m%d') END AS date FROM t")
def q_title_regex(spark, sf):
    return titles(spark, sf).select("key", *C.feed_title(F.col("title")))


ASSETS = "a AS (SELECT 'alti_' || (2019 + o_custkey % 5) || '_' || (o_custkey % 40) AS item, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS stamp, 'https://x/' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.xyz' WHEN o_orderkey % 4 = 1 THEN '.TIF' ELSE '.tif' END AS href, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 END::DOUBLE AS gsd FROM orders)"


@query("q_nearest_assets", f"WITH {ASSETS}, r AS (SELECT item, split_part(item, '_', 3) AS tile, coalesce(stamp, split_part(item, '_', 2)) AS stamp, href, coalesce(abs(gsd - 2.0), 99.0) AS off FROM a WHERE lower(href) LIKE '%.tif'), b AS (SELECT tile, stamp, item, arg_min(href, (off, href)) AS href FROM r GROUP BY ALL), k AS (SELECT tile, href, row_number() OVER (PARTITION BY tile ORDER BY stamp DESC, item) AS k FROM b) SELECT tile, href FROM k WHERE k = 1")
def q_nearest_assets(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    a = table(spark, sf, "orders").select(
        F.concat_ws("_", F.lit("alti"), c % 5 + 2019, c % 40).alias("item"), F.when(c % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("stamp"),
        F.concat(F.lit("https://x/"), o.cast("string"), F.when(o % 4 == 0, ".xyz").when(o % 4 == 1, ".TIF").otherwise(".tif")).alias("href"), F.when(o % 3 == 0, 0.5).when(o % 3 == 1, 2.0).alias("gsd"),
    )
    return C.nearest_assets(a, 2.0)


@query("q_gsd", "SELECT px, CASE WHEN px >= 2 THEN 2.0 ELSE 0.5 END::DOUBLE AS gsd FROM (VALUES (0.2::DOUBLE), (1.99), (2.0), (30.0)) t(px)")
def q_gsd(spark, sf):
    return rows(spark, "px double", (0.2,), (1.99,), (2.0,), (30.0,)).select("px", C.swiss_gsd(F.col("px")).alias("gsd"))


@query("q_request_urls", f"WITH {PLACE} SELECT id, printf('https://s/wcs?SERVICE=WCS&VERSION=1.0.0&REQUEST=GetCoverage&COVERAGE=dtm%%201&CRS=EPSG:25833&BBOX=%s,%s,%s,%s&WIDTH=%d&HEIGHT=100&FORMAT=GeoTIFF', printf('%.10g', lon), printf('%.10g', lat), printf('%.10g', lon+0.25), printf('%.10g', lat+0.125), id) AS wcs1, printf('https://s/wcs?SERVICE=WCS&VERSION=2.0.1&REQUEST=GetCoverage&COVERAGEID=dtm%%201&SUBSET=x(%s,%s)&SUBSET=y(%s,%s)&SCALESIZE=x(%d),y(100)&FORMAT=image/GeoTIFF', printf('%.10g', lon), printf('%.10g', lon+0.25), printf('%.10g', lat), printf('%.10g', lat+0.125), id) AS wcs2, printf('https://s/wcs?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=dtm%%201&STYLES=&CRS=EPSG:2154&BBOX=%s,%s,%s,%s&WIDTH=%d&HEIGHT=100&FORMAT=image/tiff', printf('%.10g', lon), printf('%.10g', lat), printf('%.10g', lon+0.25), printf('%.10g', lat+0.125), id) AS wms FROM p")
def q_request_urls(spark, sf):
    base, layer, box = F.lit("https://s/wcs?old=1"), F.lit("dtm 1"), [F.col("lon"), F.col("lat"), F.col("lon") + 0.25, F.col("lat") + 0.125]
    size = F.col("id"), F.lit(100)
    return places(spark, sf).select("id", C.coverage_url(base, layer, 25833, box, *size).alias("wcs1"), C.coverage_url(base, layer, 25833, box, *size, variant="v201_image").alias("wcs2"), C.map_url(base, layer, 2154, box, *size, variant="tiff_default").alias("wms"))


@query("q_pick", "SELECT o_custkey AS query, o_orderkey::VARCHAR AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey::VARCHAR) = 1 AS chosen FROM orders")
def q_pick(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("rank"))
    return C.pick(c, 1)


BANDS = [("a.tif", 1, "Gray"), ("b.tif", 1, "Gray"), ("b.tif", 2, "Alpha"), ("c.tif", 1, "Red"), ("c.tif", 2, "Green"), ("c.tif", 3, "Blue"), ("d.tif", 1, "Alpha"), ("e.tif", 1, None)]
BANDS_SQL = "(VALUES " + ", ".join(f"('{f}', {b}, {'NULL' if c is None else repr(c)})" for f, b, c in BANDS) + ") t(file, band, colour)"


@query("q_choose_band", f"SELECT file, CASE WHEN count(*) FILTER (colour IS DISTINCT FROM 'Alpha') = 1 THEN min(band) FILTER (colour IS DISTINCT FROM 'Alpha') END AS band FROM {BANDS_SQL} GROUP BY file")
def q_choose_band(spark, sf):
    return C.choose_band(spark.createDataFrame(BANDS, "file string, band int, colour string"))


@query("q_zoom_for_pixel", f"WITH {PLACE} SELECT id, CASE WHEN id % 9 = 0 THEN 17 ELSE greatest(0, least(17, ceil(log2(2*pi()*6378137/256*cos(radians(lat))/(id % 9 * 1.5)))))::INT END::INT AS zoom FROM p WHERE abs(lat) < 80")
def q_zoom_for_pixel(spark, sf):
    return places(spark, sf).filter("abs(lat) < 80").select("id", C.zoom_for_pixel(F.col("lat"), F.col("id") % 9 * 1.5).alias("zoom"))


@query("q_tile_range", f"WITH {PLACE}, b AS (SELECT id, lon - 1.5 AS w, lon + 1.5 AS e, lat - 1.5 AS s, lat + 1.5 AS n FROM p WHERE abs(lat) < 80) SELECT id, least(greatest(floor((w+180)/360*256)::INT, 0), 255) AS x0, least(greatest(floor((1 - asinh(tan(radians(n)))/pi())/2*256)::INT, 0), 255) AS y0, least(greatest(floor((e+180)/360*256)::INT, 0), 255) AS x1, least(greatest(floor((1 - asinh(tan(radians(s)))/pi())/2*256)::INT, 0), 255) AS y1 FROM b")
def q_tile_range(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    return places(spark, sf).filter("abs(lat) < 80").select("id", *C.tile_range(lon - 1.5, lat - 1.5, lon + 1.5, lat + 1.5, 8))


@query("q_cloud_unit", "SELECT asked, declared, projected, horizontal, coalesce(asked, CASE WHEN declared > 0 THEN declared END, CASE WHEN projected THEN horizontal END, 1.0) AS factor FROM (VALUES (0.3048::DOUBLE, 1.0::DOUBLE, true, 1.0::DOUBLE), (NULL, 0.3048, true, 1.0), (NULL, 0.0, true, 0.3048), (NULL, NULL, false, 0.3048), (NULL, NULL, true, 1.0)) t(asked, declared, projected, horizontal)")
def q_cloud_unit(spark, sf):
    r = rows(spark, "asked double, declared double, projected boolean, horizontal double", (0.3048, 1.0, True, 1.0), (None, 0.3048, True, 1.0), (None, 0.0, True, 0.3048), (None, None, False, 0.3048), (None, None, True, 1.0))
    return r.withColumn("factor", C.cloud_unit(*map(F.col, r.columns)))


@query("q_tile_overlap_latest", "WITH t AS (SELECT o_orderkey AS key, (o_custkey % 20)*10.0::DOUBLE AS x0, (o_custkey // 20 % 20)*10.0::DOUBLE AS y0, o_orderdate AS stamp FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY x0, y0 ORDER BY stamp DESC, key) AS k FROM t WHERE x0 < 85 AND x0+10 > 40 AND y0 < 60 AND y0+10 > 25) SELECT x0, y0, key, stamp FROM o WHERE k = 1")
def q_tile_overlap_latest(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 20 * F.lit(10.0)).alias("x0"), (F.floor(F.col("o_custkey") / 20) % 20 * F.lit(10.0)).alias("y0"), F.col("o_orderdate").alias("stamp"))
    return C.overlapping_latest(t, 40.0, 25.0, 85.0, 60.0, 10.0)


# Names, order of preference and boxes (west, south, east, north) of public elevation services; one without
# an order is never chosen by itself.
REGISTRY = [
    ("swisstopo", 1, 5.9, 45.7, 10.6, 47.9), ("kartverket", 2, 4.0, 57.8, 31.5, 71.5),
    ("usgs", 3, -125.0, 24.3, -66.8, 49.6), ("usgs", 3, -170.0, 51.0, -129.0, 72.0), ("usgs", 3, -161.0, 18.8, -154.7, 22.4), ("usgs", 3, -67.4, 17.8, -65.1, 18.6),
    ("gsi", 4, 122.9, 24.0, 146.0, 45.6), ("ign", 5, -5.6, 41.0, 10.0, 51.6), ("ign", 5, 55.1, -21.5, 55.9, -20.8), ("austria", None, 9.4, 46.3, 17.3, 49.1),
]
REG = "reg(name, prio, w, s, e, n) AS (VALUES " + ", ".join(f"('{a}', {b or 'NULL'}, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in REGISTRY) + ")"


def registry(spark):
    return spark.createDataFrame(REGISTRY, "name string, prio int, w double, s double, e double, n double")


@query("q_covers", f"WITH {PLACE}, {REG} SELECT DISTINCT id, name FROM p JOIN reg ON lon BETWEEN w AND e AND lat BETWEEN s AND n")
def q_covers(spark, sf):
    return C.covers(places(spark, sf), registry(spark)).select("id", "name")


@query("q_auto_source", f"WITH {PLACE}, {REG}, c AS (SELECT id, arg_min(name, prio) AS name FROM p JOIN reg ON lon BETWEEN w AND e AND lat BETWEEN s AND n WHERE prio IS NOT NULL GROUP BY id) SELECT p.id, coalesce(name, 'copernicus') AS source FROM p LEFT JOIN c USING (id)")
def q_auto_source(spark, sf):
    return C.auto_source(places(spark, sf), registry(spark))


@query("q_cache_key", "SELECT c_custkey AS id, left(sha1(lower(trim(regexp_replace(c_name || '   ' || upper(c_name), '\\s+', ' ', 'g')))), 16) AS key FROM customer")
def q_cache_key(spark, sf):
    text = F.concat("c_name", F.lit("   "), F.upper("c_name"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.cache_key(text).alias("key"))


UNIT_NAMES = ("m", "Metre", " feet ", "US survey foot", "k.m", "parsec", "Kilometres", "centi-meter", "millimetre", "us-ft", "ftUS", "foot_us", "International Foot", "usfoot", "")
UNITS = "(VALUES " + ",".join(f"('{u}')" for u in UNIT_NAMES) + ") t(unit)"
FACTORS = """CASE WHEN regexp_full_match(u, 'm|met(re|er)s?') THEN 1.0 WHEN regexp_full_match(u, 'km|kilomet(re|er)s?') THEN 1000.0 WHEN regexp_full_match(u, 'cm|centimet(re|er)s?') THEN 0.01 WHEN regexp_full_match(u, 'mm|millimet(re|er)s?') THEN 0.001
WHEN regexp_full_match(u, '(international)?(foot|feet)|ft') THEN 0.3048 WHEN regexp_full_match(u, 'usft|ftus|footus|usfoot|ussurvey(foot|feet)') THEN 1200.0::DOUBLE/3937.0 END::DOUBLE"""


@query("q_unit_factor", f"SELECT unit, {FACTORS} AS factor FROM (SELECT unit, lower(regexp_replace(unit, '[\\s_.-]', '', 'g')) AS u FROM {UNITS})")
def q_unit_factor(spark, sf):
    return rows(spark, "unit string", *[(u,) for u in UNIT_NAMES]).select("unit", C.unit_factor(F.col("unit")).alias("factor"))


@query("q_unit_precedence", "SELECT asked, declared, crs, coalesce(asked, declared, crs, 1.0) AS factor, asked IS NULL AND declared IS NULL AND crs IS NULL AS assumed FROM (VALUES (2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE), (NULL, 3.0, 4.0), (NULL, NULL, 4.0), (NULL, NULL, NULL)) t(asked, declared, crs)")
def q_unit_precedence(spark, sf):
    r = rows(spark, "asked double, declared double, crs double", (2.0, 3.0, 4.0), (None, 3.0, 4.0), (None, None, 4.0), (None, None, None))
    cols = [F.col(c) for c in ("asked", "declared", "crs")]
    return r.select(*cols, F.coalesce(*cols, F.lit(1.0)).alias("factor"), F.coalesce(*cols).isNull().alias("assumed"))


@query("q_extent_guard", f"WITH {PLACE} SELECT id, abs(lon*3) > 360 OR abs(lat*1.5) > 90 AS metres FROM p")
def q_extent_guard(spark, sf):
    return places(spark, sf).select("id", C.looks_metric(F.col("lon") * 3, F.col("lat") * 1.5).alias("metres"))


@query("q_utm_zone", f"WITH {PLACE} SELECT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + trunc((lon+180)/6)::INT + 1 AS epsg FROM p")
def q_utm_zone(spark, sf):
    return places(spark, sf).select("id", C.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@query("q_choose_resample", "SELECT mode, src, px, CASE WHEN mode IN ('average','bilinear','cubic','cubicspline') THEN mode WHEN src IS NULL THEN 'average' WHEN src > 1.05*px THEN 'bilinear' ELSE 'average' END AS alg FROM (VALUES ('auto', 30.0::DOUBLE, 10.0::DOUBLE), ('auto', 10.0, 10.0), ('cubic', 1.0, 10.0), ('auto', NULL, 10.0)) t(mode, src, px)")
def q_choose_resample(spark, sf):
    r = rows(spark, "mode string, src double, px double", ("auto", 30.0, 10.0), ("auto", 10.0, 10.0), ("cubic", 1.0, 10.0), ("auto", None, 10.0))
    return r.withColumn("alg", C.choose_resample(F.col("mode"), F.col("src"), F.col("px")))


CURVE = ((0.0, 0.0), (4000.0, 4000.0), (8848.0, 6000.0))


@query("q_curve_segments", "SELECT a0, a1, (e1-e0)/(a1-a0)*2.0 AS factor FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 4000.0::DOUBLE, 4000.0::DOUBLE), (4000.0, 4000.0, 8848.0, 6000.0)) t(a0, e0, a1, e1)")
def q_curve_segments(spark, sf):
    return E.AltitudeCurve(CURVE).segments(spark, 2.0)


# Monotone cubic: interior slope by the weighted harmonic mean of the neighbours' slopes, end slopes by the three-point rule;
# beyond the ends the secant of the end segment.
@query("q_vexag_curve", """WITH p AS (SELECT id, (id * 97 % 1200) * 10.0::DOUBLE - 1000 AS a FROM (SELECT c_custkey AS id FROM customer)),
k AS (SELECT 4000.0::DOUBLE AS h0, 4848.0::DOUBLE AS h1, 1.0::DOUBLE AS s0, 2000.0::DOUBLE/4848.0 AS s1), m AS (SELECT *, (3*(h0+h1))/((2*h1+h0)/s0 + (h1+2*h0)/s1) AS m1, ((2*h0+h1)*s0 - h0*s1)/(h0+h1) AS m0, ((2*h1+h0)*s1 - h1*s0)/(h0+h1) AS m2 FROM k),
q AS (SELECT id, a, m.*, CASE WHEN a < 4000 THEN a/4000 ELSE (a-4000)/4848 END AS t FROM p, m)
SELECT id, a, round(CASE WHEN a < 0 THEN s0*a WHEN a > 8848 THEN 6000 + s1*(a-8848) WHEN a < 4000 THEN t*(1-t)*(1-t)*4000*m0 + t*t*(3-2*t)*4000 + t*t*(t-1)*4000*m1 ELSE (1+2*t)*(1-t)*(1-t)*4000 + t*(1-t)*(1-t)*4848*m1 + t*t*(3-2*t)*6000 + t*t*(t-1)*4848*m2 END, 6) AS z FROM q""")
def q_vexag_curve(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 97 % 1200 * F.lit(10.0) - 1000).alias("a"))
    return p.withColumn("z", F.round(E.AltitudeCurve(CURVE).column(F.col("a")), 6))


@query("q_estimate", "SELECT n, 84 + 50*t AS stl_bytes, 300000000 + 220*t AS ram_bytes, t AS triangles FROM (SELECT n, round(pi()*n*n)::BIGINT AS t FROM (VALUES (500.0::DOUBLE), (1250.0::DOUBLE)) v(n))")
def q_estimate(spark, sf):
    return rows(spark, "n double", (500.0,), (1250.0,)).select("n", *C.estimate(F.col("n")))


@query("q_slug", "SELECT c_custkey AS id, trim(regexp_replace(lower(c_name || ' #x_Y'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def q_slug(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.slug(F.concat("c_name", F.lit(" #x_Y"))).alias("slug"))


@query("q_window_dims", "SELECT r, px, cell, w, greatest(1, ceil(w*px/cell - 1e-9))::BIGINT AS wc FROM (SELECT *, greatest(1, trunc((2*r + px/2)/px))::BIGINT AS w FROM (VALUES (100.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE), (10.0, 0.5, 0.5), (0.1, 4.0, 1.0)) t(r, px, cell))")
def q_window_dims(spark, sf):
    r = rows(spark, "r double, px double, cell double", (100.0, 3.0, 5.0), (10.0, 0.5, 0.5), (0.1, 4.0, 1.0))
    return C.window_dims(r)
