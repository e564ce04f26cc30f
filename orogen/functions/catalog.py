"""Catalog and tile rules as column expressions and small joins.

Fixed values: class and unit names, factors, tile name patterns and zones are those of the public formats.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
# Unit names without blanks, hyphens, dots and underscores, in lower case, with metres per unit.
_FOOT, _SURVEY_FOOT = 0.3048, 1200.0 / 3937.0
_PREFIXES = {"": 1.0, "kilo": 1000.0, "centi": 0.01, "milli": 0.001}
UNIT_FACTORS = {
    **{p + name: f for p, f in _PREFIXES.items() for name in ("metre", "metres", "meter", "meters")}, "m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001,
    **dict.fromkeys(("ft", "foot", "feet", "internationalfoot", "internationalfeet"), _FOOT),
    **dict.fromkeys(("usft", "ftus", "footus", "usfoot", "ussurveyfoot", "ussurveyfeet"), _SURVEY_FOOT),
}
# Names, CF standard names and title words by which a variable says that it is an elevation.
ELEVATION_NAMES = (
    "alt", "altitude", "bathymetry", "dem", "depth", "dsm", "dtm", "elev", "elevation", "height", "hgt", "orog", "orography", "relief", "surface_altitude", "terrain", "topo", "topography", "z",
)
STANDARD_NAMES = (
    "altitude", "bedrock_altitude", "geoid_height_above_reference_ellipsoid", "height", "height_above_geopotential_datum", "height_above_mean_sea_level", "height_above_reference_ellipsoid",
    "land_surface_altitude", "sea_floor_depth_below_geoid", "sea_floor_depth_below_reference_ellipsoid", "sea_floor_depth_below_sea_level", "sea_floor_depth_below_sea_surface", "surface_altitude",
    "surface_altitude_above_geoid",
)
TITLE_WORDS = ("elevation", "altitude", "topograph", "bathymetr", "height above")
RESAMPLING = ("average", "bilinear", "cubic", "cubicspline")


def swiss_gsd(pixel: Column) -> Column:
    """The resolution to ask for: 2 m for pixels of 2 m or more, else 0.5 m."""
    return F.when(pixel >= 2.0, 2.0).otherwise(0.5)


def nearest_assets(assets: DataFrame, gsd: float) -> DataFrame:
    """(tile, href) of (item, stamp, href, gsd): of each tile's latest item the GeoTIFF whose resolution is nearest.

    An item is named <collection>_<year>_<tile>, and its year stands in for a missing stamp; an asset that states no
    resolution is 99 away.  Of equal resolutions the first address counts, of equal stamps the first item.
    """
    parts = F.split("item", "_", 3)
    tile = F.when(F.size(parts) == 3, F.get(parts, F.lit(2))).otherwise(F.col("item"))
    stamp = F.coalesce("stamp", F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(""))
    rows = assets.filter(F.lower("href").endswith(".tif")).select("item", tile.alias("tile"), stamp.alias("stamp"), "href", F.coalesce(F.abs(F.col("gsd") - gsd), F.lit(99.0)).alias("off"))
    best = rows.groupBy("tile", "stamp", "item").agg(F.min(F.struct("off", "href"))["href"].alias("href"))
    last = best.groupBy("tile").agg(F.max("stamp").alias("stamp"))
    return best.join(last, ["tile", "stamp"]).groupBy("tile").agg(F.min(F.struct("item", "href"))["href"].alias("href"))


def number_text(c: Column) -> Column:
    """Ten significant digits at most, without trailing zeros, for requests."""
    scale = F.pow(F.lit(10.0), 9 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit("0")).otherwise(F.call_function("format_number", F.rint(c * scale) / scale, F.lit("0.##########")))


def _request(base: Column, pairs: list[tuple[str, Column]], plain: str) -> Column:
    """An address with a query; values are escaped but for the characters in ``plain``."""
    value = lambda v: reduce(lambda t, c: F.replace(t, F.lit(f"%{ord(c):02X}"), F.lit(c)), plain, F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")))
    return F.concat(F.substring_index(base, "?", 1), F.lit("?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), value(v)) for k, v in pairs]))


def coverage_url(base: Column, coverage: Column, epsg: int, box: list[Column], width: Column, height: Column, variant: str = "v100_geotiff") -> Column:
    """A GetCoverage request: WCS 1.0.0 with either name of the format, or WCS 2.0.1."""
    w, s, e, n = map(number_text, box)
    size = [c.cast("string") for c in (width, height)]
    if variant in ("v100_geotiff", "v100_image"):
        pairs = [("SERVICE", F.lit("WCS")), ("VERSION", F.lit("1.0.0")), ("REQUEST", F.lit("GetCoverage")), ("COVERAGE", coverage), ("CRS", F.lit(f"EPSG:{epsg}")), ("BBOX", F.concat_ws(",", w, s, e, n))]
        pairs += [("WIDTH", size[0]), ("HEIGHT", size[1]), ("FORMAT", F.lit("GeoTIFF" if variant == "v100_geotiff" else "image/GeoTIFF"))]
    elif variant == "v201_image":
        span = lambda a, lo, hi: F.concat(F.lit(f"{a}("), lo, F.lit(","), hi, F.lit(")"))
        pairs = [("SERVICE", F.lit("WCS")), ("VERSION", F.lit("2.0.1")), ("REQUEST", F.lit("GetCoverage")), ("COVERAGEID", coverage), ("SUBSET", span("x", w, e)), ("SUBSET", span("y", s, n))]
        pairs += [("SCALESIZE", F.concat(F.lit("x("), size[0], F.lit("),y("), size[1], F.lit(")"))), ("FORMAT", F.lit("image/GeoTIFF"))]
    else:
        raise ValueError(f"no variant {variant!r}")
    return _request(base, pairs, "(),:/")


def map_url(base: Column, layer: Column, epsg: int, box: list[Column], width: Column, height: Column, variant: str = "geotiff_normal") -> Column:
    """A GetMap request of WMS 1.3.0."""
    kind, _, style = variant.partition("_")
    if kind not in ("geotiff", "tiff"):
        raise ValueError(f"no variant {variant!r}")
    pairs = [("SERVICE", F.lit("WMS")), ("VERSION", F.lit("1.3.0")), ("REQUEST", F.lit("GetMap")), ("LAYERS", layer), ("STYLES", F.lit("normal" if style == "normal" else "")), ("CRS", F.lit(f"EPSG:{epsg}"))]
    pairs += [("BBOX", F.concat_ws(",", *map(number_text, box))), ("WIDTH", width.cast("string")), ("HEIGHT", height.cast("string")), ("FORMAT", F.lit(f"image/{kind}"))]
    return _request(base, pairs, ",:/")


def pick(candidates: DataFrame, k: int) -> DataFrame:
    """(query, name, chosen) with the k-th candidate of each query by rank chosen; a query with fewer is an error when it is met."""
    n = Window.partitionBy("query")
    rows = candidates.withColumn("n", F.count("*").over(n)).withColumn("at", F.row_number().over(n.orderBy("rank", "name")))
    known = F.assert_true((F.lit(k) >= 1) & (F.col("n") >= k), F.concat(F.lit(f"no candidate {k} for "), F.col("query"))).isNull()
    return rows.filter(known).select("query", "name", (F.col("at") == k).alias("chosen"))


def choose_band(bands: DataFrame, wanted: int | None = None) -> DataFrame:
    """(file, band) of (file, band, colour): the wanted band if the file has it, else the only one that isn't opacity, else NULL."""
    if wanted is not None:
        return bands.groupBy("file").agg(F.max(F.when(F.col("band") == wanted, F.col("band"))).alias("band"))
    useful = F.lower(F.coalesce("colour", F.lit(""))) != "alpha"
    return bands.groupBy("file").agg(F.count_if(useful).alias("n"), F.min(F.when(useful, F.col("band"))).alias("band")).select("file", F.when(F.col("n") == 1, F.col("band")).alias("band"))


def zoom_for_pixel(lat: Column, pixel: Column, most: int = 17) -> Column:
    """The lowest web zoom whose pixels are no coarser, from 0 to ``most``; the highest for no pixel size."""
    ground = F.cos(F.radians(lat)) * (2 * math.pi * 6378137.0 / 256)
    zoom = F.when(pixel > 0, F.ceil(F.log2(ground / pixel))).otherwise(most)
    return F.greatest(F.least(zoom, F.lit(most)), F.lit(0)).cast("int")


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: int) -> list[Column]:
    """(x0, y0, x1, y1) of the web tiles under a box, within the world."""
    within = lambda c: F.greatest(F.least(c, F.lit((1 << zoom) - 1)), F.lit(0))
    x0, y0 = web_tile(north, west, zoom)
    x1, y1 = web_tile(south, east, zoom)
    return [within(c).alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]


def cloud_unit(asked: Column, declared: Column, projected: Column, horizontal: Column) -> Column:
    """Metres per vertical unit of a cloud: as asked, as its system declares, as its horizontal unit if projected, else 1."""
    return F.coalesce(asked, F.when(declared > 0, declared), F.when(projected, horizontal), F.lit(1.0))


def detect_kind(path: Column, head: Column) -> Column:
    las = F.lower(path).rlike(r"\.la[sz]$") | (F.substring(head, 1, 4) == F.lit(b"LASF"))
    return F.when(path.startswith("/vsi"), "raster").when(las, "lidar").otherwise("raster")


def elevation_like(name: Column, standard: Column, long: Column) -> Column:
    """By the standard name, the last component of the variable's path, or a word of its title, whatever their case."""
    last = F.lower(F.substring_index(name, "/", -1))
    titled = [F.contains(F.lower(F.coalesce(long, F.lit(""))), F.lit(w)) for w in TITLE_WORDS]
    return F.coalesce(F.lower(F.trim(standard)).isin(*STANDARD_NAMES), F.lit(False)) | last.isin(*ELEVATION_NAMES) | reduce(Column.__or__, titled)


def choose_variable(variables: DataFrame, wanted: str | None = None) -> DataFrame:
    """(file, name, reason) per file: the variable to read of (file, name, standard, long).

    A wanted name is the whole path, or the last component if only one variable has it.  Without one, the only variable
    of a file is taken if it is like an elevation, and of several the only one that is; name is NULL otherwise.
    """
    path, last = F.trim(F.col("name"), F.lit("/")), F.substring_index("name", "/", -1)
    if wanted is not None:
        w = wanted.strip()
        hit, tail = path == w.strip("/"), last == w
    else:
        hit, tail = elevation_like(F.col("name"), F.col("standard"), F.col("long")), F.lit(False)
    n = variables.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(tail).alias("tails"), F.min(F.when(hit, F.col("name"))).alias("hit"), F.min(F.when(tail, F.col("name"))).alias("tail"),
    )
    chosen = F.when(F.col("hits") == 1, F.col("hit")).when(F.col("tails") == 1, F.col("tail"))
    return n.select("file", chosen.alias("name"), F.when(chosen.isNotNull(), "chosen").when(F.col("hits") + F.col("tails") == 0, "none").otherwise("several").alias("reason"))


def retry_after(value: Column, now: Column, cap: float = 60.0) -> Column:
    """Seconds to wait, from a number of seconds or an HTTP date, between 0 and the cap."""
    date = F.try_to_timestamp(F.substring(value, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(value.rlike("^[0-9]+$"), value.try_cast("double")).otherwise((F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.least(F.greatest(wait, F.lit(0.0)), F.lit(cap))


def circle_bbox(lat: Column, lon: Column, radius: float, margin: float = 2000.0) -> dict[str, Column]:
    d = radius + margin
    dlat, dlon = F.lit(d / METRES_PER_DEGREE), F.lit(d) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def tiles_for_circles(places: DataFrame, radius: float) -> DataFrame:
    """The one-degree tiles (south-west corners) under the circles."""
    b = circle_bbox(F.col("lat"), F.col("lon"), radius)
    f = lambda k: F.floor(b[k]).cast("int")
    rows = places.select(F.explode(F.sequence(f("south"), f("north"))).alias("tlat"), f("west").alias("w"), f("east").alias("e"))
    return rows.select(F.col("tlat").alias("lat"), F.explode(F.sequence("w", "e")).alias("lon")).distinct()


def tile_name(lat: Column, lon: Column, arc: int = 10) -> Column:
    a, b = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.format_string(f"Copernicus_DSM_COG_{arc}_%s%02d_00_%s%03d_00_DEM", F.when(a >= 0, "N").otherwise("S"), F.abs(a), F.when(b >= 0, "E").otherwise("W"), F.abs(b))


def latest(rows: DataFrame, tile: str, stamp: str, key: str) -> DataFrame:
    """The latest row of each tile; of equal stamps the smallest key.  An aggregate, so that a tile's versions combine early."""
    best = F.max_by(F.struct(key, stamp), F.struct(F.col(stamp), (-F.col(key)).alias("k")))
    return rows.groupBy(tile).agg(best.alias("b")).select(tile, f"b.{key}", f"b.{stamp}")


def snap(low: Column, high: Column, step: float) -> tuple[Column, Column]:
    return F.floor(low / step).cast("double") * step, F.ceil(high / step).cast("double") * step


def chunks(spark: SparkSession, width: int, height: int, most: int) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(most))).alias("x0")).select("x0", F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(most))).alias("y0"))
    return rows.select("x0", "y0", F.least(F.col("x0") + most, F.lit(width)).alias("x1"), F.least(F.col("y0") + most, F.lit(height)).alias("y1"))


def decode_rgb(r: Column, g: Column, b: Column) -> Column:
    v, half = r * 65536 + g * 256 + b, 1 << 23
    return F.when(v < half, v * F.lit(0.01)).when(v > half, (v - (1 << 24)) * F.lit(0.01))


def web_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n).cast("int")


def tile_fallback(want: DataFrame, have: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """For each wanted tile the highest zoom at which it or its ancestor is there; NULL if none."""
    ancestors = F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.shiftright("x", zooms[0] - z).alias("ax"), F.shiftright("y", zooms[0] - z).alias("ay")) for z in zooms]))
    rows = want.select("x", "y", ancestors.alias("a")).select("x", "y", "a.zoom", "a.ax", "a.ay")
    there = have.select("zoom", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(True).alias("there"))
    return rows.join(there, ["zoom", "ax", "ay"], "left").groupBy("x", "y").agg(F.max(F.when(F.col("there"), F.col("zoom"))).alias("zoom"))


# Fixed value: how a feed names a tile (side, north and east of its corner) and the date of its series.
FEED_TITLE = r"ALS\s+DTM\s+CRS3035RES(\d+)mN(\d+)E(\d+)\b.*?Stichtag\s+(\d{2})\.(\d{2})\.(\d{4})"


def feed_title(title: Column) -> list[Column]:
    """tile, x0, y0, size and date (yyyymmdd) of a title; NULL for other titles."""
    hit = title.rlike(FEED_TITLE)
    part = lambda k: F.regexp_extract(title, FEED_TITLE, k)
    tile = F.concat(F.lit("RES"), part(1), F.lit("mN"), part(2), F.lit("E"), part(3))
    return [F.when(hit, v).alias(n) for n, v in (("tile", tile), ("x0", part(3).cast("double")), ("y0", part(2).cast("double")), ("size", part(1).cast("double")), ("date", F.concat(part(6), part(5), part(4))))]


def overlapping_latest(tiles: DataFrame, west: float, south: float, east: float, north: float, side: float) -> DataFrame:
    """Tiles that truly overlap the bounds, the latest of each place."""
    hit = tiles.filter((F.col("x0") < east) & (F.col("x0") + side > west) & (F.col("y0") < north) & (F.col("y0") + side > south))
    k = F.row_number().over(Window.partitionBy("x0", "y0").orderBy(F.desc("stamp"), "key"))
    return hit.withColumn("k", k).filter("k = 1").select("x0", "y0", "key", "stamp")


def covers(places: DataFrame, registry: DataFrame) -> DataFrame:
    """Places with every source whose closed box holds them; the registry is a handful of rows."""
    return places.join(F.broadcast(registry), F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n"))).dropDuplicates(["id", "name"])


def auto_source(places: DataFrame, registry: DataFrame, default: str = "copernicus") -> DataFrame:
    """(id, source): of the sources that hold a place in one of their boxes the first in order, NULL order never."""
    rows = places.join(F.broadcast(registry), F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")), "left")
    return rows.groupBy("id").agg(F.coalesce(F.min_by("name", "prio"), F.lit(default)).alias("source"))


def cache_key(text: Column) -> Column:
    return F.left(F.sha1(F.encode(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "UTF-8")), F.lit(16))


def unit_factor(text: Column) -> Column:
    key = F.lower(F.regexp_replace(text, r"[\s_.\-]", ""))
    return F.get(F.array(*[F.lit(v) for v in UNIT_FACTORS.values()]), (F.array_position(F.array(*[F.lit(k) for k in UNIT_FACTORS]), key) - 1).cast("int"))


def looks_metric(x: Column, y: Column) -> Column:
    """Coordinates that no degrees could be."""
    return (F.abs(x) > 360) | (F.abs(y) > 90)


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + ((lon + 180) / 6).cast("int") + 1


def choose_resample(mode: Column, source: Column, pixel: Column) -> Column:
    return F.when(mode.isin(*RESAMPLING), mode).when(source > pixel * 1.05, "bilinear").otherwise("average")


def estimate(n: Column) -> list[Column]:
    """Triangles of a disc n cells across, with the size of its file and the memory one process would need."""
    t = F.round(F.lit(math.pi) * n * n).cast("long")
    return [(t * 50 + 84).alias("stl_bytes"), (t * 220 + 300_000_000).alias("ram_bytes"), t.alias("triangles")]


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def window_dims(rows: DataFrame) -> DataFrame:
    w = F.greatest(F.lit(1).cast("long"), ((F.col("r") * 2 + F.col("px") / 2) / F.col("px")).cast("long"))
    wc = F.greatest(F.lit(1).cast("long"), F.ceil(w * F.col("px") / F.col("cell") - 1e-9).cast("long"))
    return rows.select("r", "px", "cell", w.alias("w"), wc.alias("wc"))
