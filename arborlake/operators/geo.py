"""Points, distances, bins and densities on the sphere; all column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "nmi": 1852.0}


def latitude(c: Column) -> Column:
    """Null beyond ±90."""
    return F.when((c >= -90) & (c <= 90), c)


def longitude(c: Column) -> Column:
    """Wrapped to [-180, 180)."""
    return F.pmod(c + 180, F.lit(360)) - 180


def round_half_up(x: Column) -> Column:
    """Halves go to the greater number, also below zero."""
    return F.floor(x + 0.5)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, unit: str = "m") -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS_M / UNITS[unit] * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within(df: DataFrame, lat: float, lng: float, km: float, tie: list[str]) -> DataFrame:
    """Points within the radius with distance_km, nearest first; a latitude band goes before the exact test."""
    band = km / 111.0
    d = haversine(F.lit(float(lat)), F.lit(float(lng)), F.col("lat"), F.col("lng"), "km")
    return df.where(F.col("lat").between(lat - band - 0.1, lat + band + 0.1)).withColumn("distance_km", d).where(F.col("distance_km") <= km).orderBy("distance_km", *tie)


def in_box(south: float, west: float, north: float, east: float) -> Column:
    """Bounding box, across the antimeridian when west is beyond east; an invalid box filters nothing."""
    if not (-90 <= south <= north <= 90):
        return F.lit(True)
    lng = F.col("lng")
    return F.col("lat").between(south, north) & (lng.between(west, east) if west <= east else (lng >= west) | (lng <= east))


def in_polygon(ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lat, lng)."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > F.col("lat")) != (F.lit(y2) > F.col("lat"))) & (F.col("lng") < (x2 - x1) * (F.col("lat") - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside


def clusters(df: DataFrame, precision: int = 0) -> DataFrame:
    """key, count, mean lat, circular mean lng and bounds of grid cells; count desc, key."""
    f = 10.0**precision
    cy, cx = round_half_up(F.col("lat") * f) / f, round_half_up(F.col("lng") * f) / f
    r = F.radians("lng")
    out = df.groupBy(cy.cast("double").alias("cell_lat"), cx.cast("double").alias("cell_lng")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("lat").alias("lat"), F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))).alias("lng"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    return out.orderBy(F.desc("count"), "cell_lat", "cell_lng")


def centroid(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean direction of the points in space."""
    la, lo = F.radians("lat"), F.radians("lng")
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.avg(F.cos(la) * F.cos(lo)).alias("x"), F.avg(F.cos(la) * F.sin(lo)).alias("y"), F.avg(F.sin(la)).alias("z"))
    return m.select(*by, "points", F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lng"))


def bounds(df: DataFrame) -> DataFrame:
    """south, north, west, east; west and east leave out the largest gap between neighbouring longitudes, so a set around the antimeridian stays small."""
    lat = df.agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    lng = df.select("lng").distinct().withColumn("part", F.floor(F.col("lng") * 4))
    # Gaps within quarter degrees in parallel, gaps between them over at most 1,440 rows.
    inner = lng.withColumn("next", F.lead("lng").over(Window.partitionBy("part").orderBy("lng"))).where("next is not null").select(F.col("next").alias("west"), F.col("lng").alias("east"))
    parts = lng.groupBy("part").agg(F.min("lng").alias("lo"), F.max("lng").alias("hi"))
    outer = parts.withColumn("next", F.lead("lo").over(Window.orderBy("part"))).where("next is not null").select(F.col("next").alias("west"), F.col("hi").alias("east"))
    gaps = inner.unionByName(outer).withColumn("gap", F.col("west") - F.col("east"))
    wrap = parts.agg(F.min("lo").alias("west"), F.max("hi").alias("east")).withColumn("gap", 360 - (F.col("east") - F.col("west")))
    best = gaps.unionByName(wrap).agg(F.max_by(F.struct("west", "east"), F.struct("gap", -F.col("west"))).alias("b"))
    return lat.crossJoin(best).select("south", "north", "b.west", "b.east")


def hex_bins(df: DataFrame, size: float = 10.0, value: str | None = None) -> DataFrame:
    """q, r, count, total: pointy hexagons over the Mercator plane in degrees, by cube rounding."""
    y = F.degrees(F.ln(F.tan(F.radians(45 + F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("lat"))) / 2))))
    q0, r0 = (F.sqrt(F.lit(3.0)) / 3 * F.col("lng") - y / 3) / size, (2.0 / 3 * y) / size
    p = df.withColumn("_q", q0).withColumn("_r", r0).withColumn("_s", -F.col("_q") - F.col("_r"))
    for c in "qrs":
        p = p.withColumn("_r" + c, round_half_up(F.col("_" + c)))
        p = p.withColumn("_d" + c, F.abs(F.col("_r" + c) - F.col("_" + c)))
    q = F.when((F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds")), -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    r = F.when((F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds")), F.col("_rr")).when(F.col("_dr") > F.col("_ds"), -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    return p.groupBy(q.cast("bigint").alias("q"), r.cast("bigint").alias("r")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col(value) if value else F.lit(1.0)).alias("total"))


def density_grid(df: DataFrame, cells: int = 36, weight: str | None = None) -> DataFrame:
    """row, col, weight and its share of the greatest cell on an equirectangular grid."""
    r = F.least(F.lit(cells - 1), F.floor((90 - F.col("lat")) / 180 * cells)).cast("int")
    c = F.least(F.lit(cells - 1), F.floor((F.col("lng") + 180) / 360 * cells)).cast("int")
    g = df.groupBy(r.alias("row"), c.alias("col")).agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    top = g.agg(F.max("weight").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("row", "col", "weight", F.round(F.col("weight") / F.col("top"), 6).alias("share"))


def smooth(grid: DataFrame, reach: int = 2, kernel: str = "quartic") -> DataFrame:
    """Grid cells smoothed over their neighbours: each cell gives to those within reach, so the work is cells times a constant."""
    k = {"gaussian": lambda d: F.exp(-0.5 * d * d * 9), "quartic": lambda d: F.when(d <= 1, F.pow(1 - d * d, F.lit(2))).otherwise(0.0), "epanechnikov": lambda d: F.when(d <= 1, 1 - d * d).otherwise(0.0)}[kernel]
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = grid.select("row", "col", "weight", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    d = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) / (reach + 1)
    return near.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(F.sum(F.col("weight") * k(d)).alias("weight"))


def slerp(lat1: Column, lng1: Column, lat2: Column, lng2: Column, t: Column) -> list[Column]:
    """Latitude and longitude at share t of the great circle; the first point where both are the same."""
    a, b, c, d = F.radians(lat1), F.radians(lng1), F.radians(lat2), F.radians(lng2)
    w = haversine(lat1, lng1, lat2, lng2) / RADIUS_M
    p, q = F.sin((1 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
    x = p * F.cos(a) * F.cos(b) + q * F.cos(c) * F.cos(d)
    y = p * F.cos(a) * F.sin(b) + q * F.cos(c) * F.sin(d)
    z = p * F.sin(a) + q * F.sin(c)
    same = w < 1e-12
    return [F.when(same, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"), F.when(same, lng1).otherwise(F.degrees(F.atan2(y, x))).alias("lng")]


def position_at(df: DataFrame, by: str, ts: str, at: str) -> DataFrame:
    """Interpolated position of each track at a time, clamped at both ends; one aggregate, no sort of a track."""
    t = F.lit(at).cast("timestamp")
    before, after = F.col(ts) <= t, F.col(ts) >= t
    p = F.struct("lat", "lng", F.col(ts).alias("ts"))
    g = df.groupBy(by).agg(F.max_by(p, F.when(before, F.col(ts))).alias("a"), F.min_by(p, F.when(after, F.col(ts))).alias("b"))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    span = F.unix_micros(b["ts"]) - F.unix_micros(a["ts"])
    share = F.when(span == 0, 0.0).otherwise((F.unix_micros(t) - F.unix_micros(a["ts"])) / F.nullif(span, F.lit(0)))
    return g.select(by, (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"), (a["lng"] + (b["lng"] - a["lng"]) * share).alias("lng"))


def season(month: Column, lat: Column) -> Column:
    """Meteorological season; the southern half year is turned."""
    north = F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1).when(month.isin(6, 7, 8), 2).otherwise(3)
    k = F.when(lat < 0, (north + 2) % 4).otherwise(north)
    return F.element_at(F.array(*map(F.lit, ["winter", "spring", "summer", "autumn"])), (k + 1).cast("int"))


def geojson(df: DataFrame, properties: list[str]) -> DataFrame:
    """One feature a row as JSON text."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
