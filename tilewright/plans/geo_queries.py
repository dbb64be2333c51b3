"""Projection, tiles, regions, great circles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators import tiles
from tilewright.plans.registry import POINTS, WORLD, lat_of, lon_of, points, query, table, tile_sql

R6 = lambda c, n: F.round(c, 6).alias(n)


def tiled(df: DataFrame, z: int) -> DataFrame:
    return df.withColumns({"tx": geo.tile_index(geo.world_x(F.col("lon")), z), "ty": geo.tile_index(geo.world_y(F.col("lat")), z)})


@query(f"""WITH {WORLD}, t AS (SELECT *, {tile_sql(3)} FROM world),
r AS (SELECT tx, ty, id, weight, count(*) OVER (PARTITION BY tx, ty) AS n, row_number() OVER (PARTITION BY tx, ty ORDER BY weight DESC, id) AS place FROM t)
SELECT tx, ty, n, CAST(place AS INTEGER) AS place, id, weight FROM r WHERE place <= 3""")
def tile_top_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers per tile and the three heaviest of each: counts are combined before the shuffle, and of a tile only its best are sorted."""
    t = tiled(points(spark, sf), 3)
    sums = t.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    best = t.withColumn("place", F.row_number().over(W.partitionBy("tx", "ty").orderBy(F.desc("weight"), "id"))).where("place <= 3")
    return best.join(sums, ["tx", "ty"]).select("tx", "ty", "n", "place", "id", "weight")


@query(f"""WITH {WORLD} SELECT id, round(x, 6) AS x, round(y, 6) AS y, {tile_sql(6)} FROM world""")
def mercator_project(spark: SparkSession, sf: str) -> DataFrame:
    return tiled(points(spark, sf), 6).select("id", R6(geo.world_x(F.col("lon")), "x"), R6(geo.world_y(F.col("lat")), "y"), "tx", "ty")


@query(f"""WITH {WORLD}, t AS (SELECT id, {tile_sql(5)} FROM world)
SELECT id, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 32)))), 6) AS lat, round((tx + 0.5) / 32 * 360 - 180, 6) AS lon FROM t""")
def tile_centres(spark: SparkSession, sf: str) -> DataFrame:
    t = tiled(points(spark, sf), 5)
    return t.select("id", R6(geo.latitude_at((F.col("ty") + 0.5) / 32), "lat"), R6(geo.longitude_at((F.col("tx") + 0.5) / 32), "lon"))


_T6 = f"WITH {WORLD}, t AS (SELECT DISTINCT 6 AS z, {tile_sql(6)} FROM world)"


def _tiles(spark: SparkSession, sf: str, z: int) -> DataFrame:
    return tiled(points(spark, sf), z).select(F.lit(z).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()


@query(_T6 + ", d AS (SELECT unnest([0, 1, 2]) AS d) SELECT DISTINCT CAST(z - d AS INTEGER) AS z, tx >> d AS x, ty >> d AS y FROM t, d")
def tile_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """What is demanded: each tile and its two nearest ancestors, once."""
    return tiles.with_ancestors(_tiles(spark, sf, 6), 2).distinct()


@query(_T6 + " SELECT CAST(7 AS INTEGER) AS z, 2 * tx + i % 2 AS x, 2 * ty + i // 2 AS y FROM t, (SELECT unnest([0, 1, 2, 3]) AS i)")
def tile_children(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.children(_tiles(spark, sf, 6))


@query(_T6 + f", p AS (SELECT DISTINCT 3 AS z, {tile_sql(3)} FROM world WHERE id % 3 = 0 OR id % 3 = 1) SELECT p.tx AS px, p.ty AS py, t.tx AS x, t.ty AS y FROM p JOIN t ON t.tx >> 3 = p.tx AND t.ty >> 3 = p.ty")
def tile_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors meet descendants by an equi-join on the descendant's ancestor key."""
    t = _tiles(spark, sf, 6)
    p = tiled(points(spark, sf).where("id % 3 = 0 OR id % 3 = 1"), 3).select(F.col("tx").alias("px"), F.col("ty").alias("py")).distinct()
    met = t.withColumns({"px": geo.parent(F.col("x"), 3), "py": geo.parent(F.col("y"), 3)}).join(p, ["px", "py"])
    return met.where(geo.covers(F.lit(3), F.col("px"), F.col("py"), F.col("z"), F.col("x"), F.col("y"))).select("px", "py", "x", "y")


#: A region for each supplier: some cross the antimeridian, some are the whole world, some are upside down.
REGIONS = """regions AS (SELECT s_suppkey AS id, CAST((s_suppkey * 53) % 140 - 75 AS DOUBLE) + 0.3 AS s, CAST((s_suppkey * 53) % 140 - 75 AS DOUBLE) + 0.3 + CAST((s_suppkey * 7) % 30 - 3 AS DOUBLE) AS n,
  CAST((s_suppkey * 97) % 400 - 200 AS DOUBLE) + 0.7 AS w, CAST((s_suppkey * 97) % 400 - 200 AS DOUBLE) + 0.7 + CASE WHEN s_suppkey % 20 = 0 THEN 360 ELSE CAST((s_suppkey * 11) % 60 AS DOUBLE) END AS e, s_suppkey % 3 AS z0, 5 AS z1 FROM supplier)"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    south, west = "CAST((s_suppkey * 53) % 140 - 75 AS DOUBLE) + 0.3", "CAST((s_suppkey * 97) % 400 - 200 AS DOUBLE) + 0.7"
    return s.selectExpr("s_suppkey AS id", f"{south} AS sw_lat", f"{west} AS sw_lon", f"{south} + CAST((s_suppkey * 7) % 30 - 3 AS DOUBLE) AS ne_lat", f"{west} + CASE WHEN s_suppkey % 20 = 0 THEN 360 ELSE CAST((s_suppkey * 11) % 60 AS DOUBLE) END AS ne_lon", "CAST(s_suppkey % 3 AS INT) AS z_min", "5 AS z_max")


_COVER = REGIONS + """, z AS (SELECT *, unnest(generate_series(z0, z1)) AS z FROM regions WHERE s <= n),
f AS (SELECT *, e - w >= 360 AS full_world, (((w + 180) % 360) + 360) % 360 AS wn, (((e + 180) % 360) + 360) % 360 AS en0, (1 << z) AS k FROM z),
g AS (SELECT *, CASE WHEN en0 = 0 THEN 360.0 ELSE en0 END AS en, least(greatest(floor((1 - asinh(tan(radians(least(n, 85.0511287))))/pi())/2 * k), 0), k - 1) AS y0, least(greatest(floor((1 - asinh(tan(radians(greatest(s, -85.0511287))))/pi())/2 * k), 0), k - 1) AS y1 FROM f),
h AS (SELECT *, least(floor(wn / 360 * k), k - 1) AS a, least(floor(en / 360 * k), k - 1) AS b FROM g),
c AS (SELECT id, z, k, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, full_world, en < wn AS crossing FROM h),
r AS (SELECT id, z, y0, y1, 0 AS part, CASE WHEN full_world OR (crossing AND b + 1 >= a) THEN 0 ELSE a END AS x0, CASE WHEN full_world OR crossing THEN k - 1 ELSE greatest(a, b) END AS x1 FROM c
      UNION ALL SELECT id, z, y0, y1, 1, 0, b FROM c WHERE NOT full_world AND crossing AND b + 1 < a)"""


@query(f"WITH {_COVER} SELECT id, CAST(z AS INTEGER) AS z, CAST(part AS INTEGER) AS part, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, y0, y1 FROM r")
def region_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.region_ranges(regions(spark, sf)).select("id", "z", "part", "x0", "x1", "y0", "y1")


@query(f"WITH {_COVER} SELECT id, CAST(z AS INTEGER) AS z, x, y FROM (SELECT id, z, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM r))")
def region_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.region_tiles(regions(spark, sf)).select("id", "z", "x", "y")


@query(f"WITH {_COVER} SELECT id, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS BIGINT) AS n_tiles FROM r GROUP BY id")
def region_tile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form: no tile is made."""
    return tiles.region_ranges(regions(spark, sf)).groupBy("id").agg(F.sum(F.expr("(x1 - x0 + 1) * (y1 - y0 + 1)")).alias("n_tiles"))


@query(f"""WITH {_COVER}, t AS (SELECT id, z, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM r))
SELECT DISTINCT CAST(z AS INTEGER) AS z, x, y FROM t WHERE id % 10 = 0 EXCEPT SELECT CAST(z AS INTEGER), x, y FROM t WHERE id % 10 <> 0""")
def region_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that go with removed regions: those of no remaining region."""
    t = tiles.region_tiles(regions(spark, sf)).select("id", "z", "x", "y")
    return tiles.prunable(t.where("id % 10 = 0"), t.where("id % 10 <> 0"))


@query(f"""WITH {_COVER}, t AS (SELECT id, z, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM r)),
e AS (SELECT id, count(*) AS expected, sum(CASE WHEN (x * 31 + y * 17 + z) % 4 <> 0 THEN 1 ELSE 0 END) AS stored, sum(CASE WHEN (x * 31 + y * 17 + z) % 4 <> 0 THEN 100 + x + y ELSE 0 END) AS bytes FROM t GROUP BY id)
SELECT id, expected, CAST(stored AS BIGINT) AS stored, CAST(bytes AS BIGINT) AS bytes, round(least(1.0, stored / CAST(expected AS DOUBLE)), 6) AS fraction FROM e""")
def region_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored of each region; a tile of two regions counts in both."""
    t = tiles.region_tiles(regions(spark, sf)).select("id", "z", "x", "y")
    store = t.select("z", "x", "y").distinct().where("(x * 31 + y * 17 + z) % 4 <> 0").withColumn("bytes", F.expr("100 + x + y"))
    return tiles.progress(t, store)


#: Legs between a customer and the next one by key.
LEGS = POINTS + ", legs AS (SELECT a.id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM points a JOIN points b ON b.id = a.id + 1)"


def legs(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return p.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "id")



def _ends():
    return F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")


@query(f"""WITH {LEGS}, h AS (SELECT id, lat1, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS h,
  atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))) AS b FROM legs)
SELECT id, round(2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS angle, round((degrees(b) + 360) % 360, 6) AS bearing, round(2 * 6371000.0 * asin(sqrt(h)), 3) AS metres, round(1e9 / (40075016.686 * cos(radians(lat1))), 6) AS units FROM h""")
def great_circles(spark: SparkSession, sf: str) -> DataFrame:
    return legs(spark, sf).select("id", R6(geo.central_angle(*_ends()), "angle"), R6(geo.bearing(*_ends()), "bearing"), F.round(geo.haversine(*_ends()), 3).alias("metres"), R6(geo.units_per_metre(F.col("lat1"), 1e9), "units"))


@query(f"""WITH {LEGS}, v AS (SELECT id, cos(radians(lat1)) * cos(radians(lon1)) + cos(radians(lat2)) * cos(radians(lon2)) AS x, cos(radians(lat1)) * sin(radians(lon1)) + cos(radians(lat2)) * sin(radians(lon2)) AS y, sin(radians(lat1)) + sin(radians(lat2)) AS z FROM legs)
SELECT id, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM v""")
def great_circle_middles(spark: SparkSession, sf: str) -> DataFrame:
    """Half way the two ends weigh the same, so the oracle is the sum of the two vectors."""
    return legs(spark, sf).select("id", geo.along(*_ends(), F.lit(0.5)).alias("m")).select("id", R6(F.col("m.lat"), "lat"), R6(F.col("m.lon"), "lon"))


@query("""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST((l_orderkey * 37 + l_linenumber * 90) % 1081 - 540 AS DOUBLE) AS lon FROM lineitem)
SELECT id, lon, lon - 360 * floor((lon + 180) / 360) AS west, lon - 360 * ceil((lon - 180) / 360) AS east, CASE WHEN abs(lon) <= 180 THEN lon WHEN abs(lon % 360) <= 180 THEN lon % 360 ELSE (lon % 360) - sign(lon) * 360 END AS signed FROM d""")
def longitudes(spark: SparkSession, sf: str) -> DataFrame:
    """Three ways to wrap a longitude, which differ at the edges."""
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "CAST((l_orderkey * 37 + l_linenumber * 90) % 1081 - 540 AS DOUBLE) AS lon")
    lon = F.col("lon")
    return d.select("id", "lon", geo.west_longitude(lon).alias("west"), geo.east_longitude(lon).alias("east"), geo.signed_longitude(lon).alias("signed"))


_PATHS = """w AS (SELECT o_custkey AS path_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, ((o_orderkey * 53) % 160) - 80 + ((o_orderkey * 17) % 100) / CAST(100 AS DOUBLE) AS lat,
  ((o_orderkey * 137) % 360) - 180 + ((o_orderkey * 31) % 100) / CAST(100 AS DOUBLE) AS lon FROM orders),
s0 AS (SELECT path_id, i, lat, lon, lag(lat) OVER p AS lat0, lag(lon) OVER p AS lon0 FROM w WINDOW p AS (PARTITION BY path_id ORDER BY i)),
s AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY i) AS i, lat, lon, lat0, lon0 FROM s0 WHERE lat0 IS NULL OR lat <> lat0 OR lon <> lon0),
a AS (SELECT *, coalesce(2 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))), 0) AS angle FROM s)"""


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("path_id"), F.struct("o_orderdate", "o_orderkey").alias("place"), lat_of("o_orderkey").alias("lat"), lon_of("o_orderkey").alias("lon"))


@query(f"WITH {_PATHS} SELECT path_id, CAST(i AS INTEGER) AS i, round(sum(angle) OVER (PARTITION BY path_id ORDER BY i), 6) AS cumulative FROM a")
def path_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix sums of arc length along each path."""
    return tiles.cumulative_angles(waypoints(spark, sf)).select("path_id", "i", R6(F.col("cumulative"), "cumulative"))


@query(f"WITH {_PATHS}, t AS (SELECT path_id, count(*) AS n, sum(angle) AS total FROM a GROUP BY path_id HAVING count(*) > 1) SELECT path_id, CAST(n AS BIGINT) AS n, round(total, 6) AS total, CAST(least(greatest(ceil(total / radians(0.25)) + 1, 2), 2048) AS INTEGER) AS samples FROM t")
def path_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Length and samples of each path. Where it is a whole number of steps, rounding says whether one more is taken, so angles are made as the SQL makes them."""
    c = tiles.cumulative_angles(waypoints(spark, sf), geo.haversine_angle).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.max("cumulative").alias("total")).where("n > 1")
    return c.select("path_id", "n", R6(F.col("total"), "total"), geo.sample_count(F.col("total")).alias("samples"))


@query(f"""WITH {_PATHS}, c AS (SELECT *, sum(angle) OVER (PARTITION BY path_id ORDER BY i) AS up, sum(angle) OVER (PARTITION BY path_id) AS total FROM a),
t AS (SELECT DISTINCT path_id, total, k FROM c, (SELECT unnest(generate_series(0, 8)) AS k) WHERE total > 0),
m AS (SELECT t.path_id, t.k, t.total * t.k / 8 AS target, min(c.i) AS i FROM t JOIN c ON c.path_id = t.path_id AND c.i > 1 AND c.up >= t.total * t.k / 8 - 1e-12 GROUP BY ALL),
j AS (SELECT m.path_id, m.k, c.lat0, c.lon0, c.lat, c.lon, c.angle, least(1.0, greatest(0.0, (m.target - (c.up - c.angle)) / c.angle)) AS f FROM m JOIN c ON c.path_id = m.path_id AND c.i = m.i),
v AS (SELECT path_id, k, sin((1 - f) * angle) / sin(angle) AS p, sin(f * angle) / sin(angle) AS q, * FROM j),
x AS (SELECT path_id, k, p * cos(radians(lat0)) * cos(radians(lon0)) + q * cos(radians(lat)) * cos(radians(lon)) AS x, p * cos(radians(lat0)) * sin(radians(lon0)) + q * cos(radians(lat)) * sin(radians(lon)) AS y, p * sin(radians(lat0)) + q * sin(radians(lat)) AS z FROM v)
SELECT path_id, CAST(k AS INTEGER) AS k, round(x / sqrt(x * x + y * y + z * z), 5) AS x, round(y / sqrt(x * x + y * y + z * z), 5) AS y, round(z / sqrt(x * x + y * y + z * z), 5) AS z FROM x""")
def path_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Nine points at equal arc lengths of each path, as unit vectors."""
    s = tiles.path_points(tiles.cumulative_angles(waypoints(spark, sf)), 9)
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    return s.select("path_id", "k", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


#: Cameras: an id and its tile at zoom 6.
CAMERAS = [(0, 33, 21), (1, 2, 40), (2, 63, 5)]


@query(f"""WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(6)} FROM world), c AS (SELECT * FROM (VALUES {", ".join(map(str, CAMERAS))}) v(camera, cx, cy)),
d AS (SELECT camera, tx, ty, greatest(least(abs(tx - cx), 64 - abs(tx - cx)), abs(ty - cy)) AS distance, greatest(abs(tx - cx), abs(ty - cy)) AS flat FROM t, c)
SELECT camera, tx AS x, ty AS y, distance, flat, CAST(CASE WHEN distance <= 2 THEN 0 ELSE least(4, ceil(log2(distance / 2.0) * 1.5)) END AS INTEGER) AS drop_globe, CAST(CASE WHEN flat <= 2 THEN 0 ELSE least(4, ceil(log2(flat / 2.0) * 3.0)) END AS INTEGER) AS drop_flat,
  CAST(CASE WHEN ty < 31 THEN greatest(0, floor(log2(cosh(pi() * (1 - 2 * (ty + 1) / 64.0))))) WHEN ty > 32 THEN greatest(0, floor(log2(cosh(pi() * (1 - 2 * ty / 64.0))))) ELSE 0 END AS INTEGER) AS drop_latitude,
  CAST(row_number() OVER (PARTITION BY camera ORDER BY distance, tx, ty) AS INTEGER) AS priority FROM d""")
def tile_demand(spark: SparkSession, sf: str) -> DataFrame:
    """For each camera: distance of a tile, coarsening by distance and latitude, and the order in which tiles are asked for."""
    cameras = F.inline(F.array(*[F.struct(F.lit(c).alias("camera"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for c, x, y in CAMERAS]))
    t = _tiles(spark, sf, 6).select("x", "y", cameras)
    at = [F.col(c) for c in ("x", "y", "cx", "cy")]
    t = t.withColumns({"distance": geo.chebyshev(*at, 6), "flat": geo.chebyshev(*at)})
    order = F.row_number().over(W.partitionBy("camera").orderBy("distance", "x", "y"))
    return t.select("camera", "x", "y", "distance", "flat", geo.distance_drop(F.col("distance"), 1.5).alias("drop_globe"), geo.distance_drop(F.col("flat"), 3.0).alias("drop_flat"), geo.latitude_drop(F.col("y"), 6).alias("drop_latitude"), order.alias("priority"))


_SUN = """SELECT o_orderkey AS id, 2 * pi() / 365 * (dayofyear(ts) - 1 + (extract(hour FROM ts) - 12) / 24.0) AS g, extract(hour FROM ts) * 60.0 AS m FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts FROM orders)"""


@query(f"""WITH s AS ({_SUN}), q AS (SELECT id, degrees(0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g)) AS lat,
  (720 - m - 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g))) / 4 AS lon FROM s)
SELECT id, round(lat, 6) AS lat, round(CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END, 6) AS lon FROM q""")
def subsolar_points(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT))").alias("ts"))
    lat, lon = geo.subsolar(F.col("ts"))
    return o.select("id", R6(lat, "lat"), R6(lon, "lon"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 121) / 100.0::DOUBLE - 0.1 AS t, CAST(p_size AS DOUBLE) AS s, least(greatest((p_partkey % 121) / 100.0::DOUBLE - 0.1, 0), 1) AS c FROM part)
SELECT id, round(1 - pow(1 - c, 3), 6) AS out_cubic, round(CASE WHEN c < 0.5 THEN 4 * pow(c, 3) ELSE 1 - 4 * pow(1 - c, 3) END, 6) AS in_out, round(c * c * (3 - 2 * c), 6) AS smooth, round(s + 10 * sin(pi() * c), 6) AS altitude,
  round(0.14 + 0.46 * pow(least(s / 250, 1), 0.6), 6) AS seconds, round(1 - pow(2, -least(s / 100, 0.05) / 0.25), 6) AS catch_up, round(1 - pow(0.8, 60 * s / 1000), 6) AS smoothing FROM p""")
def animation_curves(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 121) / 100.0 - 0.1).alias("t"), F.col("p_size").cast("double").alias("s"))
    t, s = F.col("t"), F.col("s")
    return p.select("id", R6(geo.ease_out_cubic(t), "out_cubic"), R6(geo.ease_in_out_cubic(t), "in_out"), R6(geo.smoothstep(0.0, 1.0, t), "smooth"), R6(geo.altitude(s, F.lit(10.0), geo.clamp(t, 0.0, 1.0)), "altitude"), R6(geo.move_seconds(s), "seconds"), R6(geo.catch_up(s / 100, F.lit(0.25)), "catch_up"), R6(geo.smoothing(F.lit(0.2), s / 1000), "smoothing"))
