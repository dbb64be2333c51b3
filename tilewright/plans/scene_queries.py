"""Visibility, draw orders, flights and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import scene
from tilewright.operators import scene as ops
from tilewright.operators import spatial, tiles
from tilewright.plans.geo_queries import _COVER, LEGS, R6, _ends, _tiles, legs, regions
from tilewright.plans.registry import WORLD, query, table, tile_sql
from tilewright.plans.set_queries import _PLANE, plane

E = F.expr


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 180) / 10.0::DOUBLE AS z FROM part) SELECT id, round(CASE WHEN z <= 5 THEN 0 WHEN z >= 6 THEN 1 ELSE pow(z - 5, 2) * (3 - 2 * (z - 5)) END, 6) AS roads, round(CASE WHEN z <= 14 THEN 0 WHEN z >= 16 THEN 1 ELSE pow((z - 14) / 2, 2) * (3 - (z - 14)) END, 6) AS surface,
  [1.0, 0.5, 0.3, 0.15, 0.08, 0.04, 0.0][CAST(least(floor(z), 6) AS INTEGER) + 1]::DOUBLE AS vegetation, greatest(z, 11.0)::DOUBLE AS label FROM p""")
def zoom_fades(spark: SparkSession, sf: str) -> DataFrame:
    z = E("(p_partkey % 180) / CAST(10 AS DOUBLE)")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R6(scene.fade("roads", z), "roads"), R6(scene.fade("road_surface", z), "surface"), scene.vegetation(z).alias("vegetation"), scene.label_size(z).alias("label"))


@query(f"""WITH {LEGS}, f AS (SELECT id, CASE WHEN id % 6 = 0 THEN 0.0 WHEN abs(lon2 - lon1) / 360 > 0.001 THEN abs(lon2 - lon1) / 360 ELSE 0.001 END::DOUBLE AS d, 0.01 + (id % 50) / 100.0::DOUBLE AS a, 0.02 + (id % 31) / 70.0::DOUBLE AS b FROM legs),
r AS (SELECT *, ln(sqrt(pow((b * b - a * a + pow(1.42, 4) * d * d) / (2 * a * pow(1.42, 2) * d), 2) + 1) - (b * b - a * a + pow(1.42, 4) * d * d) / (2 * a * pow(1.42, 2) * d)) AS r0, -asinh((b * b - a * a - pow(1.42, 4) * d * d) / (2 * b * pow(1.42, 2) * d)) AS r1 FROM f WHERE d > 0)
SELECT id, round((r1 - r0) / 1.42, 5) AS length, round(a * cosh(r0) / cosh((r0 + r1) / 2), 5) AS middle FROM r UNION ALL SELECT id, round(abs(ln(b) - ln(a)) / 1.42, 5), round(exp((ln(a) + ln(b)) / 2), 5) FROM f WHERE d = 0""")
def camera_flights(spark: SparkSession, sf: str) -> DataFrame:
    f = legs(spark, sf).selectExpr("id", "CASE WHEN id % 6 = 0 THEN 0D ELSE greatest(abs(lon2 - lon1) / 360, 0.001D) END AS d", "0.01D + (id % 50) / CAST(100 AS DOUBLE) AS a", "0.02D + (id % 31) / CAST(70 AS DOUBLE) AS b")
    return f.select("id", scene.flight(F.col("d"), F.col("a"), F.col("b")).alias("f")).select("id", F.round("f.length", 5).alias("length"), F.round("f.middle", 5).alias("middle"))


_CLASSES = "['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'minor', 'service', 'path', 'track']"


@query(f"""SELECT p_partkey AS id, round(CASE WHEN w BETWEEN 20 AND 600 THEN w / 10.0 ELSE CASE WHEN class IN ('motorway', 'trunk', 'primary', 'service') THEN 4.0 WHEN class IN ('secondary', 'tertiary') THEN 4.5 WHEN class = 'minor' THEN 5.0 ELSE NULL END
  * CASE WHEN n IS NULL THEN CASE class WHEN 'motorway' THEN 4 WHEN 'trunk' THEN 3 WHEN 'primary' THEN 3 WHEN 'service' THEN 1 ELSE 2 END WHEN n < 1 THEN 1 WHEN n > 12 THEN 12 ELSE n END END::DOUBLE, 4) AS stated, CASE WHEN NOT w BETWEEN 20 AND 600 AND class IN ('path', 'track') THEN 2.0 END::DOUBLE AS walk, CAST(((b - a + 180) % 360 + 360) % 360 - 180 AS DOUBLE) AS turn, round((x1 - x0) - floor(x1 - x0 + 0.5), 6) AS dx
FROM (SELECT p_partkey, p_partkey % 700 - 300 AS w, {_CLASSES}[p_partkey % 9 + 1] AS class, CASE WHEN p_partkey % 4 > 0 THEN p_size % 18 - 2 END AS n, p_partkey % 360 AS a, p_size * 7 AS b, (p_partkey % 100) / 100.0::DOUBLE AS x0, (p_size % 40) / 40.0::DOUBLE AS x1 FROM part)""")
def widths_and_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Widths of carriageways by what is stated or usual for their class, and of walks, apart."""
    from tilewright.functions import geo

    classes = _CLASSES.replace("[", "(").replace("]", ")")
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 700 - 300 AS w", f"element_at(array{classes}, CAST(p_partkey % 9 + 1 AS INT)) AS class", "CASE WHEN p_partkey % 4 > 0 THEN p_size % 18 - 2 END AS n", "CAST(p_partkey % 360 AS DOUBLE) AS a", "CAST(p_size * 7 AS DOUBLE) AS b", "(p_partkey % 100) / CAST(100 AS DOUBLE) AS x0", "(p_size % 40) / CAST(40 AS DOUBLE) AS x1")
    c = F.col
    width = F.round(scene.road_width(c("class"), c("w"), c("n")).cast("double"), 4)
    walk = c("class").isin("path", "track") & ~c("w").between(20, 600)
    return p.select("id", F.when(~walk, width).alias("stated"), F.when(walk, width).alias("walk"), scene.bearing_delta(c("a"), c("b")).alias("turn"), R6(geo.shortest_world_x(c("x0"), c("x1")), "dx"))


@query(f"""WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(6)} FROM world), d AS (SELECT tx, ty, greatest(abs(tx - 20), abs(ty - 30)) AS distance FROM t)
SELECT tx AS x, ty AS y, distance, distance <= 10 AS flat, distance <= 40 AS globe, CASE WHEN distance <= 2 THEN 'full' WHEN distance <= 7 THEN 'reduced' ELSE 'minimal' END AS tier, round(4096 * 64 / (40075016.686 * cos(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 64))))), 8) AS units FROM d""")
def demand_filter(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions import geo

    t = _tiles(spark, sf, 6).withColumn("distance", geo.chebyshev(F.col("x"), F.col("y"), F.lit(20), F.lit(30)))
    d = F.col("distance")
    return t.select("x", "y", "distance", scene.demanded(d, F.lit(6), True).alias("flat"), scene.demanded(d, F.lit(6), False).alias("globe"), scene.detail_tier(d).alias("tier"), F.round(scene.tile_units_per_metre(F.col("y"), F.lit(6)), 8).alias("units"))


@query("SELECT CASE WHEN d <= 2 THEN 'full' WHEN d <= 7 THEN 'reduced' ELSE 'minimal' END AS tier, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS retained, CAST(sum(d) AS BIGINT) AS far FROM (SELECT l_suppkey % 12 AS d, l_returnflag FROM lineitem) GROUP BY 1")
def lod_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").selectExpr("l_suppkey % 12 AS d", "l_returnflag")
    return d.groupBy(scene.detail_tier(F.col("d")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("retained"), F.sum("d").alias("far"))


@query(_PLANE + " SELECT id, px >= -20 * s AND px <= 1024 + 20 * s AND py >= -20 * s AND py <= 2048 + 20 * s AS in_view, ok AND NOT dup AND z <= 14.5 AS shows, px <= 4096 AND py <= 4096 AS in_tile FROM (SELECT *, greatest(1.0, id % 4) AS s, id % 7 <> 0 AS ok, id % 5 = 0 AS dup, 13 + id % 4 AS z FROM s)")
def visibility(spark: SparkSession, sf: str) -> DataFrame:
    p = plane(spark, sf)
    no = F.lit(False)
    return p.select("id", scene.in_viewport(F.col("px"), F.col("py"), 1024.0, 2048.0, 20.0, E("CAST(id % 4 AS DOUBLE)")).alias("in_view"), scene.label_shows(E("id % 7 <> 0"), E("id % 5 = 0"), no, no, F.lit(True), E("13 + id % 4"), F.lit(14.5)).alias("shows"), scene.inside_tile(F.col("px"), F.col("py")).alias("in_tile"))


@query("""WITH r AS (SELECT l_partkey % 600 AS target, l_linenumber AS z, l_tax > 0.04 AS full FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT l_partkey % 600, l_linenumber, l_tax > 0.04 FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT target, z, "full" AS f, 'retained' AS source FROM r UNION ALL SELECT *, 'ready' FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN source = 'retained' AND f THEN 0 ELSE 1 END, z DESC, source) AS n FROM b) SELECT target, source, z FROM k WHERE n = 1""")
def placement_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey % 600 AS target", "l_linenumber AS z", "l_tax > 0.04D AS full", "l_returnflag AS f")
    return ops.precedence(rows.where("f = 'R'").drop("f"), rows.where("f = 'A'").drop("f")).select("target", "source", "z")


_PIECES = "SELECT l_suppkey AS tile, CASE l_linenumber % 3 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'ground' ELSE 'bridge' END AS structure, l_linenumber % 2 - 1 AS layer, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS role, CAST(l_quantity AS INTEGER) % 8 AS class_priority, l_partkey % 9 AS style_key, l_orderkey * 8 + l_linenumber AS sequence"


@query(f"WITH r AS ({_PIECES} FROM lineitem) SELECT tile, sequence, class_priority, style_key, CAST(row_number() OVER (PARTITION BY tile ORDER BY CASE structure WHEN 'tunnel' THEN 0 WHEN 'ground' THEN 1 ELSE 2 END, layer, role, class_priority, style_key, sequence) AS INTEGER) AS place FROM r")
def road_draw_order(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("tw_lineitem")
    return ops.road_order(spark.sql(f"{_PIECES.replace('INTEGER', 'INT')} FROM tw_lineitem"), "tile").select("tile", "sequence", "class_priority", "style_key", "place")


@query(f"""WITH r AS (SELECT *, style_key * 10 AS x0, style_key * 10 + 15 AS x1 FROM ({_PIECES} FROM lineitem)), a AS (SELECT s_suppkey AS tile, s_suppkey AS area_id, 'ground' AS structure, 0 AS layer, s_suppkey % 8 AS p, s_suppkey % 60 AS x0, s_suppkey % 60 + 20 AS x1 FROM supplier)
SELECT r.sequence, r.class_priority, a.area_id FROM r JOIN a ON a.tile = r.tile AND a.structure = r.structure AND a.layer = r.layer AND a.p >= r.class_priority AND r.x0 <= a.x1 AND a.x0 <= r.x1""")
def roads_on_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("tw_lineitem")
    r = spark.sql(f"SELECT *, style_key * 10 AS x0, style_key * 10 + 15 AS x1, 0 AS y0, 1 AS y1 FROM ({_PIECES.replace('INTEGER', 'INT')} FROM tw_lineitem)")
    a = table(spark, sf, "supplier").selectExpr("s_suppkey AS tile", "s_suppkey AS area_id", "'ground' AS structure", "0 AS layer", "s_suppkey % 8 AS class_priority", "s_suppkey % 60 AS x0", "s_suppkey % 60 + 20 AS x1", "0 AS y0", "1 AS y1")
    return ops.on_surfaces(r, a).select("sequence", "class_priority", "area_id")


@query(_PLANE + ", b AS (SELECT id, px - 30 - id % 40 AS x0, px + 30 + id % 40 AS x1, py - 25 AS y0, py + 25 AS y1, id % 10 AS o FROM s), m AS (SELECT s.id AS point_id, b.id, row_number() OVER (PARTITION BY s.id ORDER BY o DESC, b.id DESC) AS n, count(*) OVER (PARTITION BY s.id) AS c FROM s JOIN b ON s.px BETWEEN x0 AND x1 AND s.py BETWEEN y0 AND y1) SELECT point_id, id, c AS n FROM m WHERE n = 1")
def picks(spark: SparkSession, sf: str) -> DataFrame:
    p = plane(spark, sf)
    shapes = p.selectExpr("id", "px - 30 - id % 40 AS x0", "px + 30 + id % 40 AS x1", "py - 25 AS y0", "py + 25 AS y1", "id % 10 AS draw_order")
    return ops.picked(p.select(F.col("id").alias("point_id"), "px", "py"), shapes, 64.0)


@query(_PLANE + ", p AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS d FROM s a JOIN s b ON a.id < b.id AND sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 52) SELECT a, b, round(d, 6) AS distance FROM p WHERE d <= 40 OR a % 40 = b % 40")
def remembered_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = plane(spark, sf)
    kept = ops.grouped_with_memory(spatial.near_pairs(p, 52.0), p.selectExpr("id", "id % 40 AS cluster"), 40.0, 52.0)
    return kept.select("a", "b", R6(F.col("distance"), "distance"))


@query("WITH e AS (SELECT user_id AS tile, event_id % 5 AS generation, event_id AS seq, event_type AS phase FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY generation DESC, seq DESC) AS k, count(*) OVER (PARTITION BY tile) AS n FROM e) SELECT tile, generation, phase, n FROM r WHERE k = 1")
def load_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return ops.current_load(table(spark, sf, "events").selectExpr("user_id AS tile", "event_id % 5 AS generation", "event_id AS seq", "event_type AS phase"))


@query("SELECT l_partkey % 300 AS building, CAST(l_quantity AS BIGINT) % 5 AS base, l_tax AS top, min(l_orderkey * 8 + l_linenumber) AS position FROM lineitem GROUP BY ALL")
def building_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey % 300 AS building", "CAST(l_quantity AS BIGINT) % 5 AS base", "l_tax AS top", "l_orderkey * 8 + l_linenumber AS position")
    return ops.first_of_shape(rows, "building", "base", "top")


@query(f"WITH {_COVER}, t AS (SELECT DISTINCT z, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM r)) SELECT CAST(z AS INTEGER) AS z, CASE WHEN (x + y) % 7 = 0 THEN 'known_empty' WHEN (x + y) % 7 < 4 THEN 'stored' ELSE 'absent' END AS status, count(*) AS n FROM t GROUP BY ALL")
def region_resume(spark: SparkSession, sf: str) -> DataFrame:
    """What a download that goes on still has to fetch: wanted tiles against the store."""
    from tilewright.sources import store

    wanted = tiles.region_tiles(regions(spark, sf)).select("z", "x", "y").distinct()
    stored = wanted.where("(x + y) % 7 < 4").withColumn("status", E("CASE WHEN (x + y) % 7 = 0 THEN 'known_empty' ELSE 'stored' END"))
    return store.lookup(wanted, stored).groupBy("z", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEGS}, v AS (SELECT id, 2 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) AS a, 1 - pow(1 - (id % 10) / 10.0::DOUBLE, 3) AS t, * FROM legs),
x AS (SELECT id, sin((1 - t) * a) / sin(a) AS p, sin(t * a) / sin(a) AS q, lat1, lon1, lat2, lon2 FROM v) SELECT id, round(p * cos(radians(lat1)) * cos(radians(lon1)) + q * cos(radians(lat2)) * cos(radians(lon2)), 5) AS x, round(p * sin(radians(lat1)) + q * sin(radians(lat2)), 5) AS z FROM x""")
def marker_motion(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions import geo

    m = legs(spark, sf).select("id", scene.moved(*_ends(), F.lit(100.0), F.lit(1.0), E("100 + (id % 10) / CAST(10 AS DOUBLE)")).alias("m"))
    x, _, z = geo.unit_vector(F.col("m.lat"), F.col("m.lon"))
    return m.select("id", F.round(x, 5).alias("x"), F.round(z, 5).alias("z"))
