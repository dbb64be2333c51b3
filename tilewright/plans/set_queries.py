"""Joins, aggregates, caches, queues, clusters and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators import cache, lifecycle, spatial, tiles
from tilewright.plans.geo_queries import _tiles
from tilewright.plans.registry import WORLD, checkpointing, points, query, table, tile_sql

# --- placement ------------------------------------------------------------------

_T = f"WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(6)} FROM world), s AS (SELECT z, tx >> (6 - z) AS x, ty >> (6 - z) AS y FROM t, (SELECT unnest([2, 4, 5]) AS z) WHERE (tx * 7 + ty * 3 + z) % 5 = 0)"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    t = _tiles(spark, sf, 6).withColumn("sz", F.explode(F.array(F.lit(2), F.lit(4), F.lit(5)))).where("(x * 7 + y * 3 + sz) % 5 = 0")
    return t.select(F.col("sz").alias("z"), F.expr("shiftright(x, 6 - sz)").alias("x"), F.expr("shiftright(y, 6 - sz)").alias("y")).distinct()


@query(_T + """, j AS (SELECT t.tx, t.ty, max(s.z) AS sz FROM t LEFT JOIN s ON t.tx >> (6 - s.z) = s.x AND t.ty >> (6 - s.z) = s.y GROUP BY ALL)
SELECT tx AS x, ty AS y, CAST(sz AS INTEGER) AS sz, CASE WHEN sz IS NOT NULL THEN tx >> CAST(6 - sz AS BIGINT) END AS sx, CASE WHEN sz IS NOT NULL THEN ty >> CAST(6 - sz AS BIGINT) END AS sy FROM j""")
def nearest_ready_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.nearest_ancestor(_tiles(spark, sf, 6), sources(spark, sf)).select("x", "y", "sz", "sx", "sy")


@query(f"""WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(3)} FROM world), a AS (SELECT DISTINCT {tile_sql(6)} FROM world), r AS (SELECT DISTINCT z, tx >> (6 - z) AS x, ty >> (6 - z) AS y FROM a, (SELECT unnest([4, 5, 6]) AS z) WHERE (tx + ty) % 3 = 0 OR z = 6 UNION SELECT DISTINCT 12, tx, ty FROM (SELECT {tile_sql(12)} FROM world)),
n AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r p WHERE p.z < r.z AND r.x >> (r.z - p.z) = p.x AND r.y >> (r.z - p.z) = p.y))
SELECT t.tx AS x, t.ty AS y, round(coalesce(sum(pow(4.0, -(n.z - 3))), 0), 6) AS share FROM t LEFT JOIN n ON n.x >> (n.z - 3) = t.tx AND n.y >> (n.z - 3) = t.ty GROUP BY ALL""")
def covered_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each tile its ready descendants cover; nested ones don't count twice."""
    a = _tiles(spark, sf, 6).withColumn("rz", F.explode(F.array(F.lit(4), F.lit(5), F.lit(6)))).where("(x + y) % 3 = 0 OR rz = 6")
    ready = a.select(F.col("rz").alias("z"), F.expr("shiftright(x, 6 - rz)").alias("x"), F.expr("shiftright(y, 6 - rz)").alias("y")).unionByName(_tiles(spark, sf, 12).withColumn("z", F.lit(12))).distinct()
    return tiles.covered_share(_tiles(spark, sf, 3), ready).select("x", "y", F.round("share", 6).alias("share"))


@query(f"""WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(4)} FROM world), r AS (SELECT DISTINCT tx >> (9 - z) AS tx, ty >> (9 - z) AS ty, z FROM (SELECT {tile_sql(9)}, CASE WHEN id % 8 = 0 THEN 9 ELSE 6 END AS z FROM world WHERE id % 4 = 0)),
c5 AS (SELECT 2 * tx + i % 2 AS x, 2 * ty + i // 2 AS y FROM t, (SELECT unnest([0, 1, 2, 3]) AS i)), c6 AS (SELECT 2 * x + i % 2 AS x, 2 * y + i // 2 AS y FROM c5, (SELECT unnest([0, 1, 2, 3]) AS i)),
g AS (SELECT 4 AS z, tx AS x, ty AS y FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tx >> (r.z - 4) = t.tx AND r.ty >> (r.z - 4) = t.ty)
 UNION ALL SELECT 5, x, y FROM c5 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tx >> (r.z - 5) = c5.x AND r.ty >> (r.z - 5) = c5.y) AND EXISTS (SELECT 1 FROM r WHERE r.tx >> (r.z - 4) = c5.x >> 1 AND r.ty >> (r.z - 4) = c5.y >> 1)
 UNION ALL SELECT 6, x, y FROM c6 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tx >> (r.z - 6) = c6.x AND r.ty >> (r.z - 6) = c6.y) AND EXISTS (SELECT 1 FROM r WHERE r.tx >> (r.z - 5) = c6.x >> 1 AND r.ty >> (r.z - 5) = c6.y >> 1))
SELECT CAST(z AS INTEGER) AS z, x, y FROM g""")
def uncovered_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots that no ready tile fills; ready tiles lie two and five levels below the targets, and slots end two below."""
    p = points(spark, sf).where("id % 4 = 0")
    ready = tiles_of(p.where("id % 8 <> 0"), 6).withColumn("z", F.lit(6)).unionByName(tiles_of(p.where("id % 8 = 0"), 9).withColumn("z", F.lit(9)))
    return tiles.gaps(_tiles(spark, sf, 4), ready, 2)


def tiles_of(df: DataFrame, z: int) -> DataFrame:
    from tilewright.plans.geo_queries import tiled

    return tiled(df, z).select(F.lit(z).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()


@query(f"""WITH {WORLD}, t AS (SELECT id, {tile_sql(6)} FROM world), a AS (SELECT tx, ty, min(id) AS pos, 0 AS part FROM t WHERE id % 3 = 0 GROUP BY ALL UNION ALL SELECT tx, ty, min(id), 1 FROM t WHERE id % 3 = 1 GROUP BY ALL UNION ALL SELECT tx, ty, min(id), 2 FROM t WHERE id % 2 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY part, pos) AS n FROM a) SELECT tx AS x, ty AS y, CAST(part AS INTEGER) AS part, pos FROM r WHERE n = 1""")
def demand_union(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, backdrop and casters, each tile where it first comes."""
    from tilewright.plans.geo_queries import tiled

    t = tiled(points(spark, sf), 6).select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("id").alias("pos"))
    return tiles.first_seen([t.where("pos % 3 = 0"), t.where("pos % 3 = 1"), t.where("pos % 2 = 0")], "x", "y")


@query(f"WITH {WORLD}, t AS (SELECT id, {tile_sql(5)} FROM world) SELECT tx AS x, ty AS y FROM t WHERE id % 2 = 0 EXCEPT SELECT tx, ty FROM t WHERE id % 2 = 1")
def swept_except_visible(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return tiles_of(p.where("id % 2 = 0"), 5).join(tiles_of(p.where("id % 2 = 1"), 5), ["z", "x", "y"], "left_anti").select("x", "y")


@query(f"WITH {WORLD}, t AS (SELECT DISTINCT {tile_sql(6)} FROM world), r AS (SELECT DISTINCT {tile_sql(6)} FROM world WHERE id % 5 < 3) SELECT t.tx AS x, t.ty AS y, r.tx IS NOT NULL AS ready, coalesce('e' || (r.tx % 4) = 'e' || (r.ty % 4), false) AS fresh FROM t LEFT JOIN r ON t.tx = r.tx AND t.ty = r.ty")
def demand_and_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Demanded tiles against the cache, and whether its etag is still the server's."""
    p = points(spark, sf)
    ready = tiles_of(p.where("id % 5 < 3"), 6).select("z", "x", "y", F.concat(F.lit("e"), F.col("x") % 4).alias("etag"))
    server = tiles_of(p, 6).withColumn("server_etag", F.concat(F.lit("e"), F.col("y") % 4))
    return server.join(ready, ["z", "x", "y"], "left").select("x", "y", F.col("etag").isNotNull().alias("ready"), F.coalesce(F.col("etag") == F.col("server_etag"), F.lit(False)).alias("fresh"))


# --- aggregates -----------------------------------------------------------------


@query("SELECT l_suppkey % 20 AS tile, p_type AS style, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS vertices, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey % 20, p_type ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM lineitem JOIN part ON l_partkey = p_partkey")
def style_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Where each polygon's vertices begin in the buffer of its tile and style."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.selectExpr("l_suppkey % 20 AS tile", "p_type AS style", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "CAST(l_quantity AS BIGINT) AS vertices")
    before = W.partitionBy("tile", "style").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("first_index", F.coalesce(F.sum("vertices").over(before), F.lit(0))).select("tile", "style", "l_orderkey", "l_linenumber", "vertices", "first_index")


@query("SELECT l_returnflag AS structure, l_linestatus AS role, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS vertices, max(l_linenumber) AS top FROM lineitem GROUP BY ALL")
def structure_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("structure"), F.col("l_linestatus").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("vertices"), F.max("l_linenumber").alias("top"))


@query("WITH e AS (SELECT l_orderkey AS f, unnest([l_partkey % 500, l_suppkey % 500]) AS endpoint FROM lineitem WHERE l_quantity >= 45) SELECT endpoint, count(DISTINCT f) AS n FROM e GROUP BY endpoint")
def endpoint_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Different streets that end at a point; only drive-tier ones count."""
    e = table(spark, sf, "lineitem").where("l_quantity >= 45").selectExpr("l_orderkey AS f", "explode(array(l_partkey % 500, l_suppkey % 500)) AS endpoint")
    return e.groupBy("endpoint").agg(F.countDistinct("f").alias("n"))


@query("SELECT CAST(floor(l_extendedprice / 5000 + 0.5) AS BIGINT) AS vx, CAST(floor(l_quantity / 10 + 0.5) AS BIGINT) AS vy, count(*) AS n, count(DISTINCT l_orderkey) AS streets, round(max(l_tax), 4) AS half_width FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL")
def vertex_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Points, streets and the widest half at each vertex; l_linenumber < 6 stands for A4's condition on priority and painted lines."""
    return table(spark, sf, "lineitem").where("l_linenumber < 6").groupBy(F.floor(F.col("l_extendedprice") / 5000 + 0.5).alias("vx"), F.floor(F.col("l_quantity") / 10 + 0.5).alias("vy")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("streets"), F.round(F.max("l_tax"), 4).alias("half_width"))


@query("""WITH p AS (SELECT vec_id AS id, unnest(generate_series(1, 31)) AS i, embedding AS e FROM embeddings), s AS (SELECT id, CAST(e[2*i-1] AS DOUBLE) AS x0, CAST(e[2*i] AS DOUBLE) AS y0, CAST(e[2*i+1] AS DOUBLE) AS x1, CAST(e[2*i+2] AS DOUBLE) AS y1, CAST(e[63] AS DOUBLE) AS xl, CAST(e[64] AS DOUBLE) AS yl, CAST(e[1] AS DOUBLE) AS xf, CAST(e[2] AS DOUBLE) AS yf FROM p)
SELECT id, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))), 5) AS length, round((sum(x0 * y1 - x1 * y0) + max(xl * yf - xf * yl)) / 2, 5) AS area, round(least(min(x0), max(xl)), 5) AS x_min, round(greatest(max(y0), max(yl)), 5) AS y_max FROM s GROUP BY id""")
def shape_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Length, signed area and bounds of polylines, inside the row."""
    from tilewright.operators import geometry

    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), pts.alias("pts"))
    return e.select("id", F.round(geometry.length("pts"), 5).alias("length"), F.round(geometry.signed_area("pts"), 5).alias("area"), F.round(F.array_min(F.transform("pts", lambda p: p["x"])), 5).alias("x_min"), F.round(F.array_max(F.transform("pts", lambda p: p["y"])), 5).alias("y_max"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS ready, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, arg_max(event_type, event_id) AS latest, count(*) FILTER (event_type IN ('click', 'view')) AS loading FROM events GROUP BY user_id")
def load_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("ready"), F.sum(F.col("event_id") % 1000).alias("bytes"), F.max_by("event_type", "event_id").alias("latest"), F.count_if(kind.isin("click", "view")).alias("loading"))


@query("WITH a AS (SELECT l_partkey % 700 AS id, 'n' || l_suppkey % 50 AS first_alias, 'm' || l_linenumber AS second_alias FROM lineitem), b AS (SELECT DISTINCT 'n' || s_suppkey % 7 AS name FROM supplier) SELECT id, first_alias, count(*) AS n FROM a WHERE first_alias NOT IN (SELECT name FROM b) AND second_alias NOT IN (SELECT name FROM b) GROUP BY ALL")
def labels_without_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of which no name is among the shipped ones, over all rows."""
    return _without_alias(spark, sf, table(spark, sf, "lineitem"))


def _without_alias(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    """An anti-join on exploded names."""
    a = labels.selectExpr("l_partkey % 700 AS id", "array(concat('n', l_suppkey % 50), concat('m', l_linenumber)) AS alias")
    shipped = table(spark, sf, "supplier").selectExpr("concat('n', s_suppkey % 7) AS name").distinct()
    taken = a.select("alias").distinct().select("alias", F.explode("alias").alias("name")).join(shipped, "name", "left_semi").select("alias").distinct()
    return a.join(taken, "alias", "left_anti").groupBy("id", F.get("alias", F.lit(0)).alias("first_alias")).agg(F.count(F.lit(1)).alias("n"))


# --- caches and queues ----------------------------------------------------------


def entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("space"), F.concat(F.lit("p"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"), F.col("ts").alias("accessed"), (F.col("event_id") % 97 + 1).alias("size"), "event_id", "event_type")


_ENTRIES = "e AS (SELECT user_id AS space, 'p' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS path, ts AS accessed, event_id % 97 + 1 AS size, event_id, event_type FROM events)"


@query(f"WITH {_ENTRIES}, f AS (SELECT * FROM e WHERE accessed >= TIMESTAMP '2024-01-01 06:00:00' - INTERVAL 18000 SECOND), h AS (SELECT *, sum(size) OVER (PARTITION BY space ORDER BY accessed DESC, path DESC ROWS UNBOUNDED PRECEDING) AS held FROM f) SELECT space, path, size FROM h WHERE held <= 900")
def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    live = cache.within_ttl(entries(spark, sf), "TIMESTAMP_NTZ '2024-01-01 06:00:00'", 18000)
    return cache.within_quota(live, 900, "space").select("space", "path", "size")


@query(f"""WITH {_ENTRIES}, m AS (SELECT *, event_type <> 'signup' AND row_number() OVER (PARTITION BY space ORDER BY event_id DESC) > 1 AS free, sum(size) OVER (PARTITION BY space) AS total FROM e),
b AS (SELECT *, coalesce(sum(CASE WHEN free THEN size END) OVER (PARTITION BY space ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM m) SELECT space, path FROM b WHERE free AND total - gone > 1500""")
def cache_evictions(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).select("space", "path", F.col("event_id").alias("tick"), F.col("size").alias("cost"), (F.col("event_type") == "signup").alias("protected"))
    return cache.evicted(e, 1500, "space").select("space", "path")


@query(f"WITH {_ENTRIES}, p AS (SELECT space, path, CASE WHEN event_type <> 'view' THEN size END AS priority, event_id FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY priority NULLS LAST, event_id) AS n FROM p) SELECT space, path AS item FROM r WHERE n = 1")
def queue_pick(spark: SparkSession, sf: str) -> DataFrame:
    q = entries(spark, sf).select("space", F.col("path").alias("item"), F.when(F.col("event_type") != "view", F.col("size")).alias("priority"), F.col("event_id").alias("position"))
    return cache.next_in_queue(q, "space")


@query(f"WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY event_id DESC) AS n FROM e) SELECT space, path FROM r WHERE n <= 20")
def ring_buffers(spark: SparkSession, sf: str) -> DataFrame:
    return cache.last_of(entries(spark, sf).withColumnRenamed("event_id", "position"), 20, "space").select("space", "path")


@query(f"WITH {_ENTRIES} SELECT space, size, min(event_id) AS position FROM e GROUP BY ALL")
def queue_once(spark: SparkSession, sf: str) -> DataFrame:
    return cache.first_of_each(entries(spark, sf).withColumnRenamed("event_id", "position"), "space", "size")


# --- plane ----------------------------------------------------------------------

_PLANE = f"WITH {WORLD}, s AS (SELECT id, x * 4096 AS px, y * 4096 AS py FROM world)"
RADIUS = 40.0


def plane(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions import geo

    return points(spark, sf).select("id", (geo.world_x(F.col("lon")) * 4096).alias("px"), (geo.world_y(F.col("lat")) * 4096).alias("py"))


@query(_PLANE + f" SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)), 6) AS distance FROM s a JOIN s b ON a.id < b.id AND sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= {RADIUS}")
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.near_pairs(plane(spark, sf), RADIUS).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {WORLD}, s AS (SELECT id, x * 4096 AS px, y * 4096 AS py FROM world), e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id <> b.id AND sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 20), r AS (SELECT id, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id) SELECT cluster, count(*) AS n, round(avg(px), 6) AS x, round(avg(py), 6) AS y, round(min(px), 6) AS x0, round(max(px), 6) AS x1, round(min(py), 6) AS y0, round(max(py), 6) AS y1 FROM c JOIN s USING (id) GROUP BY cluster")
def marker_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = plane(spark, sf)
    checkpointing(spark)
    c = spatial.cluster_summary(p, spatial.clusters(p, 20.0))
    return c.select("cluster", "n", *[F.round(k, 6).alias(k) for k in ("x", "y", "x0", "x1", "y0", "y1")])


@query(_PLANE + ", b AS (SELECT id, px, py, 10 + id % 30 AS hw, 5 + id % 7 AS hh FROM s) SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND abs(a.px - b.px) < a.hw + b.hw AND abs(a.py - b.py) < a.hh + b.hh")
def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    b = plane(spark, sf).select("id", F.col("px").alias("cx"), F.col("py").alias("cy"), F.expr("10 + id % 30").alias("hw"), F.expr("5 + id % 7").alias("hh"))
    return spatial.overlaps(b, 64.0)


@query()
def label_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy placement in five frames; each depends on order, so it has a brute-force test instead of SQL."""
    b = plane(spark, sf).selectExpr("id % 5 AS frame_id", "id AS label_key", "px AS cx", "py AS cy", "CAST(20 + id % 60 AS DOUBLE) AS hw", "CAST(8 + id % 9 AS DOUBLE) AS hh", "CAST(id % 4 AS INT) AS priority", "CAST(id % 7 AS INT) AS secondary", "CAST(id % 50 AS INT) AS sort_priority", "id AS group_id", "id % 11 != 0 AS enabled", "id % 6 = 0 AS was_accepted")
    return spatial.collide(b, "frame_id").select("frame_id", "label_key", "accepted")


@query()
def tile_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy cover without overlaps for each of three views."""
    t = tiles.with_ancestors(_tiles(spark, sf, 5), 2).distinct().withColumn("view", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    ranked = t.withColumn("order", F.row_number().over(W.partitionBy("view").orderBy(F.desc("z"), F.abs(F.col("x") - 8 * F.col("view")), "x", "y")))
    return spatial.cover(ranked.where("(x + y + z) % (view + 2) != 0"), "view")


# --- state ----------------------------------------------------------------------


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id AS tile", "ts", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'server' WHEN 'signup' THEN 'rate_limited' WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'not_found' ELSE 'network' END AS outcome", "CAST(event_id % 9 AS DOUBLE) AS retry_after")


_FETCH = "f AS (SELECT user_id AS tile, ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'server' WHEN 'signup' THEN 'rate_limited' WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'not_found' ELSE 'network' END AS outcome, CAST(event_id % 9 AS DOUBLE) AS retry_after FROM events)"


@query(f"""WITH {_FETCH}, r AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY tile ORDER BY ts, seq) AS run FROM f), n AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY tile, run ORDER BY ts, seq) AS failures FROM r)
SELECT tile, seq, CAST(failures AS INTEGER) AS failures, CASE outcome WHEN 'success' THEN NULL WHEN 'not_found' THEN 600 WHEN 'rate_limited' THEN greatest(retry_after, 5) ELSE least(0.5 * pow(2, least(failures - 1, 6)), 30) END::DOUBLE AS wait FROM n""")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.retries(fetches(spark, sf)).select("tile", "seq", "failures", "wait")


@query(f"WITH {_FETCH} SELECT round(max(epoch(ts) + CASE WHEN outcome = 'rate_limited' THEN greatest(retry_after, 2) END), 3) AS until FROM f")
def global_block(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.blocked_until(fetches(spark, sf)).select(F.round("until", 3).alias("until"))


@query("""WITH l AS (SELECT user_id AS key, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800 THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT key, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY key, run""")
def retention_holds(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.holds(table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"), 1800.0)


@query("WITH b AS (SELECT c_custkey AS id, c_nationkey AS value FROM customer WHERE c_custkey % 4 <> 0), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS value FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return lifecycle.snapshot_changes(c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS id", "c_nationkey AS value"), c.where("c_custkey % 7 <> 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS value"))
