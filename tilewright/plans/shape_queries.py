"""Shapes. What comes out is too long for SQL; measures that must hold of it aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import geometry, shapes
from tilewright.plans.registry import query, table

_STAR = "p AS (SELECT vec_id AS id, i, (100 + 20 * CAST(embedding[i + 1] AS DOUBLE)) * cos(2 * pi() * i / 24) AS x, (100 + 20 * CAST(embedding[i + 1] AS DOUBLE)) * sin(2 * pi() * i / 24) AS y FROM embeddings, (SELECT unnest(generate_series(0, 23)) AS i))"
_AREA = ", n AS (SELECT a.id, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM p a JOIN p b ON a.id = b.id AND b.i = (a.i + 1) % 24 GROUP BY a.id)"


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon of 24 corners for each vector."""
    r = lambda i: 100 + 20 * F.get("embedding", i).cast("double")
    angle = lambda i: 2 * F.pi() * i / 24
    ring = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.struct((r(i) * F.cos(angle(i))).alias("x"), (r(i) * F.sin(angle(i))).alias("y")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ring.alias("ring"))


@query(f"WITH {_STAR}{_AREA} SELECT id, round(area, 3) AS area FROM n")
def triangle_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The triangles of each polygon cover it: their areas add up to its own."""
    t = shapes.triangulated(stars(spark, sf), "ring").select("id", F.explode("triangles").alias("t"))
    return t.groupBy("id").agg(F.round(F.sum(F.abs(geometry.signed_area("t"))), 3).alias("area"))


@query("SELECT vec_id AS id, true AS same FROM embeddings")
def footprint_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A ring turned and reversed has the same key."""
    s = stars(spark, sf).withColumn("other", F.reverse(F.concat(F.slice("ring", 8, 17), F.slice("ring", 1, 7))))
    both = shapes.with_footprint(shapes.with_footprint(s, "ring", "a"), "other", "b")
    return both.select("id", (F.col("a") == F.col("b")).alias("same"))


@query(f"WITH {_STAR}, s AS (SELECT a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON a.id = b.id AND b.i = a.i + 1), t AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s), u AS (SELECT *, greatest(0, least((-90 - x0) / dx, (90 - x0) / dx), least((-90 - y0) / dy, (90 - y0) / dy)) AS t0, least(1, greatest((-90 - x0) / dx, (90 - x0) / dx), greatest((-90 - y0) / dy, (90 - y0) / dy)) AS t1 FROM t) SELECT id, round(sum(greatest(t1 - t0, 0) * sqrt(dx * dx + dy * dy)), 3) AS length FROM u GROUP BY id HAVING sum(greatest(t1 - t0, 0)) > 0")
def clipped_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each outline lies in a square."""
    c = shapes.clipped_lines(stars(spark, sf), "ring", -90.0, 90.0).select("id", F.explode("pieces").alias("p")).select("id", F.col("p.pts").alias("pts"))
    return c.groupBy("id").agg(F.round(F.sum(geometry.length("pts")), 3).alias("length")).where("length > 0")


@query(f"WITH {_STAR}, s AS (SELECT a.id, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS n FROM p a JOIN p b ON a.id = b.id AND b.i = a.i + 1 GROUP BY a.id) SELECT id, CAST(floor(n / 50) + CASE WHEN n % 50 > 0 THEN 1 ELSE 0 END AS INTEGER) AS n, round(floor(n / 50) * 30 + least(n % 50, 30), 3) AS length FROM s")
def dash_lengths(spark: SparkSession, sf: str) -> DataFrame:
    d = shapes.dashed(stars(spark, sf), "ring", 30.0, 20.0)
    each = F.aggregate(F.transform("dashes", lambda x: geometry_length(x)), F.lit(0.0), lambda a, x: a + x)
    return d.select("id", F.size("dashes").alias("n"), F.round(each, 3).alias("length"))


def geometry_length(p):
    step = lambda i: F.sqrt(F.pow(F.get(p, i + 1)["x"] - F.get(p, i)["x"], 2) + F.pow(F.get(p, i + 1)["y"] - F.get(p, i)["y"], 2))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(p) - 2), step), F.lit(0.0), lambda a, x: a + x)


_LINES = "s AS (SELECT l_suppkey AS tile, l_orderkey AS street, l_linenumber AS n, row_number() OVER w AS seq, sum(l_linenumber) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice))"


@query(f"""WITH {_LINES}, c AS (SELECT *, coalesce(sum(CASE WHEN (street + seq) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tile, street ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM s)
SELECT tile, street, CAST(min(b - n) AS DOUBLE) AS start, CAST(sum(n) AS DOUBLE) AS length, count(*) + 1 AS points FROM c GROUP BY tile, street, chain""")
def street_stitching(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of a street, each from where the last one ended, become one line, but not across a point where a road without a name ends too; a footpath there changes nothing."""
    from pyspark.sql import Window as W

    by = W.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    end = F.sum("l_linenumber").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("double")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_orderkey").alias("street"), F.row_number().over(by).alias("seq"), end.alias("b"), F.col("l_linenumber").cast("double").alias("n"))
    y = F.col("street").cast("double")
    at = lambda x, up=0.0: F.struct(x.alias("x"), (y + up).alias("y"))
    pieces = rows.select("tile", "street", "seq", F.array(at(F.col("b") - F.col("n")), at(F.col("b"))).alias("pts"), F.lit(True).alias("drives"))
    side = rows.where("(street + seq) % 3 < 2").select("tile", F.lit(None).cast("bigint").alias("street"), (F.col("seq") + 1000).alias("seq"), F.array(at(F.col("b")), at(F.col("b"), 0.5)).alias("pts"), F.expr("(street + seq) % 3 = 0").alias("drives"))
    got = shapes.stitched(pieces.unionByName(side), "tile").where("street IS NOT NULL")
    return got.select("tile", F.col("street").cast("bigint").alias("street"), F.array_min(F.transform("pts", lambda p: p["x"])).alias("start"), geometry.length("pts").alias("length"), F.size("pts").cast("bigint").alias("points"))


@query("""WITH c AS (SELECT c_custkey AS id, abs(c_acctbal) AS total, CAST(c_custkey % 400 AS DOUBLE) AS width FROM customer), f AS (SELECT *, greatest(400.0, least(width, total) / 2) AS first, total - least(width, total) / 2 AS last FROM c WHERE width > 0 AND total > 0)
SELECT id, 0 AS nth, round(total / 2, 6) AS at FROM f WHERE total <= 800 UNION ALL SELECT id, CAST(k AS INTEGER), round(first + 800 * k, 6) FROM f, generate_series(0, 6) g(k) WHERE total > 800 AND first + 800 * k <= last""")
def road_label_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Where labels stand on a street of each length: one in the middle of a short one, and others every 800 units, seven at most."""
    end = F.struct(F.abs("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), end).alias("line"), F.expr("CAST(c_custkey % 400 AS DOUBLE)").alias("width"))
    return shapes.label_anchors(rows, "line", "width").select("id", F.posexplode("anchors").alias("nth", "at")).select("id", "nth", F.round("at", 6).alias("at"))
