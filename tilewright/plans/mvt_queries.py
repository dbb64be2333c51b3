"""Vector tiles: features of the tables are encoded, and what is read from the bytes must be what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import typed
from tilewright.plans.registry import query, table
from tilewright.sources import mvt, store

E = F.expr


def _value(**kinds: str) -> Column:
    """A property value, by kind of field; the others are null."""
    types = {"s": "STRING", "f": "FLOAT", "d": "DOUBLE", "i": "BIGINT", "u": "DECIMAL(20,0)", "si": "BIGINT", "b": "BOOLEAN"}
    return E(f"CAST(named_struct({', '.join(f"'{k}', CAST({kinds.get(k, 'NULL')} AS {t})" for k, t in types.items())}) AS {typed.VALUE})")


def _pts(*pairs: tuple[str, str]) -> Column:
    return F.array(*[F.struct(E(f"CAST({x} AS INT)").alias("x"), E(f"CAST({y} AS INT)").alias("y")) for x, y in pairs])


def point_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """A point for each part, with a property of each kind; every fourth has no id."""
    kinds = {"name": _value(s="p_name"), "size": _value(i="p_size - 25"), "price": _value(d="p_retailprice"), "half": _value(f="p_size / 2"), "key": _value(u="p_partkey"), "turn": _value(si="25 - p_size"), "odd": _value(b="p_partkey % 2 = 1")}
    p = table(spark, sf, "part").selectExpr("*", "6 AS z", "p_partkey % 16 AS x", "p_size % 8 AS y", "concat('layer', p_partkey % 3) AS layer", "IF(p_partkey % 3 = 1, 8192L, 4096L) AS extent", "CAST(p_partkey AS INT) AS feature_idx", "CAST(IF(p_partkey % 4 > 0, p_partkey, NULL) AS DECIMAL(20,0)) AS feature_id", "'point' AS geom_type")
    props = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)])
    return mvt.encoded(p.withColumns({"props": props, "parts": F.array(_pts(("p_partkey * 7 % 5000 - 400", "p_size * 90 - 100")))}))


@query("""SELECT 6 AS z, CAST(p_partkey % 16 AS INTEGER) AS x, CAST(p_size % 8 AS INTEGER) AS y, 'layer' || p_partkey % 3 AS layer, CASE WHEN p_partkey % 4 > 0 THEN p_partkey ELSE 0 END AS id, p_partkey % 4 > 0 AS has_id, p_name AS name, CAST(p_size - 25 AS BIGINT) AS size, p_retailprice AS price, p_size / 2.0::DOUBLE AS half, p_partkey AS key, CAST(25 - p_size AS BIGINT) AS turn, p_partkey % 2 = 1 AS odd,
  CAST(round((p_partkey * 7 % 5000 - 400) / CASE WHEN p_partkey % 3 = 1 THEN 2.0 ELSE 1.0 END) AS BIGINT) AS px, CAST(4096 - round((p_size * 90 - 100) / CASE WHEN p_partkey % 3 = 1 THEN 2.0 ELSE 1.0 END) AS BIGINT) AS py FROM part""")
def vector_tile_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points from bytes: layers, ids, properties of every kind, coordinates in units of 4096, y up."""
    f = mvt.geometry(mvt.features(point_tiles(spark, sf)))
    v = lambda k, kind: F.col("props")[k][kind]
    at = F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))
    place = lambda c: mvt.normalized(at[c], F.col("extent"))
    return f.select("z", "x", "y", "layer", F.col("feature_id").cast("bigint").alias("id"), "has_id", v("name", "s").alias("name"), v("size", "i").alias("size"), v("price", "d").alias("price"), v("half", "f").cast("double").alias("half"), v("key", "u").cast("bigint").alias("key"), v("turn", "si").alias("turn"), v("odd", "b").alias("odd"), place("x").alias("px"), mvt.flipped(place("y")).alias("py"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'line' ELSE 'point' END AS kind, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 + c_custkey % 2 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS n_parts, CAST(CASE c_custkey % 3 WHEN 0 THEN 4 + 4 * (c_custkey % 2) WHEN 1 THEN 5 ELSE 3 END AS BIGINT) AS n_points,
  CASE c_custkey % 3 WHEN 0 THEN 100 * 80 - (c_custkey % 2) * 20 * 10 ELSE 0 END::DOUBLE AS area, round(CASE c_custkey % 3 WHEN 1 THEN 50 + 120 + sqrt(30 * 30 + 40 * 40) ELSE 0 END::DOUBLE, 6) AS length, c_custkey % 5 AS x, c_name AS name FROM customer""")
def vector_tile_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Rings with holes, lines of several parts and point clouds from bytes; a tile that holds none gives no row, one that is cut off gives its error."""
    from tilewright.operators import geometry

    outer = _pts(("c_custkey % 900", "7"), ("c_custkey % 900 + 100", "7"), ("c_custkey % 900 + 100", "87"), ("c_custkey % 900", "87"))
    hole = _pts(("c_custkey % 900 + 30", "20"), ("c_custkey % 900 + 30", "30"), ("c_custkey % 900 + 50", "30"), ("c_custkey % 900 + 50", "20"))
    lines = F.array(_pts(("-5", "c_custkey % 70"), ("25", "c_custkey % 70 + 40"), ("25", "c_custkey % 70 + 160")), _pts(("0", "0"), ("50", "0")))
    parts = F.when(E("c_custkey % 3 = 0"), F.when(E("c_custkey % 2 = 1"), F.array(outer, hole)).otherwise(F.array(outer))).when(E("c_custkey % 3 = 1"), lines).otherwise(F.array(_pts(("1", "2"), ("c_custkey % 4000", "-3"), ("9", "9"))))
    c = table(spark, sf, "customer").selectExpr("*", "3 AS z", "c_custkey % 5 AS x", "c_nationkey % 4 AS y", "'shapes' AS layer", "4096L AS extent", "CAST(c_custkey AS INT) AS feature_idx", "CAST(c_custkey AS DECIMAL(20,0)) AS feature_id", "CASE c_custkey % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'line' ELSE 'point' END AS geom_type")
    tiles = mvt.encoded(c.withColumns({"props": F.create_map(F.lit("name"), _value(s="c_name")), "parts": parts}))
    f = mvt.geometry(mvt.features(tiles)).where("error IS NULL").withColumn("flat", F.flatten("parts"))
    measured = lambda of: F.aggregate(F.transform("flat", of), F.lit(0.0), lambda a, x: a + x)
    as_doubles = lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    f = f.withColumn("flat", F.transform("flat", as_doubles))
    area = F.when(F.col("geom_type") == "polygon", measured(geometry.signed_area)).otherwise(0.0)
    length = F.when(F.col("geom_type") == "line", measured(geometry.length)).otherwise(0.0)
    return f.select(F.col("feature_id").cast("bigint").alias("id"), F.col("geom_type").alias("kind"), F.size("flat").cast("bigint").alias("n_parts"), F.size(F.flatten("flat")).cast("bigint").alias("n_points"), area.alias("area"), F.round(length, 6).alias("length"), F.col("x").cast("bigint").alias("x"), F.col("props")["name"]["s"].alias("name"))


@query("""WITH l AS (SELECT unnest(['en', 'ru', 'fr', 'de', 'tr', 'xx']) AS lang), w AS (SELECT * FROM (VALUES (20, 0.0, -150.0, 0, ['Pacific Ocean', 'Тихий океан', 'Océan Pacifique', 'Pazifischer Ozean', 'Pasifik Okyanusu', 'Pacific Ocean']), (18, 8.0, -32.0, 0, ['Atlantic Ocean', 'Атлантический океан', 'Océan Atlantique', 'Atlantischer Ozean', 'Atlas Okyanusu', 'Atlantic Ocean']), (22, -18.0, 80.0, 0, ['Indian Ocean', 'Индийский океан', 'Océan Indien', 'Indischer Ozean', 'Hint Okyanusu', 'Indian Ocean']),
 (16, 76.0, 15.0, 0, ['Arctic Ocean', 'Северный Ледовитый океан', 'Océan Arctique', 'Arktischer Ozean', 'Arktik Okyanusu', 'Arctic Ocean']), (24, -56.0, 25.0, 0, ['Southern Ocean', 'Южный океан', 'Océan Austral', 'Südlicher Ozean', 'Güney Okyanusu', 'Southern Ocean']), (30, 35.0, 18.0, 2, ['Mediterranean Sea', 'Средиземное море', 'Mer Méditerranée', 'Mittelmeer', 'Akdeniz', 'Mediterranean Sea']),
 (32, 15.0, -74.0, 2, ['Caribbean Sea', 'Карибское море', 'Mer des Caraïbes', 'Karibisches Meer', 'Karayip Denizi', 'Caribbean Sea']), (34, 15.0, 64.0, 2, ['Arabian Sea', 'Аравийское море', 'Mer d''Arabie', 'Arabisches Meer', 'Umman Denizi', 'Arabian Sea']), (36, 57.0, -178.0, 2, ['Bering Sea', 'Берингово море', 'Mer de Béring', 'Beringmeer', 'Bering Denizi', 'Bering Sea'])) v(sort_key, lat, lon, least, names)),
t AS (SELECT CAST(n_nationkey % 4 AS INTEGER) AS z, n_nationkey AS tile, ['en', 'ru', 'fr', 'de', 'tr', 'xx'][n_nationkey % 6 + 1] AS lang, n_nationkey % 6 + 1 AS k FROM nation),
p AS (SELECT t.*, w.*, (lon + 180) / 360 * pow(2, z) AS tx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z) AS ty FROM t JOIN w ON z <= 2 AND z >= least)
SELECT tile, z, CAST(floor(tx) AS BIGINT) AS x, CAST(floor(ty) AS BIGINT) AS y, names[k] AS name, CAST(sort_key AS INTEGER) AS sort_key, CAST(round((tx - floor(tx)) * 4096) AS INTEGER) AS px, CAST(round((ty - floor(ty)) * 4096) AS INTEGER) AS py FROM p""")
def low_zoom_waters(spark: SparkSession, sf: str) -> DataFrame:
    """Names of oceans and seas on the tiles of a low zoom, all of them, in a language for each nation."""
    lang = "element_at(array('en', 'ru', 'fr', 'de', 'tr', 'xx'), CAST(n_nationkey % 6 + 1 AS INT)) AS lang"
    n = table(spark, sf, "nation").selectExpr("n_nationkey AS tile", "CAST(n_nationkey % 4 AS INT) AS z", lang)
    side = n.withColumn("x", F.explode(E("sequence(0L, shiftleft(1L, z) - 1)"))).withColumn("y", F.explode(E("sequence(0L, shiftleft(1L, z) - 1)")))
    return store.water_labels(side, F.col("lang")).select("tile", "z", "x", "y", "name", "sort_key", "px", "py")
