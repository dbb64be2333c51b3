"""Typed properties, names, styles and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import text, typed
from tilewright.operators import labels, style
from tilewright.plans.registry import query, table

E = F.expr
#: One property for each part, of a kind that its key tells.
STRINGS = ["yes", "0", "12", "-7", "abc", "3.5 m", "10 ft", "True", " 8 ", "no"]
_STR = "CASE (p_partkey // 7) % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STRINGS)) + " END"
_V = f"""v AS (SELECT p_partkey AS id, p_partkey % 7 AS k, CASE WHEN p_partkey % 7 = 0 THEN {_STR} END AS s, CASE WHEN p_partkey % 7 = 1 THEN p_partkey % 5 - 2 + 0.5 END::DOUBLE AS f,
  CASE WHEN p_partkey % 7 = 2 THEN p_partkey % 9 - 4.25 END::DOUBLE AS d, CASE WHEN p_partkey % 7 = 3 THEN p_partkey % 11 - 5 END AS i, CASE WHEN p_partkey % 7 = 4 THEN p_partkey % 13 END AS u, CASE WHEN p_partkey % 7 = 5 THEN p_partkey % 6 - 3 END AS si, CASE WHEN p_partkey % 7 = 6 THEN (p_partkey // 7) % 2 = 0 END AS b FROM part)"""


def values(spark: SparkSession, sf: str) -> DataFrame:
    when = lambda n, e, t: E(f"CAST(CASE WHEN p_partkey % 7 = {n} THEN {e} END AS {t})")
    v = F.struct(
        when(0, _STR.replace("//", "DIV"), "string").alias("s"), when(1, "p_partkey % 5 - 2 + 0.5", "float").alias("f"), when(2, "p_partkey % 9 - 4.25", "double").alias("d"), when(3, "p_partkey % 11 - 5", "bigint").alias("i"),
        when(4, "p_partkey % 13", "decimal(20,0)").alias("u"), when(5, "p_partkey % 6 - 3", "bigint").alias("si"), when(6, "(p_partkey DIV 7) % 2 = 0", "boolean").alias("b"),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), v.alias("v"))


@query(f"""WITH {_V} SELECT id, CASE k WHEN 6 THEN b WHEN 4 THEN u <> 0 WHEN 5 THEN si <> 0 WHEN 3 THEN i <> 0 WHEN 1 THEN f <> 0 WHEN 2 THEN d <> 0 WHEN 0 THEN CASE WHEN lower(s) IN ('yes', 'true') THEN true WHEN lower(s) IN ('no', '0') THEN false END END AS as_bool,
  CAST(CASE k WHEN 3 THEN i WHEN 5 THEN si WHEN 4 THEN u WHEN 1 THEN trunc(f) WHEN 2 THEN trunc(d) WHEN 0 THEN CASE s WHEN '0' THEN 0 WHEN '12' THEN 12 WHEN '-7' THEN -7 END END AS BIGINT) AS as_int,
  CAST(CASE k WHEN 3 THEN i WHEN 5 THEN si WHEN 4 THEN u WHEN 1 THEN trunc(f) WHEN 2 THEN trunc(d) WHEN 0 THEN CASE s WHEN '0' THEN 0 WHEN '12' THEN 12 WHEN '-7' THEN -7 WHEN ' 8 ' THEN 8 END END AS BIGINT) AS as_int_trimmed,
  CAST(CASE WHEN k = 4 THEN u WHEN k = 5 AND si >= 0 THEN si WHEN k = 3 AND i >= 0 THEN i WHEN s = '0' THEN 0 WHEN s = '12' THEN 12 END AS BIGINT) AS as_uint,
  round(CASE k WHEN 1 THEN f WHEN 2 THEN d WHEN 3 THEN i WHEN 4 THEN u WHEN 5 THEN si WHEN 0 THEN CASE s WHEN '0' THEN 0 WHEN '12' THEN 12 WHEN '-7' THEN -7 WHEN '3.5 m' THEN 3.5 WHEN '10 ft' THEN 3.048 WHEN ' 8 ' THEN 8 END END::DOUBLE, 6) AS numeric_value FROM v""")
def typed_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return values(spark, sf).select("id", typed.as_bool(v).alias("as_bool"), typed.as_int(v).alias("as_int"), typed.as_int_public(v, trim=True).alias("as_int_trimmed"), typed.as_uint(v).cast("bigint").alias("as_uint"), F.round(typed.numeric(v), 6).alias("numeric_value"))


@query("""SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 3 WHEN p_partkey % 5 = 1 THEN p_partkey * 2 WHEN p_partkey % 5 = 2 THEN p_size ELSE p_partkey + 1000000 END AS BIGINT) AS building FROM part""")
def building_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The id of a building, by precedence of its properties."""
    value = lambda e: E(f"CAST(named_struct('s', CAST(NULL AS STRING), 'f', CAST(NULL AS FLOAT), 'd', CAST(NULL AS DOUBLE), 'i', CAST({e} AS BIGINT), 'u', CAST(NULL AS DECIMAL(20,0)), 'si', CAST(NULL AS BIGINT), 'b', CAST(NULL AS BOOLEAN)) AS {typed.VALUE})")
    p = table(spark, sf, "part")
    third = F.when(F.col("p_partkey") % 5 == 2, F.create_map(F.lit("building_id"), value("p_size"))).otherwise(F.create_map(F.lit("other"), value("1")))
    props = F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("osm_id"), value("p_partkey * 3"), F.lit("id"), value("-1"))).when(F.col("p_partkey") % 5 == 1, F.create_map(F.lit("osm_id"), value("-5"), F.lit("id"), value("p_partkey * 2"))).otherwise(third)
    return p.select(F.col("p_partkey").alias("id"), typed.building_id(props, F.col("p_partkey") + 1000000).cast("bigint").alias("building"))


@query("""SELECT p_partkey AS id, concat_ws(':', nullif(lower(trim(p_type)), ''), nullif(lower(trim(p_brand)), '')) AS kind, CASE WHEN p_type LIKE '%_construction' THEN left(p_type, length(p_type) - 13) ELSE p_type END AS road,
  CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-br' WHEN 2 THEN 'de' ELSE 'zh-hant!' END AS lang, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' WHEN 2 THEN 'de' ELSE 'zh' END AS base, CASE p_partkey % 4 WHEN 3 THEN 'zh-hant_' WHEN 0 THEN 'en' WHEN 1 THEN 'pt-br' ELSE 'de' END AS ns FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_type || '_construction' ELSE p_type END AS p_type FROM part)""")
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("_construction"))).otherwise(F.col("p_type")))
    code = E("CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' pt_BR ' WHEN 2 THEN 'DE' ELSE 'zh-Hant!' END")
    return p.select(F.col("p_partkey").alias("id"), text.kind(F.col("p_type"), F.col("p_brand"), F.lit(" ")).alias("kind"), text.without_construction(F.col("p_type")).alias("road"), text.language(code).alias("lang"), text.base_language(code).alias("base"), text.namespace(code).alias("ns"))


@query("""WITH d AS (SELECT doc_id AS id, CASE WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'nom ' || doc_id WHEN lang = 'de' AND doc_id % 3 = 0 THEN 'Name ' || doc_id WHEN lang = 'en' AND doc_id % 5 <> 0 THEN 'English ' || doc_id END AS own, CASE WHEN doc_id % 5 <> 0 THEN 'English ' || doc_id END AS english, CASE WHEN doc_id % 7 <> 0 THEN 'local ' || doc_id END AS local FROM documents)
SELECT id, coalesce(own, english, local) AS label, coalesce(own, local, english) AS local_first FROM d""")
def localized_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names by language preference, then English and the local one, or the local one and English; one with letters that can't be shown is passed over."""
    d = table(spark, sf, "documents")
    local = E("CASE WHEN doc_id % 7 <> 0 THEN concat('local ', doc_id) ELSE 'Москва' END")
    names = F.map_from_arrays(F.array(F.lit("name_fr"), F.lit("name:de"), F.lit("name_en"), F.lit("name")), F.array(E("CASE WHEN doc_id % 2 = 0 THEN concat('nom ', doc_id) ELSE '名前' END"), E("CASE WHEN doc_id % 3 = 0 THEN concat('Name ', doc_id) ELSE '' END"), E("CASE WHEN doc_id % 5 <> 0 THEN concat('English ', doc_id) END"), local))
    return d.select(F.col("doc_id").alias("id"), text.localized(names, F.col("lang"), "A-Za-z0-9").alias("label"), text.localized(names, F.col("lang"), "A-Za-z0-9", local_first=True).alias("local_first"))


@query("""SELECT page_id AS id, url || '?x=1&token=REDACTED&y=2' AS redacted, 'https://t.example/' || page_id % 7 || '/' || page_id || '/3.mvt' AS filled, 'cache/' || page_id % 7 || '/' || page_id || '/3.mvt' AS path, CAST(page_id % 7 AS INTEGER) AS z, CAST(page_id AS INTEGER) AS x, 'HTTP 404: gone ' || page_id AS message FROM pages""")
def urls_and_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    z, x, y = E("page_id % 7"), F.col("page_id"), F.lit(3)
    back = text.parse_path(F.concat(F.lit("store/z"), z.cast("string"), F.lit("/"), x.cast("string"), F.lit("_3.mvt")))
    body = F.concat(F.lit('{"message":"gone '), x.cast("string"), F.lit('"}'))
    return p.select(x.alias("id"), text.redacted(F.concat("url", F.lit("?x=1&token=abc%20d&y=2"))).alias("redacted"), text.fill_template(F.lit("https://t.example/{z}/{x}/{y}.mvt"), z, x, y).alias("filled"), text.tile_path(F.lit("cache/"), z, x, y).alias("path"), back["z"].alias("z"), back["x"].alias("x"), text.server_message(F.lit(404), body).alias("message"))


CLASSES = ["motorway", "primary", "service", "path", "residential", "rail", "secondary"]
_CLASS = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
_ROADS = f"SELECT l_orderkey, l_linenumber, {_CLASS} AS class, CAST(l_quantity AS INTEGER) % 12 + 4 AS zoom, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


def roads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_CLASS} AS class", "CAST(l_quantity AS INT) % 12 + 4 AS zoom", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(f"""WITH r AS ({_ROADS}), m AS (SELECT *, CASE class WHEN 'motorway' THEN 5 WHEN 'primary' THEN 7 WHEN 'service' THEN 13 WHEN 'path' THEN 14 WHEN 'rail' THEN 10 WHEN 'secondary' THEN 9 ELSE 12 END AS min_zoom FROM r)
SELECT class, CAST(min_zoom AS INTEGER) AS min_zoom, CAST(zoom AS INTEGER) AS zoom, count(*) AS n FROM m WHERE zoom >= min_zoom GROUP BY ALL""")
def road_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Rules are joined by class; the zoom is a residual condition."""
    return style.visible_roads(roads(spark, sf), style.road_rules(spark)).groupBy("class", "min_zoom", "zoom").agg(F.count(F.lit(1)).alias("n"))


_COVER = "['wood', 'forest', 'grass', 'farmland', 'wetland', 'ice', 'sand', 'rock', 'moor']"
_GREEN = "['park', 'garden', 'recreation_ground', 'golf_course', 'cemetery', 'meadow', 'grassland', 'nature_reserve', 'dog_park', 'pitch', 'playground', 'verge']"
_PARKS = "['national_park', 'природно-исторический_парк', 'National_Park', 'botanical garden', 'сад', 'Сад', 'reserve', 'заповедник', 'nature_monument', 'protected_area', 'сквер']"


@query(f"""SELECT p_partkey AS id, CASE WHEN k % 2 = 0 THEN z >= 10 AND CASE WHEN cover IN ('rock', 'moor') THEN false WHEN cover = 'grass' THEN z < 13 OR coalesce(sub, 'verge') <> 'verge' ELSE true END WHEN k % 4 = 1 THEN z >= 6 ELSE true END AS land, (lv <= 4 AND (lv <= 2 OR z >= 4)) AS boundary,
  kind IN ('national_park', 'природно-исторический_парк', 'botanical garden', 'сад', 'reserve', 'заповедник', 'nature_monument') AS park,
  CASE WHEN k % 5 = 0 OR lay < 0 OR k % 11 = 0 THEN 'tunnel' WHEN k % 7 = 0 OR lay > 0 THEN 'bridge' ELSE 'ground' END AS structure
FROM (SELECT *, {_COVER}[k % 9 + 1] AS cover, CASE WHEN k % 13 > 0 THEN {_GREEN}[k % 12 + 1] END AS sub, {_PARKS}[k % 11 + 1] AS kind FROM (SELECT p_partkey, p_size, p_partkey AS k, p_size % 16 AS z, CASE WHEN p_partkey % 9 = 0 THEN 4 ELSE p_partkey % 9 END AS lv, p_partkey % 3 - 1 AS lay FROM part))""")
def feature_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Which features show, and whether a road is a tunnel or a bridge. Words of parks count as they are written; rock, unknown cover and generic grass in cities don't show."""
    p = table(spark, sf, "part").withColumns({"k": F.col("p_partkey"), "z": E("p_size % 16")})
    pick = lambda values, i: E(f"element_at(array{values.replace('[', '(').replace(']', ')')}, CAST({i} AS INT))")
    land = style.land_shows(E("CASE WHEN k % 2 = 0 THEN 'landcover' WHEN k % 4 = 1 THEN 'landuse' ELSE 'water' END"), pick(_COVER, "k % 9 + 1"), F.when(E("k % 13 > 0"), pick(_GREEN, "k % 12 + 1")), F.col("z"))
    named = pick(_PARKS, "k % 11 + 1")
    park = style.is_park(F.when(E("k % 3 > 0"), named), F.when(E("k % 3 = 0"), named))
    kind = style.structure(F.lit(None).cast("boolean"), E("k % 5 = 0"), E("k % 7 = 0"), E("CASE WHEN k % 11 = 0 THEN 'Underground hall' END"), F.lit(None).cast("string"), F.lit(None).cast("string"), E("k % 3 - 1"))
    return p.select(F.col("k").alias("id"), land.alias("land"), style.boundary_shows(E("nullif(k % 9, 0)"), F.col("z")).alias("boundary"), park.alias("park"), kind.alias("structure"))


@query("""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) - 3 END AS h, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 9 AS DOUBLE) END AS l, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 12 AS DOUBLE) - 1 END AS m, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size % 4 AS DOUBLE) END AS ml, CASE WHEN p_partkey % 11 = 0 THEN 6.0 ELSE 0.0 END::DOUBLE AS f, pow(2, 14 + p_partkey % 3 - 15) AS s FROM part),
t AS (SELECT *, CASE WHEN h IS NOT NULL THEN h WHEN l IS NOT NULL THEN 3.2 * l ELSE f END AS up, CASE WHEN m IS NOT NULL THEN m WHEN ml IS NOT NULL THEN 3.2 * ml ELSE 0 END AS down FROM b)
SELECT id, CASE WHEN up > 0 THEN round(CASE WHEN down < 0 THEN 0 WHEN down > up THEN up ELSE down END * s, 6) END AS base, CASE WHEN up > 0 THEN round(up * s, 6) END AS top FROM t""")
def building_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Where buildings begin and end above ground: a base over the height is the height, and without a height there is none."""
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    every = lambda n, e: E(f"CASE WHEN k % {n} = 0 THEN CAST({e} AS DOUBLE) END")
    high = style.extrusion(every(2, "p_size - 3"), every(3, "p_size % 9"), every(5, "p_size % 12 - 1"), every(7, "p_size % 4"), E("CASE WHEN k % 11 = 0 THEN 6.0D ELSE 0.0D END"), style.zoom_scale(E("14 + k % 3"), 15))
    return p.select(F.col("k").alias("id"), F.round(high["base"], 6).alias("base"), F.round(high["top"], 6).alias("top"))


@query(f"""WITH r AS ({_ROADS}) SELECT class, role, count(*) AS n, round(sum(w), 2) AS width FROM (SELECT class, 'line' AS role, l_linenumber AS w FROM r UNION ALL SELECT class, 'casing', l_linenumber + 2.0::DOUBLE FROM r WHERE l_returnflag <> 'N') GROUP BY ALL""")
def line_passes(spark: SparkSession, sf: str) -> DataFrame:
    f = roads(spark, sf).withColumns({"cased": F.col("l_returnflag") != "N", "width": F.col("l_linenumber").cast("double")})
    return style.passes(f).groupBy("class", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pass_width"), 2).alias("width"))


@query("""WITH o AS (SELECT p_partkey AS id, p_partkey % 500 AS b, p_size * 100 + p_partkey % 7 AS f FROM part WHERE p_partkey % 2 = 0), p AS (SELECT p_partkey % 151 AS b, p_size * 100 + p_partkey % 5 AS f FROM part WHERE p_partkey % 2 = 1)
SELECT id, b AS building_id, f AS footprint FROM o WHERE b NOT IN (SELECT b FROM p) AND f NOT IN (SELECT f FROM p)""")
def buildings_without_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    outlines = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_partkey % 500 AS building_id", "p_size * 100 + p_partkey % 7 AS footprint")
    parts = p.where("p_partkey % 2 = 1").selectExpr("p_partkey % 151 AS building_id", "p_size * 100 + p_partkey % 5 AS footprint")
    return style.standalone(outlines, parts).select("id", "building_id", "footprint")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey AS tile, l_shipmode AS m FROM (SELECT *, l_partkey % 9 AS l_shipmode FROM lineitem))
SELECT l_orderkey, l_linenumber, tile FROM c WHERE m = 0 OR tile NOT IN (SELECT tile FROM c WHERE m = 0 AND l_linenumber = 1) AND m <> 0 AND tile IN (SELECT tile FROM c GROUP BY tile HAVING NOT bool_or(m = 0))""")
def crossing_precedence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS tile", "l_partkey % 9 = 0 AS measured")
    return style.measured_first(c, "tile").select("l_orderkey", "l_linenumber", "tile")


#: Labels: lineitems by part as tile, of five categories.
CATEGORIES = ["place", "water", "peak", "poi", "housenumber"]
_CAT = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
_LABELS = f"""labels AS (SELECT l_partkey % 400 AS tile, l_orderkey * 8 + l_linenumber AS input_pos, {_CAT} AS category, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS rank, 12 + (l_suppkey % 50) / 10.0::DOUBLE AS min_camera_zoom, l_suppkey % 3 = 0 AS has_icon,
  CASE l_partkey % 400 % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'reduced' ELSE 'minimal' END AS tier FROM lineitem), p AS (SELECT *, coalesce(rank, 1000) AS sort_key, coalesce(rank, 1000) + CASE category WHEN 'water' THEN 20000 WHEN 'peak' THEN 40000 WHEN 'poi' THEN 50000 ELSE 0 END AS collision_priority FROM labels)"""


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey % 400 AS tile", "l_orderkey * 8 + l_linenumber AS input_pos", f"{_CAT} AS category", "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS rank", "12 + (l_suppkey % 50) / CAST(10 AS DOUBLE) AS min_camera_zoom", "l_suppkey % 3 = 0 AS has_icon", "CASE l_partkey % 400 % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'reduced' ELSE 'minimal' END AS tier")
    key = labels.sort_key(F.col("rank"))
    return rows.withColumns({"sort_key": key, "collision_priority": labels.collision_priority(F.col("category"), key)})


@query(f"WITH {_LABELS} SELECT tile, input_pos, collision_priority, CAST(row_number() OVER (PARTITION BY tile ORDER BY collision_priority, sort_key, input_pos) AS INTEGER) AS place FROM p")
def label_draw_order(spark: SparkSession, sf: str) -> DataFrame:
    return labels.draw_order(label_rows(spark, sf), "tile").select("tile", "input_pos", "collision_priority", "place")


@query(f"""WITH {_LABELS}, s AS (SELECT *, CASE WHEN category = 'housenumber' AND tier <> 'full' THEN NULL WHEN category = 'poi' AND tier = 'reduced' AND min_camera_zoom > 14.5 THEN CASE WHEN has_icon THEN 'icon' END ELSE 'full' END AS shown FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY tile, category = 'poi' ORDER BY collision_priority, sort_key, input_pos) AS nth FROM s WHERE shown IS NOT NULL)
SELECT tile, input_pos, category, tier, shown FROM k WHERE tier = 'full' OR (tier = 'reduced' AND nth <= 12) OR (tier = 'minimal' AND category <> 'poi' AND nth <= 4)""")
def label_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return labels.budgeted(label_rows(spark, sf), "tile").select("tile", "input_pos", "category", "tier", "shown")


@query("""WITH s AS (SELECT l_partkey AS label_key, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS rank, l_linenumber % 3 AS tier_order, l_linenumber + 5 AS z, l_suppkey AS x, l_orderkey AS y, l_linenumber % 2 AS loop FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY rank, tier_order, z DESC, x, y, loop) AS n, count(*) OVER (PARTITION BY label_key) AS n_sources FROM s) SELECT label_key, rank, CAST(tier_order AS INTEGER) AS tier_order, CAST(z AS INTEGER) AS z, x, y, CAST(loop AS INTEGER) AS loop, n_sources FROM r WHERE n = 1""")
def label_source_winners(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").selectExpr("l_partkey AS label_key", "l_returnflag = 'N' AS is_exact", "l_linestatus = 'O' AS is_live", "l_linenumber % 3 AS tier_order", "l_linenumber + 5 AS z", "l_suppkey AS x", "l_orderkey AS y", "l_linenumber % 2 AS loop")
    return labels.winners(s)


@query("""WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'place' WHEN 1 THEN 'water_name' WHEN 2 THEN 'poi' WHEN 3 THEN 'housenumber' WHEN 4 THEN 'mountain_peak' ELSE 'other' END AS layer, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS name,
  CASE (p_partkey // 6) % 6 WHEN 0 THEN 'country' WHEN 1 THEN 'city' WHEN 2 THEN 'state' WHEN 3 THEN 'Ocean' WHEN 4 THEN 'village' ELSE NULL END AS kind, p_partkey % 17 AS zoom, CASE WHEN p_size > 5 THEN p_size * 2 END AS rank, p_partkey % 10 = 0 AS capital FROM part)
SELECT id, layer = 'housenumber' OR (name IS NOT NULL AND CASE layer WHEN 'place' THEN coalesce(CASE WHEN zoom <= 2 THEN lower(kind) IN ('continent', 'country', 'ocean') WHEN zoom = 3 THEN lower(kind) IN ('continent', 'country', 'city') OR capital WHEN zoom = 4 THEN lower(kind) IN ('continent', 'country', 'state', 'province', 'city') OR capital ELSE true END, capital)
  WHEN 'water_name' THEN zoom > 4 OR coalesce(lower(kind) IN ('ocean', 'sea'), false) WHEN 'poi' THEN zoom >= 13 AND coalesce(rank, 0) <= 64 AND coalesce(kind <> 'village', true) WHEN 'mountain_peak' THEN true ELSE false END) AS shown FROM f""")
def label_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    layer = E("CASE k % 6 WHEN 0 THEN 'place' WHEN 1 THEN 'water_name' WHEN 2 THEN 'poi' WHEN 3 THEN 'housenumber' WHEN 4 THEN 'mountain_peak' ELSE 'other' END")
    kind = E("CASE (k DIV 6) % 6 WHEN 0 THEN 'country' WHEN 1 THEN 'city' WHEN 2 THEN 'state' WHEN 3 THEN 'Ocean' WHEN 4 THEN 'village' END")
    return p.select(F.col("k").alias("id"), labels.includes(layer, E("CASE WHEN k % 13 <> 0 THEN p_name END"), kind, E("k % 17"), E("CASE WHEN p_size > 5 THEN p_size * 2 END"), E("k % 10 = 0"), ("village",)).alias("shown"))


@query("""WITH f AS (SELECT p_partkey AS id, 14 AS z, CASE WHEN p_partkey % 8 <> 0 THEN p_size END AS rank, CASE p_partkey % 5 WHEN 0 THEN -1000 WHEN 1 THEN -4 WHEN 2 THEN 8 WHEN 3 THEN 40 ELSE 0 END AS bias, p_partkey % 3 = 0 AS icon FROM part),
d AS (SELECT *, z + log2(greatest(1.0, coalesce(rank, 64) + bias)) / 2 AS t FROM f) SELECT id, bias, round(greatest(least(CASE WHEN icon THEN t ELSE greatest(t, 15.0) END, z + 3.5), 14.25), 6) AS reveal FROM d""")
def poi_reveal(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    bias = labels.poi_bias(E("CASE k % 5 WHEN 0 THEN 'Museum' WHEN 1 THEN 'bank' WHEN 2 THEN 'fuel' WHEN 3 THEN 'atm' ELSE 'x' END"), E("CASE WHEN k % 5 = 2 THEN 'garden' ELSE 'y' END"))
    zoom = labels.poi_reveal_zoom(F.lit(14), E("CASE WHEN k % 8 <> 0 THEN p_size END"), bias, E("k % 3 = 0"), 15.0, 14.25)
    return p.select(F.col("k").alias("id"), bias.alias("bias"), F.round(zoom, 6).alias("reveal"))
