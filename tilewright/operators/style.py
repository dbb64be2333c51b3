"""Classification of features by rules, and what follows for roads and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The zoom from which a road class shows.
ROAD_ZOOMS = {"motorway": 5, "trunk": 5, "primary": 7, "ferry": 8, "secondary": 9, "tertiary": 10, "rail": 10, "transit": 10, "service": 13, "path": 14, "track": 14}
OTHER_ROAD_ZOOM = 12
#: Words that make a park layer's feature green.
PARK_WORDS = ["park", "парк", "garden", "сад", "reserve", "заповедник", "nature"]
#: Land cover that shows, and the kinds of grass that still do where generic grass doesn't.
COVERS = ["wood", "forest", "grass", "farmland", "wetland", "ice", "sand"]
GRASSES = ["park", "garden", "recreation_ground", "golf_course", "cemetery", "meadow", "grassland", "nature_reserve", "dog_park", "pitch", "playground"]
LEVEL_METRES = 3.2


def road_rules(spark: SparkSession) -> DataFrame:
    """(class, min_zoom): a fixed table, small enough that Spark broadcasts it by itself."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {z})" for k, z in ROAD_ZOOMS.items()) + " AS rules(class, min_zoom)")


def visible_roads(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Features (class, zoom) that show at their zoom, and from which zoom they do."""
    return features.join(rules, "class", "left").withColumn("min_zoom", F.coalesce("min_zoom", F.lit(OTHER_ROAD_ZOOM))).where("zoom >= min_zoom")


def land_shows(layer: Column, kind: Column, subclass: Column, zoom: Column) -> Column:
    """Land cover from zoom 10, of known classes only (rock is the ground itself); from zoom 13 no grass but of a subclass that is a real green."""
    real = ~(kind == "grass") | (zoom < 13) | F.coalesce(subclass.isin(GRASSES), F.lit(False))
    cover = (zoom >= 10) & F.coalesce(kind.isin(COVERS) & real, F.lit(False))
    return F.when(layer == "landcover", cover).when(layer == "landuse", zoom >= 6).otherwise(True)


def boundary_shows(admin_level: Column, zoom: Column) -> Column:
    level = F.coalesce(admin_level, F.lit(4))
    return (level <= 4) & ((level <= 2) | (zoom >= 4))


def is_park(kind: Column, subclass: Column) -> Column:
    """Whether class or subclass holds one of the words, as they are written."""
    return F.concat_ws(" ", kind, subclass).rlike("|".join(PARK_WORDS))


def structure(underground: Column, tunnel: Column, bridge: Column, location: Column, build: Column, brunnel: Column, layer: Column) -> Column:
    """tunnel, bridge or ground; tunnel wins."""
    no, low = F.lit(False), lambda c: F.coalesce(F.lower(c), F.lit(""))
    where, level = low(location), F.coalesce(layer, F.lit(0))
    below = F.coalesce(underground, no) | F.coalesce(tunnel, no) | where.rlike("underground|subterranean|tunnel|underwater") | (low(build) == "tunnel") | (low(brunnel) == "tunnel") | (level < 0)
    above = F.coalesce(bridge, no) | (low(build) == "bridge") | (low(brunnel) == "bridge") | where.rlike("bridge|elevated") | (level > 0)
    return F.when(below, "tunnel").when(above, "bridge").otherwise("ground")


def extrusion(height: Column, levels: Column, base: Column, base_levels: Column, fallback: Column | float = 0.0, scale: Column | float = 1.0) -> Column:
    """(base, top): heights in metres, else storeys, else ``fallback``, times ``scale``; the base is between 0 and the
    height. Null where nothing states a height and there is no fallback, or where the height isn't above 0."""
    fallback, scale = (x if isinstance(x, Column) else F.lit(x) for x in (fallback, scale))
    top = F.coalesce(height, levels * LEVEL_METRES, fallback)
    low = F.coalesce(base, base_levels * LEVEL_METRES, F.lit(0.0))
    made = F.struct(F.greatest(F.least(low * scale, top * scale), F.lit(0.0)).alias("base"), (top * scale).alias("top"))
    return F.when(top > 0, made)


def zoom_scale(tile_zoom: Column, anchor_zoom: Column | int) -> Column:
    """What a height in a tile is multiplied by, relative to the zoom that heights are given for."""
    return F.pow(F.lit(2.0), tile_zoom - anchor_zoom)


def passes(features: DataFrame) -> DataFrame:
    """A row for each line pass of a feature: casing first where the line has one, then the line."""
    one = lambda name, extra: F.struct(F.lit(name).alias("role"), (F.col("width") + extra).alias("pass_width"))
    return features.withColumn("pass", F.explode(F.when(F.col("cased"), F.array(one("casing", 2.0), one("line", 0.0))).otherwise(F.array(one("line", 0.0))))).select("*", "pass.*").drop("pass")


def standalone(outlines: DataFrame, parts: DataFrame) -> DataFrame:
    """Buildings drawn as they are: those without parts of their id and whose footprint no part has."""
    return outlines.join(parts.select("building_id").distinct(), "building_id", "left_anti").join(parts.select("footprint").distinct(), "footprint", "left_anti")


def measured_first(crossings: DataFrame, *group: str) -> DataFrame:
    """Crossings of a layer; where any is measured, those derived from tags are left out."""
    some = crossings.groupBy(*group).agg(F.bool_or("measured").alias("any_measured"))
    return crossings.join(some, list(group)).where(F.col("measured") | ~F.col("any_measured")).drop("any_measured")
