"""Tiles and regions in files: an offline store, region records, tile urls and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo, text
from tilewright.functions.text import localized

REGION = "id string, sw_lat double, sw_lon double, ne_lat double, ne_lon double, z_min int, z_max int, created timestamp, stored bigint, expected bigint, bytes bigint, failed bigint"


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Write tiles (z, x, y, content); an empty one marks that there is none. Files appear whole, by the commit protocol."""
    tiles.select("z", "x", "y", "content").write.mode("append").partitionBy("z").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, status, content): ``known_empty`` for empty ones. Zooms are partitions, so a filter on z reads only these."""
    stored = spark.read.schema("x int, y int, content binary, z int").parquet(path)
    return stored.select("z", "x", "y", F.when(F.octet_length("content") == 0, "known_empty").otherwise("stored").alias("status"), "content")


def lookup(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted tiles with the store's status, ``absent`` for those that it doesn't have."""
    return wanted.join(stored, ["z", "x", "y"], "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def read_tile_files(spark: SparkSession, path: str) -> DataFrame:
    """Tiles from files z<z>/<x>_<y>.mvt."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mvt").option("recursiveFileLookup", "true").load(path)
    return files.select(text.parse_path(F.col("path")).alias("t"), "content").select("t.*", F.when(F.octet_length("content") == 0, "known_empty").otherwise("stored").alias("status"), "content").where("z IS NOT NULL")


def write_regions(regions: DataFrame, path: str) -> None:
    """Region records as JSON lines in the order of their ids, times as ISO 8601."""
    regions.orderBy("id").write.mode("overwrite").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGION).json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")


def discovered(document: Column, fallback: Column) -> Column:
    """The first tile template of a TileJSON document, the fallback if there is none."""
    return F.coalesce(F.get(F.from_json(document, "tiles array<string>")["tiles"], F.lit(0)), fallback)


def trace_lines(events: DataFrame, name: str = "name", frame: str = "frame") -> DataFrame:
    """One JSON object for each event, with its keys in order."""
    rest = sorted(c for c in events.columns)
    return events.select(F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}).alias("value"))


#: Languages of the names below, in order.
WATER_LANGUAGES = ["en", "ru", "fr", "de", "es", "it", "pt", "tr"]
#: Waters that get a label up to zoom 2, by the least zoom, class, order and place, with their names.
WATERS = [
    (0, "ocean", 20, 0.0, -150.0, ["Pacific Ocean", "Тихий океан", "Océan Pacifique", "Pazifischer Ozean", "Océano Pacífico", "Oceano Pacifico", "Oceano Pacífico", "Pasifik Okyanusu"]),
    (0, "ocean", 18, 8.0, -32.0, ["Atlantic Ocean", "Атлантический океан", "Océan Atlantique", "Atlantischer Ozean", "Océano Atlántico", "Oceano Atlantico", "Oceano Atlântico", "Atlas Okyanusu"]),
    (0, "ocean", 22, -18.0, 80.0, ["Indian Ocean", "Индийский океан", "Océan Indien", "Indischer Ozean", "Océano Índico", "Oceano Indiano", "Oceano Índico", "Hint Okyanusu"]),
    (0, "ocean", 16, 76.0, 15.0, ["Arctic Ocean", "Северный Ледовитый океан", "Océan Arctique", "Arktischer Ozean", "Océano Ártico", "Mar Glaciale Artico", "Oceano Ártico", "Arktik Okyanusu"]),
    (0, "ocean", 24, -56.0, 25.0, ["Southern Ocean", "Южный океан", "Océan Austral", "Südlicher Ozean", "Océano Austral", "Oceano Australe", "Oceano Antártico", "Güney Okyanusu"]),
    (2, "sea", 30, 35.0, 18.0, ["Mediterranean Sea", "Средиземное море", "Mer Méditerranée", "Mittelmeer", "Mar Mediterráneo", "Mar Mediterraneo", "Mar Mediterrâneo", "Akdeniz"]),
    (2, "sea", 32, 15.0, -74.0, ["Caribbean Sea", "Карибское море", "Mer des Caraïbes", "Karibisches Meer", "Mar Caribe", "Mar dei Caraibi", "Mar do Caribe", "Karayip Denizi"]),
    (2, "sea", 34, 15.0, 64.0, ["Arabian Sea", "Аравийское море", "Mer d'Arabie", "Arabisches Meer", "Mar Arábigo", "Mar Arabico", "Mar Arábico", "Umman Denizi"]),
    (2, "sea", 36, 57.0, -178.0, ["Bering Sea", "Берингово море", "Mer de Béring", "Beringmeer", "Mar de Bering", "Mare di Bering", "Mar de Bering", "Bering Denizi"]),
]
LAST_WATER_ZOOM = 2


def waters(spark: SparkSession) -> DataFrame:
    """(from_zoom, kind, sort_key, lat, lon, names by language): a local relation."""
    text = lambda x: "'" + x.replace("'", "\\'") + "'"
    names = lambda ns: "map(" + ", ".join(f"'name_{k}', {text(n)}" for k, n in zip(WATER_LANGUAGES, ns, strict=True)) + f", 'name', {text(ns[0])})"
    rows = ", ".join(f"({z}, '{kind}', {order}, {lat}D, {lon}D, {names(ns)})" for z, kind, order, lat, lon, ns in WATERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(from_zoom, kind, sort_key, lat, lon, names)")


def water_labels(tiles: DataFrame, lang: Column, present: DataFrame | None = None) -> DataFrame:
    """Tiles (z, x, y and other columns) up to zoom 2 with name, kind, sort_key, px, py of their waters by a language preference, but for
    those of which a name in any language is among the tile's own water texts ``present`` (z, x, y, text)."""
    z, side = F.col("z"), F.pow(F.lit(2.0), F.col("z"))
    low = tiles.where(z <= LAST_WATER_ZOOM)
    w = waters(tiles.sparkSession).withColumns({"wx": geo.world_x(F.col("lon")), "wy": geo.world_y(F.col("lat"))})
    # nine rows at most meet the tile that holds them: an equi-join on the place's tile
    placed = w.withColumn("z", F.explode(F.sequence("from_zoom", F.lit(LAST_WATER_ZOOM)))).withColumns({"tx": F.col("wx") * side, "ty": F.col("wy") * side})
    keyed = placed.withColumns({"x": F.floor("tx").cast("bigint"), "y": F.floor("ty").cast("bigint")})
    met = low.join(keyed, ["z", "x", "y"])
    if present is not None:
        taken = met.select("z", "x", "y", "sort_key", F.explode(F.map_values("names")).alias("text")).join(present, ["z", "x", "y", "text"], "left_semi").select("z", "x", "y", "sort_key").distinct()
        met = met.join(taken, ["z", "x", "y", "sort_key"], "left_anti")
    place = lambda t, o: F.round((F.col(t) - F.col(o)) * 4096).cast("int")
    return met.select(*tiles.columns, localized(F.col("names"), lang, r"\p{L}'").alias("name"), "kind", "sort_key", place("tx", "x").alias("px"), place("ty", "y").alias("py"))


def background(z: int, x: int, y: int, spark: SparkSession, cells: int = 64) -> DataFrame:
    """A grid of vertices over one tile, (cells + 1) squared."""
    step = 4096 // cells
    line = F.sequence(F.lit(0), F.lit(cells))
    return spark.range(1).select(F.explode(line).alias("i")).select("i", F.explode(line).alias("j")).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"), (F.col("i") * step).alias("px"), (F.col("j") * step).alias("py"))
