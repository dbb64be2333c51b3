"""Labels: which are drawn, in what order, how many of a tile, and which source of a label wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
RANK_OFFSETS = {"place": 0, "water": 20_000, "peak": 40_000, "aerodrome": 40_000, "poi": 50_000}
BUDGETS = {"reduced": {"anchor": 12, "poi": 12}, "minimal": {"anchor": 4, "poi": 0}}
FULL_POI_ZOOM = 14.5
UNRANKED, MOST_RANK, POI_ZOOM, OVERVIEW_ZOOM = 64, 64, 13, 4
POI_BIAS = {
    -1000: ["hospital", "railway", "aerodrome", "university", "college", "stadium", "museum", "zoo", "attraction", "harbor", "monument", "castle"],
    -4: ["school", "theatre", "cinema", "lodging", "town_hall", "townhall", "library", "police", "fire_station", "pharmacy", "grocery", "park", "place_of_worship", "post", "bank", "campsite"],
    8: ["garden", "playground", "swimming_pool", "kindergarten", "sport"],
    40: ["bus", "bicycle_rental", "bicycle_rent", "parking", "fuel", "charging_station", "car", "car_rental", "atm"],
}


def collision_priority(category: Column, sort_key: Column) -> Column:
    offset = F.lit(0)
    for k, n in RANK_OFFSETS.items():
        offset = F.when(category == k, n).otherwise(offset)
    return offset + sort_key


def sort_key(rank: Column) -> Column:
    return F.coalesce(rank, F.lit(1000))


def includes(layer: Column, name: Column, kind: Column, zoom: Column, rank: Column, capital: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Whether a point of a layer is labelled at a zoom."""
    kind = F.lower(kind)
    major = F.coalesce(capital, F.lit(False))
    place = (
        F.when(zoom <= 2, kind.isin("continent", "country", "ocean"))
        .when(zoom == 3, kind.isin("continent", "country", "city") | major)
        .when(zoom <= OVERVIEW_ZOOM, kind.isin("continent", "country", "state", "province", "city") | major)
        .otherwise(True)
    )
    poi = (zoom >= POI_ZOOM) & (F.coalesce(rank, F.lit(0)) <= MOST_RANK)
    if excluded:
        poi = poi & ~F.coalesce(kind.isin(*excluded), F.lit(False))
    named = F.coalesce(name, F.lit("")) != ""
    shown = F.when(layer == "place", F.coalesce(place, major, F.lit(False))).when(layer == "water_name", (zoom > OVERVIEW_ZOOM) | F.coalesce(kind.isin("ocean", "sea"), F.lit(False))).when(layer.isin("mountain_peak", "aerodrome_label"), True).when(layer == "poi", poi).otherwise(False)
    return (layer == "housenumber") | (named & shown)


def poi_bias(kind: Column, subclass: Column) -> Column:
    def of(c: Column) -> Column:
        out = None
        for n, names in POI_BIAS.items():
            out = F.when(c.isin(*names), n) if out is None else out.when(c.isin(*names), n)
        return out

    return F.coalesce(of(F.lower(subclass)), of(F.lower(kind)), F.lit(0))


def poi_reveal_zoom(zoom: Column, rank: Column, bias: Column, has_icon: Column, iconless_zoom: float, floor_zoom: float) -> Column:
    """The camera zoom from which a point of interest shows."""
    delayed = zoom + F.log2(F.greatest(F.lit(1.0), F.coalesce(rank, F.lit(UNRANKED)) + bias)) / 2
    held = F.when(has_icon, delayed).otherwise(F.greatest(delayed, F.lit(iconless_zoom)))
    return F.greatest(F.least(held, zoom + 3.5), F.lit(floor_zoom))


def draw_order(labels: DataFrame, *tile: str) -> DataFrame:
    """``place`` of each label of a tile: by collision priority, sort key and input order."""
    return labels.withColumn("place", F.row_number().over(W.partitionBy(*tile).orderBy("collision_priority", "sort_key", "input_pos")))


def budgeted(labels: DataFrame, *tile: str) -> DataFrame:
    """Labels that fit their tile's tier (full, reduced, minimal), as ``shown`` full or icon.

    A point of interest of a reduced tile is drawn whole if it shows early enough, as an
    icon if it has one, else not at all, and is counted after that. House numbers are
    drawn in full tiles only. Of each tile and kind the first come first.
    """
    poi, house = F.col("category") == "poi", F.col("category") == "housenumber"
    late = poi & (F.col("tier") == "reduced") & (F.col("min_camera_zoom") > FULL_POI_ZOOM)
    shown = F.when(house & (F.col("tier") != "full"), None).when(late, F.when(F.col("has_icon"), "icon")).otherwise("full")
    kept = labels.withColumn("shown", shown).where(F.col("shown").isNotNull()).withColumn("counted", F.when(poi, "poi").otherwise("anchor"))
    budget = F.lit(None).cast("int")
    for tier, sizes in BUDGETS.items():
        for k, n in sizes.items():
            budget = F.when((F.col("tier") == tier) & (F.col("counted") == k), n).otherwise(budget)
    nth = F.row_number().over(W.partitionBy(*tile, "counted").orderBy("collision_priority", "sort_key", "input_pos"))
    return kept.withColumn("nth", nth).withColumn("budget", budget).where(F.col("budget").isNull() | (F.col("nth") <= F.col("budget"))).drop("counted", "nth", "budget")


def source_rank(exact: Column, live: Column) -> Column:
    return F.when(exact & live, 0).when(exact, 1).when(live, 2).otherwise(3)


def winners(sources: DataFrame) -> DataFrame:
    """Of each label key the source that wins: best rank, finest tier, deepest zoom, then x, y, loop. One pass of partial aggregation."""
    order = F.struct(source_rank(F.col("is_exact"), F.col("is_live")).alias("rank"), "tier_order", (-F.col("z")).alias("nz"), "x", "y", "loop")
    return sources.groupBy("label_key").agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("n_sources")).select("label_key", "w.rank", "w.tier_order", (-F.col("w.nz")).alias("z"), "w.x", "w.y", "w.loop", "n_sources")
