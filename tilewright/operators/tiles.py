"""Tile sets: ancestors, regions, placement sources and paths over tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geo

#: Zooms beyond this aren't enumerated.
DEEPEST = 30


def with_ancestors(t: DataFrame, depth: int) -> DataFrame:
    """Tiles (z, x, y) and their ancestors up to ``depth`` levels above, as far as there are any."""
    up = t.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), F.col("z").cast("int")))).alias("d"))
    return up.select((F.col("z") - F.col("d")).cast("int").alias("z"), F.expr("shiftright(x, d)").alias("x"), F.expr("shiftright(y, d)").alias("y"))


def children(t: DataFrame) -> DataFrame:
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    return t.select("z", "x", "y", quarter).select((F.col("z") + 1).cast("int").alias("z"), (2 * F.col("x") + F.col("i") % 2).alias("x"), (2 * F.col("y") + F.floor(F.col("i") / 2)).alias("y"))


def region_ranges(regions: DataFrame) -> DataFrame:
    """Rows (id, z, part, x0, x1, y0, y1): for each zoom of a region one range of columns, or two across the antimeridian.

    Regions with coordinates that aren't finite, or whose south lies north of their north, have none.
    """
    edges = [F.col(c) for c in ("sw_lat", "sw_lon", "ne_lat", "ne_lon")]
    finite = [e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")) for e in edges]
    valid = regions.where(finite[0] & finite[1] & finite[2] & finite[3] & (F.col("sw_lat") <= F.col("ne_lat")))
    low, high = geo.clamp(F.col("z_min"), 0, DEEPEST), F.least(F.col("z_max"), F.lit(DEEPEST))
    zooms = valid.where(low <= high).withColumn("z", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    n = F.pow(F.lit(2.0), F.col("z"))
    index = lambda v: geo.clamp(F.floor(v * n).cast("bigint"), 0, n.cast("bigint") - 1)
    west, east = geo.west_longitude(F.col("sw_lon")), geo.east_longitude(F.col("ne_lon"))
    found = zooms.select("id", "z", (F.col("ne_lon") - F.col("sw_lon") >= 360).alias("world"), west.alias("w"), east.alias("e"), index(geo.world_y(F.col("ne_lat"))).alias("y0"), index(geo.world_y(F.col("sw_lat"))).alias("y1"), index((west + 180) / 360).alias("a"), index((east + 180) / 360).alias("b"), (n.cast("bigint") - 1).alias("last"))
    crossing = F.col("e") < F.col("w")
    span = lambda part, x0, x1: F.struct(F.lit(part).alias("part"), x0.cast("bigint").alias("x0"), x1.cast("bigint").alias("x1"))
    whole = span(0, F.lit(0), F.col("last"))
    parts = (
        F.when(F.col("world") | crossing & (F.col("b") + 1 >= F.col("a")), F.array(whole))
        .when(crossing, F.array(span(0, F.col("a"), F.col("last")), span(1, F.lit(0), F.col("b"))))
        .otherwise(F.array(span(0, F.col("a"), F.greatest("a", "b"))))
    )
    return found.select("id", "z", "y0", "y1", F.inline(parts))


def region_tiles(regions: DataFrame) -> DataFrame:
    """Every tile of each region, with its place: zoom, row, west range first, column."""
    rows = region_ranges(regions).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).select("id", "z", "x", "y", "part")


def prunable(removed: DataFrame, remaining: DataFrame) -> DataFrame:
    """Tiles of removed regions that no remaining region has."""
    return removed.select("z", "x", "y").distinct().join(remaining, ["z", "x", "y"], "left_anti")


def progress(region_tiles: DataFrame, store: DataFrame) -> DataFrame:
    """(id, expected, stored, bytes, fraction) of regions (id, z, x, y) against stored tiles (z, x, y, bytes)."""
    met = region_tiles.join(store.select("z", "x", "y", "bytes"), ["z", "x", "y"], "left")
    sums = met.groupBy("id").agg(F.count(F.lit(1)).alias("expected"), F.count("bytes").alias("stored"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("fraction", F.round(F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col("stored") / F.col("expected"))).otherwise(0.0), 6))


def nearest_ancestor(targets: DataFrame, sources: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """Targets (z, x, y) with the deepest source tile that is the target or covers it, nulls if none: an equi-join on ancestor keys."""
    up = targets.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), F.col("z").cast("int")))).alias("d"))
    keyed = up.select("z", "x", "y", (F.col("z") - F.col("d")).cast("int").alias("sz"), F.expr("shiftright(x, d)").alias("sx"), F.expr("shiftright(y, d)").alias("sy"))
    s = sources.select(F.col("z").cast("int").alias("sz"), F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()
    best = keyed.join(s, ["sz", "sx", "sy"], "left_semi").groupBy("z", "x", "y").agg(F.max(F.struct("sz", "sx", "sy")).alias("s"))
    return targets.join(best, ["z", "x", "y"], "left").select("z", "x", "y", "s.sz", "s.sx", "s.sy")


def covered_share(targets: DataFrame, ready: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(z, x, y, share): how much of each target its ready descendants cover, at every depth unless one is given; nested ones count once."""
    r = ready.select(F.col("z").cast("int").alias("rz"), F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    up = r.select("rz", "rx", "ry", F.explode(F.when(F.col("rz") > 0, F.sequence(F.lit(1), F.least(F.lit(depth), F.col("rz"))))).alias("d")).select("rz", "rx", "ry", "d", (F.col("rz") - F.col("d")).alias("z"), F.expr("shiftright(rx, d)").alias("x"), F.expr("shiftright(ry, d)").alias("y"))
    below = targets.withColumn("z", F.col("z").cast("int")).join(up, ["z", "x", "y"])
    # a ready tile below another ready one of the same target is nested
    inner = below.alias("a").select("z", "x", "y", "rz", "rx", "ry", "d", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("k"))
    held = inner.select("z", "x", "y", "rz", "rx", "ry", "d", (F.col("rz") - F.col("k")).alias("kz"), F.expr("shiftright(rx, k)").alias("kx"), F.expr("shiftright(ry, k)").alias("ky"), "k").where("k > 0")
    nested = held.join(r.select(F.col("rz").alias("kz"), F.col("rx").alias("kx"), F.col("ry").alias("ky")), ["kz", "kx", "ky"], "left_semi").select("z", "x", "y", "rz", "rx", "ry").distinct()
    own = below.join(nested, ["z", "x", "y", "rz", "rx", "ry"], "left_anti")
    sums = own.groupBy("z", "x", "y").agg(F.sum(F.pow(F.lit(4.0), -F.col("d"))).alias("share"))
    return targets.join(sums, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("share", F.lit(0.0)).alias("share"))


def gaps(targets: DataFrame, ready: DataFrame, depth: int) -> DataFrame:
    """The coarsest tiles below each target that no ready tile covers or lies in, however deep it lies, down to ``depth`` levels."""
    r = ready.select(F.col("z").cast("int").alias("z"), "x", "y").distinct()
    open_ = targets.select(F.col("z").cast("int").alias("z"), "x", "y").join(r, ["z", "x", "y"], "left_anti")
    out = None
    for level in range(depth + 1):
        marks = with_ancestors(r, DEEPEST).distinct()
        free = open_.join(marks, ["z", "x", "y"], "left_anti")
        out = free if out is None else out.unionByName(free)
        if level < depth:
            split = open_.join(marks, ["z", "x", "y"], "left_semi")
            open_ = children(split).join(r, ["z", "x", "y"], "left_anti")
    return out


def first_seen(parts: list[DataFrame], *key: str) -> DataFrame:
    """Rows of several tables with a place ``pos``, in order, each key once: where it came first."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return every.groupBy(*key).agg(F.min(F.struct("part", "pos")).alias("at")).select(*key, "at.part", "at.pos")


# --- paths ----------------------------------------------------------------------


def cumulative_angles(waypoints: DataFrame, between: Callable[..., Column] = geo.central_angle) -> DataFrame:
    """(path_id, i, lat, lon, lat0, lon0, angle, cumulative) of waypoints (path_id, place, lat, lon); ones that repeat their predecessor are left out."""
    by = W.partitionBy("path_id").orderBy("place")
    angle = lambda: between(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    before = waypoints.withColumns({"lat0": F.lag("lat").over(by), "lon0": F.lag("lon").over(by)})
    real = before.withColumn("angle", F.when(F.col("lat0").isNull(), 0.0).otherwise(angle())).where(F.col("lat0").isNull() | (F.col("angle") > geo.DEGENERATE_ANGLE))
    return real.withColumns({"i": F.row_number().over(by), "cumulative": F.sum("angle").over(by.rowsBetween(W.unboundedPreceding, 0))}).drop("place")


def path_points(metrics: DataFrame, count: int) -> DataFrame:
    """(path_id, k, lat, lon): ``count`` points at equal arc lengths. Each segment makes the samples that fall in it, so no path is gathered."""
    totals = metrics.groupBy("path_id").agg(F.max("cumulative").alias("total")).where("total > 0")
    s = metrics.join(totals, "path_id").where("i > 1")
    n = count - 1
    low, high = F.col("cumulative") - F.col("angle"), F.col("cumulative")
    # the first segment whose end reaches the target; the first sample belongs to the first segment
    a = F.when(F.col("i") == 2, F.lit(0)).otherwise(F.floor(low / F.col("total") * n + 1e-12).cast("int") + 1)
    b = F.least(F.lit(n), F.floor(high / F.col("total") * n + 1e-12).cast("int"))
    k = s.withColumns({"a": a, "b": b}).where("a <= b").withColumn("k", F.explode(F.sequence("a", "b")))
    share = (F.col("total") * F.col("k") / n - low) / F.col("angle")
    p = geo.along(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), share)
    return k.select("path_id", "k", p.alias("p")).select("path_id", "k", "p.lat", "p.lon")
