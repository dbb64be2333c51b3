"""Visibility, fades, flights and widths as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import geo

#: Fixed values.
RHO = 1.42
FADES = {"roads": (5.0, 6.0), "landuse": (13.0, 14.0), "street_palette": (8.0, 11.5), "road_surface": (14.0, 16.0), "markings": (14.0, 15.0)}
VEGETATION = [1.0, 0.5, 0.3, 0.15, 0.08, 0.04, 0.0]
LABEL_FLOOR = 11.0
FARTHEST, FLAT_RING, BACKDROP_ZOOM = 40, 10, 3
NEAR_TIER, REDUCED_TIER = 2, 7


def fade(name: str, zoom: Column) -> Column:
    return geo.smoothstep(*FADES[name], zoom)


def vegetation(zoom: Column, first: int = 0) -> Column:
    """A share by whole zoom levels after the first."""
    step = geo.clamp(F.floor(zoom).cast("int") - first, 0, len(VEGETATION) - 1)
    return F.get(F.array(*map(F.lit, VEGETATION)), step)


def label_size(size: Column) -> Column:
    return F.greatest(size, F.lit(LABEL_FLOOR))


def flight(distance: Column, from_width: Column, to_width: Column) -> Column:
    """(length, middle): how long the smooth way between two views is, and how wide the view is half way."""
    d, a, b = distance, from_width, to_width
    b0 = (b * b - a * a + RHO**4 * d * d) / (2 * a * RHO**2 * d)
    b1 = (b * b - a * a - RHO**4 * d * d) / (2 * b * RHO**2 * d)
    r0, r1 = -F.asinh(b0), -F.asinh(b1)
    moving = F.struct(((r1 - r0) / RHO).alias("length"), (a * F.cosh(r0) / F.cosh((r0 + r1) / 2)).alias("middle"))
    still = F.struct((F.abs(F.log(b / a)) / RHO).alias("length"), F.sqrt(a * b).alias("middle"))
    return F.when(d < 1e-9, still).otherwise(moving)


def tile_units_per_metre(y: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return 4096 * n * F.cosh(math.pi * (1 - 2 * (y + 0.5) / n)) / geo.EQUATOR_METRES


def bearing_delta(a: Column, b: Column) -> Column:
    """The short way round, in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def stated_width(decimetres: Column) -> Column:
    """Metres of a width given in decimetres, null outside of 2 to 60 m."""
    return F.when(decimetres.between(20, 600), decimetres / 10.0)


#: Lanes that a class of road has if none are stated, and the width of one; other classes have a width of their own.
DEFAULT_LANES = {"motorway": 4, "trunk": 3, "primary": 3, "secondary": 2, "tertiary": 2, "minor": 2}
LANE_METRES = {"motorway": 4.0, "trunk": 4.0, "primary": 4.0, "secondary": 4.5, "tertiary": 4.5, "minor": 5.0, "service": 4.0}
WALK_METRES = 2.0


def _by_class(values: dict, road_class: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), road_class)


def lanes(road_class: Column, count: Column) -> Column:
    """Stated lanes, else those usual for the class, 1 to 12."""
    return F.greatest(F.least(F.coalesce(count, _by_class(DEFAULT_LANES, road_class), F.lit(1)), F.lit(12)), F.lit(1))


def road_width(road_class: Column, decimetres: Column, lane_count: Column) -> Column:
    """Metres: as stated, else lanes of the class's width, else that of a walk."""
    return F.coalesce(stated_width(decimetres), lanes(road_class, lane_count) * _by_class(LANE_METRES, road_class), F.lit(WALK_METRES))


def demanded(distance: Column, zoom: Column, flat: bool) -> Column:
    """Near enough to be asked for; on a flat map the far ring is left to the backdrop."""
    near = distance <= FARTHEST
    return near & ~((zoom > BACKDROP_ZOOM) & (distance > FLAT_RING)) if flat else near


def detail_tier(distance: Column) -> Column:
    return F.when(distance <= NEAR_TIER, "full").when(distance <= REDUCED_TIER, "reduced").otherwise("minimal")


def in_viewport(x: Column, y: Column, width: float, height: float, margin: float, scale: Column) -> Column:
    m = margin * F.greatest(F.lit(1.0), scale)
    return (x >= -m) & (x <= width + m) & (y >= -m) & (y <= height + m)


def inside_tile(x: Column, y: Column, extent: int = 4096) -> Column:
    return x.between(0, extent) & y.between(0, extent)


def label_shows(valid: Column, duplicate: Column, retained: Column, hidden: Column, above_horizon: Column, min_zoom: Column, zoom: Column) -> Column:
    return valid & ~duplicate & ~retained & ~hidden & above_horizon & (min_zoom <= zoom)


def moved(lat1: Column, lon1: Column, lat2: Column, lon2: Column, start: Column, seconds: Column, now: Column) -> Column:
    """Where a marker on its way is at a time: along the great circle, slower towards the end."""
    t = F.when(seconds <= 0, 1.0).otherwise(geo.clamp((now - start) / seconds, 0.0, 1.0))
    return geo.along(lat1, lon1, lat2, lon2, geo.ease_out_cubic(t))
