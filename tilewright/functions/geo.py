"""Web Mercator, great circles, tile distances and time curves as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EQUATOR_METRES = 40_075_016.686
GROUND_RADIUS = EQUATOR_METRES / (2 * math.pi)
HAVERSINE_RADIUS = 6_371_000.0
MAX_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
DEGENERATE_ANGLE, ANTIPODAL_SINE = 1e-9, 1e-7
STEP_RADIANS, MOST_SAMPLES = math.radians(0.25), 2048


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# --- projection -----------------------------------------------------------------


def mercator_y(lat: Column) -> Column:
    """Mercator y in [-1, 1], north positive, from degrees."""
    s = clamp(F.sin(F.radians(lat)), -math.tanh(math.pi), math.tanh(math.pi))
    return 0.5 * F.log((1 + s) / (1 - s)) / math.pi


def world_x(lon: Column) -> Column:
    """Normalized x in [0, 1), wrapped."""
    x = (F.radians(lon) + math.pi) / (2 * math.pi)
    return x - F.floor(x)


def world_y(lat: Column) -> Column:
    """Normalized y in [0, 1], growing south."""
    return clamp((1 - mercator_y(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))) * 0.5, 0.0, 1.0)


def latitude_at(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp((1 - 2 * clamp(y, 0.0, 1.0)) * math.pi)) - math.pi / 2)


def longitude_at(x: Column) -> Column:
    return F.degrees((x - F.floor(x)) * 2 * math.pi - math.pi)


def tile_index(normalized: Column, z) -> Column:
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    return clamp(F.floor(normalized * n).cast("bigint"), 0, n.cast("bigint") - 1)


def units_per_metre(lat: Column, size: float = 1.0) -> Column:
    return size / (EQUATOR_METRES * F.cos(F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))))


# --- longitudes -----------------------------------------------------------------


def west_longitude(lon: Column) -> Column:
    """[-180, 180): the west edge of a range."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def east_longitude(lon: Column) -> Column:
    """(-180, 180]: the east edge of a range."""
    w = west_longitude(lon)
    return F.when(w == -180.0, 180.0).otherwise(w)


def signed_longitude(lon: Column) -> Column:
    """[-180, 180] with both ends kept."""
    x = lon % 360.0
    return F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)


def shortest_longitude(a: Column, b: Column) -> Column:
    d = signed_longitude(b) - signed_longitude(a)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def shortest_world_x(a: Column, b: Column) -> Column:
    """The wrapped delta of normalized x, in [-0.5, 0.5)."""
    d = b - a
    return d - F.floor(d + 0.5)


# --- great circles --------------------------------------------------------------


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Half-chord form, accurate for short arcs too."""
    u, v = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    norm = lambda sign: F.sqrt(sum((a + sign * b) * (a + sign * b) for a, b in zip(u, v, strict=True)))
    return 2 * F.atan2(norm(-1), norm(1))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Clockwise from north in [0, 360); 0 where it isn't defined."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))


def along(lat1: Column, lon1: Column, lat2: Column, lon2: Column, progress: Column) -> Column:
    """The point (lat, lon) at a share of the great circle; antipodes go straight in latitude and shortest longitude."""
    t = clamp(progress, 0.0, 1.0)
    angle = central_angle(lat1, lon1, lat2, lon2)
    u, v = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    a, b = F.sin((1 - t) * angle) / F.sin(angle), F.sin(t * angle) / F.sin(angle)
    x, y, z = (p * a + q * b for p, q in zip(u, v, strict=True))
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    straight = point(lat1 + (lat2 - lat1) * t, signed_longitude(lon1 + shortest_longitude(lon1, lon2) * t))
    arc = point(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x)))
    return F.when((t <= 0) | (angle <= DEGENERATE_ANGLE) & (t < 1), point(lat1, lon1)).when(t >= 1, point(lat2, lon2)).when(F.sin(angle) <= ANTIPODAL_SINE, straight).otherwise(arc)


def haversine_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The angle by haversines, which loses digits close to antipodes."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dy), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return HAVERSINE_RADIUS * haversine_angle(lat1, lon1, lat2, lon2)


def sample_count(angle: Column) -> Column:
    return clamp((F.ceil(angle / STEP_RADIANS) + 1).cast("int"), 2, MOST_SAMPLES)


# --- tiles ----------------------------------------------------------------------


def parent(x: Column, by) -> Column:
    return F.shiftright(x, by) if isinstance(by, int) else F.call_function("shiftright", x, by)


def covers(pz: Column, px: Column, py: Column, z: Column, x: Column, y: Column) -> Column:
    """Whether the first tile is a strict ancestor of the second."""
    by = F.greatest(z - pz, F.lit(0)).cast("int")
    return (pz < z) & (parent(x, by) == px) & (parent(y, by) == py)


def chebyshev(x1: Column, y1: Column, x2: Column, y2: Column, z: int | None = None) -> Column:
    """Tile distance; around the globe in x if a zoom is given."""
    dx = F.abs(x1 - x2)
    if z is not None:
        dx = F.least(dx, F.lit(1 << z) - dx)
    return F.greatest(dx, F.abs(y1 - y2))


def distance_drop(distance: Column, steepness: float) -> Column:
    """Zoom levels that a tile at a distance is coarser by: 0 up to 2, 4 at most."""
    return F.when(distance <= 2, 0).otherwise(F.least(F.lit(4), F.ceil(F.log2(distance / 2.0) * steepness).cast("int")))


def latitude_drop(y: Column, z: int) -> Column:
    """Zoom levels that Mercator's stretch makes a globe's tile coarser by."""
    n = float(1 << z)
    north, south = y / n, (y + 1) / n
    near = F.when(south < 0.5, south).otherwise(north)
    drop = F.floor(-F.log2(F.cos(F.radians(latitude_at(near))))).cast("int")
    return F.when((north > 0.5) | (south < 0.5), F.greatest(F.lit(0), drop)).otherwise(0)


# --- curves ---------------------------------------------------------------------


def ease_out_cubic(t: Column) -> Column:
    return 1 - F.pow(1 - clamp(t, 0.0, 1.0), 3)


def ease_in_out_cubic(t: Column) -> Column:
    x = clamp(t, 0.0, 1.0)
    return F.when(x < 0.5, 4 * x * x * x).otherwise(1 - F.pow(-2 * x + 2, 3) / 2)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def altitude(base: Column, peak: Column, fraction: Column) -> Column:
    return base + peak * F.sin(math.pi * fraction)


def move_seconds(metres: Column) -> Column:
    return F.when(metres <= 0.01, 0.0).otherwise(0.14 + 0.46 * F.pow(F.least(metres / 250.0, F.lit(1.0)), 0.6))


def catch_up(dt: Column, half_life: Column) -> Column:
    return F.when(half_life <= 0, 1.0).otherwise(1 - F.exp(-math.log(2) * F.least(dt, F.lit(0.05)) / half_life))


def smoothing(share: Column, dt: Column) -> Column:
    return 1 - F.pow(1 - share, 60 * dt)


def subsolar(ts: Column) -> tuple[Column, Column]:
    """Latitude and longitude under the sun, in degrees, at a UTC time."""
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = (2 * math.pi / 365) * (F.dayofyear(ts) - 1 + (hours - 12) / 24)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    return F.degrees(declination), signed_longitude((720 - hours * 60 - minutes) / 4)


def backoff(outcome: Column, failures: Column, retry_after: Column) -> Column:
    """Seconds until a failed fetch may be tried again; null after a success."""
    exponential = F.least(0.5 * F.pow(F.lit(2.0), F.least(failures, F.lit(6))), F.lit(30.0))
    return (
        F.when(outcome == "success", F.lit(None).cast("double"))
        .when(outcome == "parse_failed", 120.0)
        .when(outcome.isin("missing_authorization_token", "unauthorized", "forbidden"), 30.0)
        .when(outcome.isin("not_found", "gone"), 600.0)
        .when(outcome == "rate_limited", F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.lit(5.0)))
        .when(outcome == "client", 60.0)
        .otherwise(exponential)
    )


def global_cooldown(outcome: Column, retry_after: Column) -> Column:
    """Seconds for which every fetch waits after a failure, null if none does."""
    return F.when(outcome.isin("missing_authorization_token", "unauthorized", "forbidden"), 15.0).when(outcome == "rate_limited", F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.lit(2.0)))
