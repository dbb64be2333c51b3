"""Names, languages, urls and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that are never logged.
SECRET_KEYS = ["access_token", "api_key", "apikey", "key", "token"]
ROOF_SHAPES = {"flat": 0, "gabled": 1, "hipped": 2, "pyramidal": 3, "skillion": 4, "dome": 5, "cone": 6}
COMPASS = {"n": 0.0, "ne": 45.0, "e": 90.0, "se": 135.0, "s": 180.0, "sw": 225.0, "w": 270.0, "nw": 315.0}


def kind(*parts: Column) -> Column:
    """Parts trimmed and lower case, joined by colons; empty ones left out."""
    clean = F.transform(F.array(*parts), lambda x: F.lower(F.trim(x)))
    return F.concat_ws(":", F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def language(code: Column) -> Column:
    c = F.lower(F.translate(F.trim(code), "_", "-"))
    return F.when(F.coalesce(c, F.lit("")) == "", "en").otherwise(c)


def base_language(code: Column) -> Column:
    return F.substring_index(language(code), "-", 1)


def namespace(code: Column) -> Column:
    return F.regexp_replace(language(code), "[^-0-9a-z]", "_")


def without_construction(road_class: Column) -> Column:
    return F.regexp_replace(road_class, "_construction$", "")


def name_keys(lang: Column, local_first: bool = False) -> Column:
    """Property keys by preference: the language's, its base's, then English and the local name, or these two the other way round."""
    full, base = language(lang), base_language(lang)
    own = [F.concat(F.lit(p), c) for c in (full, base) for p in ("name_", "name:")]
    rest = [F.lit("name_en"), F.lit("name:en")]
    keys = [*own, F.lit("name"), *rest] if local_first else [*own, *rest, F.lit("name")]
    return F.array_distinct(F.array(*keys))


def covered(text: Column, letters: str) -> Column:
    """Whether a text has only characters of a regex class, and white space."""
    return text.rlike(f"^[{letters}\\s]*$")


def localized(names: Column, lang: Column, letters: str, local_first: bool = False) -> Column:
    """The first name by preference that isn't empty and whose characters can all be shown."""
    values = F.transform(name_keys(lang, local_first), lambda k: F.try_element_at(names, k))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "") & covered(v, letters)), F.lit(0))


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, f"(?i)([?&](?:{'|'.join(SECRET_KEYS)})=)[^&#]*", "$1REDACTED")


def fill_template(template: Column, z: Column, x: Column, y: Column) -> Column:
    """The url of a tile; null for a template without scheme or host."""
    url = template
    for k, c in (("{z}", z), ("{x}", x), ("{y}", y)):
        url = F.replace(url, F.lit(k), c.cast("string"))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+"), url)


def tile_path(base: Column, z: Column, x: Column, y: Column, suffix: str = "mvt") -> Column:
    return F.concat(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), z.cast("string"), x.cast("string"), y.cast("string")), F.lit(f".{suffix}"))


def parse_path(path: Column) -> Column:
    """(z, x, y) of z*/x_y.mvt, nulls for other paths."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"z([0-9]+)/([0-9]+)_([0-9]+)\.mvt$", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def outcome(status: Column, length: Column) -> Column:
    """What a fetch came to, by its HTTP status (null: no answer) and body length."""
    return (
        F.when(status.isNull(), "network")
        .when(status == 401, "unauthorized")
        .when(status == 403, "forbidden")
        .when(status == 404, "not_found")
        .when(status == 410, "gone")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server")
        .when((status < 200) | (status >= 300), "client")
        .when(length == 0, "empty_body")
        .otherwise("success")
    )


def server_message(status: Column, body: Column) -> Column:
    said = F.coalesce(F.get_json_object(body, "$.message"), F.get_json_object(body, "$.error"))
    return F.concat(F.lit("HTTP "), status.cast("string"), F.when(said.isNotNull(), F.concat(F.lit(": "), said)).otherwise(""))


def mapped(values: dict, key: Column, default=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(key)), F.lit(default))
