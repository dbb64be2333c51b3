"""Reading dynamically typed property values: a struct of s, f, d, i, u, si, b, of which one is set or several are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<s:string,f:float,d:double,i:bigint,u:decimal(20,0),si:bigint,b:boolean>"
#: A whole number, as a string.
WHOLE = r"^[+-]?[0-9]{1,18}$"


def as_bool(v: Column) -> Column:
    """b, u, si, i, f, d, then a string that says yes or no."""
    text = F.lower(v["s"])
    said = F.when(text.isin("true", "yes", "1"), True).when(text.isin("false", "no", "0"), False)
    return F.coalesce(v["b"], *[v[k] != 0 for k in ("u", "si", "i", "f", "d")], said)


def _whole(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), F.expr("1") * F.regexp_replace(text, r"^\+", "").try_cast("bigint"))


def _cut(x: Column) -> Column:
    """Towards zero; null where it isn't finite or doesn't fit."""
    return F.when(F.abs(x) < 9.2e18, x.cast("bigint"))


def as_int(v: Column) -> Column:
    """i, si, u, f, d, then a string that is a whole number."""
    return F.coalesce(v["i"], v["si"], v["u"].try_cast("bigint"), _cut(v["f"]), _cut(v["d"]), _whole(v["s"]))


def as_int_public(v: Column, trim: bool = False) -> Column:
    """i, u, si, d, f, then a string: the order that styles and label profiles see."""
    text = F.trim(v["s"]) if trim else v["s"]
    return F.coalesce(v["i"], v["u"].try_cast("bigint"), v["si"], _cut(v["d"]), _cut(v["f"]), _whole(text))


def as_uint(v: Column) -> Column:
    """u, si, i, then a string; negative ones are null."""
    good = lambda x: F.when(x >= 0, x.cast("decimal(20,0)"))
    return F.coalesce(v["u"], F.when(v["si"].isNotNull(), good(v["si"])).otherwise(F.coalesce(good(v["i"]), F.when(v["i"].isNull() & v["s"].rlike("^[0-9]{1,20}$"), v["s"].try_cast("decimal(20,0)")))))


def as_double(v: Column) -> Column:
    """d, f, i, u, si, then a string that is a number."""
    return F.coalesce(v["d"], v["f"].cast("double"), *[v[k].cast("double") for k in ("i", "u", "si")], v["s"].try_cast("double"))


def numeric_text(text: Column) -> Column:
    """The number that the first token of a text begins with; feet become metres."""
    raw = F.lower(F.trim(text))
    token = F.regexp_extract(raw, r"^[;, ]*([^;, ]+)", 1)
    number = F.regexp_extract(token, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")
    return F.when(raw.contains("ft") | raw.contains("feet"), number * 0.3048).otherwise(number)


def numeric(v: Column) -> Column:
    """f, d, u, i, si, then the number in a text."""
    return F.coalesce(v["f"].cast("double"), v["d"], *[v[k].cast("double") for k in ("u", "i", "si")], numeric_text(v["s"]))


def building_id(props: Column, feature_id: Column) -> Column:
    """The first of osm_id, id, building_id that is an id, else the feature's."""
    return F.coalesce(*[as_uint(F.try_element_at(props, F.lit(k))) for k in ("osm_id", "id", "building_id")], feature_id.cast("decimal(20,0)"))
