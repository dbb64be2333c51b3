"""Vector tiles: protobuf bytes to feature rows, and the integer geometry in them.

Decoding is strict where the format is (wire data, a layer's version and name) and lenient
where it isn't (unknown fields and enum values, indices out of range). Tags and geometry
stay packed until they are asked for: ``features`` reads headers and properties, and
``polygons``, ``lines`` and ``points`` read commands of the rows that filters have left.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARINT, FIXED64, BYTES, GROUP, GROUP_END, FIXED32 = range(6)
KINDS = {0: "unknown", 1: "point", 2: "line", 3: "polygon"}
DEEPEST_GROUP = 32
EXTENT = 4096


class Malformed(ValueError):
    """Bytes that aren't a vector tile."""


def varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    for k in range(10):
        if at >= end:
            raise Malformed("a varint is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
    raise Malformed("a varint of over 10 bytes")


def _fields(data: bytes, at: int, end: int, depth: int = 0) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value); values of length-delimited fields are (from, to)."""
    while at < end:
        key, at = varint(data, at, end)
        number, wire = key >> 3, key & 7
        if number == 0:
            raise Malformed("field number 0")
        if wire == VARINT:
            value, at = varint(data, at, end)
        elif wire in (FIXED64, FIXED32):
            size = 8 if wire == FIXED64 else 4
            if at + size > end:
                raise Malformed("a fixed field is cut off")
            value, at = data[at : at + size], at + size
        elif wire == BYTES:
            size, at = varint(data, at, end)
            if at + size > end:
                raise Malformed("a field is cut off")
            value, at = (at, at + size), at + size
        elif wire == GROUP:
            at, value = _skip_group(data, at, end, number, depth + 1), None
        else:
            raise Malformed(f"wire type {wire}")
        yield number, wire, value


def _skip_group(data: bytes, at: int, end: int, group: int, depth: int) -> int:
    if depth > DEEPEST_GROUP:
        raise Malformed("groups are nested too deep")
    while at < end:
        key, at = varint(data, at, end)
        number, wire = key >> 3, key & 7
        if wire == GROUP_END:
            if number != group:
                raise Malformed("a group ends that hasn't begun")
            return at
        if wire == VARINT:
            _, at = varint(data, at, end)
        elif wire in (FIXED64, FIXED32):
            at += 8 if wire == FIXED64 else 4
        elif wire == BYTES:
            size, at = varint(data, at, end)
            at += size
        elif wire == GROUP:
            at = _skip_group(data, at, end, number, depth + 1)
        else:
            raise Malformed(f"wire type {wire}")
        if at > end:
            raise Malformed("a field of a group is cut off")
    raise Malformed("a group doesn't end")


def packed(data: bytes, runs: list) -> list[int]:
    """Unsigned 32-bit numbers of packed runs and of single values, in order; larger ones keep their low bits."""
    out = []
    for run in runs:
        if isinstance(run, tuple):
            at, end = run
            while at < end:
                value, at = varint(data, at, end)
                out.append(value & 0xFFFFFFFF)
        else:
            out.append(run & 0xFFFFFFFF)
    return out


def _text(data: bytes, span: tuple[int, int]) -> str:
    return data[span[0] : span[1]].decode("utf-8", "replace")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _value(data: bytes, at: int, end: int) -> dict:
    out = dict.fromkeys(("s", "f", "d", "i", "u", "si", "b"))
    for number, wire, v in _fields(data, at, end):
        if number == 1 and wire == BYTES:
            out["s"] = _text(data, v)
        elif number == 2 and wire == FIXED32:
            out["f"] = struct.unpack("<f", v)[0]
        elif number == 3 and wire == FIXED64:
            out["d"] = struct.unpack("<d", v)[0]
        elif number == 4 and wire == VARINT:
            out["i"] = _signed(v)
        elif number == 5 and wire == VARINT:
            out["u"] = v
        elif number == 6 and wire == VARINT:
            out["si"] = (v >> 1) ^ -(v & 1)
        elif number == 7 and wire == VARINT:
            out["b"] = v != 0
    return out


def _feature(data: bytes, at: int, end: int) -> dict:
    out = {"id": None, "kind": 0, "tags": [], "geometry": []}
    for number, wire, v in _fields(data, at, end):
        if number == 1 and wire == VARINT:
            out["id"] = v
        elif number == 3 and wire == VARINT:
            out["kind"] = v if v in KINDS else out["kind"]
        elif number in (2, 4) and wire in (VARINT, BYTES):
            out["tags" if number == 2 else "geometry"].append(v)
    return out


def layers(data: bytes) -> list[dict]:
    """Layers of a tile: name, version, extent, keys, values, features (tags and geometry as runs)."""
    out = []
    for number, wire, span in _fields(data, 0, len(data)):
        if number != 3 or wire != BYTES:
            continue
        layer = {"name": None, "version": None, "extent": EXTENT, "keys": [], "values": [], "features": []}
        for n, w, v in _fields(data, *span):
            if n == 1 and w == BYTES:
                layer["name"] = _text(data, v)
            elif n == 2 and w == BYTES:
                layer["features"].append(_feature(data, *v))
            elif n == 3 and w == BYTES:
                layer["keys"].append(_text(data, v))
            elif n == 4 and w == BYTES:
                layer["values"].append(_value(data, *v))
            elif n == 5 and w == VARINT:
                layer["extent"] = v & 0xFFFFFFFF
            elif n == 15 and w == VARINT:
                layer["version"] = v & 0xFFFFFFFF
        if layer["name"] is None or layer["version"] is None:
            raise Malformed("a layer without a name or a version")
        out.append(layer)
    return out


def properties(data: bytes, layer: dict, runs: list) -> dict[str, dict]:
    """Pairs of indices as properties: ones out of range are left out, the last of a key counts, an odd end is dropped."""
    tags = packed(data, runs)
    return {layer["keys"][k]: layer["values"][v] for k, v in zip(tags[::2], tags[1::2], strict=False) if k < len(layer["keys"]) and v < len(layer["values"])}


_VALUE = pa.struct([("s", pa.string()), ("f", pa.float32()), ("d", pa.float64()), ("i", pa.int64()), ("u", pa.decimal128(20, 0)), ("si", pa.int64()), ("b", pa.bool_())])
_SCHEMA = "z int, x int, y int, layer string, extent bigint, feature_idx int, feature_id decimal(20,0), has_id boolean, geom_type string, props map<string,struct<s:string,f:float,d:double,i:bigint,u:decimal(20,0),si:bigint,b:boolean>>, geom_cmds array<bigint>, error string"


def features(tiles: DataFrame) -> DataFrame:
    """A row for each feature of tiles (z, x, y, content); a tile that can't be read gives one row with ``error``, an empty one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                key = (t["z"], t["x"], t["y"])
                data = t["content"] or b""
                try:
                    found = []
                    for layer in layers(data):
                        for i, f in enumerate(layer["features"]):
                            props = {k: v | {"u": None if v["u"] is None else Decimal(v["u"])} for k, v in properties(data, layer, f["tags"]).items()}
                            found.append((*key, layer["name"], layer["extent"], i, Decimal(f["id"] or 0), f["id"] is not None, KINDS[f["kind"]], list(props.items()), packed(data, f["geometry"]), None))
                    rows += found
                except Malformed as e:
                    rows.append((*key, *[None] * 8, str(e)))
            names = ["z", "x", "y", "layer", "extent", "feature_idx", "feature_id", "has_id", "geom_type", "props", "geom_cmds", "error"]
            types = [pa.int32()] * 3 + [pa.string(), pa.int64(), pa.int32(), pa.decimal128(20, 0), pa.bool_(), pa.string(), pa.map_(pa.string(), _VALUE), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return tiles.select(*[F.col(c).cast("int").alias(c) for c in ("z", "x", "y")], "content").mapInArrow(run, _SCHEMA)


# --- encoding -------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, wire: int, payload: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(payload)) if wire == BYTES else b"") + payload


def _zigzag(n: int) -> int:
    return (n << 1 ^ n >> 63) & 0xFFFFFFFF


_ENCODED = {
    "s": lambda v: _field(1, BYTES, v.encode()),
    "f": lambda v: _field(2, FIXED32, struct.pack("<f", v)),
    "d": lambda v: _field(3, FIXED64, struct.pack("<d", v)),
    "i": lambda v: _field(4, VARINT, _varint(v)),
    "u": lambda v: _field(5, VARINT, _varint(int(v))),
    "si": lambda v: _field(6, VARINT, _varint((v << 1 ^ v >> 63) & 0xFFFFFFFFFFFFFFFF)),
    "b": lambda v: _field(7, VARINT, _varint(int(v))),
}


def commands(kind: str, parts: list[list[tuple[int, int]]]) -> list[int]:
    """Drawing commands of points (one part), lines, or rings."""
    out, x, y = [], 0, 0
    for part in parts:
        for i, (px, py) in enumerate(part):
            if i == 0:
                out.append((len(part) if kind == "point" else 1) << 3 | 1)
            elif i == 1 and kind != "point":
                out.append((len(part) - 1) << 3 | 2)
            out += [_zigzag(px - x), _zigzag(py - y)]
            x, y = px, py
        if kind == "polygon":
            out.append(15)
    return out


def _layer(name: str, extent: int, rows: list[dict]) -> bytes:
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = [_field(1, BYTES, name.encode()), _field(15, VARINT, _varint(2))]
    number = {k: n for n, k in KINDS.items()}
    for r in rows:
        tags = []
        for key, value in r["props"] or ():
            one = next(((k, v) for k, v in value.items() if v is not None), None)
            if one:
                tags += [keys.setdefault(key, len(keys)), values.setdefault(_ENCODED[one[0]](one[1]), len(values))]
        parts = [[(p["x"], p["y"]) for p in part] for part in r["parts"] or ()]
        head = _field(1, VARINT, _varint(int(r["feature_id"]))) if r["feature_id"] is not None else b""
        body.append(_field(2, BYTES, head + _field(2, BYTES, b"".join(map(_varint, tags))) + _field(3, VARINT, _varint(number[r["geom_type"]])) + _field(4, BYTES, b"".join(map(_varint, commands(r["geom_type"], parts))))))
    body += [_field(3, BYTES, k.encode()) for k in keys] + [_field(4, BYTES, v) for v in values] + [_field(5, VARINT, _varint(extent))]
    return _field(3, BYTES, b"".join(body))


def encoded(rows: DataFrame) -> DataFrame:
    """(z, x, y, content) of features (z, x, y, layer, extent, feature_idx, feature_id, geom_type, props, parts): one vector
    tile for each tile, whose features bound a group. A property has the one value that isn't null."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        layers: dict[tuple, list[dict]] = {}
        for r in sorted(got.to_pylist(), key=lambda r: (r["layer"], r["feature_idx"])):
            layers.setdefault((r["layer"], r["extent"]), []).append(r)
        content = b"".join(_layer(name, extent, rows) for (name, extent), rows in layers.items())
        return pa.table({"z": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([key[1].as_py()], pa.int32()), "y": pa.array([key[2].as_py()], pa.int32()), "content": pa.array([content], pa.binary())})

    flat = rows.select(*[F.col(c).cast("int").alias(c) for c in ("z", "x", "y")], "layer", "extent", "feature_idx", "feature_id", "geom_type", "props", "parts")
    return flat.groupBy("z", "x", "y").applyInArrow(run, "z int, x int, y int, content binary")


# --- geometry commands ------------------------------------------------------------


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _wrap(v: int) -> int:
    return (v + (1 << 31)) % (1 << 32) - (1 << 31)


def zigzag_column(v: Column) -> Column:
    """The same as an expression over unsigned 32-bit numbers."""
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


class _Cursor:
    """Moves along commands; coordinates wrap as 32-bit numbers do."""

    def __init__(self, commands: list[int]) -> None:
        self.commands, self.at, self.x, self.y = commands, 0, 0, 0

    def more(self) -> bool:
        return self.at < len(self.commands)

    def header(self) -> tuple[int, int]:
        word = self.commands[self.at]
        self.at += 1
        return word & 7, word >> 3

    def step(self) -> tuple[int, int]:
        dx, dy = self.commands[self.at : self.at + 2]
        self.at += 2
        self.x, self.y = _wrap(self.x + zigzag(dx)), _wrap(self.y + zigzag(dy))
        return self.x, self.y

    def has(self, pairs: int) -> bool:
        return self.at + 2 * pairs <= len(self.commands)


def ring_area(ring: list[tuple[int, int]]) -> int:
    """Twice the shoelace area, wrapped as a 64-bit number."""
    total = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True))
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def _path(c: _Cursor) -> list[tuple[int, int]] | None:
    """MoveTo 1, LineTo n > 0; None if the commands aren't that."""
    if c.header() != (1, 1) or not c.has(1):
        return None
    out = [c.step()]
    if not c.more():
        return None
    command, n = c.header()
    if command != 2 or n == 0 or not c.has(n):
        return None
    return out + [c.step() for _ in range(n)]


def polygons(commands: list[int]) -> list[list[list[tuple[int, int]]]]:
    """Polygons as [exterior, hole, ...]. Anything malformed, or a hole before any exterior, makes the feature empty."""
    c, out = _Cursor(commands), []
    while c.more():
        ring = _path(c)
        if ring is None or not c.more() or c.header() != (7, 1):
            return []
        if ring_area(ring) > 0:
            out.append([ring])
        elif not out:
            return []
        else:
            out[-1].append(ring)
    return out


def lines(commands: list[int]) -> list[list[tuple[int, int]]]:
    c, out = _Cursor(commands), []
    while c.more():
        line = _path(c)
        if line is None:
            return []
        out.append(line)
    return out


def points(commands: list[int]) -> list[tuple[int, int]]:
    """Points of MoveTo and LineTo; a stream that ends early keeps what it had."""
    c, out = _Cursor(commands), []
    while c.more():
        command, n = c.header()
        if command not in (1, 2):
            if command == 7:
                continue
            break
        for _ in range(n):
            if not c.has(1):
                return out
            out.append(c.step())
    return out


def normalized(v: Column, extent: Column) -> Column:
    """A coordinate in units of 4096 to a tile, half away from zero; an extent of 0 changes nothing."""
    return F.when(extent == 0, v.cast("double")).otherwise(F.round(v * (EXTENT / extent))).cast("bigint")


def flipped(y: Column) -> Column:
    return EXTENT - y


def geometry(rows: DataFrame) -> DataFrame:
    """``rows`` with parts (array of rings or lines) of their commands, decoded batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.int32()), ("y", pa.int32())])
        one = lambda ps: [{"x": x, "y": y} for x, y in ps]
        for batch in batches:
            parts = []
            for kind, commands in zip(batch.column("geom_type").to_pylist(), batch.column("geom_cmds").to_pylist(), strict=True):
                commands = commands or []
                shape = polygons(commands) if kind == "polygon" else [lines(commands)] if kind == "line" else [[points(commands)]]
                parts.append([[one(r) for r in p] for p in shape if p and p != [[]]])
            yield batch.append_column("parts", pa.array(parts, pa.list_(pa.list_(pa.list_(point)))))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{out}, parts array<array<array<struct<x:int,y:int>>>>")
