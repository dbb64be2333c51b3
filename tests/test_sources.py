"""Vector tiles against a small encoder, stores against files, and streams against their batch forms."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from tilewright.operators import lifecycle
from tilewright.sources import mvt, store
from tilewright.streaming import state


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(number, wire, payload):
    return varint(number << 3 | wire) + (varint(len(payload)) + payload if wire == 2 else payload)


def zig(n):
    return (n << 1) ^ (n >> 31) if n >= 0 else ((-n) << 1) - 1


VALUES = {"s": lambda v: field(1, 2, v.encode()), "f": lambda v: field(2, 5, struct.pack("<f", v)), "d": lambda v: field(3, 1, struct.pack("<d", v)), "i": lambda v: field(4, 0, varint(v)), "u": lambda v: field(5, 0, varint(v)), "si": lambda v: field(6, 0, varint(zig(v))), "b": lambda v: field(7, 0, varint(int(v)))}


def tile(name, features, extent=4096, keys=(), values=(), version=2):
    body = (field(1, 2, name.encode()) if name is not None else b"") + (field(15, 0, varint(version)) if version else b"")
    for f in features:
        body += field(2, 2, (field(1, 0, varint(f["id"])) if "id" in f else b"") + field(2, 2, b"".join(map(varint, f.get("tags", [])))) + field(3, 0, varint(f["kind"])) + field(4, 2, b"".join(map(varint, f["geometry"]))))
    body += b"".join(field(3, 2, k.encode()) for k in keys) + b"".join(field(4, 2, VALUES[k](v)) for k, v in values) + field(5, 0, varint(extent))
    return field(3, 2, body)


def ring(points):
    out, x, y = [9], 0, 0
    for i, (px, py) in enumerate(points):
        if i == 1:
            out.append((len(points) - 1) << 3 | 2)
        out += [zig(px - x), zig(py - y)]
        x, y = px, py
    return [*out, 15]


SQUARE = ring([(0, 0), (10, 0), (10, 10), (0, 10)])
HOLE = [9, zig(2), zig(-8), 26, zig(0), zig(4), zig(4), zig(0), zig(0), zig(-4), 15]


def test_commands():
    assert mvt.polygons(SQUARE) == [[[(0, 0), (10, 0), (10, 10), (0, 10)]]]
    two = mvt.polygons(SQUARE + HOLE)
    assert len(two) == 1 and len(two[0]) == 2
    assert mvt.polygons(HOLE) == [] and mvt.polygons(SQUARE[:-1]) == [] and mvt.polygons([17, 2, 2, 4, 4]) == [] and mvt.polygons([]) == []
    assert mvt.lines([9, zig(1), zig(2), 10, zig(3), zig(4)]) == [[(1, 2), (4, 6)]] and mvt.lines([9, 2, 2]) == []
    assert mvt.points([17, zig(1), zig(1), zig(1), zig(1)]) == [(1, 1), (2, 2)] and mvt.points([25, 2, 2, 2, 2]) == [(1, 1), (2, 2)]
    assert mvt.points([9, zig(2**31 - 1), 0, 9, zig(1), 0])[1][0] == -(2**31)


def test_malformed():
    good = tile("a", [{"kind": 3, "geometry": SQUARE, "id": 7}])
    assert mvt.layers(good)[0]["features"][0]["id"] == 7
    for bad in (good[:-1], b"\xff" * 11, tile(None, []), tile("a", [], version=0), b"\x1b", b"\x07", b"\x00\x00"):
        with pytest.raises(mvt.Malformed):
            mvt.layers(bad)
    group = varint(9 << 3 | 3) + field(1, 0, varint(5)) + varint(9 << 3 | 4)
    assert mvt.layers(group + good) == mvt.layers(good) or len(mvt.layers(group + good)) == 1
    deep = b"".join(varint(9 << 3 | 3) for _ in range(40)) + b"".join(varint(9 << 3 | 4) for _ in range(40))
    with pytest.raises(mvt.Malformed):
        mvt.layers(deep)


def test_feature_rows(spark):
    values = [("s", "Haus"), ("f", 1.5), ("d", -2.25), ("i", -3), ("u", 2**64 - 1), ("si", -9), ("b", True)]
    keys = ["name", "f", "d", "i", "u", "si", "b"]
    tags = [x for i in range(7) for x in (i, i)] + [0, 99, 77, 0, 1]
    content = tile("building", [{"id": 2**63 + 5, "kind": 3, "geometry": SQUARE + HOLE, "tags": tags}, {"kind": 9, "geometry": []}], 8192, keys, values)
    tiles = spark.createDataFrame([(1, 0, 0, bytearray(content)), (1, 0, 1, bytearray(content[:-2])), (1, 1, 1, bytearray(b"")), (1, 1, 0, None)], "z int, x int, y int, content binary")
    rows = mvt.features(tiles).orderBy("x", "y", "feature_idx").collect()
    assert len(rows) == 3 and rows[2].error and rows[2].layer is None
    first = rows[0]
    assert (first.layer, first.extent, int(first.feature_id), first.has_id, first.geom_type) == ("building", 8192, 2**63 + 5, True, "polygon")
    p = first.props
    assert (p["name"].s, p["f"].f, p["d"].d, p["i"].i, int(p["u"].u), p["si"].si, p["b"].b) == ("Haus", 1.5, -2.25, -3, 2**64 - 1, -9, True) and set(p) == set(keys)
    assert rows[1].geom_type == "unknown" and not rows[1].has_id
    parts = mvt.geometry(mvt.features(tiles).where("geom_type = 'polygon'")).first().parts
    assert len(parts) == 1 and len(parts[0]) == 2
    scaled = spark.createDataFrame([(5, 8192), (-5, 8192), (7, 0)], "v int, e int").select(mvt.normalized(F.col("v"), F.col("e")).alias("n")).collect()
    assert [r.n for r in scaled] == [3, -3, 7]
    assert [r.v for r in spark.range(6).select(mvt.zigzag_column(F.col("id")).alias("v")).collect()] == [0, -1, 1, -2, 2, -3]


def test_random_tiles():
    rng = random.Random(0xDEC0DE)
    for _ in range(60):
        features = [{"id": rng.getrandbits(64), "kind": rng.randint(0, 3), "geometry": [rng.getrandbits(32) for _ in range(rng.randint(0, 20))], "tags": [rng.randint(0, 5) for _ in range(rng.randint(0, 9))]} for _ in range(rng.randint(0, 5))]
        keys = [f"k{i}" for i in range(4)]
        values = [("i", rng.getrandbits(63)), ("s", "x" * rng.randint(0, 300)), ("b", False)]
        data = tile("l", features, rng.randint(0, 9000), keys, values)
        got = mvt.layers(data)[0]
        assert [(f["id"], f["kind"], mvt.packed(data, f["geometry"]), mvt.packed(data, f["tags"])) for f in got["features"]] == [(f["id"], f["kind"], f["geometry"], f["tags"]) for f in features]
        assert got["keys"] == keys and got["values"][0]["i"] == values[0][1]


def test_offline_store(spark, tmp_path):
    tiles = spark.createDataFrame([(3, 1, 2, bytearray(b"data")), (3, 1, 3, bytearray(b"")), (4, 9, 9, bytearray(b"x"))], "z int, x int, y int, content binary")
    store.write_tiles(tiles, str(tmp_path / "t"))
    wanted = spark.createDataFrame([(3, 1, 2), (3, 1, 3), (5, 0, 0)], "z int, x int, y int")
    got = {(r.z, r.x, r.y): r.status for r in store.lookup(wanted, store.read_tiles(spark, str(tmp_path / "t"))).collect()}
    assert got == {(3, 1, 2): "stored", (3, 1, 3): "known_empty", (5, 0, 0): "absent"}
    (tmp_path / "f" / "z7").mkdir(parents=True)
    (tmp_path / "f" / "z7" / "11_12.mvt").write_bytes(b"abc")
    (tmp_path / "f" / "z7" / "other.mvt").write_bytes(b"abc")
    assert [tuple(r)[:4] for r in store.read_tile_files(spark, str(tmp_path / "f")).collect()] == [(7, 11, 12, "stored")]


def test_region_records(spark, tmp_path):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [("b", 1.0, 2.0, 3.0, 4.0, 0, 5, when, 1, 2, 3, 0), ("a", -1.0, 2.0, 3.0, 4.0, 0, 5, when, 0, 2, 0, 1)]
    store.write_regions(spark.createDataFrame(rows, store.REGION).coalesce(1), str(tmp_path / "r"))
    assert sorted(map(tuple, store.read_regions(spark, str(tmp_path / "r")).collect())) == sorted(rows)


def test_discovery_and_traces(spark):
    docs = [('{"tiles":["https://t/{z}"]}',), ('{"tiles":[]}',), ("no json",), (None,)]
    got = [r.t for r in spark.createDataFrame(docs, "d string").select(store.discovered(F.col("d"), F.lit("fallback")).alias("t")).collect()]
    assert got == ["https://t/{z}", "fallback", "fallback", "fallback"]
    assert store.trace_lines(spark.createDataFrame([("load", 3, None)], "name string, frame int, error string")).first().value == '{"frame":3,"name":"load"}'
    assert store.background(2, 1, 1, spark).count() == 65 * 65


def test_water_labels(spark):
    every = spark.createDataFrame([(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)], "z int, x bigint, y bigint")
    got = store.water_labels(every, F.lit("ru")).collect()
    assert [sum(r.z == z for r in got) for z in range(5)] == [5, 5, 9, 0, 0]
    sea = {(r.z, r.name): r for r in got}
    assert (sea[0, "Тихий океан"].px, sea[0, "Тихий океан"].py, sea[0, "Тихий океан"].sort_key) == (341, 2048, 20)
    assert (sea[2, "Чёрное море"] if (2, "Чёрное море") in sea else sea[2, "Средиземное море"]).kind == "sea"
    one = spark.createDataFrame([(0, 0, 0)], "z int, x bigint, y bigint")
    taken = spark.createDataFrame([(0, 0, 0, "Atlas Okyanusu"), (0, 0, 0, "Nordsee")], "z int, x bigint, y bigint, text string")
    assert sorted(r.name for r in store.water_labels(one, F.lit("xx"), taken).collect()) == ["Arctic Ocean", "Indian Ocean", "Pacific Ocean", "Southern Ocean"]


def streamed(spark, frames, schema, tmp_path, make):
    """Rows that a stream gives for files that come one by one."""
    path = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    name = f"out{random.randint(0, 10**9)}"
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def fetches(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 4), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), i, rng.choice(["success", "server", "network", "rate_limited", "not_found"]), rng.choice([None, 1.0, 9.0])) for i in range(120)]
    return spark.createDataFrame(rows, "tile bigint, ts timestamp, seq bigint, outcome string, retry_after double")


def test_retries_as_a_stream(spark, tmp_path):
    df = fetches(spark)
    got = streamed(spark, [df.where("seq < 40"), df.where("seq >= 40 AND seq < 80"), df.where("seq >= 80")], df.schema, tmp_path, state.retries)
    want = lifecycle.retries(df).select("tile", "seq", "failures", "wait")
    key = lambda r: tuple(r)[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_holds_as_a_stream(spark, tmp_path):
    df = fetches(spark).select(F.col("tile").alias("key"), F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, seq * 7 % 11)").alias("ts"))
    far = spark.createDataFrame([(99, datetime.datetime(2030, 1, 1))], df.schema)
    got = streamed(spark, [df, far, far], df.schema, tmp_path, lambda s: state.holds(s, 9, "1 hour"))
    want = lifecycle.holds(df, 9.0)
    assert sorted(map(tuple, got.select("key", "n").collect())) == sorted(map(tuple, want.select("key", "n").collect()))


def test_fades_and_notices(spark, tmp_path):
    rows = [(1, 0.0, True), (1, 0.075, True), (1, 1.0, False), (1, 1.125, False), (1, 9.0, False), (2, 0.0, True)]
    df = spark.createDataFrame(rows, "key bigint, at double, visible boolean")
    got = streamed(spark, [df.where("at < 1"), df.where("at >= 1")], df.schema, tmp_path, state.fades)
    assert [round(r.alpha, 6) for r in got.where("key = 1").orderBy("at").collect()] == [0.0, 0.5, 1.0, 0.5, 0.0]
    told = spark.createDataFrame([("a", 0.0), ("a", 59.0), ("a", 60.0), ("b", 3.0)], "kind string, at double")
    got = streamed(spark, [told], told.schema, tmp_path / "n", state.notices)
    assert sorted(map(tuple, got.collect())) == [("a", 0.0), ("a", 60.0), ("b", 3.0)]


def test_upserts(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, False, 5.0), (2, 1, False, 6.0)], "id bigint, version bigint, removed boolean, lat double")
    second = spark.createDataFrame([(1, 2, False, 7.0), (2, 3, True, 6.0), (3, 1, False, 8.0)], first.schema)
    path = str(tmp_path / "in")
    for f in (first, second):
        f.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state.upsert(stream, str(tmp_path / "m"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.id, r.lat) for r in spark.read.parquet(str(tmp_path / "m" / "v2")).collect()) == [(1, 7.0), (3, 8.0)]
