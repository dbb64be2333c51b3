"""Every query with SQL against DuckDB on the smallest tables, and the rest against plain Python."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo, hashing, text
from tilewright.operators import geometry, lifecycle, spatial, tiles
from tilewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_others_have_their_own_test():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"label_collisions", "tile_cover"}


def test_tile_cover(spark):
    """The query against comparing every tile with all that were taken before it."""
    from tilewright.plans import set_queries

    got = sorted((r.view, r.z, r.x, r.y) for r in set_queries.tile_cover(spark, SF).collect())
    five = {(r.x, r.y) for r in set_queries._tiles(spark, SF, 5).collect()}
    every = {(5 - d, x >> d, y >> d) for x, y in five for d in range(3)}
    want = []
    for view in range(3):
        taken = []
        for z, x, y in sorted((t for t in every if sum(t) % (view + 2)), key=lambda t: (-t[0], abs(t[1] - 8 * view), t[1], t[2])):
            if not any(z >= a and (x >> (z - a), y >> (z - a)) == (b, c) or z < a and (b >> (a - z), c >> (a - z)) == (x, y) for a, b, c in taken):
                taken.append((z, x, y))
        want += [(view, *t) for t in taken]
    assert got == sorted(want) and len(got) > 30


def greedy(rows):
    """Accepted groups of one frame by comparing each box with all that are placed: (group, x, y, w, h, rank, seeded) rows, enabled ones only."""
    groups = {}
    for g, *box, rank, seeded in rows:
        boxes, best, was = groups.get(g, ([], rank, False))
        groups[g] = ([*boxes, box], min(best, rank), was or seeded)
    hits = lambda g: {o for o in placed for a in groups[g][0] for b in groups[o][0] if abs(a[0] - b[0]) < a[2] + b[2] and abs(a[1] - b[1]) < a[3] + b[3]}
    order, placed = sorted(groups, key=lambda g: (groups[g][1], g)), set()
    for g in order:
        if groups[g][2] and not hits(g):
            placed.add(g)
    for g in order:
        if g not in placed:
            behind = hits(g)
            if all(groups[g][1] < groups[o][1] for o in behind):
                placed = (placed - behind) | {g}
    return placed


def test_label_collisions(spark):
    """The query, and groups of several boxes, against all pairs."""
    from tilewright.plans import set_queries

    got = {}
    for r in set_queries.label_collisions(spark, SF).collect():
        if r.accepted:
            got.setdefault(r.frame_id, set()).add(r.label_key)
    frames = {}
    for r in set_queries.plane(spark, SF).collect():
        k = r.id
        if k % 11:
            frames.setdefault(k % 5, []).append((k, r.px, r.py, 20 + k % 60, 8 + k % 9, (k % 4, k % 7, k % 50), k % 6 == 0))
    assert got == {f: greedy(rows) for f, rows in frames.items()}
    for seed in range(20):
        labels = boxes(80, seed)
        rows = [(r.group_id, r.cx, r.cy, r.hw, r.hh, (r.priority, r.secondary, r.sort_priority), r.was_accepted) for r in labels.itertuples() if r.enabled]
        assert set(spatial.place_greedily(labels).query("accepted").group_id) == greedy(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mercator_round_trip(spark):
    rows = [(lat, lon) for lat in (-89.0, -85.0, -40.5, 0.0, 66.6, 85.0, 89.9) for lon in (-180.0, -179.99, -0.1, 0.0, 90.0, 179.99)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    got = df.select("lat", "lon", geo.latitude_at(geo.world_y(F.col("lat"))).alias("a"), geo.longitude_at(geo.world_x(F.col("lon"))).alias("o")).collect()
    for r in got:
        assert abs(r.a - max(-geo.MAX_LATITUDE, min(geo.MAX_LATITUDE, r.lat))) < 1e-9 and abs(r.o - r.lon) < 1e-9


def test_great_circle_edges(spark):
    rows = [(0.0, 0.0, 0.0, 0.0, 0.5), (0.0, 0.0, 0.0, 180.0, 0.5), (10.0, 170.0, 10.0, -170.0, 0.5), (89.0, 0.0, 89.0, 180.0, 0.5), (5.0, 5.0, 6.0, 6.0, -1.0), (5.0, 5.0, 6.0, 6.0, 2.0)]
    df = spark.createDataFrame(rows, "lat1 double, lon1 double, lat2 double, lon2 double, t double")
    c = [F.col(k) for k in ("lat1", "lon1", "lat2", "lon2")]
    got = df.select(geo.along(*c, F.col("t")).alias("p"), geo.bearing(*c).alias("b")).collect()
    assert (got[0].p.lat, got[0].p.lon, got[0].b) == (0.0, 0.0, 0.0)
    assert abs(got[1].p.lat) < 1e-9 and abs(abs(got[1].p.lon) - 90) < 1e-6
    assert abs(abs(got[2].p.lon) - 180) < 1e-9 and abs(got[3].p.lat - 90) < 1e-6
    assert (got[4].p.lat, got[5].p.lat) == (5.0, 6.0)


def test_regions_at_the_edges(spark):
    rows = [(1, -10.0, 170.0, 10.0, 190.0, 0, 3), (2, -90.0, -180.0, 90.0, 180.0, 0, 2), (3, 10.0, 0.0, -10.0, 10.0, 0, 2), (4, float("nan"), 0.0, 1.0, 1.0, 0, 1), (5, 0.0, 0.0, 1.0, 1.0, 5, 2), (6, 51.3, -0.5, 51.7, 0.3, 14, 14)]
    df = spark.createDataFrame(rows, "id int, sw_lat double, sw_lon double, ne_lat double, ne_lon double, z_min int, z_max int")
    got = {r.id: r.n for r in tiles.region_tiles(df).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {1, 2, 6} and got[2] == 1 + 4 + 16
    at3 = tiles.region_ranges(df).where("id = 1 AND z = 3").orderBy("part").collect()
    assert [(r.x0, r.x1) for r in at3] == [(7, 7), (0, 0)]


def boxes(n, seed):
    rng = random.Random(seed)
    return pd.DataFrame([{"group_id": i // 2, "cx": rng.random() * 300, "cy": rng.random() * 300, "hw": 5 + rng.random() * 20, "hh": 5 + rng.random() * 10, "priority": rng.randint(0, 2), "secondary": rng.randint(0, 2), "sort_priority": rng.randint(0, 3), "enabled": rng.random() < 0.9, "was_accepted": rng.random() < 0.3} for i in range(n)])


@pytest.mark.parametrize("seed", range(5))
def test_greedy_placement(seed):
    labels = boxes(120, seed)
    got = spatial.place_greedily(labels, cell=17.0)
    assert got.accepted.tolist() == spatial.place_greedily(labels, cell=1e6).accepted.tolist()
    rows = got[got.accepted].to_dict("records")
    hit = lambda a, b: abs(a["cx"] - b["cx"]) < a["hw"] + b["hw"] and abs(a["cy"] - b["cy"]) < a["hh"] + b["hh"]
    assert not any(hit(a, b) for a in rows for b in rows if a["group_id"] < b["group_id"])
    assert all(x.accepted.nunique() == 1 for _, x in got[got.enabled].groupby("group_id"))


def test_boxes_that_touch_do_not_overlap(spark):
    rows = [(1, 0.0, 0.0, 5.0, 5.0), (2, 10.0, 0.0, 5.0, 5.0), (3, 9.9, 0.0, 5.0, 5.0)]
    got = spatial.overlaps(spark.createDataFrame(rows, "id int, cx double, cy double, hw double, hh double"), 4.0)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 3), (2, 3)]


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() * 100 - 50, rng.random() * 100 - 50) for i in range(300)] + [(900, 0.0, 0.0), (901, 0.0, 0.0), (902, 10.0, 0.0)]
    got = sorted((r.a, r.b) for r in spatial.near_pairs(spark.createDataFrame(rows, "id int, px double, py double"), 10.0).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 10.0)
    assert got == want


def star(rng, n, r0, r1):
    import math

    far = [r0 + rng.random() * (r1 - r0) for _ in range(n)]
    return [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(far)]


def test_triangles_cover_the_polygon():
    for seed in range(60):
        rng = random.Random(seed)
        ring = star(rng, rng.randint(3, 40), 60, 100)
        holes = [] if len(ring) < 12 else [[(x * 0.1 + dx, y * 0.1 + dy) for x, y in star(rng, 6, 50, 100)] for dx, dy in ((0, 0), (25, 3), (-20, -20))][: rng.randint(0, 3)]
        assert geometry.deviation(ring, holes, geometry.triangles(ring, holes)) < 1e-9, seed
    assert geometry.triangles([(0, 0), (1, 1)]) == [] and len(geometry.triangles([(0, 0), (4, 0), (4, 4), (0, 4)])) == 2


def test_clips():
    assert abs(abs(geometry.area(geometry.clip_ring([(-5, -5), (15, -5), (15, 15), (-5, 15)], 0, 10))) - 100) < 1e-9
    assert geometry.clip_ring([(20, 20), (30, 20), (30, 30)], 0, 10) == []
    pieces = geometry.clip_line([(-5, 5), (5, 5), (5, 20), (8, 20), (8, 5)], 0, 10)
    assert [(p[1], p[2]) for p in pieces] == [(True, True), (True, False)]
    assert pieces[0][0] == [(0.0, 5.0), (5.0, 5.0), (5.0, 10.0)]


def test_rings_and_lines():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert geometry.inside(square, (4, 2)) and not geometry.inside(square, (4, 2), None) and geometry.inside(square, (1, 1), None)
    turned = [(4, 4), (4, 0), (0, 0), (0, 4), (4, 4)]
    assert geometry.canonical_ring(square) == geometry.canonical_ring(turned)
    assert geometry.outermost([square, [(1, 1), (2, 1), (2, 2)], [(9, 9), (10, 9), (10, 10)]]) == [0, 2]
    assert sum(map(geometry.line_length, geometry.dashes([(0, 0), (10, 0), (10, 10)], 3, 2))) == pytest.approx(12)
    assert [(len(p), at) for p, at in geometry.split_at([(0, 0), (3, 0), (5, 0)], {(3, 0)})] == [(2, 0.0), (2, 3.0)]
    joined = geometry.stitched([("a", [(0, 0), (1, 0)]), ("b", [(1, 0), (2, 2)]), ("a", [(2, 0), (1, 0)]), ("a", [(2, 0), (3, 0)])])
    assert joined == [("a", [(0, 0), (1, 0)]), ("b", [(1, 0), (2, 2)]), ("a", [(3, 0), (2, 0), (1, 0)])]  # not across the T with b
    assert geometry.stitched([("a", [(0, 0), (1, 0)]), (None, [(1, 0), (2, 2)]), ("a", [(2, 0), (1, 0)])], [True, False, True])[0] == ("a", [(0, 0), (1, 0), (2, 0)])
    assert len(geometry.stitched([("a", [(0, 0), (1, 0)]), (None, [(1, 0), (2, 2)]), ("a", [(2, 0), (1, 0)])], [True, True, True])) == 3
    small = [(1, 1), (2, 1), (2, 2)]
    assert geometry.outermost([square, small], [(0, 5), (0, 9)]) == [0, 1] and geometry.outermost([square, small], [(0, 5), (1, 5)]) == [0]
    assert geometry.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geometry.anchors([(0, 0), (1700, 0)], 100) == [400.0, 1200.0] and geometry.anchors([(0, 0), (50, 0)], 100) == [25.0]
    assert geometry.anchors([(0, 0), (1700, 0)], 1000) == [500.0] and len(geometry.anchors([(0, 0), (9000, 0)], 1)) == 7 and geometry.anchors([(0, 0), (50, 0)], 0) == []


def test_hashes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "ü"), (3, None)], "f bigint, t string")
    got = [r.k for r in df.select(hashing.label_key("f", "t").alias("k")).collect()]
    assert got[2] is None and got[0] == hashing.signed(hashing.fold_words(hashing.LABEL_SEED, [1, 1, 97])) and got[1] == hashing.signed(hashing.fold_words(hashing.LABEL_SEED, [2, 2, 0xC3, 0xBC]))
    assert spark.range(1).select(hashing.splitmix("id").alias("x")).first().x == hashing.signed(0xE220A8397B1DCDAF)
    pair = df.select(hashing.pair_direction(F.lit(5), F.lit(9)).alias("x"), hashing.pair_direction(F.lit(9), F.lit(5)).alias("y")).first()
    assert pair.x == pair.y


def test_outcomes(spark):
    rows = [(None, 0), (200, 5), (200, 0), (401, 0), (403, 0), (404, 0), (410, 0), (429, 0), (503, 0), (418, 0)]
    got = [r.o for r in spark.createDataFrame(rows, "s int, n int").select(text.outcome(F.col("s"), F.col("n")).alias("o")).collect()]
    assert got == ["network", "success", "empty_body", "unauthorized", "forbidden", "not_found", "gone", "rate_limited", "server", "client"]


def test_no_hold_across_a_gap(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 10, 50)]
    df = spark.createDataFrame(rows, "key int, t string").select("key", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in lifecycle.holds(df, 1800).collect()) == [1, 2]


def test_lines_beside_and_around():
    square = [(2, -1), (4, -1), (4, 1), (2, 1)]
    assert geometry.outside([(0, 0), (10, 0)], [square]) == [[(0, 0), (2.0, 0.0)], [(4.0, 0.0), (10, 0)]]
    assert geometry.outside([(0, 5), (10, 5)], [square]) == [[(0, 5), (10, 5)]] and geometry.outside([(2.5, 0), (3, 0)], [square]) == []
    assert geometry.offset([(0, 0), (10, 0)], 2) == [(0.0, 2.0), (10.0, 2.0)] and geometry.offset([(0, 0), (0, 0)], 2) == []
    corner = geometry.offset([(0, 0), (10, 0), (10, 10)], 1)
    assert corner[0] == (0.0, 1.0) and abs(corner[1][0] - 9) < 0.5 and corner[2] == (9.0, 10.0)
    assert geometry.inset([(0, 0), (10, 0)], 2, 3) == [(2.0, 0.0), (7.0, 0.0)] and geometry.inset([(0, 0), (4, 0)], 2, 3) is None
    assert geometry.inset([(0, 0), (5, 0), (5, 5)], 1, 1) == [(1.0, 0.0), (5, 0), (5.0, 4.0)]
    assert geometry.merged([[(0, 0), (1, 0)], [(5, 0), (1, 0)], [(9, 9), (8, 8)], [(-1, 0), (0, 0)]]) == [[(-1, 0), (0, 0), (1, 0), (5, 0)][::-1], [(9, 9), (8, 8)]]


def test_shape_tables(spark):
    from tilewright.operators import shapes

    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    line = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(1, "a", 0, pts((0, 0), (1, 0))), (1, "a", 1, pts((1, 0), (2, 0))), (1, "b", 2, pts((1, 0), (1, 5))), (2, "a", 0, pts((0, 0), (300, 0)))], f"tile int, street string, seq int, pts {line}")
    assert sorted((r.tile, r.street, len(r.pts)) for r in shapes.stitched(rows, "tile").collect()) == [(1, "a", 2), (1, "a", 2), (1, "b", 2), (2, "a", 2)]
    assert shapes.split_at_junctions(rows, "tile").count() == 4
    merged = {(r.tile, tuple((p.x, p.y) for p in r.pts)) for r in shapes.merged_labels(rows, "tile").collect()}
    assert {(t, frozenset(p)) for t, p in merged if t == 2} == {(2, frozenset({(0.0, 0.0), (300.0, 0.0)}))}
    assert {q for t, p in merged if t == 1 for q in p} == {(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (1.0, 5.0)}
    rings = spark.createDataFrame([(1, 0, pts((0, 0), (9, 0), (9, 9), (0, 9))), (1, 1, pts((1, 1), (2, 1), (2, 2)))], f"building int, seq int, pts {line}")
    assert [r.seq for r in shapes.outermost(rings, "building").collect()] == [0]
    cut = shapes.long_enough(shapes.clipped_lines(rows, "pts", 0.0, 100.0), "pieces", 50.0)
    assert sorted((r.tile, r.street) for r in cut.collect()) == [(1, "a"), (1, "a"), (1, "b"), (2, "a")]
    assert [len(r.clipped) for r in shapes.clipped_rings(rings, "pts", -1.0, 5.0).orderBy("seq").collect()] == [4, 3]
    assert [len(r.hull) for r in shapes.hulls(rings, "pts").orderBy("seq").collect()] == [4, 3]


def test_labels_without_alias_judge_every_row(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_linenumber").collect()
    shipped = {f"n{r.s_suppkey % 7}" for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    want = sum(not {f"n{r.l_suppkey % 50}", f"m{r.l_linenumber}"} & shipped for r in rows)
    assert sum(r.n for r in catalog.QUERIES["labels_without_alias"](spark, SF).collect()) == want
