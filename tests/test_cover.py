"""The cover index against the fold over whole polygons."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.operators import cover as V
from ember.operators import spatial as X

VERTEX = "aoi_id int, part int, ring int, seq int, lon double, lat double"


def star(n, radius, cx=0.0, cy=0.0, depth=0.4):
    """A closed ring of n vertices with many spikes."""
    points = [(cx + radius * (1 - depth * (i % 3) / 2) * math.cos(2 * math.pi * i / n), cy + radius * (1 - depth * (i % 3) / 2) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return points + points[:1]


@pytest.fixture(scope="module")
def vertices(spark):
    rings = {
        (1, 0, 0): star(10_000, 3.0),
        (1, 0, 1): star(7, 0.4, 0.25, 0.25),
        (1, 1, 0): star(5, 0.5, 5.0, 1.0),
        (2, 0, 0): [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)],  # on tile and slab borders
        (2, 0, 1): [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)],
        (3, 0, 0): [(-0.5, -2.0), (2.0, 0.0), (-0.5, 2.0), (0.5, 0.0), (-0.5, -2.0)],
        (4, 0, 0): [(7, 7), (9, 7), (8, 7), (7, 7)],  # flat
    }
    rows = [(*k, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, VERTEX)


def spots(spark, vertices):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, p)) for p in rng.uniform(-4, 6, (700, 2))]
    rows += [(x / 2, y / 2) for x in range(-3, 12) for y in range(-3, 10)]  # corners, rims and borders
    rows += [(r.lon, r.lat) for r in vertices.where("seq % 97 = 0").collect()]
    rows += [(8.5, 7.0), (8.5, 7.1), (1e3, 1e3)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, lon double, lat double")


@pytest.mark.parametrize("size,per_slab", [(1.0, 32), (4.0, 4), (0.25, 1000)])
def test_points_in_cover_equal_the_whole_polygons(spark, vertices, size, per_slab):
    points = spots(spark, vertices)
    cover = V.aoi_cover(V.ring_edges(vertices), size=size, per_slab=per_slab).cache()
    got = V.points_in_cover(points, cover, size)
    assert got.columns == ["id", "lon", "lat", "aoi_id"]
    pairs = [(r.id, r.aoi_id) for r in got.collect()]
    want = {(r.id, r.aoi_id) for r in X.points_in_aoi(points, X.polygon_edges(vertices)).collect()}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 400


def test_no_piece_holds_a_whole_polygon(vertices):
    cover = V.aoi_cover(V.ring_edges(vertices), per_slab=32).cache()
    most = cover.where("aoi_id = 1").agg(F.max(F.size("edges"))).first()[0]
    assert most < 2000  # of 10 000; at the poles all spikes point one way
    assert cover.where("edges is null and inside").count() > 0


def test_boxes_equal_the_whole_polygons(spark, vertices):
    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-4, 5, (2, 150)), *rng.uniform(0.01, 0.6, (2, 150))))]
    rows += [(200, 4.0, 4.0, 5.0, 5.0), (201, 1.5, 1.5, 2.0, 2.0), (202, -50.0, -50.0, 50.0, 50.0)]
    boxes = spark.createDataFrame(rows, "scene_id int, w double, s double, e double, n double")
    edges = V.ring_edges(vertices)
    got = {tuple(r) for r in V.boxes_meeting(boxes, edges, V.aoi_cover(edges).cache(), "scene_id").collect()}
    want = {(r.scene_id, r.aoi_id) for r in X.footprints_intersecting(boxes, X.polygon_edges(vertices)).collect()}
    assert got == want and (201, 2) not in want and len(want) > 50


def test_pairs_with_small_polygons_are_not_exchanged(spark, vertices):
    boxes = spark.createDataFrame([(1, 0.5, 0.5, 0.9, 0.9), (1, 0.5, 0.5, 0.9, 0.9), (2, 3.5, 3.5, 4.5, 4.5), (3, -9.0, -9.0, -8.0, -8.0), (4, 0.5, 0.5, 0.9, 0.9), (4, 3.5, 3.5, 4.5, 4.5)], "scene_id int, w double, s double, e double, n double")
    edges = V.ring_edges(vertices.where("aoi_id in (2, 3)")).checkpoint()
    cover = V.aoi_cover(edges).checkpoint()
    met = V.boxes_meeting(boxes, edges, cover, "scene_id")
    assert sorted(map(tuple, met.collect())) == [(1, 2), (1, 3), (2, 2), (4, 2), (4, 3)]
    single = V.boxes_meeting(boxes.where("scene_id = 2"), edges, cover, "scene_id")
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate" not in plan.splitlines()[1]  # no distinct above the pairs of small polygons


@pytest.mark.parametrize("few", [1, 6])
def test_boxes_meet_whether_polygons_travel_whole_or_not(spark, vertices, few):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-4, 5, (2, 80)), *rng.uniform(0.01, 0.9, (2, 80))))]
    boxes = spark.createDataFrame(rows, "scene_id int, w double, s double, e double, n double")
    shapes = vertices.where("aoi_id > 1")
    edges = V.ring_edges(shapes).checkpoint()
    got = sorted(tuple(r) for r in V.boxes_meeting(boxes, edges, V.aoi_cover(edges).checkpoint(), "scene_id", few=few).collect())
    want = sorted({(r.scene_id, r.aoi_id) for r in X.footprints_intersecting(boxes, X.polygon_edges(shapes)).collect()})
    assert got == want and want


def test_sizes_are_powers_of_two(spark, vertices):
    with pytest.raises(ValueError):
        V.aoi_cover(V.ring_edges(vertices), size=0.3)
    empty = V.aoi_cover(V.ring_edges(vertices.limit(0))).cache()
    assert V.points_in_cover(spots(spark, vertices), empty).count() == 0


@pytest.mark.parametrize("few", [0, 3, 6])
def test_small_pieces_in_plain_columns_decide_like_the_fold(spark, few):
    rings = {1: [(0, 0), (2, 0), (3, 1), (2, 2), (0, 2), (-1, 1), (0, 0)], 2: [(0.5, 0), (1, 3), (2, 0), (0.5, 0)], 3: star(9, 2.0)}
    rows = [(k, 0, 0, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)]
    rows += [(4, 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 0.0)])] + [(5, 0, 0, i, x, 0.5) for i, x in enumerate([0.0, float("nan"), 0.0])]
    shapes = spark.createDataFrame(rows, VERTEX)
    spots = spark.createDataFrame([(i, x / 4, y / 4) for i, (x, y) in enumerate((x, y) for x in range(-8, 13) for y in range(-8, 13))] + [(900, None, 1.0), (901, 1.0, None), (900, 1.0, 1.0), (900, 1.0, 1.0)], "id int, lon double, lat double")
    cover = V.aoi_cover(V.ring_edges(shapes), per_slab=8).checkpoint()
    got = sorted(tuple(r) for r in V.points_in_cover(spots, cover, few=few).select("id", "aoi_id").collect())
    want = sorted((r.id, r.aoi_id) for r in X.points_in_aoi(spots, X.polygon_edges(shapes.where("aoi_id <= 3"))).collect())
    assert [p for p in got if p[1] <= 3] == want and got.count((900, 1)) == 2
    assert [p for p in got if p[1] > 3] == sorted(tuple(r) for r in V.points_in_cover(spots, cover, few=-1).where("aoi_id > 3").select("id", "aoi_id").collect())


def test_pairs_with_small_pieces_are_tested_in_code_the_jvm_compiles(spark):
    shapes = spark.createDataFrame([(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (3, 1), (2, 2), (0, 2), (-1, 1), (0, 0)])], VERTEX)
    spots = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double")
    met = V.points_in_cover(spots, V.aoi_cover(V.ring_edges(shapes)).checkpoint())
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "lambda" not in joins[0] and "lambda" in joins[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.points_in_cover(spots, V.aoi_cover(V.ring_edges(shapes)).checkpoint())._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
