"""Contours of ground cells against flood fill and walking along the sides."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from ember.operators import outlines as O

KEYS = ("request_id", "epsg")
SCHEMA = "request_id bigint, epsg int, gx bigint, gy bigint, cls int, scene_id string, date_pre timestamp_ntz, date_post timestamp_ntz, inside_ha double"
CORNERS = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")


def cells(spark, grids, scene=lambda x, y: "s"):
    """``{request: {(gx, gy): cls}}`` as cells; lon/lat of corners are grid coordinates."""
    rows = [(r, 32637, x, y, c, scene(x, y), None, None, 0.25) for r, grid in grids.items() for (x, y), c in grid.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    return df.withColumns(dict(zip(CORNERS, (x, y + 1, x + 1, y + 1, x + 1, y, x, y))))


def regions_of(grid):
    """Flood fill: lists of cells of one class, 4-connected."""
    left, out = dict(grid), []
    while left:
        start, c = next(iter(left.items()))
        todo, part = [start], []
        left.pop(start)
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if left.get(n) == c:
                    left.pop(n)
                    todo.append(n)
        out.append((c, part))
    return [(c, p) for c, p in out if c > 0]


def rings_of(part):
    """Walk the border sides of one region, left turns first; lists of first corners and directions."""
    inside, step = set(part), ((1, 0), (0, 1), (-1, 0), (0, -1))
    sides = collections.defaultdict(set)
    for x, y in part:
        for d, (sx, sy, nx, ny) in enumerate(((x, y, x, y - 1), (x + 1, y, x + 1, y), (x + 1, y + 1, x, y + 1), (x, y + 1, x - 1, y))):
            if (nx, ny) not in inside:
                sides[sx, sy].add(d)
    rings = []
    while sides:
        at = min(sides)
        d, ring = min(sides[at]), []
        while at in sides and d in sides[at]:
            sides[at].remove(d)
            if not sides[at]:
                del sides[at]
            ring.append((*at, d))
            at = (at[0] + step[d][0], at[1] + step[d][1])
            options = sides.get(at, set())
            d = (d + 1) % 4 if (d + 1) % 4 in options else next(iter(options), -1)
        rings.append(ring)
    return rings


def test_a_fire_over_four_chips_is_one_ring(spark):
    grid = {(x, y): 2 for x in range(6, 14) for y in range(6, 14)}
    regions, vertices = O.visible_contours(cells(spark, {1: grid}, lambda x, y: f"chip{x // 10}{y // 10}"), KEYS, CORNERS)
    (r,) = regions.collect()
    assert (r.cells, r.rings, r.holes, r.sides, r.enclosed, r.closed) == (64, 1, 0, 32, 64, True)
    assert r.area_ha == 16.0 and r.source_scene_ids == ["chip00", "chip01", "chip10", "chip11"]
    (line,) = O.ring_lines(vertices, KEYS).collect()
    assert not line.hole and [tuple(p) for p in line.line] == [(6.0, 6.0), (14.0, 6.0), (14.0, 14.0), (6.0, 14.0), (6.0, 6.0)]


def test_holes_islands_and_touching_corners(spark):
    ring = {(x, y): 3 for x in range(9) for y in range(9) if not (2 <= x <= 6 and 2 <= y <= 6)}
    island = ring | {(4, 4): 3}  # a region of its own inside the hole
    touching = {(0, 0): 1, (1, 1): 1, (2, 0): 1, (5, 5): 1, (5, 6): 2}
    eight = {(x, y): 1 for x in range(5) for y in range(5)}
    for hole in ((1, 1), (2, 2), (3, 3)):  # holes that touch at corners
        del eight[hole]
    regions, _ = O.visible_contours(cells(spark, {1: island, 2: touching, 3: eight}), KEYS)
    got = sorted((r.request_id, r.cls, r.cells, r.rings, r.holes, r.enclosed) for r in regions.collect())
    assert got == [(1, 3, 1, 1, 0, 1), (1, 3, 56, 2, 1, 56), (2, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1), (2, 2, 1, 1, 0, 1), (3, 1, 22, len(rings_of(list(eight))), len(rings_of(list(eight))) - 1, 22)]


def test_random_grids_equal_flood_fill_and_walks(spark):
    rng = random.Random(4)
    grids = {r: {(x - 9, y - 5): rng.choice([0, 1, 1, 1, 2, 3][: rng.choice([3, 6])]) for x in range(18) for y in range(14) if rng.random() < 0.95} for r in range(6)}
    regions, vertices = O.visible_contours(cells(spark, grids), KEYS, CORNERS)
    got = collections.Counter((r.request_id, r.cls, r.cells, r.rings, r.sides, r.enclosed, r.closed) for r in regions.collect())
    want, lines = collections.Counter(), collections.Counter()
    for request, grid in grids.items():
        for c, part in regions_of(grid):
            rings = rings_of(part)
            want[request, c, len(part), len(rings), sum(map(len, rings)), len(part), True] += 1
            for ring in rings:
                first = min(range(len(ring)), key=lambda i: ring[i])
                ring = ring[first:] + ring[:first]
                bends = [(float(x), float(y)) for i, (x, y, d) in enumerate(ring) if d != ring[i - 1][2]]
                lines[request, c, tuple(bends)] += 1
    assert got == want
    found = collections.Counter((r.request_id, r.cls, tuple(tuple(p) for p in r.line[:-1])) for r in O.ring_lines(vertices, KEYS).collect())
    assert found == lines


def test_a_winding_fire_needs_few_rounds(spark):
    spiral, x, y, d, n = {}, 0, 0, 0, 24
    while n > 0:
        for _ in range(2):
            for _ in range(n):
                spiral[x, y] = 1
                x, y = x + (1, 0, -1, 0)[d], y + (0, 1, 0, -1)[d]
            d = (d + 1) % 4
        n -= 2
    (r,) = O.visible_contours(cells(spark, {1: spiral}), KEYS)[0].collect()
    assert r.rings == len(rings_of(list(spiral))) and r.enclosed == len(spiral) and r.closed


@pytest.mark.parametrize("grid", [{}, {(0, 0): 0}])
def test_no_fire(spark, grid):
    regions, vertices = O.visible_contours(cells(spark, {1: grid}), KEYS)
    assert regions.count() == 0 and vertices.count() == 0
