import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.functions import geometry as G
from ember.functions import projection as P
from ember.operators import areas as A
from ember.operators import components as K
from ember.operators import contracts as V
from ember.operators import ranking as N
from ember.operators import spatial as X
from ember.plans import analysis as Y


def test_projection_closes(spark):
    df = spark.createDataFrame([(32637, 655360.0, 5488640.0), (32638, 310000.0, 4800000.0), (32737, 655360.0, 4488640.0)], "epsg int, x double, y double")
    placed = P.with_lonlat(df, {"p": (F.col("x"), F.col("y"))})
    x, y = P.lonlat_to_utm(F.col("p_lon"), F.col("p_lat"), F.col("epsg"))
    for r in placed.select("x", "y", x.alias("x2"), y.alias("y2")).collect():
        assert abs(r.x - r.x2) < 1e-3 and abs(r.y - r.y2) < 1e-3


def test_equal_area_constants(spark):
    x, y = P.lonlat_to_cea(F.lit(180.0), F.lit(0.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row.x == pytest.approx(17367530.445, abs=1e-3) and row.y == 0.0


def scene(spark, rows):
    return spark.createDataFrame(
        rows,
        "scene_id string, chip_id string, task string, observed_at timestamp_ntz, date_pre timestamp_ntz, date_post timestamp_ntz, w double, s double, e double, n double, "
        "source_scene_id string, grid_row_offset bigint, grid_col_offset bigint, epsg int, ga double, gb double, gc double, gd double, ge double, gf double",
    )


def d(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


GEO = (4326, 0.01, 0.0, 30.0, 0.0, -0.01, 50.0)
BOX = (30.0, 49.98, 30.02, 50.0)


def request(spark, w, s, e, n, task, start="2024-01-01", end="2025-01-01"):
    r = spark.createDataFrame([("q", task, d(start), d(end), w, s, e, n)], "request_id string, task string, start timestamp_ntz, end timestamp_ntz, aw double, as double, ae double, an double")
    a = A.bbox_aoi(r.select("request_id", "aw", "as", "ae", "an"))
    ring = F.slice(G.bbox_ring(F.col("aw"), F.col("as"), F.col("ae"), F.col("an")), 1, 4)
    return r, a.select("request_id", "edges", "rings", P.ring_area_ha(ring).alias("aoi_ha"))


def run(spark, pixels, scenes, masks, valid, box, task, **period):
    px = pixels(masks, "cls", {"valid": valid}).withColumn("score", F.lit(0.5))
    r, aoi = request(spark, *box, task, **period)
    return r, aoi, px, Y.analyse(r, scenes, px, aoi, F.lit(2), F.lit(2)).first()


def test_hotspots_and_period_end(spark, pixels):
    sc = scene(spark, [("a", "c", "af", d("2024-07-01"), None, None, *BOX, None, None, None, *GEO)])
    masks, valid = {"c": [[1, 0], [1, 1]]}, {"c": [[True, False], [True, True]]}
    *_, row = run(spark, pixels, sc, masks, valid, BOX, "af")
    assert row.hotspot_count == 3 and row.data_status == "partial" and 0.7 < row.coverage_fraction < 0.8
    *_, row = run(spark, pixels, sc, masks, valid, BOX, "af", end="2024-07-01")
    assert row.data_status == "no_data" and row.hotspot_count is None and row.observation_count == 0


def test_burn_area_of_first_cell(spark, pixels):
    sc = scene(spark, [("a", "c", "bs", None, d("2024-05-01"), d("2024-07-01"), *BOX, None, None, None, *GEO)])
    masks, valid = {"c": [[1, 2], [3, 0]]}, {"c": [[True, True], [True, True]]}
    *_, row = run(spark, pixels, sc, masks, valid, (30.0, 49.99, 30.01, 50.0), "bs")
    assert row.area_1 > 0 and row.area_2 == pytest.approx(0) and row.area_3 == pytest.approx(0)
    assert row.burn_area_ha == pytest.approx(row.area_1) and row.area_1 == pytest.approx(79.74, abs=0.05)
    assert row.data_status == "complete"


def test_newest_scene_hides_older(spark, pixels):
    sc = scene(
        spark,
        [
            ("old", "c1", "bs", None, d("2024-01-05"), d("2024-02-01"), *BOX, None, None, None, *GEO),
            ("new", "c2", "bs", None, d("2024-01-05"), d("2024-07-01"), *BOX, None, None, None, *GEO),
        ],
    )
    full = [[True, True], [True, True]]
    *_, row = run(spark, pixels, sc, {"c1": [[1, 1], [1, 1]], "c2": [[3, 3], [3, 3]]}, {"c1": full, "c2": full}, BOX, "bs")
    assert row.area_1 == 0 and row.area_3 > 0 and row.observation_count == 2
    *_, row = run(spark, pixels, sc, {"c1": [[1, 1], [1, 1]], "c2": [[0, 3], [3, 3]]}, {"c1": full, "c2": [[False, True], [True, True]]}, BOX, "bs")
    assert row.area_1 > 0


def test_all_invalid_is_no_data(spark, pixels):
    sc = scene(spark, [("a", "c", "bs", None, d("2024-05-01"), d("2024-07-01"), *BOX, None, None, None, *GEO)])
    *_, row = run(spark, pixels, sc, {"c": [[1, 1], [1, 1]]}, {"c": [[False] * 2] * 2}, BOX, "bs")
    assert (row.data_status, row.coverage_fraction, row.burn_area_ha, row.observation_count) == ("no_data", 0.0, None, 1)


def test_background_winner_removes_cell(spark):
    rows = [("s", 0, 0, "b", d("2024-07-01"), 0, 0, 1, True, 0.9), ("s", 0, 0, "a", d("2024-07-01"), 0, 0, 0, True, 0.1)]
    px = spark.createDataFrame(rows, "source_scene_id string, grid_row_offset bigint, grid_col_offset bigint, scene_id string, observed_at timestamp_ntz, rw bigint, cl bigint, cls int, valid boolean, score double")
    assert N.dedup_hotspots(px, F.lit(1), F.lit(1)).count() == 0


def test_clipping_matches_exact_rectangles(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        x, y = rng.uniform(29.98, 30.12), rng.uniform(49.98, 50.12)
        rows.append((i, x, y, x, y - 0.01, x + 0.01, y - 0.01, x + 0.01, y, x + 0.005, y - 0.005, 30.0, 50.0, 30.1, 50.1))
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, lon double, lat double, aw double, as double, ae double, an double")
    got = {r.id: r.inside_ha for r in A.clip_cells(A.bbox_aoi(df)).collect()}
    for r in rows:
        w, e = max(r[1], 30.0), min(r[5], 30.1)
        s, n = max(r[4], 50.0), min(r[2], 50.1)
        want = 0.0
        if e > w and n > s:
            want = A._ha([(w, s), (e, s), (e, n), (w, n)])
        assert got.get(r[0], 0.0) == pytest.approx(want, abs=1e-6)


def flood(mask):
    mask = np.asarray(mask)
    seen, out = set(), {}
    for start in np.ndindex(mask.shape):
        if start in seen or mask[start] == 0:
            continue
        stack, comp = [start], []
        seen.add(start)
        while stack:
            r, c = stack.pop()
            comp.append(r * mask.shape[1] + c)
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and q not in seen and mask[q] == mask[r, c]:
                    seen.add(q)
                    stack.append(q)
        for p in comp:
            out[p] = min(comp)
    return out


def test_components_and_contours(spark, pixels):
    spiral = np.ones((9, 9), int)
    for line in ((1, slice(0, 8)), (3, slice(1, 9)), (5, slice(0, 8)), (7, slice(1, 9))):
        spiral[line] = 0
    rng = np.random.default_rng(1)
    masks = {"spiral": spiral.tolist(), "noise": rng.integers(0, 3, (9, 9)).tolist(), "hole": [[1, 1, 1], [1, 0, 1], [1, 1, 1]], "pinch": [[1, 0], [0, 1]]}
    comps = K.components(pixels(masks)).cache()
    for chip, mask in masks.items():
        assert {r.pos: r.comp for r in comps.where(F.col("chip_id") == chip).collect()} == flood(mask)
    rings = K.contours(comps).withColumn("px", K.planar_ring_area(F.col("line")) * F.when(F.col("hole"), -1).otherwise(1))
    sizes = {(r.chip_id, r.comp): r["count"] for r in comps.groupBy("chip_id", "comp").count().collect()}
    areas = {(r.chip_id, r.comp): r.a for r in rings.groupBy("chip_id", "comp").agg(F.sum("px").alias("a")).collect()}
    assert areas == {k: float(v) for k, v in sizes.items()}
    hole = rings.where("chip_id = 'hole' and hole").first()
    assert hole.px == -1.0 and rings.where("chip_id = 'pinch'").count() == 2


def test_ring_rules(spark):
    circle = [(10 * np.cos(t), 10 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 60, endpoint=False)]
    crossed = circle[:20] + [circle[45]] + circle[20:45] + circle[46:]
    rings = {
        "bow": [(0, 0), (2, 2), (0, 2), (2, 0)], "tri": [(0, 0), (2, 0), (1, 2)], "line": [(0, 0), (1, 1)], "far": [(0, 0), (200, 0), (1, 2)],
        "closed": [(0, 0), (2, 0), (1, 2), (0, 0)], "flat": [(0, 0), (1, 1), (2, 2)], "circle": circle, "crossed": crossed,
    }
    rows = [(k, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)]
    got = {r.aoi_id: r.problem for r in V.ring_self_intersections(spark.createDataFrame(rows, "aoi_id string, seq int, lon double, lat double")).collect()}
    assert got == {
        "bow": "self-intersection", "line": "too few vertices", "far": "outside WGS84", "closed": "repeated closing vertex", "flat": "zero area", "crossed": "self-intersection",
    }


def test_touching_rectangles_do_not_overlap(spark):
    rows = [("train", 1, 0.0, 0.0, 10.0, 10.0), ("val", 1, 10.0, 0.0, 20.0, 10.0), ("val", 1, 9.0, 9.0, 19.0, 19.0), ("val", 2, 0.0, 0.0, 10.0, 10.0)]
    grids = spark.createDataFrame(rows, "split string, epsg int, x_min double, y_min double, x_max double, y_max double")
    assert [r.val_x_min for r in X.split_overlap(grids, 7.0).collect()] == [9.0]


@pytest.mark.parametrize("rows_per_task", [3, 1_000_000])
def test_box_join_is_exact_with_and_without_salting(spark, rows_per_task):
    rng = np.random.default_rng(4)
    a = [(i, *(lambda x, y: (x, y, x + 1.5, y + 1.0))(rng.uniform(0, 9), rng.uniform(0, 9))) for i in range(60)]
    b = [(i, *(lambda x, y: (x, y, x + 2.5, y + 0.5))(rng.uniform(0, 9), rng.uniform(0, 9))) for i in range(25)]
    left = spark.createDataFrame([(i, *map(float, r)) for i, *r in a], "lid int, w double, s double, e double, n double")
    right = spark.createDataFrame([(i, *map(float, r)) for i, *r in b], "rid int, aw double, as double, ae double, an double")
    got = sorted((r.lid, r.rid) for r in X.box_join(left, right, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), 2.0, rows_per_task=rows_per_task).collect())
    want = sorted((i, j) for i, w, s, e, n in a for j, w2, s2, e2, n2 in b if w <= w2 + (e2 - w2) and w2 <= e and w <= e2 and s <= n2 and s2 <= n)
    assert got == want


def test_polygon_with_hole_covers(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    rows = [(1, 0, r, i, float(x), float(y)) for r, ring in enumerate((outer, hole)) for i, (x, y) in enumerate(ring)]
    aoi = X.polygon_edges(spark.createDataFrame(rows, "aoi_id int, part int, ring int, seq int, lon double, lat double"))
    pts = spark.createDataFrame([("in", 0.5, 0.5), ("hole", 2.0, 2.0), ("rim", 1.0, 2.0), ("edge", 4.0, 2.0), ("out", 5.0, 2.0)], "id string, lon double, lat double")
    assert {r.id for r in X.points_in_aoi(pts, aoi).collect()} == {"in", "rim", "edge"}
