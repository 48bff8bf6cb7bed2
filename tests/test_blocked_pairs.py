"""Pairs of boxes met by blocks."""

import re

import numpy as np
import pytest

from ember.operators import cover as V
from ember.operators import spatial as X
from ember.session import compilable, cut_lineage


def method_sizes(spark, df, capsys):
    """Bytes of the largest method of every compiled stage; the JVM interprets methods above 8000."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.select("*").explain("codegen")
        return [int(size) for size in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def boxes_of(seed, count, most):
    """``count`` boxes of very different sizes, some of them equal, on and across tile borders, some unknown."""
    rng = np.random.default_rng(seed)
    at, side = rng.uniform(-9, 9, (count, 2)).round(1), (most * rng.uniform(0, 1, (count, 2)) ** 4).round(1)
    rows = [(float(x), float(y), float(x + a), float(y + b)) for (x, y), (a, b) in zip(at, side)]
    return rows + rows[:5] + [(None, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, None), (-5.0, -5.0, 0.0, 0.0), (0.0, 0.0, 5.0, 5.0)]


@pytest.mark.parametrize("limits", [{}, {"rows_per_task": 7, "per_block": 3, "per_book": 2}])
@pytest.mark.parametrize("timed", [False, True])
def test_blocks_give_every_pair_once(spark, limits, timed):
    left = [(i, "ab"[i % 2] if i % 9 else None, *box, i % 11) for i, box in enumerate(boxes_of(1, 90, 30))]
    right = [(i, "ab"[i % 2], *box, i % 5 if i % 3 else None, i % 7 + 2 if i % 4 else None) for i, box in enumerate(boxes_of(2, 60, 12))]
    a = spark.createDataFrame(left + left[:3], "l int, k string, w double, s double, e double, n double, t int")
    b = spark.createDataFrame(right, "r int, k string, aw double, `as` double, ae double, an double, since int, until int")
    more = {"moment": "t", "period": ("since", "until")} if timed else {}
    got = X.blocked_join(a, b, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), 2.0, ["k"], **more, **limits)
    assert got.columns == ["k", "l", "w", "s", "e", "n", "t", "r", "aw", "as", "ae", "an", "since", "until"]
    want = []
    for i, k, w, s, e, n, t in left + left[:3]:
        for j, m, aw, as_, ae, an, since, until in right:
            if None not in (k, w, s, e, n, aw, as_, ae, an) and k == m and w <= ae and aw <= e and s <= an and as_ <= n:
                if not timed or ((since is None or t >= since) and (until is None or t < until)):
                    want.append((i, j))
    assert sorted((r.l, r.r) for r in got.collect()) == sorted(want) and len(want) > 100
    assert X.blocked_join(a.limit(0), b, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), 2.0, ["k"]).count() == 0


def test_pairs_with_small_polygons_are_tested_in_compiled_code(spark, capsys):
    ring = [(0, 0), (2, -1), (4, 0), (4, 2), (2, 3), (0, 2), (0, 0)]
    rows = [(a, 0, 0, i, float(x + 3 * a), float(y + 2 * a)) for a in range(5) for i, (x, y) in enumerate(ring)]
    edges = V.ring_edges(spark.createDataFrame(rows, "aoi_id int, part int, ring int, seq int, lon double, lat double")).checkpoint()
    boxes = spark.createDataFrame([(i, i / 3, i / 4, i / 3 + 1.5, i / 4 + 0.5) for i in range(-10, 50)], "scene_id int, w double, s double, e double, n double")
    met = V.boxes_meeting(boxes, edges, V.aoi_cover(edges).checkpoint(), "scene_id")
    sizes = method_sizes(spark, met, capsys)
    assert sizes and 0 < min(sizes) and max(sizes) < 8000
    aoi = X.polygon_edges(spark.createDataFrame(rows, "aoi_id int, part int, ring int, seq int, lon double, lat double"))
    want = sorted({(r.scene_id, r.aoi_id) for r in X.footprints_intersecting(boxes, aoi).collect()})
    assert sorted(tuple(r) for r in met.collect()) == want and want


def test_polygons_with_unknown_corners_are_met_edge_by_edge(spark):
    rows = [(1, 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, None), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    edges = V.ring_edges(spark.createDataFrame(rows, "aoi_id int, part int, ring int, seq int, lon double, lat double")).checkpoint()
    boxes = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0), (2, 9.0, 9.0, 10.0, 10.0), (3, 3.0, 3.5, 3.5, 4.5)], "scene_id int, w double, s double, e double, n double")
    met = V.boxes_meeting(boxes, edges, V.aoi_cover(edges).checkpoint(), "scene_id")
    assert sorted(tuple(r) for r in met.collect()) == [(1, 1), (3, 1)]


def test_scenes_meet_requests_by_blocks_in_space_and_time(spark):
    day = lambda c: f"timestamp_ntz '2020-01-01' + make_dt_interval({c})"
    scenes = spark.range(300).selectExpr(
        "id as scene_id", "if(id % 3 = 0, 'af', 'bs') as task", f"if(id % 3 = 0, {day('cast(id as int)')}, null) as observed_at", f"{day('cast(id - id % 4 as int)')} as date_pre",
        f"{day('cast(id as int)')} as date_post", "double(id % 17) as w", "double(id % 13) as s", "double(id % 17 + 2) as e", "double(id % 13 + 1) as n",
    )
    requests = spark.range(40).selectExpr(
        "id as request_id", "if(id % 2 = 0, 'af', 'bs') as task", f"if(id % 5 = 0, null, {day('cast(id as int)')}) as start", f"if(id % 7 = 0, null, {day('cast(4 * id + 60 as int)')}) as end",
        "double(id % 11) as aw", "double(id % 9) as as", "double(id % 11 + 3) as ae", "double(id % 9 + 3) as an",
    )
    some = X.select_scenes(scenes, requests, columns=("request_id", "scene_id"))
    moment = "if(s.task = 'af', observed_at, date_post)"
    want = scenes.alias("s").join(requests.alias("r")).where(
        f"s.task = r.task and w <= ae and aw <= e and s <= an and as <= n and (s.task = 'af' or date_pre < date_post) and (start is null or {moment} >= start) and (end is null or {moment} < end)"
    ).select("request_id", "scene_id")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    assert sorted(map(tuple, X.select_scenes(scenes, requests).select("request_id", "scene_id").collect())) == sorted(map(tuple, want.collect()))
    join = next(line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "_last" in join and "start" in join and "_w" in join  # a block out of reach or out of the period makes no pair


@pytest.mark.parametrize("before", ["65535", "4000"])
def test_written_stages_are_compilable_in_any_session(spark, before):
    limit = "spark.sql.codegen.hugeMethodLimit"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, before)
    try:
        with compilable(spark):
            assert int(spark.conf.get(limit)) <= 8000
        assert spark.conf.get(limit) == before
        assert cut_lineage(spark.range(3)).count() == 3 and spark.conf.get(limit) == before
    finally:
        spark.conf.set(limit, usual)
