"""What a request sees is found cell by cell, with the results of meeting every observation."""

import datetime

import pytest
from pyspark.sql import functions as F

from ember.operators import areas as A
from ember.operators import ranking as N
from ember.plans import analysis as Y

BASE = datetime.datetime(2024, 1, 1)
SCENES = (
    "scene_id string, chip_id string, task string, observed_at timestamp, date_pre timestamp, date_post timestamp, epsg int, ga double, gb double, gc double, gd double, ge double, gf double, "
    "w double, s double, e double, n double, source_scene_id string, grid_row_offset bigint, grid_col_offset bigint"
)


def day(k):
    return BASE + datetime.timedelta(days=k)


def world(spark, odd):
    """Twelve 4 x 4 chips over two places, four requests; ``odd`` adds repeated scene ids, repeated requests and one bound to a chip."""
    scenes, px = [], []
    for i in range(12):
        task, left = ("af", "bs")[i % 2], 3 * (i // 2 % 2)
        name = "s10" if odd and i == 4 else f"s{i}"
        when = day((i // 4) * 10)
        west, north = 30 + 0.01 * left, 50.0
        post = None if task == "af" else when
        scenes.append((name, f"c{i}", task, when if task == "af" else None, post and post - datetime.timedelta(days=5), post, 4326, 0.01, 0.0, west, 0.0, -0.01, north, west, north - 0.04, west + 0.04, north, "src" if i % 3 else None, 0, left))
        px += [(f"c{i}", r, c, (r + c + i) % 5 > 0, (r * c + i) % (2 if task == "af" else 4), 0.5) for r in range(4) for c in range(4)]
    asks = [(1, 0, 40, 30.0, 49.96, 30.07, 50.0), (2, 5, 11, 30.012, 49.971, 30.043, 49.994), (3, None, None, 29.0, 49.0, 31.0, 51.0), (4, 500, 600, 30.0, 49.96, 30.07, 50.0)]
    asks += [(2, 15, 30, 30.03, 49.96, 30.05, 49.99)] if odd else []
    rows = [(i, t, None if a is None else day(a), None if b is None else day(b), w, s, e, n, "c3" if odd and i == 1 and t == "bs" else None) for i, a, b, w, s, e, n in asks for t in ("af", "bs")]
    schema = "request_id int, task string, start timestamp, end timestamp, aw double, `as` double, ae double, an double" + (", only_chip string" if odd else "")
    requests = spark.createDataFrame([r if odd else r[:-1] for r in rows], schema)
    shapes = A.bbox_aoi(spark.createDataFrame([(i, *b) for i, _, _, *b in asks[:4]], "request_id int, aw double, `as` double, ae double, an double"))
    pixels = spark.createDataFrame(px, "chip_id string, rw bigint, cl bigint, valid boolean, cls bigint, score double")
    return requests, spark.createDataFrame(scenes, SCENES), pixels, shapes.select("request_id", "edges", "rings")


def rows(df, *columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("odd", [False, True])
def test_cells_first_gives_what_all_observations_give(spark, odd):
    requests, scenes, px, aoi = world(spark, odd)
    every = Y.observations(Y.pick_scenes(requests, scenes), Y.scene_cells(scenes, px))
    newest = Y.newest_observations(requests, scenes, px)
    for build, columns in ((Y.burned_cells, ("request_id", "gx", "gy", "scene_id", "cls", "date_pre", "inside_ha")), (Y.observed_cells, ("request_id", "task", "gx", "gy", "inside_ha"))):
        want = rows(build(every, aoi), *columns)
        assert want and rows(build(newest, aoi), *columns) == want
    columns = ("request_id", "scene_id", "observed_at", "hotspot_id", "lon", "lat", "score")
    want = rows(Y.hotspots(every, aoi, F.lit(4), F.lit(4)), *columns)
    assert want and rows(Y.seen_hotspots(requests, scenes, px, aoi, F.lit(4), F.lit(4)), *columns) == want
    if not odd:
        # a row per request, task and ground cell, not per scene that looks at it
        seen = newest.groupBy("request_id", "task", *Y.CELL).count()
        assert newest.count() == seen.count() < every.count() / 2


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_searches_look_back_only_as_far_as_they_must(spark, kind):
    scenes = [(f"s{i:03d}", BASE + datetime.timedelta(hours=7 * i) if i % 50 else None, float(i * 37 % 100), i % 9 + 0.0, 0.0, i % 9 + 2.0, 2.0) for i in range(1, 600)]
    scenes += [(f"late{i}", day(300), 5.0, 0.0, 0.0, 1.0, 1.0) for i in range(6)]
    schema = f"scene_id string, acquired_at {kind}, cloud_percent double, w double, s double, e double, n double"
    asks = [(1, 0, 400, 80.0, 2, 0.0, 6.0), (2, 0, 400, 80.0, 40, 3.0, 4.0), (3, 100, 120, 10.0, 1, 0.0, 9.0), (4, 0, 400, 80.0, 3, 50.0, 60.0), (None, 0, 90, 80.0, 3, 0.0, 5.0), (6, 0, 50, 99.0, 2, 0.0, 5.0), (6, 40, 80, 99.0, 2, 0.0, 5.0), (7, None, 50, 99.0, 2, 0.0, 5.0)]
    schema_r = "request_id int, date_start timestamp, date_end date, cloud_max double, max_results int, aw double, `as` double, ae double, an double"
    sc = spark.createDataFrame(scenes, schema)
    rq = spark.createDataFrame([(i, None if a is None else day(a), day(b).date(), c, m, w, 0.0, e, 3.0) for i, a, b, c, m, w, e in asks], schema_r)
    got = sorted(map(tuple, N.search_scenes(sc, rq).select("request_id", "scene_id", "rank", "truncated").collect()), key=repr)
    found = {}
    for i, a, b, c, m, w, e in asks:
        if a is not None:
            hits = [(t, s) for s, t, cloud, sw, _, se, _ in scenes if t and day(a) <= t < day(b + 1) and cloud <= c and sw <= e and w <= se]
            found.setdefault(i, []).extend((t, s, m) for t, s in hits)
    want = []
    for i, hits in found.items():
        hits.sort(key=lambda h: (-h[0].timestamp(), h[1]))
        want += [(i, s, k, len(hits) > m) for k, (_, s, m) in enumerate(hits, 1) if k <= m]
    # the rows of a repeated request may tie
    assert [g for g in got if g[0] != 6] == sorted((w for w in want if w[0] != 6), key=repr)
    assert sorted((g[0], g[1], g[3]) for g in got if g[0] == 6) == sorted((w[0], w[1], w[3]) for w in want if w[0] == 6)
    timed = sc.where("acquired_at is not null").withColumn("_t", N._micros(F.col("acquired_at"), kind == "timestamp"))
    once = rq.where("request_id < 6").withColumns({"_low": F.lit(0).cast("bigint"), "_high": (F.unix_micros(F.lit(day(100)).cast("timestamp")))})
    windows, widths = N.search_windows(timed, once, 5.0, 1000)
    assert windows.count() == 4 and len(widths) > 1 and windows.agg(F.min("_step")).first()[0] < len(widths) - 1
