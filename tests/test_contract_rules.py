"""Rules that once depended on row order, fixed limits or nesting depth."""

import pytest
from pyspark.sql import functions as F

from ember.operators import contracts as K
from ember.operators import models as M
from ember.operators import ranking as N
from ember.operators import tiles as T
from ember.sources.manifests import is_training

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
PARTS = {
    "good": ([(5.0, 5.0), (6.0, 5.0), (6.5, 5.5), (6.0, 6.0), (5.0, 6.0), (5.0, 5.0)], None),
    "open": ([(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 6.0)], "not closed"),
    "short": ([(5.0, 5.0), (6.0, 5.0), (5.0, 5.0)], "too few positions"),
    "flat": ([(5.0, 5.0), (6.0, 5.0), (7.0, 5.0), (5.0, 5.0)], "zero area"),
    "outside": ([(179.0, 5.0), (181.0, 5.0), (180.0, 6.0), (179.0, 5.0)], "outside WGS84"),
}


@pytest.mark.parametrize("name", sorted(PARTS))
@pytest.mark.parametrize("turned", [False, True])
def test_rings_of_a_multipolygon_are_judged_apart(spark, name, turned):
    ring, want = PARTS[name]
    rows = [(1, 0, 0, i, *p) for i, p in enumerate(SQUARE)] + [(1, 1, 0, i, *p) for i, p in enumerate(ring)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "aoi_id int, part int, ring int, seq int, lon double, lat double")
    got = [(r.part, r.problem) for r in K.check_rings(df).collect()]
    assert got == ([] if want is None else [(1, want)])


def test_self_intersection_of_a_long_ring(spark):
    n = 10_400
    ring = spark.range(n).select(F.lit(1).alias("aoi_id"), F.col("id").alias("seq"), (50 * F.cos(F.col("id") * 6.283185307179586 / n)).alias("lon"), (50 * F.sin(F.col("id") * 6.283185307179586 / n)).alias("lat"))
    assert K.ring_self_intersections(ring).count() == 0
    crossed = ring.withColumn("seq", F.when(F.col("seq") == 100, 5000).when(F.col("seq") == 5000, 100).otherwise(F.col("seq")))
    assert K.ring_self_intersections(crossed).first().problem == "self-intersection"


@pytest.mark.parametrize("limit,rows,cut", [(30, 30, True), (60, 60, False), (80, 60, False), (1, 1, True)])
def test_search_is_cut_by_the_request_only(spark, limit, rows, cut):
    scenes = spark.range(60).select(F.concat(F.lit("s"), "id").alias("scene_id"), F.expr("timestamp_ntz'2020-06-01' + make_dt_interval(0, id)").alias("acquired_at"), F.lit(0.0).alias("cloud_percent"), *[F.lit(v).alias(c) for c, v in zip("wsen", (0.0, 0.0, 1.0, 1.0))])
    request = spark.range(1).select(F.col("id").alias("request_id"), F.expr("timestamp_ntz'2020-01-01'").alias("date_start"), F.expr("date'2020-12-31'").alias("date_end"), F.lit(50.0).alias("cloud_max"), F.lit(limit).alias("max_results"), *[F.lit(v).alias(c) for c, v in zip(("aw", "as", "ae", "an"), (0.0, 0.0, 1.0, 1.0))])
    got = N.search_scenes(scenes, request).collect()
    assert len(got) == rows and {r.truncated for r in got} == {cut}


@pytest.mark.parametrize(
    "doc,want",
    [
        ('{"label":"train set"}', True), ('{"source":{"a":{"note":"train"}}}', True), ('[["x",{"y":["Validation"]}]]', True), ('"val"', True),
        ('{"train":"no","val":{"training":1}}', False), ('{"a":"retrained","b":"trains valid"}', False), ('{"a":"say \\"train\\" now"}', True),
        ('{"a":"x: train","b":1}', True), ('{"a":"not a key:"}', False), ('{"a":"line\\ntrain"}', True), ("", False), ("{}", False), (None, False),
    ],
)
def test_training_words_in_any_string_value(spark, doc, want):
    df = spark.createDataFrame([(doc,)], "doc string")
    assert df.select(is_training(F.col("doc")).alias("t")).first().t is want


def test_crop_of_a_chip_beyond_twenty_bits(spark):
    side = 1200
    px = spark.createDataFrame([(1, 1100, 1150, 1, True)], "chip_id int, rw int, cl int, y int, valid boolean")
    row = T.crop_windows(px, side, side, 10, 3, centred=100).first()
    assert (row.top, row.left) == (1095, 1145)


def test_early_stop_of_burn_model_is_refused(spark):
    with pytest.raises(ValueError):
        M.fit_boosted(spark.range(1), ["id"], "bs", validation="v")


@pytest.mark.parametrize("name,second,backend", [("tree", 0.0, "tree"), ("cnn", 1.0, "cnn"), ("ensemble_cnn_0.25", 0.25, "ensemble"), ("ensemble_cnn_1", 1.0, "ensemble"), ("ensemble_cnn_2", None, "ensemble_cnn_2"), ("ensemble_cnn_x", None, "ensemble_cnn_x"), ("ensemble_cnn_1e-1", None, "ensemble_cnn_1e-1")])
def test_recipe_names(spark, name, second, backend):
    row = M.recipes(spark.createDataFrame([(name,)], "selected string")).first()
    assert (row.second_weight, row.backend) == (second, backend)
