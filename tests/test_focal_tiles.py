import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.functions import spectral as S
from ember.operators import focal as W
from ember.operators import pixels as P
from ember.operators import tiles as T


def table(spark, arrays):
    rows = [(k, r, c, float(a[r, c])) for k, a in arrays.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "chip_id string, rw bigint, cl bigint, v double")


@pytest.mark.parametrize("k", [3, 5, 9, 11])
def test_focal_mean_is_symmetric_padding(spark, k):
    rng = np.random.default_rng(k)
    arrays = {f"c{i}": rng.normal(size=(6, 9)) for i in range(2)}
    got = W.focal_mean(table(spark, arrays), "v", k, 6, 9, "m").collect()
    assert len(got) == 108
    for row in got:
        pad = np.pad(arrays[row.chip_id], k // 2, mode="symmetric")
        assert row.m == pytest.approx(pad[row.rw:row.rw + k, row.cl:row.cl + k].mean(), abs=1e-12)


def test_focal_mean_uses_one_exchange(spark):
    df = table(spark, {"c": np.zeros((6, 9))})
    plan = W.focal_mean(df, "v", 3, 6, 9, "m")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_window_wider_than_chip_is_refused(spark):
    with pytest.raises(ValueError):
        W.focal_mean(table(spark, {"c": np.zeros((2, 2))}), "v", 7, 2, 2, "m")


def test_symmetries_are_distinct_and_invert(spark):
    a = np.arange(35.0).reshape(5, 7)
    variants = T.d4_variants(table(spark, {"c": a}), 5, 7).collect()
    images = {}
    for r in variants:
        images.setdefault((r.turns, r.mirror), {})[(r.rw, r.cl)] = r.v
    assert len({tuple(sorted(v.items())) for v in images.values()}) == 8
    for turns, mirror in T.D4:
        want = np.rot90(a, turns)
        want = want[:, ::-1] if mirror else want
        assert all(images[turns, mirror][i] == want[i] for i in np.ndindex(want.shape))
    back = T.d4_average(T.d4_variants(table(spark, {"c": a}), 5, 7), ["v"], 5, 7).collect()
    assert all(r.v == a[r.rw, r.cl] for r in back) and len(back) == 35


def test_augment_matches_numpy(spark):
    a = np.arange(12.0).reshape(3, 4)
    want = np.rot90(a[:, ::-1][::-1], 3)
    got = T.augment(table(spark, {"c": a}), 3, 4, True, True, 3).collect()
    assert all(want[r.rw, r.cl] == r.v for r in got)


def test_crops_stay_inside_and_centre(spark):
    a = np.zeros((12, 12))
    a[1, 11] = 2
    px = table(spark, {f"c{i}": a for i in range(20)}).withColumn("y", F.col("v").cast("int")).withColumn("valid", F.lit(True))
    rows = T.crop_windows(px, 12, 12, 4, 9, centred=100).collect()
    assert {(r.top, r.left) for r in rows} == {(0, 8)}
    cut = T.crop(px, T.crop_windows(px, 12, 12, 4, 9, centred=0), 4)
    assert cut.count() == 20 * 16 and cut.agg(F.max("rw")).first()[0] == 3


def test_feature_contract_names():
    assert len(P.af_feature_names()) == 23 and len(set(P.af_feature_names())) == 23
    assert len(P.bs_feature_names()) == 55 and len(set(P.bs_feature_names())) == 55


def test_features_match_numpy(spark):
    rng = np.random.default_rng(0)
    h, w = 6, 7
    bands = {n: rng.uniform(1, 300, (h, w)).astype(np.float32) for n in (*S.VIIRS, *S.AF_AUX)}
    bands["valid"] = np.ones((h, w), np.float32)
    bands["I4"][0, 0] = np.nan
    rows = [("c", r, c, *[float(bands[n][r, c]) for n in bands]) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "chip_id string, rw bigint, cl bigint, " + ", ".join(f"{n} float" for n in bands))
    got = {(r.rw, r.cl): r for r in P.features_af(df, h, w).collect()}
    thermal = np.nan_to_num(bands["I4"] - bands["I5"]) / np.float32(20)
    pad = np.pad(thermal.astype(float), 5, mode="symmetric")
    for (r, c), row in got.items():
        assert row.I4_minus_I5 == pytest.approx(thermal[r, c], abs=1e-7)
        assert row.thermal_mean_11 == pytest.approx(pad[r:r + 11, c:c + 11].mean(), abs=1e-5)
        assert row.observed == bool(np.isfinite(bands["I4"][r, c]))
    assert got[0, 0].I4 == 0.0


def test_norm_diff_stays_in_range(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1e30, -1e30), (-3.0, 3.0), (float("nan"), 1.0)], "a float, b float")
    vals = [r.n for r in df.select(S.norm_diff(F.col("a"), F.col("b")).alias("n")).collect()]
    assert vals[0] == 0.0 and vals[1] == 1.0 and -1.0 <= vals[2] < -0.99 and np.isnan(vals[3])


def test_focal_means_of_chips_over_several_batches(spark):
    rng = np.random.default_rng(3)
    grids = {c: rng.random((6, 7)) for c in ("a", "b", None)}
    grids["a"][2, 3] = np.nan
    gone, empty = ("b", 0, 0), (None, 5, 6)  # a missing pixel and one without a value
    rows = [(c, r, k, None if (c, r, k) == empty else float(g[r, k])) for c, g in grids.items() for r in range(6) for k in range(7) if (c, r, k) != gone]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "chip_id string, rw int, cl int, v double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.chip_id, r.rw, r.cl): r.m for r in W.focal_means(df, {"m": ("v", 3)}, 6, 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    for (c, r, k), value in got.items():
        lines = []
        for y in np.clip([r - 1, r, r + 1], 0, 5):
            cells = [grids[c][y, x] for x in np.clip([k - 1, k, k + 1], 0, 6) if (c, y, x) not in (gone, empty)]
            if cells:
                lines.append(np.mean(cells))
        assert value == pytest.approx(np.mean(lines), nan_ok=True)
    with pytest.raises(Exception, match="pixel outside"):
        W.focal_means(df, {"m": ("v", 3)}, 4, 7).count()
    assert W.focal_means(df.limit(0), {"m": ("v", 3)}, 6, 7).count() == 0
