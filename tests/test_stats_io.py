import datetime
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.functions import text as T
from ember.operators import confusion as C
from ember.operators import indexing as I
from ember.operators import models as M
from ember.operators import resample as R
from ember.operators import sampling as S
from ember.sources import assets as A
from ember.sources import manifests as J
from ember.sources import sinks as O
from ember.streaming import requests as Q


def test_dense_index_is_a_permutation(spark):
    df = I.dense_index(spark.range(500).withColumnRenamed("id", "k"), "k")
    rows = df.collect()
    assert sorted(r.idx for r in rows) == list(range(500)) and {r.n_total for r in rows} == {500}


@pytest.mark.parametrize("limit", [5, 1000])
def test_salted_join_keeps_every_pair(spark, limit):
    left = spark.range(60).select(F.when(F.col("id") < 50, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.createDataFrame([(1, "x"), (1, "y"), (55, "z"), (99, "n")], "k bigint, b string")
    got = I.salted_join(left, right, ["k"], F.col("a"), limit)
    assert got.count() == 101 and got.select("a", "b").distinct().count() == 101


def stats(spark, n=6):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", *map(int, rng.integers(1, 20, 6))) for i in range(n)]
    return spark.createDataFrame(rows, "chip_id string, a_tp bigint, a_fp bigint, a_fn bigint, b_tp bigint, b_fp bigint, b_fn bigint"), rows


def test_bootstrap_equals_replayed_draws(spark):
    import hashlib

    df, rows = stats(spark)
    order = sorted(rows, key=lambda r: (hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    want = []
    for rep in range(20):
        picks = [int(hashlib.md5(f"7:{rep}:{i}".encode()).hexdigest()[:15], 16) % 6 for i in range(6)]
        total = np.sum([order[p][1:] for p in picks], axis=0)
        f = [2 * a / (2 * a + b + c) for a, b, c in (total[:3], total[3:])]
        want.append(f[1] - f[0])
    got = {r.rep: r.delta for r in R.bootstrap_deltas(df, 20, 7, R.AF_CELLS).collect()}
    assert [got[i] for i in range(20)] == pytest.approx(want)
    row = R.bootstrap_delta(df, 20, 7, R.AF_CELLS).first()
    assert (row.low, row.high) == pytest.approx(tuple(np.percentile(want, (2.5, 97.5))))
    assert row.std == pytest.approx(np.std(want, ddof=1))


def test_bootstrap_of_one_chip_has_no_width(spark):
    df, _ = stats(spark, 1)
    row = R.bootstrap_delta(df, 10, 1, R.AF_CELLS).first()
    assert row.low == row.high == row.mean


def test_group_split_keeps_groups_whole(spark):
    meta = spark.range(400).select(F.col("id").alias("chip_id"), (F.col("id") % 90).alias("g"), (F.col("id") % 3).alias("s"))
    split = R.group_split(meta, ["g"], ["s"])
    joined = meta.join(split, "chip_id")
    assert joined.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = joined.where("split = 'val'").count() / 400
    assert 0.15 < share < 0.25


def test_capped_sample(spark):
    px = spark.range(1000).select((F.col("id") % 2).cast("string").alias("chip_id"), (F.col("id") % 4 == 0).cast("int").alias("y"), F.col("id").alias("rw"), F.lit(0).alias("cl"), (F.col("id") % 10 != 0).alias("valid"))
    sample = S.sample_pixels(px, S.class_cap(80, 2, 2), 3)
    assert {r["count"] for r in sample.groupBy("chip_id", "y").count().collect()} <= {20, 20}
    info = {r.y: r for r in S.sample_info(px, sample).collect()}
    assert info[1].weight == pytest.approx(info[1].population / info[1].selected)


def test_normaliser_floor(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "a double, b double")
    row = C.fit_normaliser(df, ["a", "b"], F.lit(True)).first()
    assert (row.a_mean, row.a_std, row.a_count) == (2.0, 1.0, 2) and row.b_std == pytest.approx(1e-4)


def test_losses_are_finite_and_ignore_invalid(spark):
    df = spark.createDataFrame([(0.9, 1, True), (0.0, 1, False), (0.1, 0, True)], "p double, t int, valid boolean")
    row = C.binary_loss(df, "p", "t", 3.0).first()
    p, t = np.array([0.9, 0.1]), np.array([1, 0])
    bce = (-(3 * t * np.log(p) + (1 - t) * np.log(1 - p)) * ((1 - p) * t + p * (1 - t)) ** 1.5).mean()
    assert row.loss == pytest.approx(bce + 1 - (2 * 0.9 + 1) / (1.0 + 1 + 1))


def test_recipes(spark):
    rows = spark.createDataFrame([("ensemble_cnn_0.25",), ("tree",), ("cnn",), ("ensemble_cnn_7",)], "selected string")
    got = {r.selected: (r.tree_weight, r.backend) for r in M.recipes(rows).collect()}
    assert got["ensemble_cnn_0.25"] == (0.75, "ensemble") and got["tree"][0] == 1.0 and got["cnn"][0] == 0.0 and got["ensemble_cnn_7"][0] is None


def test_files_and_checksums(spark, tmp_path):
    import hashlib

    names = ["AF_1_VIIRS_I1-I5.tif", "AF_1_AUX.tif", "AF_1_MASK.tif", "notes.txt", "bad_AUX.tif"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode())
    files = A.list_files(spark, str(tmp_path))
    assets = A.asset_table(files)
    assert {(r.chip_id, r.key) for r in assets.collect()} == {("AF_1", "viirs"), ("AF_1", "aux")}
    assert A.asset_inventory(assets).first().missing == ["mask"]
    digests = A.file_digests(spark, str(tmp_path))
    manifest = spark.createDataFrame([(names[0], hashlib.sha256(names[0].encode()).hexdigest().upper()), (names[1], "00"), ("gone", "00"), ("../x", "00")], "name string, sha256 string")
    assert {r.name: r.state for r in A.checksum_audit(manifest, digests).collect()} == {names[0]: "ok", names[1]: "corrupt", "gone": "missing", "../x": "escaping"}


def test_large_files_are_hashed_split_by_split(spark, tmp_path):
    import hashlib

    noise = np.random.default_rng(2).bytes(300_000)
    kept = {"a b é.bin": noise, "end.bin": noise + b"\n", "open.txt": b"x\r\n\r\ny", "mark.csv": b"\xef\xbb\xbfa\nb\n", "mark_open.csv": b"\xef\xbb\xbfa\nb", "lines.txt": b"\n" * 5000, "packed.gz": gzip.compress(noise), "one.txt": b"1"}
    (tmp_path / "sub").mkdir()
    for i, (n, data) in enumerate(kept.items()):
        (tmp_path / ("sub" if i % 2 else ".") / n).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # many splits of one file
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "400000")
    try:
        for whole in (0, 1, 1000, 1 << 28):
            got = A.file_digests(spark, str(tmp_path), whole=whole).collect()
            assert sorted((r.name, r.size_bytes, r.sha256) for r in got) == sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in kept.items()), whole
        (tmp_path / "long.bin").write_bytes(noise * 2)  # does not fit in a row
        got = {r.name: r.sha256 for r in A.file_digests(spark, str(tmp_path), whole=350_000).collect()}
        assert got["long.bin"] == hashlib.sha256(noise * 2).hexdigest() and len(got) == len(kept) + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_metadata_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_bytes("﻿chip_id,kind,epsg\nAF_1,af,EPSG:32637\nBS_2,bs,32638.0\n".encode("utf-8"))
    df = J.read_chip_meta(spark, str(path), "chip_id string, kind string, epsg string")
    assert [(r.chip_id, r.e) for r in df.select("chip_id", T.epsg_code(F.col("epsg")).alias("e")).collect()] == [("AF_1", 32637), ("BS_2", 32638)]
    assert J.meta_violations(df).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("chip,kind,epsg\nAF_1,af,1\n")
    with pytest.raises(Exception):
        J.read_chip_meta(spark, str(bad), "chip_id string, kind string, epsg string").collect()


def test_probability_cache_prunes_partitions(spark, tmp_path):
    px = spark.createDataFrame([("af", "a", 0.5), ("bs", "b", 0.5)], "task string, chip_id string, p double")
    O.write_probs(px, str(tmp_path / "p"))
    cache = O.read_probs(spark, str(tmp_path / "p"), "bs")
    assert cache.count() == 1 and "PartitionFilters: [isnotnull(task" in cache._jdf.queryExecution().executedPlan().toString()


def test_summary_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert O.summary_json(df).first().value == '{"a":null,"b":null,"c":1.5}'


def test_inclusive_days(spark):
    start, end = T.days_to_period(F.lit("2026-09-01"), F.lit("2026-09-03"))
    row = spark.range(1).select(start.alias("s"), end.alias("e"))
    back = row.select("s", "e", *[c.cast("string").alias(n) for c, n in zip(T.period_to_days(F.col("s"), F.col("e")), ("a", "b"))]).first()
    assert back.s == datetime.datetime(2026, 9, 1) and back.e == datetime.datetime(2026, 9, 4)
    assert (back.a, back.b) == ("2026-09-01", "2026-09-03")


def test_admission_rule(spark):
    base = datetime.datetime(2024, 1, 1, 0, 59, 30)
    rng = np.random.default_rng(1)
    times = {c: sorted(int(t) for t in rng.integers(0, 900, 60)) for c in "ab"}
    rows = [(c, i, base + datetime.timedelta(seconds=t)) for c in times for i, t in enumerate(times[c])]
    got = {(r.client, r.event_id): r.admitted for r in Q.admission(spark.createDataFrame(rows, "client string, event_id bigint, ts timestamp"), 3).collect()}
    for c, series in times.items():
        kept = []
        for i, t in enumerate(series):
            kept = [k for k in kept if k > t - 60]
            ok = len(kept) < 3
            if ok:
                kept.append(t)
            assert got[c, i] == ok


def test_manifests_are_walked_to_any_depth(spark):
    deep = {"path": "z", "sha256": {"f": "AB"}}
    for i in range(7):
        deep = {f"k{i}": deep} if i % 2 else [deep, "text", None, 3]
    rows = [
        (json.dumps({"bundle_id": "d", "x": deep}),),
        (json.dumps({"bundle_id": "c", "path": "a/./b", "sha256": {"../f": "1"}, "more": {"path": "a", "sha256": {"f": "2", "/g": "3"}}}),),
        (json.dumps({"bundle_id": "e", "path": 5, "sha256": "text", "list": []}),),
        ("not json",), ("",), (None,), ("[]",),
    ]
    files = J.walk_manifests(spark.createDataFrame(rows, "json string"))
    got = {(r.bundle_id, r.place, r.target, r.escapes, r.sha256) for r in files.collect()}
    assert got == {
        ("d", "$.x[0].k5[0].k3[0].k1[0]", "z/f", False, "ab"),
        ("c", "$", "a/f", False, "1"), ("c", "$.more", "a/f", False, "2"), ("c", "$.more", "a/g", True, "3"),
    }
    assert [(r.bundle_id, r.target, r.n, r.places) for r in J.conflicting_targets(files).collect()] == [("c", "a/f", 2, ["$", "$.more"])]
    assert J.walk_manifests(spark.createDataFrame([], "json string")).count() == 0
