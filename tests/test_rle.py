import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.operators import rle as R
from ember.operators import submission as B
from ember.operators.pixels import pack_bands


def encode(mask):
    flat = np.r_[0, np.asarray(mask).reshape(-1), 0]
    d = np.diff(flat)
    return " ".join(f"{s + 1} {e - s}" for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)))


def test_single_class_by_brute_force(pixels):
    rng = np.random.default_rng(8)
    masks = {f"m{i}": (rng.random((5, 4 + i)) < 0.4).astype(int).tolist() for i in range(3)} | {"none": np.zeros((3, 3), int).tolist()}
    for name, mask in masks.items():
        got = R.rle_encode_classes(pixels({name: mask}), (1,)).first()
        assert got.rle == encode(mask)


def test_every_class_by_brute_force(pixels):
    mask = np.random.default_rng(9).integers(0, 4, (4, 9))
    got = {r.class_id: r.rle for r in R.rle_encode_classes(pixels({"m": mask.tolist()}), (1, 2, 3)).collect()}
    assert got == {c: encode((mask == c).astype(int)) for c in (1, 2, 3)}


def test_random_masks_round_trip(pixels):
    rng = np.random.default_rng(3)
    masks = {f"c{i}": rng.integers(0, 4, (6, 7)).tolist() for i in range(4)}
    masks["full"] = np.ones((6, 7), int).tolist()
    px = pixels(masks)
    for row in R.rle_encode(px).collect():
        assert row.rle == encode((np.asarray(masks[row.chip_id]) == row.class_id).astype(int))
    arrays = pack_bands(px, ["cls"]).select("chip_id", R.rle_of_array(F.col("cls"), 2).alias("r")).collect()
    assert all(r.r == encode((np.asarray(masks[r.chip_id]) == 2).astype(int)) for r in arrays)
    assert R.rle_round_trip(px, 7).count() == 0


@pytest.mark.parametrize(
    "text,rule",
    [
        ("2 2 6 1", None), ("", None), ("1", "odd tokens"), ("a 1", "not an integer"), ("0 1", "start below one"), ("1 0", "empty run"),
        ("6 2", "beyond the mask"), ("1 1 2 1", "unordered, overlapping or adjacent"), ("3 1 1 1", "unordered, overlapping or adjacent"),
        (" 1 1", "not canonical text"), ("1  1", "not canonical text"), ("01 1", "not canonical text"), ("nan", "missing"),
    ],
)
def test_violations(spark, text, rule):
    df = spark.createDataFrame([("a", text)], "chip_id string, rle string")
    got = [r.problem for r in R.rle_violations(df, 2, 3).collect()]
    assert got == ([] if rule is None else [rule])


def test_overlap_is_reported(spark):
    df = spark.createDataFrame([("a", 1, "2 1"), ("a", 2, "2 1"), ("a", 3, "")], "chip_id string, class_id int, rle string")
    _, clash = R.rle_decode_classes(df, 3)
    assert clash.first().pos == 1


def test_submission_keeps_template(spark, pixels, tmp_path):
    from ember.sources.sinks import read_submission, write_submission

    t = spark.createDataFrame([("BS_2", 3, 0), ("AF_1", 1, 1), ("BS_2", 1, 2), ("BS_2", 2, 3)], "chip_id string, class_id int, template_pos bigint")
    px = pixels({"AF_1": [[0, 1], [1, 1]], "BS_2": [[1, 1], [0, 3]]})
    sub = B.build_submission(t, px)
    assert B.validate_submission(sub, t, F.lit(4), F.lit(2)).first().status == "pass"
    assert B.template_problems(t, px, {"af": (1,), "bs": (1, 2, 3)}).count() == 0
    path = str(tmp_path / "sub")
    write_submission(sub, path, single_file=True)
    part = next((tmp_path / "sub").glob("part-*.csv")).read_text().splitlines()
    assert part == ['"chip_id","class_id","rle"', '"BS_2","3","4 1"', '"AF_1","1","2 3"', '"BS_2","1","1 2"', '"BS_2","2",""']
    assert [r.rle for r in read_submission(spark, path).collect()] == ["4 1", "2 3", "1 2", ""]
    write_submission(sub, path)  # sorted parts: in name order they are the same file
    rows = [line for f in sorted((tmp_path / "sub").glob("part-*.csv")) for line in f.read_text().splitlines() if "chip_id" not in line]
    assert rows == part[1:]


def test_runs_cross_row_borders_only_when_adjacent(pixels):
    got = {(r.start, r.len) for r in R.runs(pixels({"a": [[0, 0, 1], [1, 1, 0], [1, 0, 1]]})).collect()}
    assert got == {(2, 3), (6, 1), (8, 1)}
