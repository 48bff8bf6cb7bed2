"""I5-I6, J3-J4, K: runs, masks and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import longs
from checks.registry import query
from checks.views import HEIGHT, WIDTH
from ember.operators import areas as A
from ember.operators import rle as R
from ember.operators import submission as B

_RUNS = """(SELECT chip_id, cls, min(pos) AS start, count(*) AS len FROM (SELECT chip_id, cls, pos, pos-row_number() OVER (PARTITION BY chip_id, cls ORDER BY pos) AS g FROM fx_class WHERE cls>0) q GROUP BY chip_id, cls, g)"""
_RLE = f"(SELECT chip_id, cls AS class_id, string_agg(CAST(start+1 AS VARCHAR)||' '||CAST(len AS VARCHAR), ' ' ORDER BY start) AS rle FROM {_RUNS} r GROUP BY chip_id, cls)"
_SUB_PX = "SELECT CASE WHEN task='af' THEN 'AF_' ELSE 'BS_' END||CAST(chip_id AS VARCHAR(20)) AS chip_id, rw, cl, pos, CASE WHEN task='af' AND cls<>1 THEN 0 ELSE cls END AS cls FROM fx_class"
_TEMPLATE = """SELECT DISTINCT CASE WHEN task='af' THEN 'AF_' ELSE 'BS_' END||CAST(chip_id AS VARCHAR(20)) AS chip_id, class_id, chip_id*3+class_id AS template_pos FROM fx_class, (VALUES (1),(2),(3)) c(class_id) WHERE task='bs' OR class_id=1"""


def sub_px(inp):
    return inp.spark.sql(_SUB_PX.replace("FROM fx_class", "FROM {c}"), c=inp.fx_class)


def template(inp):
    chips = inp.fx_class.select("chip_id", "task").distinct()
    rows = chips.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("class_id")).where("task = 'bs' or class_id = 1")
    name = F.concat(F.when(F.col("task") == "af", "AF_").otherwise("BS_"), F.col("chip_id").cast("string"))
    return rows.select(name.alias("chip_id"), "class_id", (F.col("chip_id") * 3 + F.col("class_id")).alias("template_pos"))


@query("i5_runs", f"SELECT chip_id, cls, start, len FROM {_RUNS} r")
def i5_runs(inp):
    return longs(R.runs(inp.fx_class))


_SHIFTED = "CASE WHEN start%7=0 THEN len+3 ELSE len END"


@query("i6_check_runs", f"SELECT chip_id, cls, start, len, prev_end FROM (SELECT *, lag(start+len) OVER (PARTITION BY chip_id, cls ORDER BY start, len) AS prev_end FROM (SELECT chip_id, cls, start, {_SHIFTED} AS len FROM {_RUNS} r) a) b WHERE start<=prev_end")
def i6_check_runs(inp):
    bent = R.runs(inp.fx_class).withColumn("len", F.expr(_SHIFTED))
    return longs(R.check_runs(bent))


@query("k1_rle_encode", f"SELECT chip_id, class_id, rle FROM {_RLE} r WHERE class_id=1")
def k1_rle_encode(inp):
    px = inp.fx_class.withColumn("cls", F.when(F.col("cls") == 1, 1).otherwise(0))
    return longs(R.rle_encode(px))


@query("k1_rle_of_array", f"SELECT c.chip_id, coalesce(rle,'') AS rle FROM (SELECT DISTINCT chip_id FROM fx_class) c LEFT JOIN {_RLE} r ON r.chip_id=c.chip_id AND class_id=2")
def k1_rle_of_array(inp):
    from ember.operators.pixels import pack_bands

    return pack_bands(inp.fx_class, ["cls"]).select("chip_id", R.rle_of_array(F.col("cls"), 2).alias("rle"))


@query("k2_rle_decode", "SELECT chip_id, cls AS class_id, pos, rw, cl FROM fx_class WHERE cls>0")
def k2_rle_decode(inp):
    return longs(R.rle_decode(R.rle_encode(inp.fx_class), WIDTH))


_BENT_RLE = f"""(SELECT chip_id, class_id, CASE chip_id%9 WHEN 1 THEN rle||' 5' WHEN 2 THEN 'a 1' WHEN 3 THEN '0 2 '||rle WHEN 4 THEN '1 0 '||rle WHEN 5 THEN rle||' 299 9' WHEN 6 THEN '300 1 '||rle WHEN 7 THEN '  '||rle WHEN 8 THEN 'None' ELSE rle END AS rle FROM {_RLE} r)"""


@query(
    "k3_rle_violations",
    f"""SELECT chip_id, class_id, CASE chip_id%9 WHEN 1 THEN 'odd tokens' WHEN 2 THEN 'not an integer' WHEN 3 THEN 'start below one' WHEN 4 THEN 'empty run' WHEN 5 THEN 'beyond the mask'
 WHEN 6 THEN 'unordered, overlapping or adjacent' WHEN 7 THEN 'not canonical text' WHEN 8 THEN 'missing' END AS problem FROM {_RLE} r WHERE chip_id%9<>0""",
)
def k3_rle_violations(inp):
    bad = "CASE chip_id%9 WHEN 1 THEN rle||' 5' WHEN 2 THEN 'a 1' WHEN 3 THEN '0 2 '||rle WHEN 4 THEN '1 0 '||rle WHEN 5 THEN rle||' 299 9' WHEN 6 THEN '300 1 '||rle WHEN 7 THEN '  '||rle WHEN 8 THEN 'None' ELSE rle END"
    bent = R.rle_encode(inp.fx_class).withColumn("rle", F.expr(bad))
    return longs(R.rle_violations(bent, HEIGHT, WIDTH).drop("rle"))


@query("k4_rle_encode_bs", f"SELECT c.chip_id, CAST(k.class_id AS BIGINT) AS class_id, coalesce(rle,'') AS rle FROM (SELECT DISTINCT chip_id FROM fx_class) c CROSS JOIN (VALUES (1),(2),(3)) k(class_id) LEFT JOIN {_RLE} r ON r.chip_id=c.chip_id AND r.class_id=k.class_id")
def k4_rle_encode_bs(inp):
    return longs(R.rle_encode_classes(inp.fx_class, (1, 2, 3)))


@query("k5_rle_decode_bs", "SELECT chip_id, pos, cls FROM fx_class WHERE cls>0")
def k5_rle_decode_bs(inp):
    px, _ = R.rle_decode_classes(R.rle_encode_classes(inp.fx_class, (1, 2, 3)), WIDTH)
    return longs(px.select("chip_id", "pos", "cls"))


@query("j3_overlapping_pixels", "SELECT chip_id, pos, count(*) AS n FROM (SELECT chip_id, pos FROM fx_class WHERE cls>0 UNION ALL SELECT chip_id, pos+1 FROM fx_class WHERE cls=3) q GROUP BY chip_id, pos HAVING n>1")
def j3_overlapping_pixels(inp):
    px = inp.fx_class.where("cls > 0").select("chip_id", "pos", "cls")
    moved = inp.fx_class.where("cls = 3").select("chip_id", (F.col("pos") + 1).alias("pos"), F.lit(9).alias("cls"))
    return R.overlapping_pixels(px.unionByName(moved))


@query("j4_union_cells", "SELECT DISTINCT chip_id, rw, cl FROM fx_class WHERE cls IN (1,3) OR valid")
def j4_union_cells(inp):
    c = inp.fx_class
    return A.union_cells(c.where("cls = 1"), c.where("cls = 3"), c.where("valid"), keys=["chip_id", "rw", "cl"])


@query("k6_rle_round_trip", "SELECT chip_id, pos, cls AS class_id, 'lost' AS side FROM fx_class WHERE false")
def k6_rle_round_trip(inp):
    return longs(R.rle_round_trip(inp.fx_class, WIDTH))


_SUBMISSION = f"(SELECT t.chip_id, t.class_id, t.template_pos, coalesce(r.rle,'') AS rle FROM ({_TEMPLATE}) t LEFT JOIN (SELECT CASE WHEN chip_id%2=0 THEN 'AF_' ELSE 'BS_' END||CAST(chip_id AS VARCHAR) AS cid, class_id, rle FROM {_RLE} q WHERE chip_id%2=1 OR class_id=1) r ON r.cid=t.chip_id AND r.class_id=t.class_id)"


@query("k7_build_submission", f"SELECT chip_id, CAST(class_id AS BIGINT) AS class_id, template_pos, rle FROM {_SUBMISSION} s")
def k7_build_submission(inp):
    return longs(B.build_submission(template(inp), sub_px(inp)))


@query(
    "k8_validate_submission",
    f"""SELECT count(*) AS data_rows, count(DISTINCT CASE WHEN chip_id LIKE 'AF%' THEN chip_id END) AS af_chips, count(DISTINCT CASE WHEN chip_id LIKE 'BS%' THEN chip_id END) AS bs_chips, CAST(0 AS BIGINT) AS problems, 'pass' AS status FROM {_SUBMISSION} s""",
)
def k8_validate_submission(inp):
    sub = B.build_submission(template(inp), sub_px(inp))
    return B.validate_submission(sub, template(inp), F.lit(HEIGHT * WIDTH), F.lit(WIDTH))


@query(
    "k8_submission_problems",
    f"""SELECT template_pos, chip_id, CAST(class_id AS BIGINT) AS class_id, 'key differs from template' AS problem FROM {_SUBMISSION} s WHERE template_pos%11=4
 UNION ALL SELECT template_pos, chip_id, CAST(class_id AS BIGINT), 'odd tokens' FROM {_SUBMISSION} s WHERE template_pos%13=5 AND template_pos%11<>4""",
)
def k8_submission_problems(inp):
    t = template(inp)
    sub = B.build_submission(t, sub_px(inp)).withColumn("rle", F.when(F.col("template_pos") % 13 == 5, F.concat("rle", F.lit(" 7"))).otherwise(F.col("rle")))
    sub = sub.withColumn("rle", F.ltrim("rle"))
    t = t.withColumn("class_id", F.when(F.col("template_pos") % 11 == 4, F.col("class_id") + 5).otherwise(F.col("class_id")))
    return longs(B.submission_problems(sub, t, F.lit(HEIGHT * WIDTH), F.lit(WIDTH)))


@query("k7_template_problems", f"SELECT DISTINCT chip_id, CASE WHEN pos=1 THEN 'class rows' ELSE 'no prediction' END AS problem FROM ({_TEMPLATE}) t, (VALUES (1),(2)) p(pos) WHERE (pos=1 AND chip_id LIKE 'BS%' AND template_pos//3%5=1) OR (pos=2 AND template_pos//3%7=2)".replace("template_pos//3", "CAST(substr(chip_id,4) AS BIGINT)"))
def k7_template_problems(inp):
    number = F.substring("chip_id", 4, 20).cast("bigint")
    t = template(inp).where(~((number % 5 == 1) & F.col("chip_id").startswith("BS") & (F.col("class_id") == 2)))
    px = sub_px(inp).where(number % 7 != 2)
    return B.template_problems(t, px, {"af": (1,), "bs": (1, 2, 3)})


@query("u1_rle_udtf", "SELECT chip_id, cls AS class_id, pos, rw, cl FROM fx_class WHERE cls>0")
def u1_rle_udtf(inp):
    R.register_rle_udtf(inp.spark)
    coded = R.rle_encode(inp.fx_class)
    out = inp.spark.sql(f"SELECT c.chip_id, c.class_id, p.pos, p.rw, p.cl FROM {{coded}} c, LATERAL rle_pixels(c.rle, {WIDTH}) p", coded=coded)
    return longs(out)
