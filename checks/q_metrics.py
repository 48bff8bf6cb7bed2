"""F: counts, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import RECIPE, RECIPE_WEIGHT, TREE, af_pixels, decided, longs, rounded
from checks.registry import query
from ember.functions import scores as S
from ember.operators import areas as A
from ember.operators import confusion as C
from ember.operators import search as G

DEC = Q.decided(RECIPE_WEIGHT, RECIPE)
DEC_VALID = Q.decided(RECIPE_WEIGHT, RECIPE, "valid")
AF = f"(SELECT *, CASE WHEN truth=1 THEN 1 ELSE 0 END AS fire, CASE WHEN CAST({Q.blend(RECIPE_WEIGHT, 1)} AS DOUBLE)>=0.35 THEN 1 ELSE 0 END AS pred FROM fx_pixel)"

_NORM = ["I4", "I5", "t2m"]


@query(
    "f1_fit_normaliser",
    "SELECT "
    + ", ".join(
        f"{Q.r(f'{n}_m')} AS {n}_mean, {Q.r(f'sqrt(greatest({n}_q-{n}_m*{n}_m,1e-8))', 5)} AS {n}_std, {n}_count" for n in _NORM
    )
    + " FROM (SELECT "
    + ", ".join(
        f"avg(CASE WHEN ok_{n} THEN CAST({n} AS DOUBLE) END) AS {n}_m, avg(CASE WHEN ok_{n} THEN CAST({n} AS DOUBLE)*{n} END) AS {n}_q, count(CASE WHEN ok_{n} THEN 1 END) AS {n}_count"
        for n in _NORM
    )
    + " FROM (SELECT *, "
    + ", ".join(f"(valid>0.5 AND NOT isnan({n})) AS ok_{n}" for n in _NORM)
    + " FROM fx_af) a) b",
)
def f1_fit_normaliser(inp):
    out = C.fit_normaliser(inp.fx_af, _NORM, F.col("valid") > 0.5)
    out = out.select(*[c for n in _NORM for c in (f"{n}_mean", F.round(f"{n}_std", 5).alias(f"{n}_std"), f"{n}_count")])
    return rounded(out)


@query(
    "f2_class_balance_af",
    f"SELECT {Q.r('greatest(least(n0/greatest(n1,1.0),30.0),1.0)')} AS pos_weight FROM (SELECT CAST(sum(CASE WHEN truth<>1 THEN 1 ELSE 0 END) AS DOUBLE) AS n0, CAST(sum(CASE WHEN truth=1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM fx_pixel WHERE valid) q",
)
def f2_class_balance_af(inp):
    px = inp.fx_pixel.withColumn("y", (F.col("truth") == 1).cast("int"))
    return rounded(C.class_balance(px, "af", use=F.col("valid")))


@query(
    "f2_class_balance_bs",
    "SELECT "
    + ", ".join(Q.r(f"greatest(least(n/greatest(n{c},1.0)/4,8.0),0.25)") + f" AS w{c}" for c in range(4))
    + " FROM (SELECT CAST(count(*) AS DOUBLE) AS n, "
    + ", ".join(f"CAST(count(CASE WHEN truth={c} THEN 1 END) AS DOUBLE) AS n{c}" for c in range(4))
    + " FROM fx_pixel WHERE valid) q",
)
def f2_class_balance_bs(inp):
    return rounded(C.class_balance(inp.fx_pixel, "bs", "truth", F.col("valid")))


@query("f3_confusion_binary", f"SELECT {Q.binary('fire')} FROM {AF} a")
def f3_confusion_binary(inp):
    return C.confusion_binary(af_pixels(inp.fx_pixel), (), "fire")


@query(
    "f4_f1",
    f"SELECT chip_id, {Q.r(Q.f1('tp', 'fp', 'fn'))} AS f1 FROM (SELECT chip_id, {Q.binary('fire')} FROM {AF} a GROUP BY chip_id) q",
)
def f4_f1(inp):
    counts = C.confusion_binary(af_pixels(inp.fx_pixel), ["chip_id"], "fire")
    return rounded(counts.select("chip_id", S.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")))


@query("f5_iou_burn", f"SELECT chip_id, IoU_burn FROM ({Q.score_select(DEC + ' d', 'chip_id')}) q")
def f5_iou_burn(inp):
    wide = C.confusion_wide(decided(inp.fx_pixel), ["chip_id"])
    return rounded(C.score_wide(wide, ["chip_id"]).select("chip_id", "IoU_burn"))


@query("f6_iou_severity", f"SELECT task, IoU_1, IoU_2, IoU_3 FROM ({Q.score_select(DEC + ' d', 'task')}) q")
def f6_iou_severity(inp):
    wide = C.confusion_wide(decided(inp.fx_pixel), ["task"])
    return rounded(C.score_wide(wide, ["task"]).select("task", "IoU_1", "IoU_2", "IoU_3"))


@query(
    "f7_competition_score",
    f"""SELECT {Q.r('F1_af')} AS F1_af, {Q.r('IoU_burn')} AS IoU_burn, {Q.r('IoU_1')} AS IoU_1, {Q.r('IoU_2')} AS IoU_2, {Q.r('IoU_3')} AS IoU_3,
 {Q.r('mIoU_sev')} AS mIoU_sev, {Q.r('0.35*F1_af+0.35*IoU_burn+0.30*mIoU_sev')} AS Score
 FROM (SELECT {Q.f1('tp', 'fp', 'fn')} AS F1_af FROM (SELECT {Q.binary('fire')} FROM {AF} a WHERE task='af') x) y,
 ({Q.score_select(Q.decided(RECIPE_WEIGHT, RECIPE, "task='bs'") + ' d', rounded=False)}) z""",
)
def f7_competition_score(inp):
    af = af_pixels(inp.fx_pixel.where("task = 'af'")).select(F.col("fire").alias("truth"), "pred")
    bs = decided(inp.fx_pixel.where("task = 'bs'")).select("truth", "pred")
    return rounded(C.competition_score(af, bs))


@query("f8_confusion4", f"SELECT CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, count(*) AS n FROM {DEC} d GROUP BY truth, pred")
def f8_confusion4(inp):
    return longs(C.confusion(decided(inp.fx_pixel)))


@query("f9_score_confusion", Q.score_select(DEC + " d", "task"))
def f9_score_confusion(inp):
    return rounded(C.score_confusion(C.confusion(decided(inp.fx_pixel), ["task"]), ["task"]))


@query(
    "f10_precision_recall",
    f"SELECT chip_id, tp, fp, fn, {Q.r('CASE WHEN tp+fp>0 THEN tp*1.0/(tp+fp) END')} AS precision, {Q.r('CASE WHEN tp+fn>0 THEN tp*1.0/(tp+fn) END')} AS recall, {Q.r(Q.f1('tp', 'fp', 'fn'))} AS f1 FROM (SELECT chip_id, {Q.binary('fire')} FROM {AF} a WHERE valid GROUP BY chip_id) q",
)
def f10_precision_recall(inp):
    return rounded(C.precision_recall(C.confusion_binary(af_pixels(inp.fx_pixel.where("valid")), ["chip_id"], "fire")))


@query(
    "f11_confusion_by_chip",
    "SELECT chip_id, " + ", ".join(f"count(CASE WHEN truth={t} AND pred={p} THEN 1 END) AS c{t}{p}" for t in range(4) for p in range(4)) + f" FROM {DEC_VALID} d GROUP BY chip_id",
)
def f11_confusion_by_chip(inp):
    return C.confusion_wide(decided(inp.fx_pixel.where("valid")), ["chip_id"])


@query(
    "f12_score_histogram",
    "SELECT truth, bin, count(*) AS n FROM (SELECT truth, CAST("
    + "+".join(f"CASE WHEN t1>=CAST({e} AS FLOAT) THEN 1 ELSE 0 END" for e in G.DNBR_EDGES)
    + " AS BIGINT) AS bin FROM fx_pixel WHERE valid) q GROUP BY truth, bin",
)
def f12_score_histogram(inp):
    return longs(C.score_histogram(inp.fx_pixel.where("valid"), "t1", G.DNBR_EDGES))


@query("f13_label_histogram", "SELECT task, CASE WHEN valid THEN truth ELSE 255 END AS label, count(*) AS n FROM fx_pixel GROUP BY ALL")
def f13_label_histogram(inp):
    px = inp.fx_pixel.withColumn("y", F.when(F.col("valid"), F.col("truth")))
    return longs(C.label_histogram(px))


_CELLS = ", ".join(f"sum(CASE WHEN truth={t} AND pred={p} THEN 1 ELSE 0 END) AS c{t}{p}" for t in range(4) for p in range(4))
_SUB = f"""SELECT d.*, CAST(extract(year FROM m.date_pre) AS VARCHAR) AS year,
 CASE WHEN cloud_frac<=0.1 THEN '<=0.1' WHEN cloud_frac<=0.3 THEN '(0.1,0.3]' ELSE '>0.3' END AS cloud_bin FROM {DEC_VALID} d JOIN fx_meta m USING (chip_id)"""


def _sub(grp: str, name: str) -> str:
    tp, fp, fn = "sum(CASE WHEN truth>0 AND pred>0 THEN 1 ELSE 0 END)", "sum(CASE WHEN truth=0 AND pred>0 THEN 1 ELSE 0 END)", "sum(CASE WHEN truth>0 AND pred=0 THEN 1 ELSE 0 END)"
    extra = f"SELECT {name} AS name, count(DISTINCT chip_id) AS chips, count(*) AS pixels, {Q.r(f'{tp}*1.0/nullif({tp}+{fp},0)')} AS burn_precision, {Q.r(f'{tp}*1.0/nullif({tp}+{fn},0)')} AS burn_recall FROM sub GROUP BY 1"
    return f"SELECT '{grp}' AS grp, e.*, s.* EXCLUDE (name) FROM ({extra}) e JOIN ({Q.score_select(f'(SELECT *, {name} AS name FROM sub) z', 'name')}) s USING (name)"


@query("f14_subgroup_report", f"WITH sub AS ({_SUB}) {_sub('year', 'year')} UNION ALL BY NAME {_sub('cloud', 'cloud_bin')} UNION ALL BY NAME {_sub('global', chr(39) + 'all' + chr(39))}")
def f14_subgroup_report(inp):
    meta = inp.fx_meta.select("chip_id", F.date_format("date_pre", "yyyy").alias("year"), C.cloud_bin(F.col("cloud_frac")).alias("cloud_bin"))
    return rounded(C.subgroup_report(decided(inp.fx_pixel.where("valid")), meta))


@query("f15_split_counts", "SELECT kind, split, count(*) AS n FROM fx_meta GROUP BY kind, split")
def f15_split_counts(inp):
    return C.split_counts(inp.fx_meta)


@query(
    "f16_mask_counts",
    "SELECT chip_id, " + ", ".join(f"count(CASE WHEN cls={c} THEN 1 END) AS n{c}" for c in range(4)) + ", count(CASE WHEN cls>0 THEN 1 END) AS positive FROM fx_class GROUP BY chip_id",
)
def f16_mask_counts(inp):
    return C.mask_counts(inp.fx_class)


@query(
    "f17_overall_digest",
    """WITH d AS (SELECT chip_id, sha256(unhex(string_agg('0'||CAST(cls AS VARCHAR),'' ORDER BY pos))) AS h FROM fx_class GROUP BY chip_id),
 b AS (SELECT substr(md5(CAST(chip_id AS VARCHAR)),1,3) AS bucket, sha256(string_agg(h,'' ORDER BY chip_id)) AS h, count(*) AS n FROM d GROUP BY 1)
 SELECT sha256(string_agg(h,'' ORDER BY bucket)) AS sha256, CAST(sum(n) AS BIGINT) AS masks FROM b""",
)
def f17_overall_digest(inp):
    return C.overall_digest(C.mask_digest(inp.fx_class))


@query("f17_mask_digest", "SELECT chip_id, sha256(unhex(string_agg('0'||CAST(cls AS VARCHAR),'' ORDER BY pos))) AS sha256 FROM fx_class GROUP BY chip_id")
def f17_mask_digest(inp):
    return C.mask_digest(inp.fx_class)


@query(
    "f18_loss_binary",
    f"""SELECT {Q.r('b/m')} AS cross_entropy, {Q.r('1-(2*i+1)/(sp+st+1)')} AS dice, {Q.r('b/m+1-(2*i+1)/(sp+st+1)')} AS loss FROM (SELECT sum(-(3.0*t*ln(p)+(1-t)*ln(1-p))*pow((1-p)*t+p*(1-t),1.5)) AS b,
 CAST(count(*) AS DOUBLE) AS m, sum(p*t) AS i, sum(p) AS sp, sum(t) AS st FROM (SELECT greatest(least(CAST(t1 AS DOUBLE),1-1e-12),1e-12) AS p, CASE WHEN truth=1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM fx_pixel WHERE valid) q) z""",
)
def f18_loss_binary(inp):
    px = inp.fx_pixel.withColumn("fire", (F.col("truth") == 1).cast("int"))
    return rounded(C.binary_loss(px, "t1", "fire", 3.0))


_W = (0.5, 1.0, 2.0, 4.0)


@query(
    "f18_loss_multiclass",
    f"SELECT {Q.r('ce/m')} AS cross_entropy, {Q.r('1-d')} AS dice, {Q.r('ce/m+1-d')} AS loss FROM (SELECT sum(ce) AS ce, CAST(count(*) AS DOUBLE) AS m, ("
    + "+".join(f"(2*sum(p{c}*h{c})+1)/(sum(p{c}+h{c})+1)" for c in range(4))
    + ")/4 AS d FROM (SELECT *, "
    + "+".join(f"-({w}::DOUBLE)*h{c}*ln(p{c})" for c, w in enumerate(_W))
    + " AS ce FROM (SELECT "
    + ", ".join(f"greatest(CAST(t{c} AS DOUBLE),1e-12) AS p{c}, CASE WHEN truth={c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h{c}" for c in range(4))
    + " FROM fx_pixel WHERE valid) q) w) z",
)
def f18_loss_multiclass(inp):
    return rounded(C.multiclass_loss(inp.fx_pixel, TREE, "truth", _W))


@query(
    "f19_catalog_summary",
    """SELECT dataset_id, scene_count, tasks, strftime(first_date,'%Y-%m-%d %H:%M:%S') AS first_date, strftime(greatest(last_scene,last_preset),'%Y-%m-%d %H:%M:%S') AS last_date FROM
 (SELECT 'd'||CAST(epsg AS VARCHAR) AS dataset_id, count(*) AS scene_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS tasks,
  min(CASE WHEN kind='af' THEN acquired_at ELSE date_pre END) AS first_date, max(CASE WHEN kind='af' THEN acquired_at ELSE date_post END) AS last_scene,
  max(CASE WHEN kind='af' THEN acquired_at + INTERVAL 1 SECOND ELSE date_post + INTERVAL 1 DAY END) AS last_preset FROM fx_meta GROUP BY epsg) q""",
)
def f19_catalog_summary(inp):
    from ember.sources.manifests import build_scenes

    scenes = build_scenes(inp.fx_meta).join(inp.fx_meta.select(F.col("chip_id").alias("scene_id"), F.concat(F.lit("d"), "epsg").alias("dataset_id")), "scene_id")
    scenes = scenes.withColumnsRenamed({"scene_date_pre": "date_pre", "scene_date_post": "date_post"})
    out = A.catalog_summary(scenes, scenes.select("dataset_id", "period_end"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select("dataset_id", "scene_count", F.array_join("tasks", ",").alias("tasks"), F.date_format("first_date", fmt).alias("first_date"), F.date_format("last_date", fmt).alias("last_date"))


@query("f20_envelope", f"SELECT aoi_id, {Q.r('min(lon)')} AS w, {Q.r('min(lat)')} AS s, {Q.r('max(lon)')} AS e, {Q.r('max(lat)')} AS n FROM fx_vertex GROUP BY aoi_id")
def f20_envelope(inp):
    return rounded(A.envelope(inp.fx_vertex, ["aoi_id"]))


@query(
    "f24_prior_weights",
    f"""SELECT y, population, selected, {Q.r('w')} AS weight, {Q.r('w/(sum(w*selected) OVER ()/sum(selected) OVER ())')} AS weight_mean1 FROM (SELECT *, sqrt(population*1.0/selected) AS w FROM
 (SELECT truth AS y, count(*) AS population, count(CASE WHEN pos%5=0 THEN 1 END) AS selected FROM fx_pixel WHERE valid GROUP BY truth) q) z""",
)
def f24_prior_weights(inp):
    counts = inp.fx_pixel.where("valid").groupBy(F.col("truth").alias("y")).agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("pos") % 5 == 0).alias("selected"))
    return rounded(C.prior_weights(counts, power=0.5))


_RESULT = """SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'MODEL_NOT_READY' WHEN 'O' THEN 'partial' END AS status,
 CASE WHEN o_orderpriority='1-URGENT' THEN 'no_data' WHEN o_orderpriority='2-HIGH' THEN 'complete' END AS af_status, CASE WHEN o_orderpriority='3-MEDIUM' THEN 'no_data' END AS bs_status,
 o_custkey%3<>0 AS has_af, o_custkey%5<>0 AS has_bs, CAST(o_custkey%50 AS DOUBLE) AS hotspot_count, o_totalprice/1000 AS burn_area_ha,
 CASE WHEN o_custkey%7=0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice/3000 END AS area_1, o_totalprice*0.25 AS area_2, o_totalprice/6000 AS area_3 FROM orders"""


@query(
    "f25_normalise_result",
    f"""WITH raw AS ({_RESULT}), st AS (SELECT * REPLACE (CASE WHEN status='MODEL_NOT_READY' THEN 'model_unavailable' ELSE coalesce(status,'complete') END AS status) FROM raw),
 md AS (SELECT * REPLACE (CASE WHEN status='model_unavailable' THEN status WHEN af_status IS NOT NULL THEN af_status WHEN has_af THEN status ELSE 'no_data' END AS af_status,
  CASE WHEN status='model_unavailable' THEN status WHEN bs_status IS NOT NULL THEN bs_status WHEN has_bs THEN status ELSE 'no_data' END AS bs_status) FROM st)
 SELECT request_id, status, af_status, bs_status, has_af, has_bs, {Q.r("CASE WHEN af_status NOT IN ('no_data','model_unavailable') THEN hotspot_count END")} AS hotspot_count,
 """
    + ", ".join(Q.r(f"CASE WHEN bs_status NOT IN ('no_data','model_unavailable') AND NOT isnan({m}) THEN {m} END") + f" AS {m}" for m in ("burn_area_ha", "area_1", "area_2", "area_3"))
    + " FROM md",
)
def f25_normalise_result(inp):
    raw = inp.spark.sql(_RESULT.replace("FROM orders", "FROM {orders}").replace("CAST('NaN' AS DOUBLE)", "double('NaN')"), orders=inp.orders)
    return rounded(A.normalise_result(raw))


@query("f26_validation_score", Q.score_select(DEC_VALID + " d"))
def f26_validation_score(inp):
    return rounded(C.validation_score(decided(inp.fx_pixel), "bs"))


@query(
    "f27_combined_with_fixed",
    f"SELECT task, {Q.r('score')} AS score, {Q.r('0.35*0.93+score')} AS combined_score, {Q.r('0.35*0.93+score-0.7')} AS delta_vs_baseline FROM ({Q.score_select(DEC_VALID + ' d', 'task', rounded=False)}) q",
)
def f27_combined_with_fixed(inp):
    scored = C.score_confusion(C.confusion(decided(inp.fx_pixel.where("valid")), ["task"]), ["task"]).select("task", "score")
    return rounded(C.combined_with_fixed(scored, 0.93, 0.7))


@query(
    "a19_band_profile",
    "SELECT label AS grp, band, count(*) AS n, "
    + f"{Q.r('min(v)')} AS low, {Q.r('max(v)')} AS high, count(DISTINCT v) AS n_values FROM (SELECT CAST(valid AS INTEGER) AS label, unnest(['I1','I5','dem']) AS band, unnest([CAST(I1 AS DOUBLE),CAST(I5 AS DOUBLE),CAST(dem AS DOUBLE)]) AS v FROM fx_af) q GROUP BY label, band",
)
def a19_band_profile(inp):
    px = inp.fx_af.withColumn("grp", F.col("valid").cast("int"))
    return rounded(C.band_profile(px, "grp", ["I1", "I5", "dem"]))


@query("u5_sql_functions", f"SELECT chip_id, {Q.r(Q.f1('tp', 'fp', 'fn'))} AS f1, {Q.r(Q.iou('tp', 'tp+fp+fn'))} AS iou FROM (SELECT chip_id, {Q.binary('fire')} FROM {AF} a GROUP BY chip_id) q")
def u5_sql_functions(inp):
    from ember.functions.register import register_sql_functions

    register_sql_functions(inp.spark)
    counts = C.confusion_binary(af_pixels(inp.fx_pixel), ["chip_id"], "fire")
    return rounded(inp.spark.sql("SELECT chip_id, f1_score(tp, fp, fn) AS f1, iou_score(tp, tp + fp + fn) AS iou FROM {counts}", counts=counts))


