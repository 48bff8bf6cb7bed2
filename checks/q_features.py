"""A5-A6, C and D: pixels, features and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import RECIPE, TREE, longs, rounded
from checks.registry import query
from checks.views import HEIGHT, WIDTH
from ember.functions import decision as D
from ember.functions import spectral as S
from ember.operators import confusion as C
from ember.operators import focal as W
from ember.operators import pixels as P
from ember.operators import tiles as T

FL = lambda x: f"CAST({x} AS FLOAT)"
KEY = "chip_id, rw, cl"


def fin(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 0 ELSE {x} END"


def nd(a: str, b: str) -> str:
    ratio = f"(({a}-{b})/(abs({a})+abs({b})+{FL('1e-5')}))"
    return f"CASE WHEN isnan({ratio}) THEN CAST(0 AS FLOAT) ELSE greatest(least({ratio},CAST(1 AS FLOAT)),CAST(-1 AS FLOAT)) END"


@query("a5_explode_bands", f"SELECT chip_id, pos, rw, cl, {Q.r('v')} AS v FROM fx_band")
def a5_explode_bands(inp):
    chips = inp.embeddings.select(F.col("vec_id").alias("chip_id"), F.col("embedding").alias("v"))
    return rounded(P.explode_bands(chips, ["v"], 8))


@query("a6_label_pixels", "SELECT chip_id, rw, cl, CASE WHEN valid THEN cls ELSE -1 END AS y, valid AS labelled FROM fx_class")
def a6_label_pixels(inp):
    marked = inp.fx_class.withColumn("label", F.when(F.col("valid"), F.col("cls")).otherwise(255))
    return longs(P.label_pixels(P.pack_bands(marked, ["label"]), "label", WIDTH).withColumn("y", F.coalesce("y", F.lit(-1))))


@query(
    "a16_display_mask",
    "SELECT chip_id, string_agg(CAST(CASE WHEN valid THEN cls ELSE 255 END AS VARCHAR), ' ' ORDER BY pos) AS mask FROM fx_class GROUP BY chip_id",
)
def a16_display_mask(inp):
    packed = P.pack_bands(P.display_mask(inp.fx_class).withColumn("mask", F.col("mask").cast("string")), ["mask"])
    return packed.select("chip_id", F.array_join("mask", " ").alias("mask"))


_AF_SCALE = {
    **{n: f"{n}" for n in ("I1", "I2", "I3", "valid")},
    **{n: f"({n}-{FL('273.15')})/{FL(50)}" for n in ("I4", "I5", "t2m")},
    "solar_zenith": f"solar_zenith/{FL(90)}", "sensor_zenith": f"sensor_zenith/{FL(90)}", "landcover": f"landcover/{FL(100)}",
    "dem": f"dem/{FL(1000)}", "rh2m": f"rh2m/{FL(100)}", "wind_speed": f"wind_speed/{FL(20)}",
}


@query("c1_af_scale", f"SELECT {KEY}, " + ", ".join(f"{Q.r(fin(e))} AS {n}" for n, e in _AF_SCALE.items()) + " FROM fx_af")
def c1_af_scale(inp):
    return rounded(inp.fx_af.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.af_scaled().items()]))


_THERMAL = f"({fin('(I4-I5)')})/{FL(20)}"


@query(
    "c2_af_thermal",
    f"SELECT {KEY}, {Q.r(_THERMAL)} AS I4_minus_I5, {Q.r(fin(f'((I4-t2m)/{FL(20)})'))} AS I4_minus_t2m, {Q.r(fin(f'((I5-t2m)/{FL(20)})'))} AS I5_minus_t2m FROM fx_af",
)
def c2_af_thermal(inp):
    return rounded(inp.fx_af.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.af_thermal().items()]))


@query("c3_norm_diff", f"SELECT {KEY}, {Q.r(nd(FL('dem'), FL('t2m')))} AS nd FROM fx_af")
def c3_norm_diff(inp):
    return rounded(inp.fx_af.select("chip_id", "rw", "cl", S.norm_diff(F.col("dem"), F.col("t2m")).alias("nd")))


@query("c4_af_ratios", f"SELECT {KEY}, {Q.r(nd('I2', 'I1'))} AS reflectance_nd21, {Q.r(nd('I3', 'I2'))} AS reflectance_nd32 FROM fx_af")
def c4_af_ratios(inp):
    return rounded(inp.fx_af.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.af_ratios().items()]))


def _bs_scale_sql() -> dict[str, str]:
    out = {}
    for w in ("pre", "post"):
        out |= {f"{w}_{b}": f"{FL(f'{w}_{b}')}/{FL(10000)}" for b in S.OPTICAL}
        out[f"{w}_SCL"] = f"{FL(f'{w}_SCL')}/{FL(11)}"
    for w in ("pre", "post"):
        out |= {f"{w}_{b}_db": f"({FL(f'{w}_{b}')}/{FL(100)})/{FL(30)}" for b in S.SAR}
    return out | {"dem": f"{FL('dem')}/{FL(1000)}", "slope": f"{FL('slope')}/{FL(90)}", "landcover": f"{FL('landcover')}/{FL(100)}"}


def _bs_delta_sql() -> dict[str, str]:
    out = {f"delta_{b}": f"{FL(f'pre_{b}')}/{FL(10000)}-{FL(f'post_{b}')}/{FL(10000)}" for b in S.OPTICAL}
    return out | {f"delta_{b}_db": f"({FL(f'pre_{b}')}/{FL(100)}-{FL(f'post_{b}')}/{FL(100)})/{FL(20)}" for b in S.SAR}


def _bs_index_sql() -> dict[str, str]:
    out = {}
    for name, (a, b) in S.INDICES.items():
        pre, post = (nd(f"({FL(f'{w}_{a}')}/{FL(10000)})", f"({FL(f'{w}_{b}')}/{FL(10000)})") for w in ("pre", "post"))
        out |= {f"pre_{name}": pre, f"post_{name}": post, f"delta_{name}": f"({pre})-({post})"}
    return out


def _named(sql: dict[str, str]) -> str:
    return ", ".join(f"{Q.r(e)} AS {n}" for n, e in sql.items())


@query("c5_bs_scale", f"SELECT {KEY}, {_named(_bs_scale_sql())} FROM fx_bs")
def c5_bs_scale(inp):
    return rounded(inp.fx_bs.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.bs_scaled().items()]))


@query("c6_bs_deltas", f"SELECT {KEY}, {_named(_bs_delta_sql())} FROM fx_bs")
def c6_bs_deltas(inp):
    return rounded(inp.fx_bs.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.bs_deltas().items()]))


@query("c7_bs_indices", f"SELECT {KEY}, {_named(_bs_index_sql())} FROM fx_bs")
def c7_bs_indices(inp):
    return rounded(inp.fx_bs.select("chip_id", "rw", "cl", *[c.alias(n) for n, c in S.bs_indices().items()]))


@query("c8_finite0", f"SELECT {KEY}, {Q.r('CASE WHEN isnan(I1) THEN 0 ELSE I1 END')} AS I1, {Q.r('CASE WHEN isnan(I4) THEN 0 ELSE I4 END')} AS I4 FROM fx_af")
def c8_finite0(inp):
    return rounded(inp.fx_af.select("chip_id", "rw", "cl", S.finite0(F.col("I1")).alias("I1"), S.finite0(F.col("I4")).alias("I4")))


@query("c9_af_valid", f"SELECT {KEY}, (valid>0.5 AND NOT isnan(I1) AND NOT isnan(I4)) AS observed FROM fx_af")
def c9_af_valid(inp):
    return inp.fx_af.select("chip_id", "rw", "cl", S.af_observed().alias("observed"))


@query("c10_bs_valid", f"SELECT {KEY}, (pre_SCL IN (2,4,5,6,7) AND post_SCL IN (2,4,5,6,7)) AS observed FROM fx_bs")
def c10_bs_valid(inp):
    return inp.fx_bs.select("chip_id", "rw", "cl", S.bs_observed().alias("observed"))


@query(
    "c11_standardise",
    f"""WITH st AS (SELECT avg(CASE WHEN valid>0.5 AND NOT isnan(I4) THEN CAST(I4 AS DOUBLE) END) AS m, avg(CASE WHEN valid>0.5 AND NOT isnan(I4) THEN CAST(I4 AS DOUBLE)*I4 END) AS q FROM fx_af)
 SELECT {KEY}, {Q.r('CASE WHEN isnan(I4) THEN 0 ELSE (CAST(I4 AS DOUBLE)-m)/sqrt(q-m*m) END', 5)} AS I4 FROM fx_af, st""",
)
def c11_standardise(inp):
    px = inp.fx_af.select("chip_id", "rw", "cl", "I4", "valid")
    stats = C.fit_normaliser(px, ["I4"], F.col("valid") > 0.5)
    return rounded(P.standardise(px, ["I4"], stats).select("chip_id", "rw", "cl", "I4"), 5)


@query("c12_to_vector", f"SELECT {KEY}, {Q.r('I2')} AS f0, {Q.r('I5')} AS f1, {Q.r('dem')} AS f2 FROM fx_af")
def c12_to_vector(inp):
    from pyspark.ml.functions import vector_to_array

    vec = P.to_vector(inp.fx_af, ["I2", "I5", "dem"])
    return rounded(vec.select("chip_id", "rw", "cl", *[F.get(vector_to_array("features"), F.lit(i)).alias(f"f{i}") for i in range(3)]))


def mirrored(col: str, source: str, k: int, out: str, height: int = HEIGHT, width: int = WIDTH) -> str:
    """Direct (non-separable) mean over the mirrored square, as a self-join."""
    h = k // 2
    return f"""(SELECT p.chip_id, p.rw, p.cl, avg(CAST(s.{col} AS DOUBLE)) AS {out} FROM {source} p, range(-{h},{h + 1}) dy(y), range(-{h},{h + 1}) dx(x), {source} s
 WHERE s.chip_id=p.chip_id
  AND s.rw = CASE WHEN p.rw+y<0 THEN -1-(p.rw+y) WHEN p.rw+y>={height} THEN {2 * height}-1-(p.rw+y) ELSE p.rw+y END
  AND s.cl = CASE WHEN p.cl+x<0 THEN -1-(p.cl+x) WHEN p.cl+x>={width} THEN {2 * width}-1-(p.cl+x) ELSE p.cl+x END
 GROUP BY p.chip_id, p.rw, p.cl)"""


@query("d1_focal_mean", f"SELECT chip_id, rw, cl, {Q.r('m')} AS m3 FROM {mirrored('v', 'fx_band', 3, 'm', 8, 8)} q")
def d1_focal_mean(inp):
    return rounded(W.focal_mean(inp.fx_band.select("chip_id", "rw", "cl", "v"), "v", 3, 8, 8, "m3").select("chip_id", "rw", "cl", "m3"))


@query("d1_focal_mean_11", f"SELECT chip_id, rw, cl, {Q.r('m')} AS m11 FROM {mirrored('t1', 'fx_pixel', 11, 'm')} q")
def d1_focal_mean_11(inp):
    return rounded(W.focal_mean(inp.fx_pixel.select("chip_id", "rw", "cl", "t1"), "t1", 11, HEIGHT, WIDTH, "m11").select("chip_id", "rw", "cl", "m11"))


@query("d2_focal_contrast", f"SELECT chip_id, rw, cl, {Q.r('CAST(v AS DOUBLE)-m')} AS contrast FROM fx_band JOIN {mirrored('v', 'fx_band', 5, 'm', 8, 8)} q USING (chip_id, rw, cl)")
def d2_focal_contrast(inp):
    px = inp.fx_band.select("chip_id", "rw", "cl", F.col("v").cast("double").alias("v"))
    return rounded(W.focal_contrast(px, "v", 5, 8, 8, "contrast").select("chip_id", "rw", "cl", "contrast"))


_SMOOTH = "fx_pixel" + "".join(f" JOIN {mirrored(f't{c}', 'fx_pixel', 3, f'm{c}')} q{c} USING (chip_id, rw, cl)" for c in range(4))


@query(
    "d3_smooth_probs",
    f"SELECT chip_id, rw, cl, CAST({Q.argmax([f'(CAST({m} AS FLOAT)*CAST(m{c} AS FLOAT))' for c, m in enumerate(RECIPE)])} AS BIGINT) AS cls FROM {_SMOOTH}",
)
def d3_smooth_probs(inp):
    px = inp.fx_pixel.select("chip_id", "rw", "cl", *TREE)
    smooth = W.smooth_scores(px, TREE, 3, HEIGHT, WIDTH)
    return smooth.select("chip_id", "rw", "cl", D.decide_bs([F.col(c) for c in TREE], RECIPE).cast("bigint").alias("cls"))


@query("d4_d4_average", f"SELECT chip_id, rw, cl, {Q.r('t1')} AS t1 FROM fx_pixel")
def d4_d4_average(inp):
    variants = T.d4_variants(inp.fx_pixel.select("chip_id", "rw", "cl", "t1"), HEIGHT, WIDTH)
    return rounded(T.d4_average(variants, ["t1"], HEIGHT, WIDTH))


@query(
    "d4_d4_variant_scores",
    f"""SELECT chip_id, rw, cl, {Q.r('(8*CAST(t1 AS DOUBLE)+(0+1+2+3)*0.5+4*0.25)/8')} AS s FROM fx_pixel""",
)
def d4_d4_variant_scores(inp):
    variants = T.d4_variants(inp.fx_pixel.select("chip_id", "rw", "cl", "t1"), HEIGHT, WIDTH)
    shifted = variants.withColumn("s", F.col("t1").cast("double") + F.when(F.col("mirror"), 0.25).otherwise(F.col("turns") * 0.5))
    return rounded(T.d4_average(shifted, ["s"], HEIGHT, WIDTH))


_H, _W = HEIGHT - 1, WIDTH - 1
_DRAW = lambda *p: Q.draw(7, "chip_id", *p)


@query(
    "d5_crop_windows",
    f"""WITH p AS (SELECT chip_id, truth, min(struct_pack(draw:={_DRAW('truth', 'rw', 'cl')}, rw:=rw, cl:=cl)) AS k FROM fx_pixel WHERE valid AND truth IN (1,2,3) GROUP BY chip_id, truth),
 l AS (SELECT chip_id, list(k ORDER BY truth) AS ks FROM p GROUP BY chip_id),
 c AS (SELECT chip_id, ks, CASE WHEN ks IS NOT NULL THEN ks[{_DRAW("'class'")}%len(ks)+1] END AS px FROM (SELECT DISTINCT chip_id FROM fx_pixel) a LEFT JOIN l USING (chip_id))
 SELECT chip_id, CAST(CASE WHEN ks IS NOT NULL AND {_DRAW("'centre'")}%100<70 THEN greatest(0,least(px.rw-4,{HEIGHT - 8})) ELSE {_DRAW("'top'")}%{HEIGHT - 8 + 1} END AS BIGINT) AS top,
 CAST(CASE WHEN ks IS NOT NULL AND {_DRAW("'centre'")}%100<70 THEN greatest(0,least(px.cl-4,{WIDTH - 8})) ELSE {_DRAW("'left'")}%{WIDTH - 8 + 1} END AS BIGINT) AS "left" FROM c""",
)
def d5_crop_windows(inp):
    return T.crop_windows(inp.fx_pixel.withColumn("y", F.col("truth")), HEIGHT, WIDTH, 8, 7)


@query(
    "d5_sample_crops",
    f"""WITH w AS (SELECT chip_id, {_DRAW("'top'")}%{HEIGHT - 8 + 1} AS tp, {_DRAW("'left'")}%{WIDTH - 8 + 1} AS lf FROM (SELECT DISTINCT chip_id FROM fx_pixel) q)
 SELECT chip_id, rw-tp AS rw, cl-lf AS cl, truth FROM fx_pixel JOIN w USING (chip_id) WHERE rw>=tp AND rw<tp+8 AND cl>=lf AND cl<lf+8""",
)
def d5_sample_crops(inp):
    px = inp.fx_pixel.withColumn("y", F.col("truth"))
    windows = T.crop_windows(px, HEIGHT, WIDTH, 8, 7, centred=0)
    return T.crop(px, windows, 8).select("chip_id", "rw", "cl", "truth")


@query("d6_augment", f"SELECT chip_id, {_W}-({_W}-cl) AS rw, {_H}-rw AS cl, truth FROM fx_pixel")
def d6_augment(inp):
    return T.augment(inp.fx_pixel, HEIGHT, WIDTH, True, True, 1).select("chip_id", "rw", "cl", "truth")


def _focal_sql(col: str, k: int, out: str, source: str) -> str:
    return f" JOIN {mirrored(col, source, k, out)} j_{out} USING (chip_id, rw, cl)"


_AF_ALL = {n: fin(e) for n, e in _AF_SCALE.items()} | {
    "I4_minus_I5": _THERMAL,
    "I4_minus_t2m": fin(f"((I4-t2m)/{FL(20)})"),
    "I5_minus_t2m": fin(f"((I5-t2m)/{FL(20)})"),
    "reflectance_nd21": nd("I2", "I1"),
    "reflectance_nd32": nd("I3", "I2"),
}
_AF_BASE = f"""SELECT chip_id, rw, cl, {', '.join(f'{e} AS {n}' for n, e in _AF_ALL.items())}, {fin(f'((I4-{FL("273.15")})/{FL(50)})')} AS i4n, (valid>0.5 AND NOT isnan(I1) AND NOT isnan(I4)) AS observed FROM fx_af"""
_FOCAL_AF = {
    "thermal_mean_3": "CAST(tm3 AS FLOAT)", "thermal_contrast_3": "I4_minus_I5-CAST(tm3 AS FLOAT)",
    "thermal_mean_11": "CAST(tm11 AS FLOAT)", "thermal_contrast_11": "I4_minus_I5-CAST(tm11 AS FLOAT)", "I4_contrast_11": "i4n-CAST(im11 AS FLOAT)",
}


@query(
    "c14_af_features",
    f"""WITH b AS ({_AF_BASE}) SELECT chip_id, rw, cl, observed, {', '.join(f'{Q.r(n)} AS {n}' for n in _AF_ALL)}, {', '.join(f'{Q.r(e, 5)} AS {n}' for n, e in _FOCAL_AF.items())}
 FROM b{_focal_sql('I4_minus_I5', 3, 'tm3', 'b')}{_focal_sql('I4_minus_I5', 11, 'tm11', 'b')}{_focal_sql('i4n', 11, 'im11', 'b')}""",
)
def c14_af_features(inp):
    """All 23 features and the observed flag."""
    out = P.features_af(inp.fx_af, HEIGHT, WIDTH)
    return rounded(out.withColumns({c: F.round(F.col(c).cast("double"), 5) for c in _FOCAL_AF}))


_BS_ALL = {**_bs_scale_sql(), **_bs_delta_sql(), **_bs_index_sql()}
_BS_BASE = f"SELECT chip_id, rw, cl, {', '.join(f'{e} AS {n}' for n, e in _BS_ALL.items())}, (pre_SCL IN (2,4,5,6,7) AND post_SCL IN (2,4,5,6,7)) AS observed FROM fx_bs"
_FOCAL_BS = {"dNBR_mean_3": ("delta_NBR", 3), "dNDVI_mean_3": ("delta_NDVI", 3), "dNBR_mean_9": ("delta_NBR", 9), "dNDVI_mean_9": ("delta_NDVI", 9), "sar_VH_delta_mean_5": ("delta_VH_db", 5)}


@query(
    "c13_bs_features",
    f"""WITH b AS ({_BS_BASE}) SELECT chip_id, rw, cl, observed, {', '.join(f'{Q.r(n)} AS {n}' for n in _BS_ALL)}, {', '.join(f"{Q.r(f'CAST(m_{n} AS FLOAT)', 5)} AS {n}" for n in _FOCAL_BS)}
 FROM b{''.join(_focal_sql(c, k, f'm_{n}', 'b') for n, (c, k) in _FOCAL_BS.items())}""",
)
def c13_bs_features(inp):
    """All 55 features and the observed flag."""
    out = P.features_bs(inp.fx_bs, HEIGHT, WIDTH)
    return rounded(out.withColumns({c: F.round(F.col(c).cast("double"), 5) for c in _FOCAL_BS}))
