"""G and H: searches, resampling, sampling, decisions and models."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import RECIPE, RECIPE_WEIGHT, SECOND, TREE, af_pixels, decided, longs, rounded
from checks.q_metrics import AF, DEC_VALID
from checks.registry import query
from checks.views import HEIGHT, WIDTH
from ember.functions import decision as D
from ember.operators import confusion as C
from ember.operators import models as M
from ember.operators import pixels as P
from ember.operators import resample as R
from ember.operators import sampling as S
from ember.operators import search as G
from ember.plans import evaluation as V
from ember.session import scratch

REPS = 200


def curve(source: str, score: str, truth: str, keys: str = "") -> str:
    """Exact threshold by one global window over distinct scores."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{Q.r('threshold')} AS threshold, {Q.r('f')} AS f1, CAST(positives AS BIGINT) AS positives FROM (SELECT {k}max(pos) AS positives, arg_max(s, (f, s)) AS threshold, max(f) AS f FROM
 (SELECT *, 2.0*tp/(np+pos) AS f FROM (SELECT {k}s, sum(t) OVER (PARTITION BY {keys if keys else '1'} ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY {keys if keys else '1'} ORDER BY s DESC) AS np, sum(t) OVER ({part}) AS pos
 FROM (SELECT {k}CAST({score} AS DOUBLE) AS s, count(*) AS n, sum({truth}) AS t FROM {source} GROUP BY {k}s) a) b) c {group}) d"""


@query("g1_best_threshold", curve("(SELECT *, CASE WHEN truth=1 THEN 1 ELSE 0 END AS fire FROM fx_pixel WHERE valid) z", "t1", "fire"))
def g1_best_threshold(inp):
    px = inp.fx_pixel.where("valid").withColumn("fire", (F.col("truth") == 1).cast("int"))
    return rounded(G.best_threshold(px, "t1", "fire"))


@query("g1_best_threshold_by_chip", curve(f"(SELECT *, CASE WHEN truth=1 THEN 1 ELSE 0 END AS fire, {Q.blend(RECIPE_WEIGHT, 1)} AS mix FROM fx_pixel) z", "mix", "fire", "chip_id"))
def g1_best_threshold_by_chip(inp):
    return rounded(G.best_threshold(af_pixels(inp.fx_pixel), "score", "fire", ["chip_id"]))


def grid_values(sets) -> str:
    rows = ",".join(f"({i},{a}::FLOAT,{b}::FLOAT,{c}::FLOAT)" for i, (_, a, b, c) in enumerate(sets))
    return f"(VALUES {rows}) g(cand,m1,m2,m3)"


COARSE = [(1.0, *m) for m in itertools.product(G.COARSE_STEPS, repeat=3)]


def grid_sql(prefix: str, sets, where: str = "valid", source: str = "fx_pixel", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    pred = Q.argmax([f"{prefix}0", f"({prefix}1*m1)", f"({prefix}2*m2)", f"({prefix}3*m3)"])
    return Q.score_select(f"(SELECT {k}cand, m1, m2, m3, truth, {pred} AS pred FROM {source}, {grid_values(sets)} WHERE {where}) q", f"{k}cand, m1, m2, m3", rounded=False)


@query("g2_grid_multipliers", f"SELECT CAST(cand AS BIGINT) AS cand, {Q.r('m1')} AS m1, {Q.r('m2')} AS m2, {Q.r('m3')} AS m3, {Q.r('IoU_burn')} AS IoU_burn, {Q.r('mIoU_sev')} AS mIoU_sev, {Q.r('score')} AS score FROM ({grid_sql('t', COARSE)}) z ORDER BY z.score DESC, cand LIMIT 1")
def g2_grid_multipliers(inp):
    best = G.grid_multipliers(inp.fx_pixel.where("valid"), TREE)
    return longs(rounded(best.select("cand", "m1", "m2", "m3", "IoU_burn", "mIoU_sev", "score")))


@query("g2_all_candidates", f"SELECT CAST(cand AS BIGINT) AS cand, {Q.r('score')} AS score FROM ({grid_sql('t', COARSE)}) z")
def g2_all_candidates(inp):
    return longs(rounded(G.score_candidates(inp.fx_pixel.where("valid"), TREE, G.multiplier_grid()).select("cand", "score")))


_EDGE = ",".join(f"({i},{e}::FLOAT)" for i, e in enumerate(G.DNBR_EDGES))


@query(
    "g3_grid_dnbr",
    f"""WITH ed AS (SELECT * FROM (VALUES {_EDGE}) v(i,e)), tr AS (SELECT a.e AS t1, b.e AS t2, c.e AS t3 FROM ed a JOIN ed b ON b.i>a.i JOIN ed c ON c.i>b.i),
 px AS (SELECT n2 AS v, truth FROM fx_pixel WHERE valid)
 SELECT {Q.r('t1')} AS t1, {Q.r('t2')} AS t2, {Q.r('t3')} AS t3, IoU_burn, mIoU_sev, score FROM ({Q.score_select('(SELECT tr.t1, tr.t2, tr.t3, truth, CASE WHEN v>=tr.t3 THEN 3 WHEN v>=tr.t2 THEN 2 WHEN v>=tr.t1 THEN 1 ELSE 0 END AS pred FROM px, tr) q', 't1, t2, t3')}) z""",
)
def g3_grid_dnbr(inp):
    hist = C.score_histogram(inp.fx_pixel.where("valid"), "n2", G.DNBR_EDGES)
    return rounded(G.grid_dnbr(hist).select("t1", "t2", "t3", "IoU_burn", "mIoU_sev", "score"))


def tuning_ctes(source: str, initial, passes: int = 2) -> str:
    """The coordinate search unrolled: one candidate table, log and state per (pass, class).

    ``source`` has ``truth, z0..z3``; a pass after one without a change changes nothing.
    """
    first = ", ".join(f"{m}::FLOAT AS m{c}" for c, m in enumerate(initial) if c)
    fixed = Q.argmax(["z0", "(z1*w.m1)", "(z2*w.m2)", "(z3*w.m3)"])
    steps = ",".join(f"({i},{v}::FLOAT)" for i, v in enumerate(G.TUNING_STEPS))
    out = [
        f"px AS MATERIALIZED {source}, st AS MATERIALIZED (SELECT * FROM (VALUES {steps}) v(i,s)), s00 AS (SELECT {first})",
        f"s0 AS MATERIALIZED (SELECT w.*, q.score AS best FROM s00 w, ({Q.score_select(f'(SELECT truth, {fixed} AS pred FROM px, s00 w) p', rounded=False)}) q)",
    ]
    for n in range(1, 3 * passes + 1):
        c = (n - 1) % 3 + 1
        pred = Q.argmax(["z0", *[f"(z{j}*{'st.s' if j == c else f'w.m{j}'})" for j in (1, 2, 3)]])
        tried = Q.score_select(f"(SELECT st.i, st.s, truth, {pred} AS pred FROM px, st, s{n - 1} w) p", "i, s", rounded=False)
        state = ", ".join(f"coalesce((SELECT arg_max(s,i) FROM l{n}),w.m{j}) AS m{j}" if j == c else f"w.m{j}" for j in (1, 2, 3))
        out += [
            f"k{n} AS MATERIALIZED ({tried})",
            f"a{n} AS (SELECT k.i, k.s, k.score, w.best, w.m{c} AS m, coalesce(max(k.score) OVER (ORDER BY k.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),w.best) AS prev FROM k{n} k, s{n - 1} w)",
            f"l{n} AS MATERIALIZED (SELECT i, s, score, coalesce(lag(s) OVER (ORDER BY i),m) AS f FROM a{n} WHERE score>greatest(prev,best)+1e-12)",
            f"s{n} AS MATERIALIZED (SELECT {state}, coalesce((SELECT max(score) FROM l{n}),w.best) AS best FROM s{n - 1} w)",
        ]
    return ", ".join(out)


def tuning_source(second_weight: float | None = None) -> str:
    mixed = [f"t{c}" if second_weight is None else f"{second_weight}::FLOAT*n{c}+{1 - second_weight}::FLOAT*t{c}" for c in range(4)]
    return "(SELECT truth, " + ", ".join(f"{m} AS z{c}" for c, m in enumerate(mixed)) + " FROM fx_pixel WHERE valid)"


_LOG = " UNION ALL ".join(f"SELECT {(n - 1) // 3 + 1} AS pass_no, {(n - 1) % 3 + 1} AS class_id, f, s, score FROM l{n}" for n in range(1, 7))


@query(
    "g4_tune_multipliers",
    f"WITH {tuning_ctes(tuning_source(), (1.0, 1.0, 1.0, 1.0))} SELECT pass_no, class_id, {Q.r('f')} AS from_value, {Q.r('s')} AS to_value, {Q.r('score')} AS score FROM ({_LOG} UNION ALL SELECT 0, 0, m1, m2, best FROM s6) z",
)
def g4_tune_multipliers(inp):
    weights, score, log = G.tune_multipliers(inp.fx_pixel.where("valid"), TREE)
    rows = [(r["pass_no"], r["class_id"], r["from_value"], r["to_value"], r["score"]) for r in log] + [(0, 0, weights[1], weights[2], score)]
    return rounded(inp.spark.createDataFrame(rows, "pass_no int, class_id int, from_value double, to_value double, score double"))


_WS = ",".join(f"({i},{w}::FLOAT,{1 - w}::FLOAT)" for i, w in enumerate(G.BLEND_WEIGHTS))


@query("g5_sweep_weights_af", f"SELECT CAST(cand AS BIGINT) AS cand, threshold, f1, positives FROM ({curve(f'(SELECT cand, CASE WHEN truth=1 THEN 1 ELSE 0 END AS fire, w*n1+u*t1 AS mix FROM fx_pixel, (VALUES {_WS}) g(cand,w,u) WHERE valid) z', 'mix', 'fire', 'cand')}) y")
def g5_sweep_weights_af(inp):
    px = inp.fx_pixel.where("valid").withColumn("fire", (F.col("truth") == 1).cast("int"))
    return longs(rounded(G.sweep_weights_af(px, "n1", "t1", truth="fire").drop("second_weight")))


def sweep_sql(weights, sets) -> str:
    ws = ",".join(f"({i},{w}::FLOAT,{1 - w}::FLOAT)" for i, w in enumerate(weights))
    mixed = ", ".join(f"w*n{c}+u*t{c} AS z{c}" for c in range(4))
    source = f"(SELECT wi, truth, {mixed} FROM fx_pixel, (VALUES {ws}) gw(wi,w,u) WHERE valid) src"
    return f"SELECT CAST(wi*{len(sets)}+cand AS BIGINT) AS cand, {Q.r('score')} AS score FROM ({grid_sql('z', sets, 'true', source, 'wi')}) y"


@query("g5_sweep_weights_bs", sweep_sql(G.BLEND_WEIGHTS, COARSE))
def g5_sweep_weights_bs(inp):
    return longs(rounded(G.sweep_weights_bs(inp.fx_pixel.where("valid"), SECOND, TREE).select("cand", "score")))


@query("g6_grid_fixed", sweep_sql(G.SECOND_WEIGHTS, G.FIXED_MULTIPLIERS))
def g6_grid_fixed(inp):
    out = G.sweep_weights_bs(inp.fx_pixel.where("valid"), SECOND, TREE, G.SECOND_WEIGHTS, G.FIXED_MULTIPLIERS)
    return longs(rounded(out.select("cand", "score")))


@query("g7_grid_balanced", sweep_sql(G.SECOND_WEIGHTS, G.LOW_PRIOR_MULTIPLIERS))
def g7_grid_balanced(inp):
    out = G.sweep_weights_bs(inp.fx_pixel.where("valid"), SECOND, TREE, G.SECOND_WEIGHTS, G.LOW_PRIOR_MULTIPLIERS)
    return longs(rounded(out.select("cand", "score")))


@query("g8_pick_recipe", f"SELECT cand, score FROM ({sweep_sql(G.SECOND_WEIGHTS, G.FIXED_MULTIPLIERS).replace(Q.r('score'), 'score')}) w ORDER BY score DESC, cand LIMIT 1".replace("SELECT cand, score", f"SELECT cand, {Q.r('score')} AS score", 1).replace("ORDER BY score", "ORDER BY w.score"))
def g8_pick_recipe(inp):
    out = G.sweep_weights_bs(inp.fx_pixel.where("valid"), SECOND, TREE, G.SECOND_WEIGHTS, G.FIXED_MULTIPLIERS)
    return longs(rounded(G.pick_first_best(out).select("cand", "score")))


def pairs(inp):
    base = C.confusion_wide(decided(inp.fx_pixel.where("valid"), 1.0, (1, 1, 1, 1)), ["chip_id"])
    return R.paired_stats(base, C.confusion_wide(decided(inp.fx_pixel.where("valid")), ["chip_id"]))


def af_pairs(inp):
    a = C.confusion_binary(af_pixels(inp.fx_pixel, 0.35), ["chip_id"], "fire")
    return R.paired_stats(a, C.confusion_binary(af_pixels(inp.fx_pixel, 0.30), ["chip_id"], "fire"), R.AF_CELLS)


AF30 = AF.replace(">=0.35", ">=0.30")
_BASE_VALID = Q.decided(1.0, (1, 1, 1, 1), "valid")


def _unit_sums(source: str, unit: str) -> str:
    return f"(SELECT {unit}, " + ", ".join(f"{v} AS {n}" for n, v in Q.counts().items()) + f" FROM {source} d GROUP BY {unit})"


def _rep_score(prefix: str) -> str:
    s = lambda n: f"sum({prefix}.{n})"
    sev = "+".join(f"({Q.iou(s(f'i{c}'), s(f'u{c}'))})" for c in (1, 2, 3))
    return f"(0.35*({Q.iou(s('btp'), s('bu'))})+0.30*(({sev})/3))"


_SUMMARY = f"""SELECT count(*) AS replicates, {Q.r('avg(delta)')} AS mean, {Q.r('quantile_cont(delta,0.5)')} AS median, {Q.r('stddev_samp(delta)')} AS std, {Q.r('quantile_cont(delta,0.025)')} AS low, {Q.r('quantile_cont(delta,0.975)')} AS high, {Q.r('avg(CASE WHEN delta>0 THEN 1.0 ELSE 0.0 END)')} AS share_above_zero FROM reps"""


@query(
    "g9_bootstrap_delta",
    f"""WITH ca AS {_unit_sums(_BASE_VALID, 'chip_id')}, cb AS {_unit_sums(DEC_VALID, 'chip_id')},
 ix AS (SELECT chip_id, row_number() OVER (ORDER BY md5(CAST(chip_id AS VARCHAR)), chip_id)-1 AS idx, count(*) OVER () AS n FROM ca),
 dr AS (SELECT rep, {Q.draw(42, 'rep', 'i.idx')}%n AS pick FROM ix i, range({REPS}) r(rep)),
 reps AS (SELECT rep, {_rep_score('cb')}-{_rep_score('ca')} AS delta FROM dr JOIN ix ON ix.idx=dr.pick JOIN ca USING (chip_id) JOIN cb USING (chip_id) GROUP BY rep) {_SUMMARY}""",
)
def g9_bootstrap_delta(inp):
    return rounded(R.bootstrap_delta(pairs(inp), REPS, 42))


@query(
    "g10_bootstrap_groups",
    f"""WITH un AS (SELECT concat_ws('|',m.epsg,m.x_min,m.y_min,m.x_max,m.y_max) AS grid, a.*, b.tp AS btp, b.fp AS bfp, b.fn AS bfn FROM fx_meta m JOIN (SELECT chip_id, {Q.binary('fire')} FROM {AF} q GROUP BY chip_id) a USING (chip_id) JOIN (SELECT chip_id, {Q.binary('fire')} FROM {AF30} q GROUP BY chip_id) b USING (chip_id)),
 g AS (SELECT grid, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(btp) AS btp, sum(bfp) AS bfp, sum(bfn) AS bfn FROM un GROUP BY grid),
 ix AS (SELECT *, row_number() OVER (ORDER BY md5(grid), grid)-1 AS idx, count(*) OVER () AS n FROM g), dr AS (SELECT rep, {Q.draw(42, 'rep', 'i.idx')}%n AS pick FROM ix i, range({REPS}) r(rep)),
 reps AS (SELECT rep, {Q.f1('sum(btp)', 'sum(bfp)', 'sum(bfn)')}-({Q.f1('sum(tp)', 'sum(fp)', 'sum(fn)')}) AS delta FROM dr JOIN ix ON ix.idx=dr.pick GROUP BY rep) {_SUMMARY}""".replace("sum(btp)/", "sum(btp)/").replace(
        f"{Q.f1('sum(btp)', 'sum(bfp)', 'sum(bfn)')}-", f"({Q.f1('sum(btp)', 'sum(bfp)', 'sum(bfn)')})-"
    ),
)
def g10_bootstrap_groups(inp):
    return rounded(R.bootstrap_groups(af_pairs(inp), inp.fx_meta, ["epsg", "x_min", "y_min", "x_max", "y_max"], REPS, 42, R.AF_CELLS))


_CAND = ",".join([f"(-1,{0.25}::FLOAT,{0.75}::FLOAT)", *[f"({i},{w}::FLOAT,{1 - w}::FLOAT)" for i, w in enumerate((0.25, 0.5))]])
_MIXED = f"(SELECT cand, CASE WHEN truth=1 THEN 1 ELSE 0 END AS fire, CAST(w*n1+u*t1 AS DOUBLE) AS mix FROM fx_pixel, (VALUES {_CAND}) g(cand,w,u) WHERE valid)"


@query(
    "g11_compare_af",
    f"""WITH mx AS {_MIXED}, th AS (SELECT cand, arg_max(s,(f,s)) AS th FROM (SELECT *, 2.0*tp/(np+pos) AS f FROM (SELECT cand, s, sum(t) OVER (PARTITION BY cand ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY cand ORDER BY s DESC) AS np, sum(t) OVER (PARTITION BY cand) AS pos FROM (SELECT cand, mix AS s, count(*) AS n, sum(fire) AS t FROM mx GROUP BY cand, mix) a) b) c WHERE cand>=0 GROUP BY cand UNION ALL SELECT -1, 0.4),
 sc AS (SELECT cand, th, {Q.binary('fire', '(CASE WHEN mix>=th THEN 1 ELSE 0 END)')} FROM mx JOIN th USING (cand) GROUP BY cand, th), fs AS (SELECT *, {Q.f1('tp', 'fp', 'fn')} AS f1 FROM sc)
 SELECT CAST(cand AS BIGINT) AS cand, {Q.r('th')} AS threshold, tp, fp, fn, {Q.r('f1')} AS f1, {Q.r('0.35*f1+0.38')} AS combined_score, {Q.r('f1-max(CASE WHEN cand=-1 THEN f1 END) OVER ()')} AS delta_f1 FROM fs""",
)
def g11_compare_af(inp):
    px = inp.fx_pixel.where("valid").withColumn("fire", (F.col("truth") == 1).cast("int"))
    return longs(rounded(G.compare_af(px, "n1", "t1", 0.25, 0.4, (0.25, 0.5), 0.38, "fire").drop("second_weight")))


def _half(side: str, source: str) -> str:
    h = "CAST(('0x'||substr(sha256(CAST(chip_id AS VARCHAR)),64,1))::BIGINT%2 AS BIGINT)"
    return f"(SELECT half, score AS {side}_score FROM ({Q.score_select(f'(SELECT *, {h} AS half FROM {source} d) e', 'half', rounded=False)}) f)"


@query(
    "g12_hash_halves",
    f"SELECT half, chips, {Q.r('a_score')} AS a_score, {Q.r('b_score')} AS b_score, {Q.r('b_score-a_score')} AS delta FROM {_half('a', _BASE_VALID)} a JOIN {_half('b', DEC_VALID)} b USING (half) JOIN (SELECT ('0x'||substr(sha256(CAST(chip_id AS VARCHAR)),64,1))::BIGINT%2 AS half, count(DISTINCT chip_id) AS chips FROM fx_pixel GROUP BY 1) c USING (half)",
)
def g12_hash_halves(inp):
    return longs(rounded(R.hash_halves(pairs(inp))))


_PAIR_INITIAL = (1.0, 1.3, 1.3, 1.0)
_KEPT = f"(SELECT truth, {Q.argmax(['z0', '(z1*1.3::FLOAT)', '(z2*1.3::FLOAT)', 'z3'])} AS pred FROM {tuning_source(0.0)} z) p"


@query(
    "g13_compare_pair",
    f"""WITH {tuning_ctes(tuning_source(0.5), _PAIR_INITIAL)} SELECT second_weight, m0, {Q.r('m1')} AS m1, {Q.r('m2')} AS m2, {Q.r('m3')} AS m3, {Q.r('score')} AS score
 FROM (SELECT 0.5::DOUBLE AS second_weight, 1.0::DOUBLE AS m0, m1, m2, m3, best AS score FROM s6 UNION ALL SELECT 0.0, 1.0, 1.3, 1.3, 1.0, score FROM ({Q.score_select(_KEPT, rounded=False)}) k) z""",
)
def g13_compare_pair(inp):
    rows = G.compare_pair(inp.fx_pixel.where("valid"), SECOND, TREE, _PAIR_INITIAL, (0.0, 0.5))
    flat = [(w, *[float(v) for v in m], s) for w, m, s in rows]
    return rounded(inp.spark.createDataFrame(flat, "second_weight double, m0 double, m1 double, m2 double, m3 double, score double"))




@query(
    "g14_group_split",
    """WITH t AS (SELECT chip_id, concat_ws('|',epsg,x_min,y_min) AS grp, kind, epsg FROM fx_meta), g AS (SELECT grp, count(*) AS n, min(kind) AS kind, min(epsg) AS epsg, md5('ember:'||grp) AS d FROM t GROUP BY grp),
 o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY kind, epsg ORDER BY d, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b, sum(n) OVER (PARTITION BY kind, epsg) AS al FROM g)
 SELECT chip_id, CASE WHEN (2*b+n)*100<=2*20*al THEN 'val' ELSE 'train' END AS split FROM t JOIN o USING (grp)""",
)
def g14_group_split(inp):
    return R.group_split(inp.fx_meta.drop("split"), ["epsg", "x_min", "y_min"], ["kind", "epsg"])


@query("g15_compare_smoothing")
def g15_compare_smoothing(inp):
    return rounded(V.compare_smoothing(inp.fx_pixel, SECOND, TREE, RECIPE_WEIGHT, RECIPE, HEIGHT, WIDTH, replicates=50))


_SAMPLED = f"(SELECT chip_id, truth AS y, rw, cl FROM (SELECT *, row_number() OVER (PARTITION BY chip_id, truth ORDER BY {Q.draw(5, 'chip_id', 'truth', 'rw', 'cl')}, rw, cl) AS k FROM fx_pixel WHERE valid) q WHERE k<=20)"


def sampled(inp):
    return S.sample_pixels(inp.fx_pixel.withColumnRenamed("truth", "y"), 20, 5)


@query("h1_sample_pixels", f"SELECT * FROM {_SAMPLED} s")
def h1_sample_pixels(inp):
    return sampled(inp).select("chip_id", "y", "rw", "cl")


@query("h1_sample_info", f"SELECT y, population, selected, {Q.r('population*1.0/selected')} AS weight FROM (SELECT truth AS y, count(*) AS population FROM fx_pixel WHERE valid GROUP BY truth) a JOIN (SELECT y, count(*) AS selected FROM {_SAMPLED} s GROUP BY y) b USING (y)")
def h1_sample_info(inp):
    return rounded(S.sample_info(inp.fx_pixel.withColumnRenamed("truth", "y"), sampled(inp)))


NAMES = ["I2", "I3", "I5", "dem", "t2m"]


def training(inp):
    """Band pixels with labels that depend on the bands."""
    px = inp.fx_af.select("chip_id", "rw", "cl", *[F.col(n).cast("double").alias(n) for n in NAMES])
    y = (F.col("I5") > 300).cast("int") + 2 * (F.col("dem") > 1500).cast("int")
    return px.withColumn("y4", y).withColumn("valid", F.lit(True))


def _per_class(df, prefix, classes):
    """Aggregate view of a scored table: classes, counts and score sums."""
    total = sum((F.col(f"{prefix}{c}").cast("double") for c in range(classes)), F.lit(0.0))
    return df.groupBy("y").agg(F.count(F.lit(1)).alias("pixels"), F.max(F.abs(total - 1)).alias("worst_sum"), F.avg(f"{prefix}1").alias("mean_1"))


@query("h2_fit_boosted_af")
def h2_fit_boosted_af(inp):
    px = training(inp).withColumn("y", F.col("y4") % 2).withColumn("held_out", F.col("chip_id") % 5 == 0)
    sample = S.sample_pixels(px, 40, 3)
    model = M.fit_boosted(sample, NAMES, "af", rounds=4, depth=3, validation="held_out")
    return _per_class(M.score(px, model, NAMES, 2), "t", 2)


@query("h2_fit_boosted_bs")
def h2_fit_boosted_bs(inp):
    px = training(inp).withColumn("y", F.col("y4"))
    info = S.sample_info(px, S.sample_pixels(px, 20, 3))
    sample = S.with_prior_weight(S.sample_pixels(px, 20, 3), info)
    model = M.fit_boosted(sample, NAMES, "bs", rounds=2, depth=3, weight="weight")
    return _per_class(M.score(px, model, NAMES, 4), "t", 4)


@query("h3_fit_forest")
def h3_fit_forest(inp):
    px = training(inp).withColumn("y", F.col("y4"))
    model = M.fit_forest(S.sample_pixels(px, 20, 3), NAMES, trees=5, depth=4)
    return _per_class(M.score(px, model, NAMES, 4, "f"), "f", 4)


@query("h4_fit_mlp")
def h4_fit_mlp(inp):
    px = training(inp).withColumn("y", F.col("y4"))
    stats = C.fit_normaliser(px, NAMES, F.lit(True))
    scaled = P.standardise(px, NAMES, stats)
    model = M.fit_mlp(S.sample_pixels(scaled, 20, 3), NAMES, 4, hidden=(8,), rounds=10)
    return _per_class(M.score(scaled, model, NAMES, 4, "n"), "n", 4)


def linear_scorer(x):
    """Softmax of two fixed linear scores (stands for any injected scorer)."""
    import numpy as np

    z = np.stack([np.zeros(len(x), dtype="float64"), (x[:, 2].astype("float64") - 300.0) / 10.0], axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@query("h5_score_with", f"SELECT chip_id, rw, cl, {Q.r('1/(1+exp((CAST(I5 AS DOUBLE)-300)/10))', 5)} AS n0, {Q.r('1/(1+exp(-(CAST(I5 AS DOUBLE)-300)/10))', 5)} AS n1 FROM fx_af")
def h5_score_with(inp):
    scored = M.score_with(inp.fx_af.select("chip_id", "rw", "cl", "I2", "I3", "I5"), linear_scorer, ["I2", "I3", "I5"], 2)
    return rounded(scored.select("chip_id", "rw", "cl", "n0", "n1"), 5)


@query("u2_scorer_udf", f"SELECT chip_id, {Q.r('avg(1/(1+exp(-(CAST(I5 AS DOUBLE)-300)/10)))', 4)} AS mean_1, count(*) AS pixels FROM fx_af GROUP BY chip_id")
def u2_scorer_udf(inp):
    scored = M.score_with(inp.fx_af.select("chip_id", "I2", "I3", "I5"), linear_scorer, ["I2", "I3", "I5"], 2)
    return rounded(scored.groupBy("chip_id").agg(F.avg(F.col("n1").cast("double")).alias("mean_1"), F.count(F.lit(1)).alias("pixels")), 4)


@query("h6_blend", "SELECT chip_id, rw, cl, " + ", ".join(f"{Q.r(Q.blend(RECIPE_WEIGHT, c))} AS b{c}" for c in range(4)) + " FROM fx_pixel")
def h6_blend(inp):
    mixed = D.blend([F.col(c) for c in SECOND], [F.col(c) for c in TREE], RECIPE_WEIGHT)
    return rounded(inp.fx_pixel.select("chip_id", "rw", "cl", *[m.alias(f"b{i}") for i, m in enumerate(mixed)]))


@query("h7_decide_af", f"SELECT chip_id, rw, cl, CAST(pred AS BIGINT) AS pred FROM {AF} a")
def h7_decide_af(inp):
    return longs(af_pixels(inp.fx_pixel).select("chip_id", "rw", "cl", "pred"))


@query("h8_decide_bs", f"SELECT chip_id, rw, cl, CAST(pred AS BIGINT) AS pred FROM {Q.decided(RECIPE_WEIGHT, RECIPE)} d")
def h8_decide_bs(inp):
    return longs(decided(inp.fx_pixel).select("chip_id", "rw", "cl", "pred"))


@query("h9_decide_dnbr", "SELECT chip_id, rw, cl, CAST(CASE WHEN n2>=0.4::FLOAT THEN 3 WHEN n2>=0.2::FLOAT THEN 2 WHEN n2>=0.1::FLOAT THEN 1 ELSE 0 END AS BIGINT) AS cls FROM fx_pixel")
def h9_decide_dnbr(inp):
    return longs(inp.fx_pixel.select("chip_id", "rw", "cl", D.decide_dnbr(F.col("n2"), (0.1, 0.2, 0.4)).alias("cls")))


@query("h10_blend_equal", "SELECT chip_id, rw, cl, " + ", ".join(f"{Q.r(f'(t{c}+n{c})*0.5::FLOAT')} AS b{c}" for c in range(4)) + " FROM fx_pixel")
def h10_blend_equal(inp):
    from ember.operators.joins import join_scores

    both = join_scores(inp.fx_pixel.select("chip_id", "rw", "cl", *TREE), inp.fx_pixel.select("chip_id", "rw", "cl", *SECOND))
    mixed = D.blend_equal([F.col(c) for c in TREE], [F.col(c) for c in SECOND])
    return rounded(both.select("chip_id", "rw", "cl", *[m.alias(f"b{i}") for i, m in enumerate(mixed)]))


_SPEC = "SELECT o_orderkey AS id, CASE o_custkey%5 WHEN 0 THEN 'tree' WHEN 1 THEN 'cnn' WHEN 2 THEN 'ensemble_cnn_0.25' WHEN 3 THEN 'ensemble_cnn_1' ELSE 'ensemble_cnn_2' END AS selected FROM orders"


@query("h11_recipes", f"SELECT id, selected, {Q.r('w')} AS second_weight, {Q.r('1-w')} AS tree_weight, CASE WHEN selected IN ('ensemble_cnn_0.25','ensemble_cnn_1') THEN 'ensemble' ELSE selected END AS backend FROM (SELECT *, CASE selected WHEN 'tree' THEN 0.0 WHEN 'cnn' THEN 1.0 WHEN 'ensemble_cnn_0.25' THEN 0.25 WHEN 'ensemble_cnn_1' THEN 1.0 END AS w FROM ({_SPEC}) q) z")
def h11_recipes(inp):
    return rounded(M.recipes(inp.spark.sql(_SPEC.replace("FROM orders", "FROM {o}"), o=inp.orders)))


def _metric_rows(source: str) -> str:
    return f"(UNPIVOT ({Q.score_select(source + ' d', rounded=False)}) ON IoU_burn, IoU_1, IoU_2, IoU_3, mIoU_sev, score INTO NAME metric VALUE value)"


@query("h12_replay", f"SELECT metric, {Q.r('value')} AS value FROM {_metric_rows(DEC_VALID)} m")
def h12_replay(inp):
    recorded = V.score_long(C.score_wide(C.confusion_wide(decided(inp.fx_pixel.where("valid")), []), []))
    metrics, _ = V.replay(inp.fx_pixel, SECOND, TREE, RECIPE_WEIGHT, RECIPE, recorded)
    return rounded(metrics)


@query(
    "h12_replay_report",
    f"""WITH a AS {_metric_rows(DEC_VALID)}, r AS (SELECT metric, value FROM {_metric_rows(_BASE_VALID)} m UNION ALL SELECT 'F1_af', 0.5)
 SELECT metric, {Q.r('a.value')} AS actual, {Q.r('r.value')} AS expected, coalesce(abs(a.value-r.value)<=0.005,false) AS reproduced FROM a FULL JOIN r USING (metric)""",
)
def h12_replay_report(inp):
    """A recipe replayed against a stored summary: that of the unweighted tree scores, with a metric the replay does not give."""
    stored = scratch(inp.spark, "summary")
    base = V.score_long(C.score_wide(C.confusion_wide(decided(inp.fx_pixel.where("valid"), 1.0, (1, 1, 1, 1)), []), []))
    base.union(inp.spark.sql("SELECT 'F1_af', 0.5D")).write.json(stored)
    recorded = inp.spark.read.schema("metric string, value double").json(stored)
    return rounded(V.replay_report(inp.fx_pixel, SECOND, TREE, RECIPE_WEIGHT, RECIPE, recorded))


_CSPEC = "SELECT o_orderkey AS id, CASE o_custkey%4 WHEN 0 THEN 'a=tree=/m/a' WHEN 1 THEN 'b=cnn=x=y' WHEN 2 THEN '=tree=/m' ELSE 'c=svm=/m' END AS spec FROM orders"


@query("u3_candidate_spec", f"SELECT id, spec, CASE spec WHEN 'a=tree=/m/a' THEN 'a' WHEN 'b=cnn=x=y' THEN 'b' END AS name, CASE spec WHEN 'a=tree=/m/a' THEN 'tree' WHEN 'b=cnn=x=y' THEN 'cnn' END AS kind, CASE spec WHEN 'a=tree=/m/a' THEN '/m/a' WHEN 'b=cnn=x=y' THEN 'x=y' END AS path FROM ({_CSPEC}) q")
def u3_candidate_spec(inp):
    return M.candidate_spec(inp.spark.sql(_CSPEC.replace("FROM orders", "FROM {o}"), o=inp.orders))


@query("u4_grouped_arrow", f"SELECT half, {Q.r('score')} AS score FROM (SELECT half, b_score AS score FROM {_half('b', DEC_VALID)} z) q")
def u4_grouped_arrow(inp):
    """Score from counts in a grouped Arrow aggregate over 16 rows per group."""
    px = decided(inp.fx_pixel.where("valid")).withColumn("half", R.half_of(F.col("chip_id")).cast("bigint"))
    counts = C.confusion(px, ["half"])
    return rounded(counts.groupBy("half").agg(C.grouped_burn_score().alias("score")))
