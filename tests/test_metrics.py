from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.functions import decision as D
from ember.functions import scores as S
from ember.operators import confusion as C
from ember.operators import contracts as K
from ember.operators import search as G


def pairs(pixels, truth, pred):
    return pixels(truth, "truth", {"pred": pred})


def random_masks(seed, classes, shapes):
    rng = np.random.default_rng(seed)
    return {f"c{i}": rng.integers(0, classes, shape).tolist() for i, shape in enumerate(shapes)}


def flat(masks):
    return np.concatenate([np.ravel(masks[k]) for k in sorted(masks)])


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_counts_pool_all_chips(pixels, seed):
    shapes = [(1, 5), (4, 3), (2, 7)]
    truth, pred = random_masks(seed, 2, shapes), random_masks(seed + 50, 2, shapes)
    row = C.precision_recall(C.confusion_binary(pairs(pixels, truth, pred))).first()
    t, p = flat(truth).astype(bool), flat(pred).astype(bool)
    want = int((t & p).sum()), int((~t & p).sum()), int((t & ~p).sum())
    assert (row.tp, row.fp, row.fn) == want
    assert row.f1 == pytest.approx(2 * want[0] / (2 * want[0] + want[1] + want[2]))


@pytest.mark.parametrize("seed", [21, 22])
def test_class_overlap_by_brute_force(pixels, seed):
    shapes = [(3, 4), (2, 6)]
    truth, pred = random_masks(seed, 4, shapes), random_masks(seed + 50, 4, shapes)
    row = C.score_confusion(C.confusion(pairs(pixels, truth, pred))).first()
    t, p = flat(truth), flat(pred)
    for name, a, b in [("IoU_burn", t > 0, p > 0), *[(f"IoU_{c}", t == c, p == c) for c in (1, 2, 3)]]:
        assert row[name] == pytest.approx((a & b).sum() / (a | b).sum())


def test_absent_classes_count_as_perfect(pixels):
    none = {"only": np.zeros((4, 5), int).tolist()}
    row = C.competition_score(pairs(pixels, none, none), pairs(pixels, none, none)).first()
    assert {row[c] for c in ("F1_af", "IoU_burn", "IoU_1", "IoU_2", "IoU_3", "mIoU_sev", "Score")} == {1.0}
    some = {"only": [[2, 2, 0], [0, 2, 2]]}
    row = C.score_confusion(C.confusion(pairs(pixels, some, some))).first()
    assert (row.IoU_1, row.IoU_2, row.IoU_3) == (1.0, 1.0, 1.0)


# Published confusion matrices, counts and the scores they give.
def test_known_confusion_scores(spark):
    cm = [[9912186, 385120, 243209, 69681], [66892, 395306, 13277, 210], [9891, 10857, 429098, 7655], [4007, 0, 11098, 237993]]
    long = spark.createDataFrame([(t, p, cm[t][p]) for t in range(4) for p in range(4)], "truth int, pred int, n bigint")
    row = C.score_confusion(long).first()
    assert row.IoU_burn == pytest.approx(0.586688701444679, abs=1e-15)
    assert row.score == pytest.approx(0.38184949737834106, abs=1e-15)


def test_known_f1(spark):
    f1 = spark.range(1).select(S.f1(F.lit(1523), F.lit(144), F.lit(87)).alias("f")).first().f
    assert f1 == pytest.approx(0.9295086969789441, abs=1e-15)


def test_known_dnbr_histogram(spark):
    hist = [
        [7948418, 1074007, 477546, 318078, 229033, 166779, 229297, 104088, 29271, 10824, 2314, 20541],
        [4364, 172386, 171071, 98939, 19964, 5235, 2873, 585, 163, 53, 43, 9],
        [36, 252, 1549, 37287, 105941, 115944, 177801, 13458, 4111, 1000, 111, 11],
        [1, 3, 6, 12, 86, 316, 30001, 118100, 69099, 21570, 7743, 6161],
    ]
    long = spark.createDataFrame([(t, b, hist[t][b]) for t in range(4) for b in range(12)], "truth int, bin int, n bigint")
    scored = G.grid_dnbr(long)
    assert scored.count() == 165
    best = G.pick_first_best(scored).first()
    assert (best.t1, best.t2, best.t3) == (0.1, 0.2, 0.4)
    assert best.score == pytest.approx(0.23361520336639158, abs=1e-14)
    assert best.IoU_burn == pytest.approx(0.3638147044669266, abs=1e-14)


def test_label_255_is_a_violation(pixels):
    px = pairs(pixels, {"a": [[255, 1]]}, {"a": [[0, 1]]})
    assert K.check_classes(px, [0, 1]).count() == 1


def numpy_threshold(score, truth):
    pos = truth.sum()
    best = (-1.0, None)
    for t in sorted(set(score.tolist()), reverse=True):
        pred = score >= np.float32(t)
        f = 2 * (pred & truth).sum() / (pred.sum() + pos)
        if f > best[0]:
            best = (f, t)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_threshold_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    score = np.round(rng.random(400), 2).astype(np.float32) ** 3
    truth = rng.random(400) < score
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, truth)], "s double, truth int")
    row = G.best_threshold(df, "s").first()
    f, t = numpy_threshold(score, truth)
    assert row.f1 == pytest.approx(f) and row.threshold == pytest.approx(t)


def test_threshold_edge_cases(spark):
    same = spark.createDataFrame([(0.1, 1)] * 4, "s double, truth int")
    row = G.best_threshold(same, "s").first()
    assert row.f1 == 1.0 and row.threshold == pytest.approx(np.float32(0.1))
    none = spark.createDataFrame([(0.1, 0), (0.9, 0)], "s double, truth int")
    row = G.best_threshold(none, "s").first()
    assert row.threshold > 1.0 and row.f1 == 1.0


def test_blend_then_multiply(spark):
    df = spark.createDataFrame([(0.0, 0.8, 0.2, 0.0, 0.0, 0.2, 0.8, 0.0)], "n0 float,n1 float,n2 float,n3 float,t0 float,t1 float,t2 float,t3 float")
    mixed = D.blend([F.col(f"n{i}") for i in range(4)], [F.col(f"t{i}") for i in range(4)], 0.25)
    row = df.select(D.decide_bs(mixed, (1, 1, 2, 1)).alias("c"), mixed[1].alias("b1"), mixed[2].alias("b2")).first()
    assert row.c == 2 and row.b1 == pytest.approx(0.65) and row.b2 == pytest.approx(0.35)


def test_first_maximum_wins(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (0.1, 0.5, 0.5, 0.0)], "a float,b float,c float,d float")
    got = [r.c for r in df.select(D.decide_bs([F.col(x) for x in "abcd"], (1, 1, 1, 1)).alias("c")).collect()]
    assert got == [0, 1]


def brute_score(p, truth, m):
    pred = (p * np.asarray(m, dtype=np.float32)).argmax(1)
    cm = np.bincount(truth * 4 + pred, minlength=16).reshape(4, 4)
    union = cm[1:].sum() + cm[0, 1:].sum()
    burn = 1.0 if union == 0 else cm[1:, 1:].sum() / union
    sev = []
    for c in (1, 2, 3):
        u = cm[c].sum() + cm[:, c].sum() - cm[c, c]
        sev.append(1.0 if u == 0 else cm[c, c] / u)
    return 0.35 * burn + 0.30 * sum(sev) / 3


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 4, 300)
    p = rng.random((300, 4)).astype(np.float32)
    p[:, 0] += 0.5
    p[np.arange(300), truth] += 0.4
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(truth, p)], "truth int, t0 float, t1 float, t2 float, t3 float").cache()
    df.count()
    return df, p, truth


def test_tuning_replays_the_coordinate_search(scored):
    df, p, truth = scored
    weights, best, log = [1.0] * 4, brute_score(p, truth, [1] * 4), []
    for _ in range(2):
        changed = False
        for c, step in product((1, 2, 3), G.TUNING_STEPS):
            trial = [*weights[:c], step, *weights[c + 1:]]
            value = brute_score(p, truth, trial)
            if value > best + 1e-12:
                weights, best, changed = trial, value, True
                log.append((c, step))
        if not changed:
            break
    got, score, rows = G.tune_multipliers(df, ["t0", "t1", "t2", "t3"])
    assert got == weights and score == pytest.approx(best, abs=1e-12)
    assert [(r["class_id"], r["to_value"]) for r in rows] == log and log


def test_steps_of_a_class_equal_scoring_each_candidate(spark):
    rng = np.random.default_rng(5)
    values = rng.choice([0.0, 0.1, 0.25, 0.5, -0.5, float("nan")], (400, 4), p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.1])
    rows = [(int(t), *[None if rng.random() < 0.05 else float(v) for v in r]) for t, r in zip(rng.integers(0, 4, 400), values)]
    df = spark.createDataFrame(rows, "truth int, t0 float, t1 float, t2 float, t3 float")
    names, weights, steps = ["t0", "t1", "t2", "t3"], [1.0, 0.4, 2.0, 1.0], (2.0, 0.4, 1.0, 5.0)
    for c in (1, 2, 3):
        grid = [{"cand": i, **{f"m{j}": s if j == c else weights[j] for j in (1, 2, 3)}} for i, s in enumerate(steps)]
        want = {r.cand: r.score for r in G.score_candidates(df, names, grid).collect()}
        got = {r.cand: r.score for r in G.score_steps(df, names, weights, c, steps).collect()}
        assert got == want and len(got) == 4
    with pytest.raises(ValueError):
        G.score_steps(df, names, weights, 0, steps)


def test_grid_first_strict_maximum(scored):
    df, p, truth = scored
    values = [brute_score(p, truth, (1.0, *m)) for m in product(G.COARSE_STEPS, repeat=3)]
    row = G.grid_multipliers(df, ["t0", "t1", "t2", "t3"]).first()
    assert row.cand == int(np.argmax(values)) and row.score == pytest.approx(max(values))


def test_histogram_bins_are_left_closed(spark):
    df = spark.createDataFrame([(0.05, 0), (0.1, 0), (0.04, 1), (0.9, 2)], "s float, truth int")
    got = {(r.truth, r.bin) for r in C.score_histogram(df, "s", G.DNBR_EDGES).collect()}
    edges = np.asarray(G.DNBR_EDGES, np.float32)
    want = {(t, int(np.digitize(np.float32(s), edges))) for s, t in [(0.05, 0), (0.1, 0), (0.04, 1), (0.9, 2)]}
    assert got == want
