"""Threshold, multiplier and weight searches on aggregated statistics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import decision as D
from ember.functions import scores as S
from ember.operators.confusion import CELLS, confusion, score_confusion, score_wide, widen
from ember.operators.joins import with_candidates
from ember.session import cut_lineage

# The candidate grids.
DNBR_EDGES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
BLEND_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
COARSE_STEPS = (0.7, 1.0, 1.3)
TUNING_STEPS = (0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0)
SECOND_WEIGHTS = (0.0, 0.15, 0.25, 0.35, 0.5, 1.0)
FIXED_MULTIPLIERS = (
    (1.0, 1.0, 1.0, 1.0), (1.0, 0.7, 0.7, 0.7), (1.0, 1.3, 1.3, 1.3), (1.0, 1.6, 1.6, 1.3), (1.0, 1.0, 1.0, 0.7),
    (1.0, 1.3, 1.3, 0.7), (1.0, 3.0, 3.0, 0.8), (1.0, 2.2, 2.2, 1.3), (1.0, 2.0, 2.2, 1.3), (1.0, 2.4, 2.2, 1.3),
    (1.0, 2.2, 2.0, 1.3), (1.0, 2.2, 2.4, 1.3), (1.0, 2.2, 2.2, 1.1), (1.0, 2.2, 2.2, 1.5),
)
LOW_PRIOR_MULTIPLIERS = (
    (1.0, 0.4, 0.4, 0.2), (1.0, 0.4, 0.5, 0.3), (1.0, 0.6, 0.6, 0.4), (1.0, 0.3, 0.3, 0.2),
    (1.0, 0.5, 0.5, 0.3), (1.0, 0.7, 0.7, 0.4), (1.0, 0.7, 0.7, 0.7), (1.0, 1.0, 1.0, 1.0),
)
ABOVE_ONE = 1.0000000000000002  # threshold that predicts nothing
BINS_PER_E = 512


def best_threshold(px: DataFrame, score: str, truth: str = "truth", keys: Sequence[str] = ()) -> DataFrame:
    """Exact F1-maximising float32 threshold per key; ties take the highest.

    Rows shrink to one per distinct score, then cumulative counts are built in
    two levels: totals of logarithmic score bins (at most ~54 000 for float32
    scores in [0, 1]) and running sums inside one bin (at most ~33 000 distinct
    floats).  Both windows are bounded whatever the number of pixels.
    """
    keys = list(keys)
    rows = px.select(*keys, F.col(score).cast("float").alias("_s"), (F.col(truth) > 0).cast("bigint").alias("_t"))
    distinct = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_tp"))
    s = F.col("_s").cast("double")
    level = F.floor(F.log(F.abs(s)) * BINS_PER_E) + 100_000
    binned = distinct.withColumn("_bin", F.when(s > 0, level).when(s < 0, -level).otherwise(0))

    by_bin = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"), F.sum("_tp").alias("_bt"))
    above = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_bn").over(by_bin), F.lit(0)).alias("_n_above"),
        F.coalesce(F.sum("_bt").over(by_bin), F.lit(0)).alias("_t_above"),
        F.sum("_bt").over(whole).alias("_pos"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        binned.join(above, [*keys, "_bin"])
        .withColumn("_pred", F.sum("_n").over(inside) + F.col("_n_above"))
        .withColumn("_hit", F.sum("_tp").over(inside) + F.col("_t_above"))
    )
    value = F.try_divide(2.0 * F.col("_hit"), F.col("_pred") + F.col("_pos"))
    best = curve.groupBy(*keys).agg(
        F.max(F.struct(value.alias("f1"), F.col("_s").cast("double").alias("threshold"))).alias("_b"), F.max("_pos").alias("positives")
    )
    none = F.coalesce(F.col("positives"), F.lit(0)) == 0
    return best.select(
        *keys,
        F.when(none, F.lit(ABOVE_ONE)).otherwise(F.col("_b.threshold")).alias("threshold"),
        F.when(none, F.lit(1.0)).otherwise(F.col("_b.f1")).alias("f1"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
    )


def multiplier_grid(steps: Sequence[float] = COARSE_STEPS) -> list[dict]:
    return [
        {"cand": i, "m1": a, "m2": b, "m3": c} for i, (a, b, c) in enumerate(itertools.product(steps, repeat=3))
    ]


def score_candidates(px: DataFrame, scores: Sequence[str], grid: Sequence[dict], keys: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """Burn scores of every multiplier candidate (``cand, m1, m2, m3``).

    Each pixel is unfolded in place and collapses again map-side into
    ``candidates x 16`` counts, so the exchange does not grow with pixels.
    """
    wide = with_candidates(px.select(*keys, truth, *scores), grid)
    names = [k for k in grid[0]]
    mult = [1.0] + [F.col(f"m{c}") for c in (1, 2, 3)]
    decided = wide.withColumn("pred", D.decide_bs([F.col(s) for s in scores], mult))
    return score_confusion(confusion(decided, [*keys, *names], truth), [*keys, *names])


def score_steps(px: DataFrame, scores: Sequence[str], weights: Sequence[float], c: int, steps: Sequence[float], truth: str = "truth") -> DataFrame:
    """Burn scores of every multiplier of class ``c``, the others held: ``cand, step, ..., score``.

    A pixel is read once: it is class ``c`` at the steps where its product beats
    the best other class, and that other class elsewhere.  Pixels shrink map-side
    to counts per (truth, other class, steps won); for scores that are not
    negative the steps won start at one flip point, so there are at most
    ``16 * (steps + 1)`` groups, whatever the number of pixels.  The steps are
    unfolded on these counts only.  At most 62 steps, one bit each.
    """
    if not 1 <= c <= 3 or not 0 < len(steps) <= 62:
        raise ValueError("need a class from 1 to 3 and 1 to 62 steps")
    product = [F.col(s).cast("float") * F.lit(float(w)).cast("float") for s, w in zip(scores, weights)]
    others = F.array(*[F.lit(None).cast("float") if i == c else p for i, p in enumerate(product)])
    before = F.array_max(F.array(*product[:c]))
    after = F.array_max(F.array(*product[c + 1:])) if c < 3 else F.lit(None).cast("float")
    won = F.lit(0).cast("bigint")
    for i, step in enumerate(steps):
        own = F.col(scores[c]).cast("float") * F.lit(float(step)).cast("float")
        # earlier classes win ties, later ones lose them
        wins = F.coalesce(own > F.col("_before"), own.isNotNull()) & F.coalesce(own >= F.col("_after"), own.isNotNull())
        won = won + F.when(wins, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    rival = (F.array_position(others, F.array_max(others)) - 1).cast("int")
    read = px.select(F.col(truth).cast("int").alias("truth"), scores[c], rival.alias("_rival"), before.alias("_before"), after.alias("_after"))
    counts = read.groupBy("truth", "_rival", won.alias("_won")).agg(F.count(F.lit(1)).alias("n"))
    wide = with_candidates(counts, [{"cand": i, "step": float(s)} for i, s in enumerate(steps)])
    taken = F.expr("shiftright(_won, cand)").bitwiseAND(F.lit(1)) == 1
    long = wide.withColumn("pred", F.when(taken, F.lit(c)).otherwise(F.col("_rival")))
    return score_confusion(long, ["cand", "step"])


def pick_first_best(candidates: DataFrame, score: str = "score", order: str = "cand", keys: Sequence[str] = ()) -> DataFrame:
    """Highest score, earliest declared candidate on ties; keeps all columns."""
    others = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(order))).alias("_b")
    )
    return best.select(*keys, "_b.*")


def grid_multipliers(px: DataFrame, scores: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """27-point multiplier grid; the first strict maximum wins."""
    return pick_first_best(score_candidates(px, scores, multiplier_grid(), keys), keys=keys)


def dnbr_triples(edges: Sequence[float] = DNBR_EDGES) -> list[dict]:
    return [
        {"cand": i, "a": a, "b": b, "c": c} for i, (a, b, c) in enumerate(itertools.combinations(range(len(edges)), 3))
    ]


def grid_dnbr(histogram: DataFrame, edges: Sequence[float] = DNBR_EDGES) -> DataFrame:
    """All rising threshold triples scored from the 4 x 12 histogram alone."""
    wide = with_candidates(histogram, dnbr_triples(edges))
    pred = F.when(F.col("bin") <= F.col("a"), 0).when(F.col("bin") <= F.col("b"), 1).when(F.col("bin") <= F.col("c"), 2).otherwise(3)
    names = ["cand", "a", "b", "c"]
    scored = score_wide(widen(wide.withColumn("pred", pred), names), names)
    edge = F.array(*[F.lit(float(e)) for e in edges])
    return scored.select("cand", *[edge[F.col(k)].alias(f"t{i}") for i, k in enumerate("abc", 1)], "IoU_burn", "IoU_1", "IoU_2", "IoU_3", "mIoU_sev", "score")


def tune_multipliers(px: DataFrame, scores: Sequence[str], initial: Sequence[float] = (1.0, 1.0, 1.0, 1.0), steps: Sequence[float] = TUNING_STEPS, truth: str = "truth", passes: int = 2):
    """Coordinate search over class multipliers.

    Returns ``(final multipliers, score, log rows)``.  Every (pass, class) is
    one Spark job that scores all steps from one read of each pixel
    (:func:`score_steps`); the driver only replays the acceptance rule on those
    eight rows.
    """
    weights = [float(v) for v in initial]
    if len(weights) != 4 or weights[0] != 1.0 or any(not (0 < v < float("inf")) for v in weights):
        raise ValueError("need four positive finite multipliers, the first equal to 1")

    start = {"cand": 0, "m1": weights[1], "m2": weights[2], "m3": weights[3]}
    best = score_candidates(px, scores, [start], truth=truth).first()["score"]
    log = []
    for number in range(1, passes + 1):
        changed = False
        for c in (1, 2, 3):
            origin = weights[c]
            found = {r["cand"]: r["score"] for r in score_steps(px, scores, weights, c, steps, truth).select("cand", "score").collect()}
            for step, value in zip(steps, [found[i] for i in range(len(steps))]):
                if value > best + 1e-12:
                    log.append({"pass_no": number, "class_id": c, "from_value": origin, "to_value": float(step), "score": value})
                    weights[c], best, origin, changed = float(step), value, float(step), True
        if not changed:
            break
    return weights, best, log


def blend_columns(second: Sequence[str], tree: Sequence[str], tree_weight) -> list:
    return D.blend([F.col(c) for c in second], [F.col(c) for c in tree], tree_weight)


def sweep_weights_af(px: DataFrame, second: str, tree: str, weights: Sequence[float] = BLEND_WEIGHTS, truth: str = "truth") -> DataFrame:
    """Best exact threshold for each second-scorer weight."""
    grid = [{"cand": i, "second_weight": w} for i, w in enumerate(weights)]
    wide = with_candidates(px.select(truth, second, tree), grid)
    mixed = blend_columns([second], [tree], F.lit(1.0) - F.col("second_weight"))[0]
    return best_threshold(wide.withColumn("_mix", mixed), "_mix", truth, ["cand", "second_weight"])


def sweep_weights_bs(px: DataFrame, second: Sequence[str], tree: Sequence[str], weights: Sequence[float] = BLEND_WEIGHTS, multipliers: Sequence[Sequence[float]] | None = None, truth: str = "truth") -> DataFrame:
    """Every (weight, multipliers) candidate, numbered in declared order.

    Without ``multipliers`` the 27-point grid is used for every weight.
    """
    sets = list(multipliers) if multipliers is not None else [(1.0, *m) for m in itertools.product(COARSE_STEPS, repeat=3)]
    weight_grid = [{"wi": i, "second_weight": float(w)} for i, w in enumerate(weights)]
    mixed = with_candidates(px.select(truth, *second, *tree), weight_grid)
    blended = mixed.select(
        truth,
        "wi",
        "second_weight",
        *[c.alias(f"_b{i}") for i, c in enumerate(blend_columns(second, tree, F.lit(1.0) - F.col("second_weight")))],
    )
    grid = [{"mi": i, "m1": float(m[1]), "m2": float(m[2]), "m3": float(m[3])} for i, m in enumerate(sets)]
    keys = ["wi", "second_weight"]
    scored = score_candidates(blended, [f"_b{i}" for i in range(4)], grid, keys, truth)
    return scored.withColumn("cand", F.col("wi") * len(sets) + F.col("mi"))


def compare_af(px: DataFrame, second: str, tree: str, frozen_weight: float, frozen_threshold: float, weights: Sequence[float], fixed_bs: float, truth: str = "truth") -> DataFrame:
    """Frozen blend and threshold against re-optimised ones, with deltas.

    ``weights`` are second-scorer weights; the frozen entry is ``cand = -1``.
    """
    from ember.operators.confusion import confusion_binary

    best = sweep_weights_af(px, second, tree, weights, truth)
    frozen = px.sparkSession.range(1).select(
        F.lit(-1).alias("cand"), F.lit(float(frozen_weight)).alias("second_weight"), F.lit(float(frozen_threshold)).alias("threshold")
    )
    recipes = best.select("cand", "second_weight", "threshold").unionByName(frozen)
    grid = [{"cand": i, "second_weight": float(w)} for i, w in [(-1, frozen_weight), *enumerate(weights)]]
    wide = with_candidates(px.select(truth, second, tree), grid)
    mixed = wide.select("cand", truth, blend_columns([second], [tree], F.lit(1.0) - F.col("second_weight"))[0].alias("_mix"))
    # recipes: one row per candidate weight, so the broadcast side is bounded by the grid
    decided = mixed.join(F.broadcast(recipes), "cand").withColumn("pred", D.decide_af(F.col("_mix"), F.col("threshold")))
    counts = confusion_binary(decided, ["cand", "second_weight", "threshold"], truth)
    f1 = S.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = counts.withColumn("f1", f1)
    base = F.max(F.when(F.col("cand") == -1, F.col("f1"))).over(Window.partitionBy())
    return scored.withColumn("combined_score", F.lit(S.W_AF) * F.col("f1") + F.lit(float(fixed_bs))).withColumn("delta_f1", F.col("f1") - base)


def compare_pair(px: DataFrame, second: Sequence[str], tree: Sequence[str], initial: Sequence[float], weights: Sequence[float] = (0.0, 0.25, 0.5), truth: str = "truth"):
    """Tune multipliers for each blend weight; weight 0 keeps the initial ones.

    Returns a list of ``(second_weight, multipliers, score)``.  A blend is
    written once per weight and its tuning jobs read that, not the sources.
    """
    out = []
    for w in weights:
        names = [f"_b{i}" for i in range(4)]
        blended = px.select(truth, *[c.alias(n) for n, c in zip(names, blend_columns(second, tree, 1.0 - w))])
        if w == 0.0:
            grid = [{"cand": 0, "m1": float(initial[1]), "m2": float(initial[2]), "m3": float(initial[3])}]
            score = score_candidates(blended, names, grid, truth=truth).first()["score"]
            out.append((w, list(initial), score))
            continue
        multipliers, score, _ = tune_multipliers(cut_lineage(blended), names, initial, truth=truth)
        out.append((w, multipliers, score))
    return out
