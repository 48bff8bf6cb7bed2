"""Replaying recipes and comparing candidates on validation pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.functions import decision as D
from ember.operators.confusion import CELLS, confusion_wide, score_wide
from ember.operators.contracts import check_metrics
from ember.operators.focal import smooth_scores
from ember.operators.resample import bootstrap_delta, hash_halves, paired_stats
from ember.session import cut_lineage


def score_long(scored: DataFrame, names: Sequence[str] = ("IoU_burn", "IoU_1", "IoU_2", "IoU_3", "mIoU_sev", "score")) -> DataFrame:
    """One ``(metric, value)`` row per score."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return scored.select(F.inline(rows))


def replay(px: DataFrame, second: Sequence[str], tree: Sequence[str], tree_weight: float, multipliers: Sequence[float], recorded: DataFrame, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Metrics of a stored recipe and the recorded ones it fails to reproduce."""
    mixed = D.blend([F.col(c) for c in second], [F.col(c) for c in tree], tree_weight)
    decided = px.where(F.col("valid")).withColumn("pred", D.decide_bs(mixed, multipliers))
    metrics = score_long(score_wide(confusion_wide(decided, []), []))
    return metrics, check_metrics(metrics, recorded, tolerance)


def replay_report(px: DataFrame, second: Sequence[str], tree: Sequence[str], tree_weight: float, multipliers: Sequence[float], recorded: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Every replayed or recorded metric: ``metric, actual, expected, reproduced``.

    A metric on one side only is not reproduced.
    """
    metrics, _ = replay(px, second, tree, tree_weight, multipliers, recorded, tolerance)
    # the replay is one row of scores; written once, the pixels are not counted for each side
    metrics = cut_lineage(metrics)
    failed = check_metrics(metrics, recorded, tolerance).select("metric", F.lit(False).alias("_reproduced"))
    both = metrics.select("metric", F.col("value").alias("actual")).join(recorded.select("metric", F.col("value").alias("expected")), "metric", "full_outer")
    return both.join(failed, "metric", "left").select("metric", "actual", "expected", F.coalesce("_reproduced", F.lit(True)).alias("reproduced"))


def smoothing_stats(px: DataFrame, second: Sequence[str], tree: Sequence[str], tree_weight: float, multipliers: Sequence[float], window: int | None, height: int, width: int) -> DataFrame:
    """Per-chip confusion of the blend, optionally smoothed before deciding."""
    names = [f"_p{i}" for i in range(4)]
    mixed = D.blend([F.col(c) for c in second], [F.col(c) for c in tree], tree_weight)
    blended = px.select("chip_id", "rw", "cl", "truth", "valid", *[c.alias(n) for c, n in zip(mixed, names)])
    if window:
        blended = smooth_scores(blended, names, window, height, width)
    decided = blended.where(F.col("valid")).withColumn("pred", D.decide_bs([F.col(n) for n in names], multipliers))
    return confusion_wide(decided, ["chip_id"])


def compare_smoothing(px: DataFrame, second: Sequence[str], tree: Sequence[str], tree_weight: float, multipliers: Sequence[float], height: int, width: int, windows: Sequence[int] = (3, 5), replicates: int = 200, seed: int = 42) -> DataFrame:
    """Unsmoothed against smoothed: scores, delta, bootstrap interval, halves."""
    base = smoothing_stats(px, second, tree, tree_weight, multipliers, None, height, width)
    out = None
    for k in windows:
        cand = smoothing_stats(px, second, tree, tree_weight, multipliers, k, height, width)
        pairs = paired_stats(base, cand)
        totals = pairs.agg(*[F.sum(f"{p}{c}").alias(f"{p}{c}") for p in ("a_", "b_") for c in CELLS])
        a = score_wide(totals, [f"b_{c}" for c in CELLS], "a_").select(F.col("score").alias("base_score"), *[f"b_{c}" for c in CELLS])
        b = score_wide(a, ["base_score"], "b_").select("base_score", "score")
        halves = hash_halves(pairs).agg(
            F.max(F.when(F.col("half") == 0, F.col("delta"))).alias("delta_half_0"), F.max(F.when(F.col("half") == 1, F.col("delta"))).alias("delta_half_1")
        )
        boot = bootstrap_delta(pairs, replicates, seed)
        # ungrouped aggregates: one row on every side
        row = b.join(F.broadcast(halves), F.lit(True)).join(F.broadcast(boot.select("low", "high")), F.lit(True))
        row = row.select(F.lit(k).alias("window"), "base_score", "score", (F.col("score") - F.col("base_score")).alias("delta"), "low", "high", "delta_half_0", "delta_half_1")
        out = row if out is None else out.unionByName(row)
    return out
