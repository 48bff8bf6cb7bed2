"""Pixel counts and the scores derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import scores as S
from ember.functions.spectral import is_finite


def fit_normaliser(px: DataFrame, names: Sequence[str], use: Column) -> DataFrame:
    """One row of ``<name>_mean, _std, _count`` over finite permitted values.

    The variance floor keeps constant channels usable.
    """
    parts = []
    for n in names:
        value = F.when(use & is_finite(F.col(n)), F.col(n).cast("double"))
        parts += [F.sum(value).alias(f"{n}_s"), F.sum(value * value).alias(f"{n}_q"), F.count(value).alias(f"{n}_count")]
    sums = px.agg(*parts)
    out = []
    for n in names:
        mean = F.try_divide(F.col(f"{n}_s"), F.col(f"{n}_count"))
        spread = F.try_divide(F.col(f"{n}_q"), F.col(f"{n}_count")) - mean * mean
        out += [mean.alias(f"{n}_mean"), F.sqrt(F.greatest(spread, F.lit(1e-8))).alias(f"{n}_std"), F.col(f"{n}_count")]
    return sums.select(*out)


def class_balance(px: DataFrame, task: str, label: str = "y", use: Column | None = None) -> DataFrame:
    """Positive weight (AF) or four class weights (BS) from label counts."""
    rows = px if use is None else px.where(use)
    n = 2 if task == "af" else 4
    counts = rows.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in range(n)])
    if task == "af":
        weight = F.col("n0") / F.greatest(F.col("n1"), F.lit(1))
        return counts.select(F.greatest(F.least(weight, F.lit(30.0)), F.lit(1.0)).alias("pos_weight"))
    total = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")
    return counts.select(
        *[F.greatest(F.least(total / F.greatest(F.col(f"n{c}"), F.lit(1)) / 4, F.lit(8.0)), F.lit(0.25)).alias(f"w{c}") for c in range(4)]
    )


def confusion(px: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Long form ``(keys, truth, pred, n)``: sixteen groups per key, combined map-side."""
    return px.groupBy(*keys, F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_binary(px: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return px.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )


def confusion_wide(px: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per key with the sixteen cells ``c00`` .. ``c33``."""
    code = F.col(truth).cast("int") * 4 + F.col(pred).cast("int")
    long = px.groupBy(*keys, code.alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    return long.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("_code") == t * 4 + p, F.col("_n"))), F.lit(0)).alias(f"c{t}{p}") for t in range(4) for p in range(4)]
    )


CELLS = [f"c{t}{p}" for t in range(4) for p in range(4)]


def _total(cells: Sequence[Column]) -> Column:
    out = cells[0]
    for c in cells[1:]:
        out = out + c
    return out


def burn_counts(prefix: str = "") -> tuple[Column, Column, Column]:
    """tp, fp, fn of burned (class > 0) from wide cells."""
    cell = lambda t, p: F.col(f"{prefix}c{t}{p}")
    tp = _total([cell(t, p) for t in (1, 2, 3) for p in (1, 2, 3)])
    return tp, _total([cell(0, p) for p in (1, 2, 3)]), _total([cell(t, 0) for t in (1, 2, 3)])


def severity_iou(prefix: str = "") -> list[Column]:
    cell = lambda t, p: F.col(f"{prefix}c{t}{p}")
    out = []
    for c in (1, 2, 3):
        row, col = _total([cell(c, p) for p in range(4)]), _total([cell(t, c) for t in range(4)])
        out.append(S.iou(cell(c, c), row + col - cell(c, c)))
    return out


def score_wide(wide: DataFrame, keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """IoU_burn, IoU_1..3, mIoU_sev and the weighted burn score per row."""
    tp, fp, fn = burn_counts(prefix)
    sev = severity_iou(prefix)
    return (
        wide.select(*keys, S.iou(tp, tp + fp + fn).alias("IoU_burn"), *[v.alias(f"IoU_{c}") for c, v in zip((1, 2, 3), sev)])
        .withColumn("mIoU_sev", (F.col("IoU_1") + F.col("IoU_2") + F.col("IoU_3")) / 3)
        .withColumn("score", S.weighted_burn(F.col("IoU_burn"), F.col("mIoU_sev")))
    )


def widen(long: DataFrame, keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Long confusion to wide cells (also sums duplicates)."""
    return long.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col(n))), F.lit(0)).alias(f"c{t}{p}")
            for t in range(4)
            for p in range(4)
        ]
    )


def score_confusion(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return score_wide(widen(long, keys), keys)


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precision, recall (NULL on a zero denominator) and f1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": S.ratio(tp, tp + fp), "recall": S.ratio(tp, tp + fn), "f1": S.f1(tp, fp, fn)})


def competition_score(af: DataFrame, bs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """F1_af, IoU_burn, IoU_1..3, mIoU_sev and Score over all given pixels."""
    counts = confusion_binary(af, (), truth, pred).select(S.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("F1_af"))
    burn = score_confusion(confusion(bs, (), truth, pred)).drop("score")
    # both sides are ungrouped aggregates: one row each
    both = counts.join(F.broadcast(burn), F.lit(True))
    return both.withColumn("Score", S.overall(F.col("F1_af"), F.col("IoU_burn"), F.col("mIoU_sev")))


def score_histogram(px: DataFrame, score: str, edges: Sequence[float], truth: str = "truth") -> DataFrame:
    """Counts by truth and bin; bin = number of edges not above the score."""
    value = F.col(score).cast("float")
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + (value >= F.lit(float(e)).cast("float")).cast("int")
    return px.groupBy(F.col(truth).cast("int").alias("truth"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def label_histogram(px: DataFrame, keys: Sequence[str] = ("task",), label: str = "y") -> DataFrame:
    return px.groupBy(*keys, F.coalesce(F.col(label), F.lit(255)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def mask_counts(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """Pixels per class and mask, and the positive total."""
    return px.groupBy(*keys).agg(
        *[F.count_if(F.col(cls) == c).alias(f"n{c}") for c in range(4)], F.count_if(F.col(cls) > 0).alias("positive")
    )


def mask_digest(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls", order: str = "pos") -> DataFrame:
    """sha256 of each mask's C-order bytes (a mask is bounded by contract)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.lpad(F.hex(F.col(cls).cast("long")), 2, "0").alias("h"))))
    text = F.concat_ws("", F.transform(ordered, lambda s: s["h"]))
    return px.groupBy(*keys).agg(F.sha2(F.unhex(text), 256).alias("sha256"))


def overall_digest(digests: DataFrame, key: str = "chip_id", digits: int = 3) -> DataFrame:
    """One sha256 over all mask digests, independent of partitioning.

    Two levels: masks are hashed in key order inside buckets of the key's own
    digest, then the bucket digests (at most ``16 ** digits``) in bucket order.
    """
    bucket = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, digits)

    def chain(order: str) -> Column:
        return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("sha256")))), lambda x: x["sha256"])), 256)

    parts = digests.groupBy(bucket.alias("bucket")).agg(chain(key).alias("sha256"), F.count(F.lit(1)).alias("n"))
    return parts.agg(chain("bucket").alias("sha256"), F.sum("n").alias("masks"))


def subgroup_report(px: DataFrame, meta: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Global, per-year and per-cloud-bin confusions in one pass.

    Pixels shrink to per-chip counts first; only those meet the metadata and
    the grouping sets.  ``meta``: chip_id, year, cloud_bin.
    """
    by_chip = confusion_wide(px, ["chip_id"], truth, pred)
    joined = by_chip.join(meta.select("chip_id", "year", "cloud_bin"), "chip_id")
    cells = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in CELLS)
    total = " + ".join(CELLS)
    grouped = joined.sparkSession.sql(
        f"""SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(cloud_bin) = 0 THEN 'cloud' ELSE 'global' END AS grp,
                   coalesce(year, cloud_bin, 'all') AS name, count(*) AS chips, CAST(sum({total}) AS BIGINT) AS pixels, {cells}
            FROM {{joined}} GROUP BY GROUPING SETS ((), (year), (cloud_bin))""",
        joined=joined,
    )
    scored = score_wide(grouped, ["grp", "name", "chips", "pixels", *CELLS])
    tp, fp, fn = burn_counts()
    return scored.withColumns({"burn_precision": S.ratio(tp, tp + fp), "burn_recall": S.ratio(tp, tp + fn)}).drop(*CELLS)


def cloud_bin(cloud: Column) -> Column:
    """Three cloud classes; NULL outside [0, 1]."""
    return (
        F.when(F.isnan(cloud) | (cloud < 0) | (cloud > 1), F.lit(None).cast("string"))
        .when(cloud <= 0.1, "<=0.1")
        .when(cloud <= 0.3, "(0.1,0.3]")
        .when(cloud <= 1, ">0.3")
    )


def binary_loss(px: DataFrame, prob: str, truth: str, pos_weight: float, valid: str = "valid") -> DataFrame:
    """Focal-weighted cross-entropy plus soft Dice on permitted pixels."""
    use = F.col(valid)
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(1e-12)), F.lit(1 - 1e-12))
    t = F.when(use, F.col(truth)).otherwise(0).cast("double")
    bce = -(F.lit(float(pos_weight)) * t * F.log(p) + (1 - t) * F.log(1 - p))
    focal = F.pow((1 - p) * t + p * (1 - t), F.lit(1.5))
    m = F.when(use, 1.0).otherwise(0.0)
    sums = px.agg(
        F.sum(bce * focal * m).alias("b"), F.sum(m).alias("m"), F.sum(p * t * m).alias("i"), F.sum(p * m).alias("sp"), F.sum(t * m).alias("st")
    )
    ce = F.col("b") / F.greatest(F.col("m"), F.lit(1.0))
    dice = 1 - (2 * F.col("i") + 1) / (F.col("sp") + F.col("st") + 1)
    return sums.select(ce.alias("cross_entropy"), dice.alias("dice"), (ce + dice).alias("loss"))


def multiclass_loss(px: DataFrame, probs: Sequence[str], truth: str, weights: Sequence[float], valid: str = "valid") -> DataFrame:
    """Weighted cross-entropy plus macro soft Dice over four classes."""
    m = F.when(F.col(valid), 1.0).otherwise(0.0)
    t = F.when(F.col(valid), F.col(truth)).otherwise(0)
    ce = F.lit(0.0)
    parts = []
    for c, name in enumerate(probs):
        p = F.greatest(F.col(name).cast("double"), F.lit(1e-12))
        hot = F.when(t == c, 1.0).otherwise(0.0)
        ce = ce - F.lit(float(weights[c])) * hot * F.log(p)
        parts += [F.sum(p * hot * m).alias(f"i{c}"), F.sum((p + hot) * m).alias(f"d{c}")]
    sums = px.agg(F.sum(ce * m).alias("ce"), F.sum(m).alias("m"), *parts)
    entropy = F.col("ce") / F.greatest(F.col("m"), F.lit(1.0))
    dice = F.lit(0.0)
    for c in range(4):
        dice = dice + (2 * F.col(f"i{c}") + 1) / (F.col(f"d{c}") + 1)
    dice = 1 - dice / 4
    return sums.select(entropy.alias("cross_entropy"), dice.alias("dice"), (entropy + dice).alias("loss"))


def validation_score(px: DataFrame, task: str, truth: str = "truth", pred: str = "pred", valid: str = "valid") -> DataFrame:
    """Scores on permitted pixels only (equal to zeroing both sides for BS)."""
    kept = px.where(F.col(valid))
    if task == "af":
        return precision_recall(confusion_binary(kept, (), truth, pred))
    return score_confusion(confusion(kept, (), truth, pred))


def combined_with_fixed(metrics: DataFrame, fixed_f1: float, baseline: float) -> DataFrame:
    """Overall score with the other task frozen, and its change."""
    total = F.lit(S.W_AF * fixed_f1) + F.col("score")
    return metrics.withColumns({"combined_score": total, "delta_vs_baseline": total - F.lit(float(baseline))})


def band_profile(px: DataFrame, group: str, bands: Sequence[str]) -> DataFrame:
    """Per group and band: count, minimum, maximum and number of distinct values.

    Bands are unpivoted before the aggregation; distinct values are counted by
    a two-step group-by, so a continuous band does not pile up in one buffer.
    """
    stack = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands])
    long = px.select(group, F.inline(stack))
    per_value = long.groupBy(group, "band", "value").agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(group, "band").agg(
        F.sum("_n").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("value").alias("n_values"),
    )


def prior_weights(population: DataFrame, keys: Sequence[str] = ("y",), power: float = 1.0) -> DataFrame:
    """Population / selected per class, raised to ``power``, plus the mean-1 form.

    ``population``: keys, population, selected (a handful of class rows).
    """
    w = F.when(F.col("selected") > 0, F.pow(F.col("population") / F.col("selected"), F.lit(float(power)))).otherwise(0.0)
    weighted = population.withColumn("weight", w)
    whole = Window.partitionBy()
    mean = F.sum(F.col("weight") * F.col("selected")).over(whole) / F.sum("selected").over(whole)
    return weighted.withColumn("weight_mean1", F.col("weight") / mean)


def split_counts(meta: DataFrame, keys: Sequence[str] = ("kind", "split")) -> DataFrame:
    """Chips per kind and split."""
    return meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grouped_burn_score(truth: str = "truth", pred: str = "pred", n: str = "n"):
    """Burn score as a grouped Arrow aggregate over the 16 cells of a confusion."""
    @F.pandas_udf("double")
    def burn_score(t: pd.Series, p: pd.Series, k: pd.Series) -> float:
        def overlap(a: pd.Series, b: pd.Series) -> float:
            union = k[a | b].sum()
            return 1.0 if union == 0 else k[a & b].sum() / union

        severity = sum(overlap(t == c, p == c) for c in (1, 2, 3)) / 3
        return float(S.W_BURN * overlap(t > 0, p > 0) + S.W_SEVERITY * severity)

    return burn_score(truth, pred, n)
