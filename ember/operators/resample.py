"""Bootstraps, hash halves and group-isolated splits on per-chip statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import scores as S
from ember.operators.confusion import CELLS, score_wide
from ember.operators.indexing import dense_index, draw
from ember.session import cut_lineage

AF_CELLS = ["tp", "fp", "fn"]


def paired_stats(a: DataFrame, b: DataFrame, cells: Sequence[str] = CELLS, key: str = "chip_id") -> DataFrame:
    """Per-unit counts of two recipes side by side (``a_`` / ``b_`` columns)."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cells])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in cells])
    return left.join(right, key)


def _delta(cells: Sequence[str]):
    if list(cells) == AF_CELLS:
        def value(p: str) -> Column:
            return S.f1(F.col(f"{p}tp"), F.col(f"{p}fp"), F.col(f"{p}fn"))

        return value("b_") - value("a_")
    from ember.operators.confusion import burn_counts, severity_iou

    def score(p: str) -> Column:
        tp, fp, fn = burn_counts(p)
        s1, s2, s3 = severity_iou(p)
        return S.weighted_burn(S.iou(tp, tp + fp + fn), (s1 + s2 + s3) / 3)

    return score("b_") - score("a_")


def bootstrap_deltas(pairs: DataFrame, replicates: int, seed: int, cells: Sequence[str] = CELLS, key: str = "chip_id") -> DataFrame:
    """Score difference of each bootstrap replicate: ``(rep, delta)``.

    Works on one narrow row per unit; draws are digests of (seed, replicate,
    slot), so a lost task redraws the same units.  The draws shuffle to the
    units and are summed per replicate map-side.
    """
    # the statistics are narrow; written once, pixels are not counted again
    indexed = dense_index(cut_lineage(pairs), key)
    slots = indexed.select(F.col("idx").alias("slot"), "n_total", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    draws = slots.select("rep", F.pmod(draw(seed, F.col("rep"), F.col("slot")), F.col("n_total")).alias("idx"))
    both = [f"{p}{c}" for p in ("a_", "b_") for c in cells]
    # identical draws of one replicate collapse before they meet the statistics
    times = draws.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("_k"))
    summed = times.join(indexed.select("idx", *both), "idx").groupBy("rep").agg(*[F.sum(F.col(c) * F.col("_k")).alias(c) for c in both])
    return summed.select("rep", _delta(cells).alias("delta"))


def summarise_deltas(deltas: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, 95 % interval and share above zero."""
    q = F.percentile("delta", [0.025, 0.5, 0.975])
    return deltas.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg("delta").alias("mean"),
        F.stddev_samp("delta").alias("std"),
        q.alias("_q"),
        F.avg((F.col("delta") > 0).cast("double")).alias("share_above_zero"),
    ).select("replicates", "mean", F.col("_q")[1].alias("median"), "std", F.col("_q")[0].alias("low"), F.col("_q")[2].alias("high"), "share_above_zero")


def bootstrap_delta(pairs: DataFrame, replicates: int = 2000, seed: int = 42, cells: Sequence[str] = CELLS, key: str = "chip_id") -> DataFrame:
    return summarise_deltas(bootstrap_deltas(pairs, replicates, seed, cells, key))


def group_stats(pairs: DataFrame, meta: DataFrame, fields: Sequence[str], cells: Sequence[str], key: str = "chip_id") -> DataFrame:
    """Sum unit statistics per exact grid, keyed by the joined field text."""
    both = [f"{p}{c}" for p in ("a_", "b_") for c in cells]
    label = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    return pairs.join(meta.select(key, label.alias("grid")), key).groupBy("grid").agg(*[F.sum(c).alias(c) for c in both])


def bootstrap_groups(pairs: DataFrame, meta: DataFrame, fields: Sequence[str], replicates: int, seed: int, cells: Sequence[str] = CELLS) -> DataFrame:
    """Cluster bootstrap: whole grids are drawn instead of chips."""
    return bootstrap_delta(group_stats(pairs, meta, fields, cells), replicates, seed, cells, key="grid")


def half_of(chip: Column) -> Column:
    """sha256(chip) modulo 2 from the last hex digit."""
    digest = F.sha2(chip.cast("string").cast("binary"), 256)
    return F.conv(F.substring(digest, 64, 1), 16, 10).cast("int") % 2


def hash_halves(pairs: DataFrame, cells: Sequence[str] = CELLS, key: str = "chip_id") -> DataFrame:
    """Metrics of both recipes in each fixed half: ``half, chips, a_score, b_score, delta``."""
    both = [f"{p}{c}" for p in ("a_", "b_") for c in cells]
    halves = pairs.groupBy(half_of(F.col(key)).alias("half")).agg(
        F.count(F.lit(1)).alias("chips"), *[F.sum(c).alias(c) for c in both]
    )
    if list(cells) == AF_CELLS:
        value = lambda p: S.f1(F.col(f"{p}tp"), F.col(f"{p}fp"), F.col(f"{p}fn"))
        return halves.select("half", "chips", value("a_").alias("a_score"), value("b_").alias("b_score"), (value("b_") - value("a_")).alias("delta"))
    a = score_wide(halves, ["half", "chips", *both], "a_").select("half", "chips", F.col("score").alias("a_score"), *[f"b_{c}" for c in cells])
    b = score_wide(a, ["half", "chips", "a_score"], "b_")
    return b.select("half", "chips", "a_score", F.col("score").alias("b_score"), (F.col("score") - F.col("a_score")).alias("delta"))


def group_split(meta: DataFrame, group: Sequence[str], strata: Sequence[str], percent: int = 20, seed: str = "ember") -> DataFrame:
    """Train/validation split that keeps groups whole: ``(chip_id, split)``.

    Groups are put in digest order inside their stratum; a group is validation
    while the chips before it plus half of its own stay below ``percent`` of
    the stratum.  Running sums go through 4096 digest buckets per stratum, so a
    stratum holding most of the data does not land in one window.
    """
    strata = list(strata)
    name = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    tagged = meta.withColumn("_group", name)
    groups = tagged.groupBy("_group").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(s).alias(s) for s in strata]
    ).withColumn("_digest", F.md5(F.concat_ws(":", F.lit(seed), F.col("_group")).cast("binary"))).withColumn(
        "_bucket", F.substring("_digest", 1, 3)
    )
    buckets = groups.groupBy(*strata, "_bucket").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata)
    starts = buckets.select(
        *strata, "_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_start"), F.sum("_bn").over(whole).alias("_all")
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_digest", "_group").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(starts, [*strata, "_bucket"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    is_val = (2 * F.col("_before") + F.col("_n")) * 100 <= 2 * percent * F.col("_all")
    assigned = placed.select("_group", F.when(is_val, "val").otherwise("train").alias("split"))
    return tagged.select("chip_id", "_group").join(assigned, "_group").select("chip_id", "split")
