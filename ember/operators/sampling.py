"""Capped stratified samples for model fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ember.operators.indexing import draw


def class_cap(max_pixels: int, chips: int, classes: int) -> int:
    return max(1, max_pixels // max(1, chips * classes))


def sample_pixels(px: DataFrame, cap: int, seed: int, label: str = "y", valid: str = "valid") -> DataFrame:
    """At most ``cap`` permitted pixels per chip and class, without replacement.

    Ranking by digest is a per-group limit, which Spark applies map-side before
    the exchange as well, so a crowded class never travels whole.
    """
    kept = px.where(F.col(valid) & F.col(label).isNotNull())
    order = draw(seed, F.col("chip_id"), F.col(label), F.col("rw"), F.col("cl"))
    ranked = kept.withColumn("_o", order).withColumn(
        "_r", F.row_number().over(Window.partitionBy("chip_id", label).orderBy("_o", "rw", "cl"))
    )
    return ranked.where(F.col("_r") <= cap).drop("_o", "_r")


def sample_info(px: DataFrame, sample: DataFrame, label: str = "y", valid: str = "valid") -> DataFrame:
    """Population and selected counts per class with the prior weight."""
    population = px.where(F.col(valid) & F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("population"))
    selected = sample.groupBy(label).agg(F.count(F.lit(1)).alias("selected"))
    both = population.join(selected, label, "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return both.withColumn("weight", F.when(F.col("selected") > 0, F.col("population") / F.col("selected")).otherwise(0.0))


def with_prior_weight(sample: DataFrame, info: DataFrame, label: str = "y", power: float = 1.0) -> DataFrame:
    """Attach ``(population / selected) ** power``; ``info`` has one row per class."""
    weights = info.select(label, F.pow("weight", F.lit(float(power))).alias("weight"))
    return sample.join(F.broadcast(weights), label)
