"""Blending scores and turning them into classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ember.functions.spectral import f32


def _f(value: Column | float) -> Column:
    return value.cast("float") if isinstance(value, Column) else f32(value)


def blend(second: Sequence[Column], tree: Sequence[Column], tree_weight: Column | float) -> list[Column]:
    """``(1 - w) * second + w * tree`` in float32, one Column per class."""
    w = _f(tree_weight)
    rest = (F.lit(1.0) - tree_weight.cast("double")).cast("float") if isinstance(tree_weight, Column) else f32(1.0 - tree_weight)
    return [rest * s.cast("float") + w * t.cast("float") for s, t in zip(second, tree)]


def blend_equal(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [(x.cast("float") + y.cast("float")) * f32(0.5) for x, y in zip(a, b)]


def decide_af(score: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score.cast("double") >= limit, 1).otherwise(0)


def decide_bs(scores: Sequence[Column], multipliers: Sequence[Column | float]) -> Column:
    """Index of the first largest ``score * multiplier`` (float32 products).

    Both array functions have generated code; the products appear twice in the
    expression, not once per comparison, which keeps filters on the class small
    when Spark inlines them.
    """
    weighted = F.array(*[s.cast("float") * _f(m) for s, m in zip(scores, multipliers)])
    return (F.array_position(weighted, F.array_max(weighted)) - 1).cast("int")


def decide_dnbr(score: Column, thresholds: Sequence[Column | float]) -> Column:
    """Four severity classes from three rising burn-ratio thresholds."""
    low, medium, high = (_f(t) for t in thresholds)
    value = score.cast("float")
    return F.when(value >= high, 3).when(value >= medium, 2).when(value >= low, 1).otherwise(0)
