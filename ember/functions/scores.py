"""Count-to-score formulas.  Absence on both sides counts as a perfect score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the three parts of the overall score.
W_AF, W_BURN, W_SEVERITY = 0.35, 0.35, 0.30


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    total = 2 * tp + fp + fn
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * tp, total))


def iou(inter: Column, union: Column) -> Column:
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(inter.cast("double"), union))


def ratio(part: Column, whole: Column) -> Column:
    """Plain quotient that is NULL when the denominator is zero."""
    return F.when(whole != 0, F.try_divide(part.cast("double"), whole))


def weighted_burn(iou_burn: Column, miou: Column) -> Column:
    return F.lit(W_BURN) * iou_burn + F.lit(W_SEVERITY) * miou


def overall(f1_af: Column, iou_burn: Column, miou: Column) -> Column:
    return F.lit(W_AF) * f1_af + F.lit(W_BURN) * iou_burn + F.lit(W_SEVERITY) * miou
