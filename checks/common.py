"""Spark-side helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.functions import decision as D

RECIPE_WEIGHT = 0.75
RECIPE = (1.0, 2.2, 2.2, 1.3)
SECOND = ["n0", "n1", "n2", "n3"]
TREE = ["t0", "t1", "t2", "t3"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floats for comparison; minus zero becomes zero."""
    fix = {
        f.name: F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fix) if fix else df


def longs(df: DataFrame) -> DataFrame:
    """Integers as bigint, like SQL counts."""
    fix = {f.name: F.col(f.name).cast("bigint") for f in df.schema.fields if f.dataType.typeName() in ("integer", "short", "byte")}
    return df.withColumns(fix) if fix else df


def decided(px: DataFrame, weight: float = RECIPE_WEIGHT, multipliers=RECIPE) -> DataFrame:
    mixed = D.blend([F.col(c) for c in SECOND], [F.col(c) for c in TREE], weight)
    return px.withColumn("pred", D.decide_bs(mixed, multipliers))


def af_pixels(px: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Fire view of the pixels: class 1 against the rest."""
    mixed = D.blend([F.col("n1")], [F.col("t1")], RECIPE_WEIGHT)[0]
    return px.withColumn("fire", (F.col("truth") == 1).cast("int")).withColumn("score", mixed).withColumn("pred", D.decide_af(F.col("score"), threshold))
