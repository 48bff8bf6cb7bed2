"""Chips to submission: features, scores, blend, decision, run lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.functions import decision as D
from ember.operators import models
from ember.operators.rle import rle_encode_classes
from ember.operators.submission import build_submission


def decide(px: DataFrame, task: str, second: Sequence[str], tree: Sequence[str], tree_weight: float, threshold: float = 0.5, multipliers: Sequence[float] = (1, 1, 1, 1)) -> DataFrame:
    """Blend two scorers in float32 and add the class ``cls``."""
    mixed = D.blend([F.col(c) for c in second], [F.col(c) for c in tree], tree_weight)
    cls = D.decide_af(mixed[0], threshold) if task == "af" else D.decide_bs(mixed, multipliers)
    return px.withColumn("cls", cls.cast("int"))


def predict(px: DataFrame, task: str, names: Sequence[str], tree_model, second_model, recipe: dict) -> DataFrame:
    """Score feature pixels with two fitted models and decide their class."""
    classes = 2 if task == "af" else 4
    scored = models.score(px, tree_model, names, classes, "t")
    scored = models.score(scored, second_model, names, classes, "n")
    pick = ["1"] if task == "af" else ["0", "1", "2", "3"]
    return decide(
        scored,
        task,
        [f"n{i}" for i in pick],
        [f"t{i}" for i in pick],
        recipe["tree_weight"],
        recipe.get("threshold", 0.5),
        recipe.get("class_multipliers", (1, 1, 1, 1)),
    )


def submit(template: DataFrame, px: DataFrame) -> DataFrame:
    return build_submission(template, px)


def chip_products(requested: DataFrame, px: DataFrame, scenes: DataFrame) -> DataFrame:
    """Raw products of registered chips: size, classes and one RLE per class.

    ``scenes``: chip_id, task, georeferenced.  Unregistered chips are reported
    by ``joins.missing_ids`` and do not appear here.
    """
    wanted = requested.select("chip_id").distinct().join(scenes.select("chip_id", "task", "georeferenced"), "chip_id")
    chosen = px.join(wanted.select("chip_id", "task"), "chip_id")
    size = chosen.groupBy("chip_id").agg((F.max("rw") + 1).alias("height"), (F.max("cl") + 1).alias("width"))
    masks = rle_encode_classes(chosen, (1, 2, 3), ("chip_id",)).join(wanted.select("chip_id", "task"), "chip_id").where(
        (F.col("task") == "bs") | (F.col("class_id") == 1)
    )
    packed = masks.groupBy("chip_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "rle"))).alias("rles"))
    return wanted.join(size, "chip_id").join(packed, "chip_id")
