"""Building and checking the submission table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ember.functions.text import task_of
from ember.operators.joins import fill_template
from ember.operators.rle import overlapping_pixels, rle_decode, rle_encode, rle_problem


def build_submission(template: DataFrame, px: DataFrame) -> DataFrame:
    """``chip_id, class_id, rle`` for exactly the template's keys, in its order.

    ``template``: chip_id, class_id, template_pos; ``px``: class pixels.
    """
    masks = rle_encode(px, ("chip_id",))
    return fill_template(template.select("chip_id", "class_id", "template_pos"), masks)


def template_problems(template: DataFrame, px: DataFrame, classes: Mapping[str, tuple[int, ...]]) -> DataFrame:
    """Repeated keys, incomplete class rows and chips on one side only."""
    repeated = template.groupBy("chip_id", "class_id").count().where("count > 1").select("chip_id", F.lit("repeated key").alias("problem"))
    wanted = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.array(*[F.lit(int(c)) for c in v]))])
    per_chip = template.groupBy("chip_id").agg(F.array_sort(F.collect_set(F.col("class_id").cast("int"))).alias("_have"))
    partial = per_chip.where(F.col("_have") != wanted[task_of(F.col("chip_id"))]).select("chip_id", F.lit("class rows").alias("problem"))
    have, predicted = template.select("chip_id").distinct(), px.select("chip_id").distinct()
    unseen = have.join(predicted, "chip_id", "left_anti").select("chip_id", F.lit("no prediction").alias("problem"))
    extra = predicted.join(have, "chip_id", "left_anti").select("chip_id", F.lit("not in template").alias("problem"))
    return repeated.unionByName(partial).unionByName(unseen).unionByName(extra)


def submission_problems(sub: DataFrame, template: DataFrame, size: Column, width: Column) -> DataFrame:
    """``(template_pos, chip_id, class_id, problem)`` of every bad row.

    Both tables carry ``template_pos``; order equality is an equi-join on the
    position, never a sort.  ``size`` and ``width`` are Columns over ``chip_id``.
    """
    left = sub.select("template_pos", "chip_id", "class_id", "rle", F.lit(True).alias("_s"))
    right = template.select("template_pos", F.col("chip_id").alias("_chip"), F.col("class_id").alias("_class"), F.lit(True).alias("_t"))
    both = left.join(right, "template_pos", "full_outer")
    order = (
        F.when(F.col("_s").isNull(), "row missing")
        .when(F.col("_t").isNull(), "row not in template")
        .when((F.col("chip_id") != F.col("_chip")) | (F.col("class_id") != F.col("_class")), "key differs from template")
    )
    named = both.withColumns({"chip_id": F.coalesce("chip_id", "_chip"), "class_id": F.coalesce("class_id", "_class")})
    rows = named.withColumn("problem", F.coalesce(order, rle_problem(F.col("rle"), size))).where(F.col("problem").isNotNull())
    rows = rows.select("template_pos", "chip_id", "class_id", "problem")
    readable = sub.where(rle_problem(F.col("rle"), size).isNull())
    px = rle_decode(readable.select("chip_id", "class_id", "rle"), width)
    clashing = overlapping_pixels(px).select("chip_id").distinct()
    overlap = sub.join(clashing, "chip_id", "left_semi").select("template_pos", "chip_id", "class_id", F.lit("classes overlap").alias("problem"))
    repeated = (
        sub.groupBy("chip_id", "class_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("template_pos").alias("template_pos"))
        .where("_n > 1")
        .select("template_pos", "chip_id", "class_id", F.lit("repeated key").alias("problem"))
    )
    return rows.unionByName(overlap).unionByName(repeated)


def validate_submission(sub: DataFrame, template: DataFrame, size: Column, width: Column) -> DataFrame:
    """One report row: rows, chips per task, number of problems and status."""
    problems = submission_problems(sub, template, size, width).agg(F.count(F.lit(1)).alias("problems"))
    chips = sub.select("chip_id").distinct().agg(
        F.count_if(task_of(F.col("chip_id")) == "af").alias("af_chips"), F.count_if(task_of(F.col("chip_id")) == "bs").alias("bs_chips")
    )
    rows = sub.agg(F.count(F.lit(1)).alias("data_rows"))
    # three ungrouped aggregates: one row each
    one = rows.join(F.broadcast(chips), F.lit(True)).join(F.broadcast(problems), F.lit(True))
    return one.withColumn("status", F.when(F.col("problems") == 0, "pass").otherwise("fail"))
