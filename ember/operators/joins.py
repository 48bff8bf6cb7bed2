"""Lookups, anti/semi joins and candidate grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_scores(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("chip_id", "rw", "cl")) -> DataFrame:
    """Two score tables pixel by pixel."""
    return a.join(b, list(keys), "inner")


def with_meta(df: DataFrame, meta: DataFrame, key: str = "chip_id") -> DataFrame:
    """Attach metadata; rows without any keep ``has_meta = false``."""
    return df.join(meta.withColumn("has_meta", F.lit(True)), key, "left").withColumn(
        "has_meta", F.coalesce(F.col("has_meta"), F.lit(False))
    )


def missing_meta(df: DataFrame, meta: DataFrame, key: str = "chip_id") -> DataFrame:
    return df.select(key).distinct().join(meta.select(key), key, "left_anti")


def missing_ids(requested: DataFrame, registry: DataFrame, key: str = "chip_id") -> DataFrame:
    return requested.select(key).distinct().join(registry.select(key), key, "left_anti")


def requested_scenes(scenes: DataFrame, requested: DataFrame, key: str = "chip_id") -> DataFrame:
    return scenes.join(requested.select(key), key, "left_semi")


def fill_template(template: DataFrame, rles: DataFrame) -> DataFrame:
    """Every template row with its RLE, or the empty mask."""
    return template.join(rles, ["chip_id", "class_id"], "left").withColumn("rle", F.coalesce("rle", F.lit("")))


def with_candidates(df: DataFrame, grid: Sequence[Mapping[str, float | int]]) -> DataFrame:
    """Repeat each row for every entry of a parameter grid.

    The grid is a short list known to the driver; it enters the plan as a
    literal array, so rows are unfolded in place - no join and no shuffle.
    """
    def literal(value):
        return F.lit(float(value)) if isinstance(value, float) else F.lit(value)

    entries = F.array(*[F.struct(*[literal(v).alias(k) for k, v in row.items()]) for row in grid])
    return df.select("*", F.inline(entries))


def _task_sets(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per ``key``: its distinct task sets and how often each occurs, as ``name``."""
    sets = df.select(key, F.array_sort(F.array_distinct("tasks")).alias("_set")).where(F.size("_set") > 0)
    counted = sets.groupBy(key, "_set").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_set", "_n"))).alias(name))


def capable_bundles(
    requests: DataFrame, bundles: DataFrame, rows_per_task: int = 20_000, per_list: int = 128, per_group: int = 64, per_book: int = 32
) -> DataFrame:
    """(request, bundle) pairs where a ready bundle covers all wanted tasks.

    Distinct task sets meet on the task: two sets qualify when they matched as
    many tasks as the request has.  Lists of requests and lists of bundles then
    meet on their sets, so the pairs themselves are never exchanged or counted.
    They come list by list, a list of requests with ``per_book`` lists of bundles at a time.
    ``requests``: request_id, tasks; ``bundles``: bundle_id, status, tasks.
    """
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # many pairs from few bytes: not to be coalesced
    wants = _task_sets(requests.repartition(tasks, "request_id"), "request_id", "_wants")
    offers = _task_sets(bundles.where(F.col("status") == "ready"), "bundle_id", "_offers")

    def unfolded(df: DataFrame, name: str, count: str) -> DataFrame:
        return df.select(name).distinct().select(name, F.inline(name)).select(name, F.size("_set").alias(f"{name}_size"), F.col("_n").alias(count), F.explode("_set").alias("task"))

    fits = (
        unfolded(wants, "_wants", "_r")
        .join(unfolded(offers, "_offers", "_b"), "task")
        .groupBy("_wants", "_offers")
        .agg(F.sum(F.col("_r") * F.col("_b")).alias("_met"), F.min("_wants_size").alias("_wanted"))
        .where(F.col("_met") == F.col("_wanted"))
        .select("_wants", "_offers")
    )
    able = offers.join(fits, "_offers").select("bundle_id", "_wants")

    def listed(df: DataFrame, key: str, most: int, per_part: int, name: str) -> tuple[DataFrame, DataFrame]:
        """``_wants``, a part of about ``per_part`` keys and arrays of ``most`` keys of it; and how many parts ``_wants`` has."""
        part = f"{name}_part"
        counted = df.groupBy("_wants").agg(F.ceil(F.count(F.lit(1)) / per_part).alias(f"{name}_parts"))
        dealt = df.select("_wants", key).join(counted, "_wants").withColumn(part, F.pmod(F.xxhash64(key), F.col(f"{name}_parts")))
        number = F.row_number().over(Window.partitionBy("_wants", part).orderBy(key))
        lists = dealt.withColumn("_list", F.floor((number - 1) / most)).groupBy("_wants", part, "_list")
        return lists.agg(F.collect_list(F.struct(key))[key].alias(name)).drop("_list"), counted  # by struct, so that a null key stays

    asking, request_parts = listed(wants, "request_id", per_group, rows_per_task, "_asking")
    offered, bundle_parts = listed(able, "bundle_id", per_list, per_list * per_book, "_able")

    def copied(df: DataFrame, counted: DataFrame, name: str) -> DataFrame:
        return df.join(counted, "_wants").withColumn(f"{name}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{name}_parts") - 1))).drop(f"{name}_parts")

    on = ["_wants", "_asking_part", "_able_part"]
    met = copied(asking, bundle_parts, "_able").repartition(tasks, *on).join(copied(offered, request_parts, "_asking").repartition(tasks, *on), on)
    # list by list: rows that follow each other repeat what came shortly before, which files store in little
    return met.select("_able", F.explode("_asking").alias("request_id")).select("request_id", F.explode("_able").alias("bundle_id"))
