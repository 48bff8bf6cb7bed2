"""Dense numbering and hot-key handling without single-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, name: str = "idx", total: str = "n_total", digits: int = 3) -> DataFrame:
    """Number the rows 0..n-1 in order of ``(md5(key), key)`` and add the total.

    Rows are bucketed by the first ``digits`` hex digits of the digest: at most
    ``16 ** digits`` bucket counts are summed up in one window, and the rows are
    numbered inside their own bucket.  No window sees the whole table.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", key)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, "_bucket")
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_digest", "_bucket", "_rank", "_start")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Column,
    rows_per_task: int = 2_000_000,
    how: str = "inner",
) -> DataFrame:
    """Equi-join that cuts hot ``keys`` of ``left`` into several shuffle keys.

    Keys holding more than ``rows_per_task`` left rows get
    ``ceil(rows / rows_per_task)`` salts; only the right rows of those keys are
    repeated.  ``spread`` is any per-row value used to pick the salt.  Both
    sides are dealt to a fixed number of tasks: few bytes may make many pairs,
    so adaptive execution must not gather them in a few tasks by their bytes.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )
    spread_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")))
        .drop("_salts")
    )
    copied_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    on = [*keys, "_salt"]
    return spread_left.repartition(tasks, *on).join(copied_right.repartition(tasks, *on), on, how).drop("_salt")


def draw(seed: int, *parts: Column) -> Column:
    """Reproducible 60-bit draw from a seed and identifying values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
